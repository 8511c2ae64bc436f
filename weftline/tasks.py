"""Extraction tasks: what to look for, validated once on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TASK_SCHEMA = "task_idx int, task_type string, task_name string, labels array<string>"
KINDS = ("entities", "relations", "classifications")


@dataclass(frozen=True)
class Task:
    kind: str
    name: str
    labels: tuple[str, ...]

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of task: {self.kind}")
        if not self.labels:
            raise ValueError(f"task {self.name} has no labels")


def entities(*labels: str) -> Task:
    return Task("entities", "entities", tuple(labels))


def relations(name: str, *fields: str) -> Task:
    return Task("relations", name, tuple(fields))


def classifications(name: str, *classes: str) -> Task:
    return Task("classifications", name, tuple(classes))


def from_table(tasks: DataFrame) -> list[Task]:
    """Tasks of a task table, in order; the table is a task list and therefore small."""
    return [Task(r["task_type"], r["task_name"], tuple(r["labels"])) for r in tasks.orderBy("task_idx").collect()]


def to_table(spark: SparkSession, tasks: Sequence[Task]) -> DataFrame:
    return spark.createDataFrame([(i, t.kind, t.name, list(t.labels)) for i, t in enumerate(tasks)], TASK_SCHEMA)
