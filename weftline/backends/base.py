"""What a scoring backend provides.

A separable backend gives, per label, scores of a span's first word, its last word and its width; the
engine then scores and prunes spans in Catalyst expressions. A span backend (exported graphs) scores
whole texts itself and hands over candidates and class logits as tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame

from weftline.tasks import Task


@runtime_checkable
class Backend(Protocol):
    #: The most slots (instances of a task in one text) that are ever decoded.
    count_slots: int
    #: By how much each further slot lowers all logits.
    slot_step: int

    def start_scores(self, word: Column, labels: Sequence[str]) -> Column:
        """array<int>: what a word as first word of a span adds to the logit of each label."""

    def end_scores(self, word: Column, labels: Sequence[str]) -> Column:
        """array<int>: the same for the last word."""

    def width_scores(self, labels: Sequence[str], max_width: int) -> list[list[int]]:
        """What a width (its index) adds to the logit of each label."""

    def end_bounds(self, labels: Sequence[str]) -> list[float]:
        """The most that any last word adds, by which first words are dropped early; infinity where it is not known."""

    def counted(self, word: Column) -> Column:
        """int: what a word adds to the predicted count of its text."""


@runtime_checkable
class LinearBackend(Backend, Protocol):
    """A backend whose start_scores and end_scores are sums of weighted features, of which there are few."""

    def features(self, word: Column) -> Column:
        """array<int>: the features of a word."""

    def feature_weights(self, labels: Sequence[str], last: bool) -> list[tuple[int, ...]]:
        """By label what the features of a first, or of a last, word weigh."""


@runtime_checkable
class SpanBackend(Protocol):
    def span_scores(self, words: DataFrame, tasks: Sequence[Task], threshold: float | Column, max_width: int, padding: str, semantics: str) -> DataFrame:
        """Candidates above the threshold with the columns of ``operators.spans.candidates``."""

    def class_logits(self, words: DataFrame, tasks: Sequence[Task], semantics: str) -> DataFrame:
        """id, task_idx, label_idx, label, logit of the classification tasks that are not gated away."""
