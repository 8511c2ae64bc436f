"""The extraction engine: texts and tasks in, three DataFrames out, all of it lazy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.backends.base import Backend, SpanBackend
from weftline.backends.lexical import LexicalBackend
from weftline.functions.words import exploded, word_table
from weftline.operators import decode, onepass, prompt, spans
from weftline.tasks import Task


@dataclass(frozen=True)
class Extraction:
    """``results`` holds everything in one table and one pass: id, task_idx, kind, label, text, score."""

    entities: DataFrame | None
    relations: DataFrame | None
    classifications: DataFrame | None
    results: DataFrame | None = None


@dataclass
class ExtractionEngine:
    """``semantics="v2"`` gates classification behind a predicted count and pairs one relation per task;
    ``"v1"`` always classifies, pairs per count slot and drops spans without subwords.
    ``padding="reference"`` keeps windows past the end (they alias word 0), ``"mask"`` drops them."""

    backend: Backend | SpanBackend = field(default_factory=LexicalBackend)
    max_width: int = 8
    semantics: str = "v2"
    padding: str = "reference"

    def __post_init__(self) -> None:
        if self.semantics not in ("v1", "v2") or self.padding not in ("reference", "mask") or self.max_width < 1:
            raise ValueError("semantics is v1 or v2, padding reference or mask, max_width at least 1")

    def words(self, df: DataFrame, tasks: Sequence[Task], id_col: str, text_col: str, keep: dict[str, Column] | None = None) -> DataFrame:
        """Words with offsets and subword positions after the prompt of ``tasks``."""
        pieces, _, _ = prompt.assemble(tasks)
        size = sum(max(1, -(-len(p) // 4)) for p in pieces)
        return prompt.subword_positions(word_table(df, id_col, text_col, keep), size)

    def extract(
        self, df: DataFrame, tasks: Sequence[Task], id_col: str = "id", text_col: str = "text", threshold: float | Column = 0.5, flat_ner: bool | Column = False
    ) -> Extraction:
        """All tasks of all texts. ``threshold`` and ``flat_ner`` may be columns of ``df`` and differ from text to text.

        The spans of all tasks are scored, pruned and suppressed in one pass over the words; the classes
        of all tasks are another branch of the same exchange.
        """
        keep = {n: c for n, c in (("_threshold", threshold), ("_flat", flat_ner)) if isinstance(c, Column)}
        words = self.words(df, tasks, id_col, text_col, keep)
        at = {k: [i for i, t in enumerate(tasks) if t.kind == k] for k in ("entities", "relations", "classifications")}
        limit, mode = F.col("_threshold") if "_threshold" in keep else threshold, F.col("_flat") if "_flat" in keep else flat_ner
        entities = relations = classes = results = None
        if at["entities"] or at["relations"]:
            kept = self._spans(words, tasks, limit, mode, list(keep))
            group = ["id", "task_idx", "_slot"]
            if at["entities"]:
                entities = kept.filter(F.col("task_idx").isin(at["entities"])).drop("_slot")
            if at["relations"]:
                relations = self._relations(kept, tasks, at["relations"], group)
            results = self._in_one_pass(kept, tasks, at["relations"], group)
        if at["classifications"]:
            classes = self._classify(words, tasks)
            rows = classes.select("id", "task_idx", F.lit("class").alias("kind"), "label", F.lit(None).cast("string").alias("text"), "score")
            results = rows if results is None else results.unionByName(rows)
        if tasks and not isinstance(self.backend, SpanBackend):
            plain = exploded(df, id_col, text_col, keep)
            results = onepass.results(plain, tasks, self.backend, limit, mode, self.max_width, self.padding, self.semantics)
        return Extraction(entities, relations, classes, results)

    def _spans(self, words: DataFrame, tasks: Sequence[Task], threshold: float | Column, flat: bool | Column, keep: list[str]) -> DataFrame:
        """The spans of all entity and relation tasks that survive suppression."""
        wanted = [(i, t.labels) for i, t in enumerate(tasks) if t.kind != "classifications"]
        if isinstance(self.backend, SpanBackend):
            found = self.backend.span_scores(words, tasks, threshold, self.max_width, self.padding, self.semantics)
        else:
            found = spans.candidates(words, wanted, self.backend, threshold, self.max_width, self.padding, [k for k in keep if k == "_flat"])
        found = found.withColumn("text", F.trim("text")).filter("text <> ''" + (" and start_tok < end_tok" if self.semantics == "v1" else ""))
        paired = [i for i, t in enumerate(tasks) if t.kind == "relations"] if self.semantics == "v1" else []
        found = found.withColumn("_slot", F.when(F.col("task_idx").isin(paired), F.col("c_idx")).otherwise(0) if paired else F.lit(0))
        return decode.suppress(found, ["id", "task_idx", "_slot"], flat).drop("_flat")

    def _relations(self, kept: DataFrame, tasks: Sequence[Task], which: list[int], group: list[str]) -> DataFrame:
        pairs = decode.pair_relations(kept.filter(F.col("task_idx").isin(which)), group)
        return _named(pairs, tasks, which, {"relation_type": lambda t: t.labels[0], "task_name": lambda t: t.name}).withColumnRenamed("_slot", "c_idx")

    def _in_one_pass(self, kept: DataFrame, tasks: Sequence[Task], relations: list[int], group: list[str]) -> DataFrame:
        """Entities and relations as rows of one table: the pairs of a group are found by windows over the placement that is there."""
        is_relation = F.col("task_idx").isin(relations) if relations else F.lit(False)
        w = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        best = {f"_{x}": F.first(F.when(is_relation & (F.col("label") == x), F.struct("text", "score", "rank")), ignorenulls=True).over(w) for x in ("head", "tail")}
        rows = kept.withColumns(best).filter(~is_relation | ((F.col("_head.rank") == F.col("rank")) & F.col("_tail").isNotNull()))
        rows = _named(rows, tasks, relations, {"_type": lambda t: t.labels[0]})
        return rows.select(
            "id", "task_idx", F.when(is_relation, F.lit("relation")).otherwise(F.lit("entity")).alias("kind"), F.when(is_relation, F.col("_type")).otherwise(F.col("label")).alias("label"),
            F.when(is_relation, F.concat_ws(" -> ", "_head.text", "_tail.text")).otherwise(F.col("text")).alias("text"), "score",
        )

    def _classify(self, words: DataFrame, tasks: Sequence[Task]) -> DataFrame:
        """The best class of every classification task: their scores are summed together."""
        which = [i for i, t in enumerate(tasks) if t.kind == "classifications"]
        if isinstance(self.backend, SpanBackend):
            logits = self.backend.class_logits(words, tasks, self.semantics)
        else:
            table = [(i, m, x) for i in which for m, x in enumerate(tasks[i].labels)]
            scores = self.backend.start_scores(F.col("word"), [x for _, _, x in table])
            per = words.select("id", self.backend.counted(F.col("word")).alias("u"), scores.alias("s")).groupBy("id").agg(
                F.count("*").alias("n"), F.sum("u").alias("count"), *[F.sum(F.col("s")[g]).alias(f"l{g}") for g in range(len(table))]
            )
            if self.semantics == "v2":
                per = per.filter(F.col("count") > 0)
            each = F.array(*[F.struct(F.lit(i).alias("task_idx"), F.lit(m).alias("label_idx"), F.lit(x).alias("label"), (F.col(f"l{g}") / F.col("n")).alias("logit")) for g, (i, m, x) in enumerate(table)])
            logits = per.select("id", F.explode(each).alias("x")).select("id", "x.*")
        best = decode.softmax_best(logits, ["id", "task_idx"], last_wins=self.semantics == "v2")
        return _named(best, tasks, which, {"task_name": lambda t: t.name})


def _named(df: DataFrame, tasks: Sequence[Task], which: Sequence[int], columns: dict) -> DataFrame:
    """``df`` with what the task of each row says."""
    if not which:
        return df.withColumns({n: F.lit(None).cast("string") for n in columns})
    table = F.create_map(*[x for i in which for x in (F.lit(i), F.struct(*[F.lit(f(tasks[i])).alias(n) for n, f in columns.items()]))])
    return df.withColumn("_t", table[F.col("task_idx")]).withColumns({n: F.col(f"_t.{n}") for n in columns}).drop("_t")
