"""Decoding of scored candidates: order, greedy suppression, relations, classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Generation order of candidates; it breaks ties of the score.
ORDER = ("c_idx", "start", "width_idx", "label_idx")


def greedy(candidates: Column, same_label: bool) -> Column:
    """Keep, in order, each span that overlaps no kept one (of the same label, or of any).

    Spans are half-open: touching ones do not overlap.
    """

    def step(acc: Column, x: Column) -> Column:
        def clash(s: Column) -> Column:
            c = (x["end_tok"] > s["start_tok"]) & (x["start_tok"] < s["end_tok"])
            return c & (s["label"] == x["label"]) if same_label else c

        return F.when(F.exists(acc, clash), acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(candidates, F.filter(candidates, lambda x: F.lit(False)), step)


def suppress(df: DataFrame, group: Sequence[str], flat: bool | Column = False, order: Sequence[str] = ORDER, score: str = "score") -> DataFrame:
    """Greedy non-maximum suppression inside each ``group``; adds ``rank`` (0 first) in order of score.

    Candidates are cut into islands of overlapping spans first (per label unless ``flat``): islands are
    independent, so the arrays suppression runs over stay short however long a text is. ``flat`` may
    be a column, so that the mode can differ from row to row.
    """
    flat = F.lit(flat) if isinstance(flat, bool) else flat
    d = df.withColumn("_flat", flat).withColumn("_part", F.when(F.col("_flat"), F.lit("")).otherwise(F.col("label")))
    keys = [*group, "_part"]
    w = Window.partitionBy(*keys).orderBy("start_tok", "end_tok", *order)
    before = F.max("end_tok").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_new", (before.isNull() | (F.col("start_tok") >= before)).cast("int"))
    d = d.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cols = [c for c in df.columns if c not in group]
    first = [(-F.col(score)).alias("_s"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]]
    packed = d.groupBy(*keys, "_island").agg(F.array_sort(F.collect_list(F.struct(*first, *cols))).alias("_c"))
    # inside an island of one label or of flat mode, any overlap is a clash
    kept = packed.select(*group, F.explode(greedy(F.col("_c"), same_label=False)).alias("_k")).select(*group, "_k.*")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_s", *[f"_o{i}" for i in range(len(order))])) - 1
    return kept.withColumn("rank", rank).select(*df.columns, "rank")


def pair_relations(kept: DataFrame, group: Sequence[str], head: str = "head", tail: str = "tail") -> DataFrame:
    """The best head with the best tail of each group."""
    one = F.struct("text", "label", "score", "start_tok", "end_tok")
    best = kept.groupBy(*group).agg(
        F.min_by(F.when(F.col("label") == head, one), F.when(F.col("label") == head, F.col("rank"))).alias("head"),
        F.min_by(F.when(F.col("label") == tail, one), F.when(F.col("label") == tail, F.col("rank"))).alias("tail"),
    )
    return best.filter("head is not null and tail is not null")


def softmax_best(logits: DataFrame, group: Sequence[str], last_wins: bool) -> DataFrame:
    """group, label, score: the class with the highest logit; ties go to the first class, or to the last."""
    sign = 1 if last_wins else -1
    top = F.max("logit").over(Window.partitionBy(*group))
    e = logits.withColumn("_e", F.exp(F.col("logit") - top))
    best = e.groupBy(*group).agg(F.max_by(F.struct("label", "_e"), F.struct("logit", (sign * F.col("label_idx")).alias("t"))).alias("b"), F.sum("_e").alias("z"))
    return best.select(*group, F.col("b.label").alias("label"), F.round(F.col("b._e") / F.col("z"), 6).alias("score"))


def argmax_first(values: Column) -> Column:
    """Index of the first maximum of an array."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1
