"""Span enumeration: every start, widths 1 to max_width, scored and filtered in one pass over the words."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.backends.base import Backend


def enumerate_spans(words: DataFrame, max_width: int = 8, padding: str = "reference") -> DataFrame:
    """id, start, width_idx, end (exclusive), is_padding; ``padding="mask"`` leaves out windows past the last word."""
    n = F.count("*").over(Window.partitionBy("id"))
    rows = words.select("id", F.col("pos").alias("start"), n.alias("n"))
    rows = rows.withColumn("width_idx", F.explode(F.sequence(F.lit(0), F.lit(max_width - 1))))
    pad = F.col("start") + F.col("width_idx") >= F.col("n")
    out = rows.select("id", "start", "width_idx", F.least(F.col("start") + F.col("width_idx") + 1, F.col("n")).cast("int").alias("end"), pad.alias("is_padding"))
    return out if padding == "reference" else out.filter(~F.col("is_padding"))


def logit_of(threshold: float | Column) -> float | Column:
    """The logit above which sigmoid exceeds ``threshold``."""
    if isinstance(threshold, Column):
        t = threshold.cast("double")
        return F.when(t <= 0, F.lit(-math.inf)).when(t >= 1, F.lit(math.inf)).otherwise(F.log(t / (1 - t)))
    if threshold <= 0:
        return -math.inf
    return math.inf if threshold >= 1 else math.log(threshold / (1 - threshold))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def candidates(
    words: DataFrame, labels: Sequence[str] | Sequence[tuple[int, Sequence[str]]], backend: Backend, threshold: float | Column, max_width: int = 8,
    padding: str = "reference", keep: Sequence[str] = (),
) -> DataFrame:
    """Spans above the threshold: id, c_idx, start, width_idx, end, task_idx, label_idx, label, logit, score, offsets, text, is_padding, ``keep``.

    ``words`` comes from ``word_table`` with subword positions. ``labels`` are those of one task or
    (task_idx, labels) of several, which are scored together. The attributes of the next words come by
    lead over the placement the words already have, so there is no join. Per word and label a bound on
    what the last word can add decides whether widths are tried at all; widths are rows of plain
    columns inside whole-stage code. A window past the end is scored as the span of word 0, as the
    reference does, unless ``padding="mask"``. Each further slot lowers all logits, so only slots that
    can still pass are expanded.
    """
    groups = [(0, list(labels))] if labels and isinstance(labels[0], str) else [(t, list(ls)) for t, ls in labels]
    table = [(t, m, x) for t, ls in groups for m, x in enumerate(ls)]
    names = [x for _, _, x in table]
    cut = logit_of(threshold)
    cut = cut if isinstance(cut, Column) else F.lit(float(cut))
    here = Window.partitionBy("id").orderBy("pos")
    whole = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = F.struct("e", "char_end", "byte_end", "end_tok", "spaced")
    scored = words.withColumns({"s": backend.start_scores(F.col("word"), names), "e": backend.end_scores(F.col("word"), names), "_u": backend.counted(F.col("word")), "_cut": cut})
    rows = scored.withColumns({
        **{f"l{k}": F.lead(carried, k).over(here) for k in range(1, max_width)}, "l0": carried,
        "zs": F.first("s").over(here.rowsBetween(Window.unboundedPreceding, 0)), "ze": F.first("e").over(here.rowsBetween(Window.unboundedPreceding, 0)),
        "slots": F.least(F.sum("_u").over(whole), F.lit(backend.count_slots)).cast("int"), "left": (F.count("*").over(whole) - F.col("pos")).cast("int"),
    })
    w = backend.width_scores(names, max_width)
    most = [e + max(w[k][g] for k in range(max_width)) for g, e in enumerate(backend.end_bounds(names))]
    near_end = (F.col("left") < max_width) & F.lit(padding == "reference")
    hope = [(F.col("s")[g] + float(most[g]) > F.col("_cut")) | (near_end & (F.col("zs")[g] + F.col("ze")[g] + w[0][g] > F.col("_cut"))) for g in range(len(table))]
    ahead = [F.coalesce(F.col(f"l{k}.spaced"), F.lit("")) for k in range(1, max_width)]
    starts = rows.filter((F.col("slots") > 0) & reduce(lambda a, b: a | b, hope)).select(
        "id", "pos", "left", "slots", "s", "zs", "ze", "_cut", "char_start", "byte_start", "start_tok", F.concat("word", *ahead).alias("run"),
        F.coalesce(*[F.col(f"l{k}") for k in range(max_width - 1, -1, -1)]).alias("last"), F.array(*[F.col(f"l{k}") for k in range(max_width)]).alias("ls"),
        F.explode(F.array(*[F.when(h, F.lit(g)) for g, h in enumerate(hope)])).alias("g"), *keep,
    ).filter("g is not null")
    wide = starts.select("*", F.posexplode("ls").alias("width_idx", "l")).drop("ls")
    pad = F.col("l").isNull()
    g, k = F.col("g"), F.col("width_idx")
    flat = F.array(*[F.lit(x) for row in w for x in row])
    own = F.col("s")[g] + F.col("l.e")[g] + flat[k * len(table) + g]
    zeroth = F.col("zs")[g] + F.col("ze")[g] + F.array(*[F.lit(x) for x in w[0]])[g]
    good = wide.withColumn("logit", F.when(pad, zeroth).otherwise(own)).filter((F.col("logit") > F.col("_cut")) & (~pad if padding == "mask" else F.lit(True)))
    step = backend.slot_step
    top = F.when(F.col("_cut") == -math.inf, F.col("slots")).otherwise(F.least(F.col("slots"), F.ceil((F.col("logit") - F.col("_cut")) / step).cast("int"))) if step else F.col("slots")
    slotted = good.withColumn("c_idx", F.explode(F.sequence(F.lit(0), top - 1)))
    end = F.coalesce("l", "last")
    out = slotted.select(
        "id", "c_idx", F.col("pos").alias("start"), "width_idx", (F.col("pos") + F.least(k + 1, F.col("left"))).cast("int").alias("end"),
        F.array(*[F.lit(t) for t, _, _ in table])[g].alias("task_idx"), F.array(*[F.lit(m) for _, m, _ in table])[g].alias("label_idx"), F.array(*[F.lit(x) for x in names])[g].alias("label"),
        (F.col("logit") - step * F.col("c_idx")).cast("int").alias("logit"), "char_start", end["char_end"].alias("char_end"), "byte_start", end["byte_end"].alias("byte_end"),
        "start_tok", end["end_tok"].alias("end_tok"), F.substring(F.col("run"), F.lit(1), (end["char_end"] - F.col("char_start")).cast("int")).alias("text"), pad.alias("is_padding"), "_cut", *keep,
    )
    return out.filter(F.col("logit") > F.col("_cut")).drop("_cut").withColumn("score", F.round(sigmoid(F.col("logit")), 6))
