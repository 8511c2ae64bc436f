"""Row-local extraction for Structured Streaming: offsets and suppression by array functions, no shuffle, no state."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.backends.lexical import LexicalBackend
from weftline.functions.words import bare, spaced_words, split_words
from weftline.operators.decode import greedy
from weftline.operators.prompt import assemble, n_subwords
from weftline.operators.spans import logit_of, sigmoid
from weftline.session import keep_until_end, shared_dir
from weftline.tasks import Task

WORD_STRUCT = "struct<w:string,cs:bigint,ce:bigint,bs:bigint,be:bigint,ts:bigint,te:bigint>"


def placed_words(text: Column, prompt_subwords: int) -> Column:
    """array of words with character, byte and subword offsets, by a running sum inside the row."""

    def step(acc: Column, m: Column) -> Column:
        w = bare(m)
        last = F.try_element_at(acc, F.lit(-1))
        ce = F.coalesce(last["ce"], F.lit(0).cast("bigint")) + F.length(m)
        be = F.coalesce(last["be"], F.lit(0).cast("bigint")) + F.octet_length(m)
        ts = F.coalesce(last["te"], F.lit(1 + prompt_subwords).cast("bigint"))
        item = F.struct(w.alias("w"), (ce - F.length(w)).alias("cs"), ce.alias("ce"), (be - F.octet_length(w)).alias("bs"), be.alias("be"), ts.alias("ts"), (ts + n_subwords(w)).alias("te"))
        return F.concat(acc, F.array(item))

    return F.aggregate(spaced_words(text), F.array().cast(f"array<{WORD_STRUCT}>"), step)


def _of_label(m: int) -> Callable[[Column], Column]:
    return lambda x: (x["label_idx"] == m) & (x["span"] != "")


def _labelled(label: str) -> Callable[[Column], Column]:
    return lambda x: x["label"] == label


def _once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with its costly columns behind a generator, which no rule of the optimizer folds into what reads them."""
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.explode_outer(F.array(F.struct(*columns))).alias("_x")).select(*others, *[F.col(f"_x.{c}").alias(c) for c in columns])


def _row_spans(df: DataFrame, id_col: str, text_col: str, tasks: Sequence[Task], which: int, threshold: float, flat_ner: bool, max_width: int, padding: str, keep: Sequence[str] = (), best_only: bool = False) -> DataFrame:
    """id, kept: the surviving spans of one task as an array inside the row of their text.

    ``best_only``: the first span of each label, which nothing of its label can suppress.
    """
    backend, labels = LexicalBackend(), list(tasks[which].labels)
    size = sum(max(1, -(-len(p) // 4)) for p in assemble(tasks)[0])
    cut, widths = logit_of(threshold), backend.width_scores(labels, max_width)
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep).filter("text is not null")
    base = base.withColumn("ws", placed_words(F.col("text"), size)).filter(F.size("ws") > 0)
    scored = F.transform("ws", lambda w: F.struct(backend.start_scores(w["w"], labels).alias("s"), backend.end_scores(w["w"], labels).alias("e")))
    base = base.withColumn("sc", scored)
    seen = F.aggregate("ws", F.lit(0), lambda acc, w: acc + backend.counted(w["w"]))
    n, step = F.size("ws"), backend.slot_step
    # no logit can pass in later slots than these
    most = max(a + b + max(row[m] for row in widths) for m, (a, b) in enumerate(zip(backend.start_bounds(labels), backend.end_bounds(labels), strict=True)))
    useful = backend.count_slots if cut == -math.inf else max(0, min(backend.count_slots, math.ceil((most - cut) / step))) if cut < math.inf else 0
    base = base.withColumn("slots", F.least(seen, F.lit(useful)))
    options = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m"), F.lit(widths[k][m]).alias("w"), F.lit(widths[0][m]).alias("w0")) for k in range(max_width) for m in range(len(labels))])
    names = F.array(*[F.lit(x) for x in labels])

    def of_start(i: Column) -> Column:
        def one(o: Column) -> Column:
            last = F.least(i + o["k"] + 1, n)
            pad = i + o["k"] >= n
            own = F.element_at("sc", i + 1)["s"][o["m"]] + F.element_at("sc", last)["e"][o["m"]] + o["w"]
            zeroth = F.element_at("sc", F.lit(1))["s"][o["m"]] + F.element_at("sc", F.lit(1))["e"][o["m"]] + o["w0"]
            return F.struct(i.alias("start"), o["k"].alias("width_idx"), o["m"].alias("label_idx"), F.when(pad, zeroth).otherwise(own).alias("logit"), last.alias("last"), pad.alias("pad"))

        return F.filter(F.transform(options, one), lambda x: (x["logit"] > F.lit(cut)) & (~x["pad"] if padding == "mask" else F.lit(True)))

    base = base.withColumn("c", F.flatten(F.transform(F.sequence(F.lit(0), n - 1), of_start)))
    slots = F.when(F.col("slots") > 0, F.sequence(F.lit(0), F.col("slots") - 1)).otherwise(F.array().cast("array<int>"))

    def placed(x: Column, c: Column) -> Column:
        a, b, logit = F.element_at("ws", x["start"] + 1), F.element_at("ws", x["last"]), x["logit"] - step * c
        score = F.round(sigmoid(logit), 6)
        return F.struct(
            (-score).alias("_s"), c.alias("c_idx"), x["start"].alias("start"), x["width_idx"].alias("width_idx"), x["label_idx"].alias("label_idx"),
            names[x["label_idx"]].alias("label"), score.alias("score"), logit.alias("logit"), a["ts"].alias("start_tok"), b["te"].alias("end_tok"), a["cs"].alias("char_start"), b["ce"].alias("char_end"),
            F.trim(F.substring(F.col("text"), (a["cs"] + 1).cast("int"), (b["ce"] - a["cs"]).cast("int"))).alias("span"),
        )

    if best_only:
        first = F.transform(F.when(F.col("slots") > 0, F.col("c")).otherwise(F.slice("c", 1, 0)), lambda x: placed(x, F.lit(0)))
        firsts = F.array(*[F.array_min(F.filter(first, _of_label(m))) for m in range(len(labels))])
        return _once(_once(base.select("id", *keep, "ws", "text", "c", "slots"), "ws", "c", "slots").select("id", *keep, firsts.alias("kept")), "kept")
    all_slots = F.flatten(F.transform(slots, lambda c: F.transform("c", lambda x: placed(x, c))))
    kept = greedy(F.array_sort(F.filter(all_slots, lambda x: (x["logit"] > F.lit(cut)) & (x["span"] != ""))), same_label=not flat_ner)
    return _once(_once(base.select("id", *keep, "ws", "text", "c", "slots"), "ws", "c", "slots").select("id", *keep, kept.alias("kept")), "kept")


def row_local_entities(df: DataFrame, id_col: str, text_col: str, task: Task, threshold: float, flat_ner: bool = False, max_width: int = 8, padding: str = "reference", keep: Sequence[str] = ()) -> DataFrame:
    """The entities of each row, one row per entity; the same results as the batch plan."""
    spans = _row_spans(df, id_col, text_col, [task], 0, threshold, flat_ner, max_width, padding, keep)
    # outer, so that no filter on the array is inferred and evaluated a second time below
    out = spans.select("id", *keep, F.posexplode_outer("kept").alias("rank", "k")).filter("k is not null").select("id", *keep, "rank", "k.*")
    return out.withColumnRenamed("span", "text").drop("_s")


def row_local_relations(df: DataFrame, id_col: str, text_col: str, task: Task, threshold: float, max_width: int = 8, padding: str = "reference") -> DataFrame:
    """id, head_text, head_score, tail_text, tail_score, relation_type, task_name: at most one relation a text."""
    spans = _row_spans(df, id_col, text_col, [task], 0, threshold, False, max_width, padding, best_only=True)
    first = {x: F.try_element_at(F.filter("kept", _labelled(x)), F.lit(1)) for x in ("head", "tail")}
    pair = F.struct(*[c.alias(n) for n, c in first.items()])
    both = _once(spans.select("id", pair.alias("p")), "p").filter("p.head is not null and p.tail is not null").select("id", "p.*")
    return both.select("id", F.col("head.span").alias("head_text"), F.col("head.score").alias("head_score"), F.col("tail.span").alias("tail_text"), F.col("tail.score").alias("tail_score"), F.lit(task.labels[0]).alias("relation_type"), F.lit(task.name).alias("task_name"))


def row_local_classes(df: DataFrame, id_col: str, text_col: str, task: Task) -> DataFrame:
    """id, label, score, task_name: the best class of each text that a count does not gate away, the last of equals."""
    backend = LexicalBackend()
    ws = split_words(F.col(text_col))
    base = df.select(F.col(id_col).alias("id"), ws.alias("ws")).filter(F.size("ws") > 0)
    zero = F.struct(F.lit(0).alias("n"), F.array(*[F.lit(0)] * len(task.labels)).alias("s"))
    total = F.aggregate("ws", zero, lambda acc, w: F.struct((acc["n"] + backend.counted(w)).alias("n"), F.zip_with(acc["s"], backend.start_scores(w, task.labels), lambda a, b: a + b).alias("s")))
    base = _once(base.select("id", F.size("ws").alias("words"), total.alias("t")), "words", "t").filter("t.n > 0")
    base = _once(base.select("id", F.transform("t.s", lambda v: v / F.col("words")).alias("l")).withColumn("top", F.array_max("l")), "l", "top")
    last = F.size("l") - F.array_position(F.reverse("l"), F.col("top")).cast("int")
    z = F.aggregate("l", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    return base.select("id", F.array(*[F.lit(x) for x in task.labels])[last].alias("label"), F.round(1.0 / z, 6).alias("score"), F.lit(task.name).alias("task_name"))


def entity_counts(entities: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Entities by label and window of event time as a stream: rows later than the watermark ``late`` are dropped, windows leave when it has passed them."""
    per = entities.withWatermark(time, late).groupBy(F.window(time, window), "label").agg(F.count("*").alias("n"))
    return per.select(F.col("window.start").alias("window_start"), "label", "n")


def run_stream(spark: SparkSession, source: str, plan: Callable[[DataFrame], DataFrame], complete: bool = False) -> DataFrame:
    """Run ``plan`` as a stream over the files of a Parquet table until all of them are read; the written results.

    Rows are appended as they are final. With ``complete`` an aggregate is written anew with each batch,
    so that windows the watermark has not yet closed are there as well.
    """
    schema = spark.read.parquet(source).schema
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    keep_until_end(spark, path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source if _is_dir(spark, source) else source + "*")
    rows = plan(stream)
    writer = rows.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if complete:
        writer = writer.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out"))
    else:
        writer = writer.outputMode("append").format("parquet").option("path", f"{path}/out")
    writer.start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def stream_entities(spark: SparkSession, sf: str, table: str, id_col: str, task: Task, threshold: float) -> DataFrame:
    return run_stream(spark, f"{sf}/{table}.parquet", lambda d: row_local_entities(d, id_col, "text", task, threshold))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
