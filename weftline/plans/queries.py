"""Registered queries of the extraction engine and of its composition with relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.words import split_words as split
from weftline.functions.words import word_table
from weftline.operators import decode, joins, prompt, spans
from weftline.plans import sql
from weftline.plans.engine import ExtractionEngine
from weftline.streaming.extract import entity_counts, row_local_classes, row_local_entities, row_local_relations, run_stream, stream_entities
from weftline.tasks import classifications, entities as entity_task, from_table, relations

NER = ("person", "organization", "location", "date", "event")
TASK = entity_task(*NER)
RELATION = relations("works_with", "head", "tail")
TOPIC = classifications("topic", "finance", "legal", "news", "health", "logistics", "energy", "culture")
THRESHOLD = 0.9
_BACKEND = ExtractionEngine().backend
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(oracle: str | None = None):
    """Register a query under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")  # each step once
        return f

    return add


def _prompt_size(*tasks) -> int:
    return sum(max(1, -(-len(p) // 4)) for p in prompt.assemble(tasks)[0])


_SENT = "WITH " + sql.words("test_sentences", "sent_id")
_DOCS = "WITH " + sql.words("documents", "doc_id")


# -- words ------------------------------------------------------------------------------------------
@query(_SENT + " SELECT id, pos, word FROM w")
def split_words(spark: SparkSession, sf: str) -> DataFrame:
    t = _t(spark, sf, "test_sentences").filter("text is not null")
    return t.select(F.col("sent_id").alias("id"), F.posexplode(split(F.col("text"))).alias("pos", "word"))  # no exchange


@query(_DOCS + " SELECT id, pos, char_start, char_end, byte_start, byte_end FROM w")
def split_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return word_table(_t(spark, sf, "documents"), "doc_id", "text").drop("word", "spaced")


@query(
    f"SELECT doc_id AS id, CAST(len(regexp_extract_all(text, '(?i){sql.re2_word()}')) AS INT) AS n_words FROM documents WHERE text IS NOT NULL"
)
def word_count(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), F.size(split(F.col("text"))).alias("n_words"))


# -- prompt -----------------------------------------------------------------------------------------
_BLOCKS = """
b AS (SELECT task_idx, max(task_idx) OVER () AS last, list_concat(list_concat(['(', '[P]', CASE WHEN task_type = 'entities' THEN 'entities' ELSE task_name END, '('],
  flatten(list_transform(labels, lambda x: [CASE task_type WHEN 'entities' THEN '[E]' WHEN 'relations' THEN '[R]' ELSE '[L]' END, x]))), [')', ')']) AS p FROM extraction_task),
x AS (SELECT task_idx, list_append(p, CASE WHEN task_idx < last THEN '[SEP_STRUCT]' ELSE '[SEP_TEXT]' END) AS p FROM b),
y AS (SELECT task_idx, unnest(p) AS piece, unnest(range(len(p))) AS k FROM x)"""


@query(f"WITH {_BLOCKS} SELECT CAST(row_number() OVER (ORDER BY task_idx, k) - 1 AS INT) AS piece_idx, piece, task_idx FROM y")
def prompt_multitask(spark: SparkSession, sf: str) -> DataFrame:
    return prompt.prompt_pieces(_t(spark, sf, "extraction_task"))


@query(f"""WITH {_BLOCKS}, n AS (SELECT *, row_number() OVER (ORDER BY task_idx, k) - 1 AS i FROM y),
h AS (SELECT task_idx, i AS prompt_idx FROM n WHERE piece = '[P]'),
m AS (SELECT task_idx, piece AS label, i, lag(piece) OVER (ORDER BY i) AS before FROM n)
SELECT m.task_idx, CAST(h.prompt_idx AS INT) AS prompt_idx, CAST(row_number() OVER (PARTITION BY m.task_idx ORDER BY i) - 1 AS INT) AS label_idx, label, CAST(i AS INT) AS field_idx
FROM m JOIN h ON m.task_idx = h.task_idx WHERE before IN ('[E]', '[R]', '[L]')""")
def field_indices(spark: SparkSession, sf: str) -> DataFrame:
    return prompt.field_positions(_t(spark, sf, "extraction_task"))


@query(f"{_SENT}, {sql.subwords(_prompt_size(TASK))} SELECT id, pos, start_tok, end_tok FROM wt")
def subword_map(spark: SparkSession, sf: str) -> DataFrame:
    return ExtractionEngine().words(_t(spark, sf, "test_sentences"), [TASK], "sent_id", "text").select("id", "pos", "start_tok", "end_tok")


@query(f"""{_SENT}, {sql.subwords(_prompt_size(TASK))}
SELECT id, min(start_tok) AS text_start, max(end_tok) AS text_end, CAST(max(end_tok) + 1 AS BIGINT) AS sequence_length, count(*) AS n_words FROM wt GROUP BY id""")
def sequence_bounds(spark: SparkSession, sf: str) -> DataFrame:
    w = ExtractionEngine().words(_t(spark, sf, "test_sentences"), [TASK], "sent_id", "text")
    return w.groupBy("id").agg(F.min("start_tok").alias("text_start"), F.max("end_tok").alias("text_end"), (F.max("end_tok") + 1).alias("sequence_length"), F.count("*").alias("n_words"))


@query(f"""WITH {_BLOCKS}, n AS (SELECT *, row_number() OVER (ORDER BY task_idx, k) - 1 AS i FROM y),
s AS (SELECT *, 1 + coalesce(sum(greatest(CAST(ceil(length(piece) / 4.0) AS BIGINT), 1)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tok FROM n),
h AS (SELECT task_idx, tok AS prompt_tok FROM s WHERE piece = '[P]'),
m AS (SELECT task_idx, piece AS label, i, tok, lag(piece) OVER (ORDER BY i) AS before FROM s)
SELECT m.task_idx, CAST(h.prompt_tok AS BIGINT) AS prompt_tok, CAST(row_number() OVER (PARTITION BY m.task_idx ORDER BY i) - 1 AS INT) AS label_idx, label, CAST(tok AS BIGINT) AS field_tok
FROM m JOIN h ON m.task_idx = h.task_idx WHERE before IN ('[E]', '[R]', '[L]')""")
def field_subwords(spark: SparkSession, sf: str) -> DataFrame:
    """Where the prompt and the labels of each task stand among the subwords."""
    return prompt.field_subwords(_t(spark, sf, "extraction_task"))


@query(f"""{_SENT}, {sql.subwords(_prompt_size(TASK))},
b AS (SELECT id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS ws, min(start_tok) AS s, max(end_tok) AS e FROM wt GROUP BY id)
SELECT t.sent_id AS id, '{" ".join(prompt.assemble([TASK])[0])}' || coalesce(' ' || ws, '') AS pieces, CAST(coalesce(n, 0) AS INT) AS n_words,
CAST(coalesce(e + 1, {_prompt_size(TASK) + 2}) AS BIGINT) AS mask, CAST(coalesce(s, 0) AS BIGINT) AS text_start, CAST(coalesce(e, 0) AS BIGINT) AS text_end
FROM test_sentences t LEFT JOIN b ON b.id = t.sent_id WHERE t.text IS NOT NULL""")
def sequence_records(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt and words of every text as one sequence, with its mask, maps and bounds."""
    t = _t(spark, sf, "test_sentences").filter("text is not null").select(F.col("sent_id").alias("id"), "text")
    s = prompt.sequences(t, ExtractionEngine().words(t, [TASK], "id", "text"), [TASK])
    mask = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return s.select("id", F.array_join("pieces", " ").alias("pieces"), F.size("word_to_token").alias("n_words"), mask.alias("mask"), "text_start", "text_end")


# -- spans and scores -------------------------------------------------------------------------------
def _span_sql(where: str) -> str:
    return f"""{_SENT}, n AS (SELECT id, pos, count(*) OVER (PARTITION BY id) AS n FROM w)
SELECT id, pos AS start, CAST(k AS INT) AS width_idx, CAST(least(pos + k + 1, n) AS INT) AS "end", pos + k >= n AS is_padding
FROM n, (SELECT unnest(range(8)) AS k) {where}"""


@query(_span_sql(""))
def span_enumerate(spark: SparkSession, sf: str) -> DataFrame:
    return spans.enumerate_spans(word_table(_t(spark, sf, "test_sentences"), "sent_id", "text"))


@query(_span_sql("WHERE pos + k < n"))
def span_enumerate_masked(spark: SparkSession, sf: str) -> DataFrame:
    return spans.enumerate_spans(word_table(_t(spark, sf, "test_sentences"), "sent_id", "text"), padding="mask")


_CAND = f"{_SENT}, {sql.subwords(_prompt_size(TASK))}, {sql.candidates(NER, THRESHOLD)}"


@query(_CAND + ' SELECT id, c_idx, start, width_idx, "end", label, score, is_padding FROM c')
def threshold_candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = ExtractionEngine()
    c = spans.candidates(e.words(_t(spark, sf, "test_sentences"), [TASK], "sent_id", "text"), NER, e.backend, THRESHOLD)
    return c.select("id", "c_idx", "start", "width_idx", "end", "label", "score", "is_padding")


_VEC = """WITH q AS (SELECT vec_id AS q_id, embedding AS b FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT vec_id, q_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(b[i] AS DOUBLE))) AS x FROM embeddings, q)"""


@query(_VEC + " SELECT vec_id, q_id, round(x, 6) AS dot, round(1 / (1 + exp(-x)), 6) AS score FROM d")
def dot_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Stored vectors against the query vectors (every id divisible by 20): dot product and sigmoid."""
    from weftline.backends.vectors import dot_scores as scores

    e = _t(spark, sf, "embeddings")
    return scores(e.select("vec_id", "embedding"), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("b")))


@query(_VEC + " SELECT vec_id, arg_min(q_id, struct_pack(a := -round(x, 6), b := q_id)) AS q_id, round(max(x), 6) AS dot FROM d GROUP BY vec_id")
def vector_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """The query vector with the highest dot product, the first of equals."""
    d = QUERIES["dot_scores"](spark, sf)
    return d.groupBy("vec_id").agg(F.min_by("q_id", F.struct(-F.col("dot"), "q_id")).alias("q_id"), F.max("dot").alias("dot"))


@query(f"""{_SENT}, u AS (SELECT id, least(sum(CAST(regexp_matches(word, '^\\p{{Lu}}') AS INT)), 20) AS n FROM w GROUP BY id)
SELECT id, CAST(n AS INT) AS pred_count FROM u""")
def count_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """The predicted count: first maximum of count logits -|c - seen|."""
    w = word_table(_t(spark, sf, "test_sentences"), "sent_id", "text")
    backend = ExtractionEngine().backend
    seen = F.least(F.sum(backend.counted(F.col("word"))), F.lit(backend.count_slots))
    logits = F.array(*[-F.abs(F.col("seen") - c) for c in range(backend.count_slots + 1)])
    return w.groupBy("id").agg(seen.alias("seen")).select("id", decode.argmax_first(logits).alias("pred_count"))


# -- decoding ---------------------------------------------------------------------------------------
_FIELDS = ("label", "score", "start", "width_idx", "c_idx", "start_tok", "end_tok", "char_start", "char_end", "byte_start", "byte_end")
_OUT = "id, u.label AS label, u.score AS score, rank, u.start_tok AS start_tok, u.end_tok AS end_tok, u.char_start AS char_start, u.char_end AS char_end"
_COLS = ["id", "label", "score", "rank", "start_tok", "end_tok", "char_start", "char_end", "text"]


def _entities_sql(flat: bool = False, threshold: float = THRESHOLD, masked: bool = False, table: str = "test_sentences", key: str = "sent_id") -> str:
    return f"""WITH {sql.words(table, key)}, {sql.subwords(_prompt_size(TASK))}, {sql.candidates(NER, threshold, masked=masked)},
{sql.nms("c", ["id"], str(flat).lower(), decode.ORDER, _FIELDS)}
SELECT {_OUT}, trim(substr(t.text, CAST(u.char_start AS INT) + 1, CAST(u.char_end - u.char_start AS INT))) AS text FROM k JOIN {table} t ON t.{key} = k.id"""


def _entities(spark: SparkSession, sf: str, table: str = "test_sentences", key: str = "sent_id", threshold: float = THRESHOLD, flat: bool = False, **engine) -> DataFrame:
    return ExtractionEngine(**engine).extract(_t(spark, sf, table), [TASK], key, "text", threshold, flat).entities.select(*_COLS)


@query(_entities_sql())
def entities(spark: SparkSession, sf: str) -> DataFrame:
    return _entities(spark, sf)


@query(_entities_sql(flat=True))
def entities_flat(spark: SparkSession, sf: str) -> DataFrame:
    return _entities(spark, sf, flat=True)


@query(_entities_sql(masked=True))
def entities_masked(spark: SparkSession, sf: str) -> DataFrame:
    return _entities(spark, sf, padding="mask")


@query(_entities_sql(table="documents", key="doc_id", threshold=0.99))
def extract_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _entities(spark, sf, "documents", "doc_id", threshold=0.99)


@query(_entities_sql(threshold=0.99))
def stream_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The row-local plan in Structured Streaming over all texts."""
    return stream_entities(spark, sf, "test_sentences", "sent_id", TASK, 0.99).select(*_COLS)


@query("""SELECT time_bucket(INTERVAL 1 DAY, ingested_at) AS window_start, label, count(*) AS n
FROM (WITH e AS (""" + _entities_sql(threshold=0.99) + """) SELECT e.label, s.ingested_at FROM e JOIN test_sentences s ON s.sent_id = e.id) GROUP BY 1, 2""")
def stream_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Entities by label and day of arrival, counted as a stream."""

    def plan(d: DataFrame) -> DataFrame:
        return entity_counts(row_local_entities(d, "sent_id", "text", TASK, 0.99, keep=["ingested_at"]), "ingested_at", "1 day", "1 hour")

    return run_stream(spark, f"{sf}/test_sentences.parquet", plan, complete=True)


def _relations_sql(group: list[str], threshold: float) -> str:
    g = ", ".join(group)
    c = "c_idx" if "c_idx" in group else "0 AS c_idx"
    pick = "struct_pack(text := text, label := label, score := score, start_tok := start_tok, end_tok := end_tok)"
    fields = [f for f in _FIELDS if f not in group]
    return f"""{_SENT}, {sql.subwords(_prompt_size(RELATION))}, {sql.candidates(RELATION.labels, threshold)},
{sql.nms("c", group, "false", decode.ORDER, fields)},
n AS (SELECT k.{', k.'.join(group)}, rank, u.label AS label, u.score AS score, u.start_tok AS start_tok, u.end_tok AS end_tok,
  trim(substr(t.text, CAST(u.char_start AS INT) + 1, CAST(u.char_end - u.char_start AS INT))) AS text FROM k JOIN test_sentences t ON t.sent_id = k.id),
p AS (SELECT {g}, arg_min({pick}, rank) FILTER (label = 'head') AS head, arg_min({pick}, rank) FILTER (label = 'tail') AS tail FROM n GROUP BY {g})
SELECT id, {c}, head.text AS head_text, head.score AS head_score, tail.text AS tail_text, tail.score AS tail_score, 'head' AS relation_type, 'works_with' AS task_name
FROM p WHERE head IS NOT NULL AND tail IS NOT NULL"""


def _relations(spark: SparkSession, sf: str, semantics: str) -> DataFrame:
    r = ExtractionEngine(semantics=semantics).extract(_t(spark, sf, "test_sentences"), [RELATION], "sent_id", "text", 0.8).relations
    return r.select(
        "id", "c_idx", F.col("head.text").alias("head_text"), F.col("head.score").alias("head_score"), F.col("tail.text").alias("tail_text"),
        F.col("tail.score").alias("tail_score"), "relation_type", "task_name",
    )


@query(_relations_sql(["id", "c_idx"], 0.8))
def relations_v1(spark: SparkSession, sf: str) -> DataFrame:
    return _relations(spark, sf, "v1")


@query(_relations_sql(["id"], 0.8))
def relations_v2(spark: SparkSession, sf: str) -> DataFrame:
    return _relations(spark, sf, "v2")


def _class_ctes(task, last_wins: bool, p: str) -> str:
    """CTE ``p``o: id, label, score of a classification task over w."""
    s = _BACKEND.sql_scores("word", task.labels, 0)
    names = "[" + ", ".join(f"'{x}'" for x in task.labels) + "]"
    sums = "[" + ", ".join(f"CAST(sum(s[{m + 1}]) AS DOUBLE) / count(*)" for m in range(len(task.labels))) + "]"
    gate = "HAVING sum(CAST(regexp_matches(word, '^\\p{Lu}') AS INT)) > 0" if last_wins else ""
    tie = "DESC" if last_wins else "ASC"
    return f"""{p}f AS (SELECT id, word, {s} AS s FROM w), {p}l AS (SELECT id, {sums} AS l FROM {p}f GROUP BY id {gate}),
{p}x AS (SELECT id, unnest(l) AS logit, unnest(range(len(l))) AS m, list_max(l) AS top FROM {p}l),
{p}z AS (SELECT id, sum(exp(logit - top)) AS z FROM {p}x GROUP BY id),
{p}b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY logit DESC, m {tie}) AS r FROM {p}x),
{p}o AS (SELECT b.id, {names}[m + 1] AS label, round(exp(logit - top) / z, 6) AS score FROM {p}b b JOIN {p}z z ON b.id = z.id WHERE r = 1)"""


def _classify_sql(last_wins: bool) -> str:
    return f"{_SENT}, {_class_ctes(TOPIC, last_wins, 'y_')} SELECT id, label, score, 'topic' AS task_name FROM y_o"


def _classify(spark: SparkSession, sf: str, semantics: str) -> DataFrame:
    c = ExtractionEngine(semantics=semantics).extract(_t(spark, sf, "test_sentences"), [TOPIC], "sent_id", "text").classifications
    return c.select("id", "label", "score", "task_name")


@query(_classify_sql(False))
def classify_softmax(spark: SparkSession, sf: str) -> DataFrame:
    return _classify(spark, sf, "v1")


@query(_classify_sql(True))
def classify_v2_gated(spark: SparkSession, sf: str) -> DataFrame:
    return _classify(spark, sf, "v2")


MULTI = (entity_task("person", "organization", "location", "date", "phone number", "email", "tax id"), RELATION, TOPIC, entity_task("product", "event", "organization"))


def _multitask_sql(tasks, threshold: float) -> str:
    size = _prompt_size(*tasks)
    parts, ctes = [], [sql.words("test_sentences", "sent_id"), sql.subwords(size)]
    for i, t in enumerate(tasks):
        if t.kind == "classifications":
            ctes.append(_class_ctes(t, True, f"t{i}_"))
            parts.append(f"SELECT id, {i} AS task_idx, 'class' AS kind, label, CAST(NULL AS VARCHAR) AS text, score FROM t{i}_o")
            continue
        p = f"t{i}_"
        ctes += [sql.candidates(t.labels, threshold, prefix=p), sql.nms(f"{p}c", ["id"], "false", decode.ORDER, _FIELDS, f"{p}k")]
        ctes.append(f"""{p}n AS (SELECT k.id, rank, u.label AS label, u.score AS score,
  trim(substr(t.text, CAST(u.char_start AS INT) + 1, CAST(u.char_end - u.char_start AS INT))) AS text FROM {p}k k JOIN test_sentences t ON t.sent_id = k.id)""")
        if t.kind == "entities":
            parts.append(f"SELECT id, {i} AS task_idx, 'entity' AS kind, label, text, score FROM {p}n")
        else:
            ctes.append(f"""{p}p AS (SELECT id, arg_min(text, rank) FILTER (label = 'head') AS h, arg_min(score, rank) FILTER (label = 'head') AS s, arg_min(text, rank) FILTER (label = 'tail') AS t FROM {p}n GROUP BY id)""")
            parts.append(f"SELECT id, {i} AS task_idx, 'relation' AS kind, '{t.labels[0]}' AS label, h || ' -> ' || t AS text, s AS score FROM {p}p WHERE h IS NOT NULL AND t IS NOT NULL")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(parts)


@query(_multitask_sql(MULTI, THRESHOLD))
def extract_multitask(spark: SparkSession, sf: str) -> DataFrame:
    """Two entity tasks, a relation and a classification in one pass; a row per result with its kind."""
    return ExtractionEngine().extract(_t(spark, sf, "test_sentences"), MULTI, "sent_id", "text", THRESHOLD).results


@query(_relations_sql(["id"], 0.8).replace("0 AS c_idx, ", ""))
def stream_relations(spark: SparkSession, sf: str) -> DataFrame:
    """One relation a text, as a stream."""
    return run_stream(spark, f"{sf}/test_sentences.parquet", lambda d: row_local_relations(d, "sent_id", "text", RELATION, 0.8))


@query(_classify_sql(True))
def stream_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of each text, as a stream."""
    return run_stream(spark, f"{sf}/test_sentences.parquet", lambda d: row_local_classes(d, "sent_id", "text", TOPIC))


@query()
def extract_task_table(spark: SparkSession, sf: str) -> DataFrame:
    """All tasks of the task table in one pass."""
    return ExtractionEngine().extract(_t(spark, sf, "test_sentences"), from_table(_t(spark, sf, "extraction_task")), "sent_id", "text", THRESHOLD).results


# -- operators over stored results ------------------------------------------------------------------
_LATEST = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY loaded_at DESC, text, label) AS r_ FROM extracted_entity) WHERE r_ = 1)"""


@query(f"WITH {_LATEST} SELECT entity_id, sent_id, run_id, task_idx, text, label, score, start_tok, end_tok FROM d")
def latest_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """One row per entity_id: the last one loaded."""
    return joins.latest(_t(spark, sf, "extracted_entity"), ["entity_id"], [F.col("loaded_at").desc(), F.col("text").asc_nulls_last(), F.col("label").asc_nulls_last()]).select(
        "entity_id", "sent_id", "run_id", "task_idx", "text", "label", "score", "start_tok", "end_tok"
    )


_STORED = ("entity_id", "label", "score", "start_tok", "end_tok")


@query(f"""WITH {_LATEST}, v AS (SELECT d.sent_id, d.run_id, d.task_idx, d.entity_id, d.label, CAST(d.score AS DOUBLE) AS score, d.start_tok, d.end_tok, r.flat_ner
  FROM d JOIN extraction_run r ON d.run_id = r.run_id WHERE d.label IS NOT NULL AND d.score > r.threshold),
{sql.nms("v", ["sent_id", "run_id", "task_idx"], "flat_ner", ["entity_id"], _STORED)}
SELECT sent_id, run_id, task_idx, u.entity_id AS entity_id, u.label AS label, rank FROM k""")
def stored_nms_by_run(spark: SparkSession, sf: str) -> DataFrame:
    """Threshold and suppression of stored mentions with the parameters of each row's own run."""
    e = QUERIES["latest_deliveries"](spark, sf).withColumn("score", F.col("score").cast("double"))
    r = _t(spark, sf, "extraction_run").select("run_id", "threshold", "flat_ner")
    kept = e.join(r, "run_id").filter("label is not null and score > threshold").drop("text", "threshold")
    out = decode.suppress(kept, ["sent_id", "run_id", "task_idx"], F.col("flat_ner"), order=["entity_id"])
    return out.select("sent_id", "run_id", "task_idx", "entity_id", "label", "rank")


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY sent_id, run_id, task_name ORDER BY score DESC NULLS LAST, class_id) AS r FROM classification_result)
SELECT sent_id, run_id, task_name, label, round(CAST(score AS DOUBLE), 6) AS score FROM b WHERE r = 1""")
def stored_best_class(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "classification_result")
    best = joins.latest(c, ["sent_id", "run_id", "task_name"], [F.col("score").desc_nulls_last(), F.col("class_id").asc()])
    return best.select("sent_id", "run_id", "task_name", "label", F.round(F.col("score").cast("double"), 6).alias("score"))


@query("""SELECT r.rel_id, r.relation_type, t.task_name, r.head.text AS head_text, r.tail.text AS tail_text FROM extracted_relation r
JOIN extraction_task t ON r.task_idx = t.task_idx WHERE r.head.text IS NOT NULL AND r.tail.text IS NOT NULL""")
def stored_relations(spark: SparkSession, sf: str) -> DataFrame:
    r, t = _t(spark, sf, "extracted_relation"), _t(spark, sf, "extraction_task").select("task_idx", "task_name")
    both = r.filter("head.text is not null and tail.text is not null").join(F.broadcast(t), "task_idx")  # one row per task of a task list
    return both.select("rel_id", "relation_type", "task_name", F.col("head.text").alias("head_text"), F.col("tail.text").alias("tail_text"))


@query("""SELECT e.entity_id, e.loaded_at, r.run_id AS last_run FROM extracted_entity e ASOF LEFT JOIN extraction_run r ON e.loaded_at >= r.started_at""")
def asof_run(spark: SparkSession, sf: str) -> DataFrame:
    """The last run started when each row was loaded."""
    e = _t(spark, sf, "extracted_entity").select("entity_id", "loaded_at")
    r = _t(spark, sf, "extraction_run").select("started_at", F.col("run_id").alias("last_run"))
    return joins.asof(e, r, "loaded_at", "started_at", ["last_run"])


@query("""SELECT e.entity_id, e.sent_id, e.loaded_at, c.label AS last_class FROM extracted_entity e ASOF LEFT JOIN
(SELECT c.sent_id, s.ingested_at, max(c.label) AS label FROM classification_result c JOIN test_sentences s ON c.sent_id = s.sent_id GROUP BY ALL) c
ON e.sent_id = c.sent_id AND e.loaded_at >= c.ingested_at""")
def asof_class(spark: SparkSession, sf: str) -> DataFrame:
    """The class that each mention's own text had when the mention was loaded."""
    e = _t(spark, sf, "extracted_entity").select("entity_id", "sent_id", "loaded_at")
    c = _t(spark, sf, "classification_result").select("sent_id", F.col("label").alias("last_class")).join(_t(spark, sf, "test_sentences").select("sent_id", "ingested_at"), "sent_id")
    return joins.asof(e, c, "loaded_at", "ingested_at", ["last_class"], by=["sent_id"])


@query("""SELECT s.source, e.label, count(*) AS n, count(DISTINCT e.text) AS n_texts, CAST(grouping(s.source) * 2 + grouping(e.label) AS BIGINT) AS level
FROM extracted_entity e JOIN test_sentences s ON e.sent_id = s.sent_id GROUP BY ROLLUP (s.source, e.label)""")
def label_rollup(spark: SparkSession, sf: str) -> DataFrame:
    e, s = _t(spark, sf, "extracted_entity").select("sent_id", "label", "text"), _t(spark, sf, "test_sentences").select("sent_id", "source")
    return e.join(s, "sent_id").rollup("source", "label").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"), F.grouping_id().alias("level"))


@query("""SELECT label, run_id, count(*) AS n, round(sum(CAST(score AS DOUBLE)), 4) AS total FROM extracted_entity GROUP BY CUBE (label, run_id)""")
def label_cube(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "extracted_entity").cube("label", "run_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("score").cast("double")), 4).alias("total"))


@query("""WITH g AS (SELECT label, text, count(*) AS n FROM extracted_entity WHERE label IS NOT NULL AND text IS NOT NULL GROUP BY label, text),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, text) AS INT) AS rank FROM g) SELECT label, text, n, rank FROM r WHERE rank <= 10""")
def top_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A top-k report: the ten most frequent texts of each label."""
    g = _t(spark, sf, "extracted_entity").na.drop(subset=["label", "text"]).groupBy("label", "text").agg(F.count("*").alias("n"))
    w = Window.partitionBy("label").orderBy(F.col("n").desc(), "text")
    return g.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")


@query("""SELECT sent_id FROM test_sentences EXCEPT SELECT sent_id FROM classification_result""")
def unclassified(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "test_sentences").select("sent_id").exceptAll(_t(spark, sf, "classification_result").select("sent_id").distinct())


@query("""SELECT sent_id FROM extracted_relation INTERSECT SELECT sent_id FROM classification_result""")
def related_and_classified(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "extracted_relation").select("sent_id").intersect(_t(spark, sf, "classification_result").select("sent_id"))


@query("""SELECT s.sent_id, s.source FROM test_sentences s WHERE EXISTS (SELECT 1 FROM extracted_entity e WHERE e.sent_id = s.sent_id AND e.label = 'tax id')""")
def with_tax_id(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "extracted_entity").filter("label = 'tax id'")
    return _t(spark, sf, "test_sentences").join(e, "sent_id", "left_semi").select("sent_id", "source")


@query("""SELECT time_bucket(INTERVAL 6 HOURS, loaded_at) AS bucket, label, count(*) AS n FROM extracted_entity GROUP BY 1, 2""")
def loads_by_window(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "extracted_entity")
    return e.groupBy(F.window("loaded_at", "6 hours"), "label").agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), "label", "n")


@query("""SELECT source, domain, count(*) AS n, CAST(grouping(source) * 2 + grouping(domain) AS BIGINT) AS level FROM test_sentences GROUP BY GROUPING SETS ((source), (domain), ())""")
def source_domain_sets(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "test_sentences")
    return d.groupingSets([["source"], ["domain"], []], "source", "domain").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""SELECT sent_id FROM extracted_relation UNION SELECT sent_id FROM classification_result""")
def related_or_classified(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "extracted_relation").select("sent_id").union(_t(spark, sf, "classification_result").select("sent_id")).distinct()


@query("""SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2""")
def event_properties(spark: SparkSession, sf: str) -> DataFrame:
    """A property inside the JSON of each event."""
    e = _t(spark, sf, "events").select("event_type", "value", F.get_json_object("props", "$.k").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("""SELECT s.source, count(*) AS n, count(DISTINCT e.text) AS texts FROM test_sentences s LEFT JOIN extracted_entity e ON s.sent_id = e.sent_id AND e.label = 'person' GROUP BY s.source""")
def persons_by_source(spark: SparkSession, sf: str) -> DataFrame:
    s, e = _t(spark, sf, "test_sentences").select("sent_id", "source"), _t(spark, sf, "extracted_entity").filter("label = 'person'").select("sent_id", "text")
    return s.join(e, "sent_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


@query("""SELECT entity_id, loaded_at, lag(score) OVER w AS before, CAST(ntile(4) OVER w AS INT) AS quarter, dense_rank() OVER (PARTITION BY sent_id ORDER BY label NULLS LAST) AS label_rank
FROM extracted_entity WINDOW w AS (PARTITION BY sent_id ORDER BY loaded_at, entity_id, score)""")
def mention_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("sent_id").orderBy("loaded_at", "entity_id", "score")
    by_label = Window.partitionBy("sent_id").orderBy(F.col("label").asc_nulls_last())
    return _t(spark, sf, "extracted_entity").select("entity_id", "loaded_at", F.lag("score").over(w).alias("before"), F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(by_label).cast("bigint").alias("label_rank"))


@query("""SELECT sent_id AS id, CAST(len(regexp_extract_all(text, '(?i)""" + sql.re2_word() + """')) AS INT) AS n_words FROM test_sentences WHERE text IS NOT NULL""")
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The splitter as a function in SQL."""
    from weftline.functions.sql import register

    register(spark)
    _t(spark, sf, "test_sentences").createOrReplaceTempView("wl_texts")
    return spark.sql("SELECT sent_id AS id, wl_word_count(text) AS n_words FROM wl_texts WHERE text IS NOT NULL")


@query("""SELECT sent_id, text, language FROM test_sentences""")
def text_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Texts written as JSON lines, CSV and ORC and read back one from the other."""
    from weftline.sources.texts import read_texts, write_texts

    out, schema = _t(spark, sf, "test_sentences").select("sent_id", "text", "language"), "sent_id bigint, text string, language string"
    for fmt in ("json", "csv", "orc"):
        out = read_texts(spark, write_texts(out, fmt), fmt, schema)
    return out


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def line_summary(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )


@query("""SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def orders_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_custkey", "o_totalprice")
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    per = o.join(c, "o_custkey").groupBy("n_nationkey").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("t"))
    n = _t(spark, sf, "nation").select("n_nationkey", "n_name")
    return per.join(n, "n_nationkey").groupBy("n_name").agg(F.sum("n_orders").alias("n_orders"), F.round(F.sum("t"), 2).alias("total"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
