"""Goldens of the extraction semantics and properties of suppression."""

import random

import pytest
from pyspark.sql import functions as F

from weftline import tasks as T
from weftline.functions.words import split_words, word_table
from weftline.operators import decode, joins, prompt, spans
from weftline.plans.engine import ExtractionEngine


def df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")


def test_splitter_branches(spark):
    t = "See https://a.example/x?y=1 or WWW.b.example, mail a.b+c@d-e.example, @some_one well-known x_y é é 漢字 ok!"
    got = df(spark, [t]).select(split_words(F.col("text"))).first()[0]
    assert got[1] == "https://a.example/x?y=1" and got[3] == "WWW.b.example," and "a.b+c@d-e.example" in got
    assert "@some_one" in got and "well-known" in got and "x_y" in got and "é" in got and "漢字" in got and got[-1] == "!"


def test_offsets_are_characters_and_bytes(spark):
    t = "  é漢 a b "
    rows = word_table(df(spark, [t]), "id", "text").orderBy("pos").collect()
    assert [(r["word"], t[r["char_start"] : r["char_end"]], t.encode()[r["byte_start"] : r["byte_end"]].decode()) for r in rows] == [(w, w, w) for w in ("é漢", "a", "b")]


def test_blank_and_null_texts_give_nothing(spark):
    d = df(spark, ["", "   ", None])
    out = ExtractionEngine(semantics="v1").extract(d, [T.entities("person"), T.classifications("c", "a", "b")], "id", "text")
    assert out.entities.count() == 0 and out.classifications.count() == 0 and out.relations is None


def test_tasks_are_validated():
    with pytest.raises(ValueError):
        T.classifications("x")
    with pytest.raises(ValueError):
        ExtractionEngine(semantics="v3")


def test_prompt_indexes():
    pieces, heads, fields = prompt.assemble([T.entities("a", "b"), T.relations("r", "head", "tail")])
    assert pieces[:10] == ["(", "[P]", "entities", "(", "[E]", "a", "[E]", "b", ")", ")"] and pieces[-1] == "[SEP_TEXT]"
    assert [pieces[i] for i in heads] == ["[P]", "[P]"] and [[pieces[i] for i in f] for f in fields] == [["a", "b"], ["head", "tail"]]
    assert prompt.assemble([])[0] == ["[SEP_TEXT]"]


def test_padding_aliases_word_zero(spark):
    d = df(spark, ["Rome is nice"])
    both = ExtractionEngine().extract(d, [T.entities("person")], "id", "text", 0.9).entities
    one = ExtractionEngine(padding="mask").extract(d, [T.entities("person")], "id", "text", 0.9).entities
    assert {r["text"] for r in one.collect()} == {"Rome"} and {"Rome", "is nice"} <= {r["text"] for r in both.collect()}
    assert both.filter("is_padding").count() > 0 and one.filter("is_padding").count() == 0


def kept(spark, rows, flat):
    d = spark.createDataFrame(rows, "id int, label string, score double, start_tok int, end_tok int, c_idx int, start int, width_idx int, label_idx int")
    return {(r["label"], r["start_tok"], r["end_tok"]) for r in decode.suppress(d, ["id"], flat).collect()}


def brute(rows, flat):
    out = []
    for r in sorted(rows, key=lambda r: (-r[2], *r[5:9])):
        if not any(r[4] > s[3] and r[3] < s[4] and (flat or r[1] == s[1]) for s in out):
            out.append(r)
    return {(r[1], r[3], r[4]) for r in out}


@pytest.mark.parametrize("flat", [False, True])
def test_suppression_equals_brute_force(spark, flat):
    rng = random.Random(3)
    rows = []
    for k in range(200):
        s = rng.randrange(60)
        rows.append((0, rng.choice("ab"), rng.choice([0.5, 0.6, 0.7]), s, s + rng.randrange(1, 6), 0, s, k % 8, k))
    assert kept(spark, rows, flat) == brute(rows, flat)


def test_touching_spans_coexist(spark):
    rows = [(0, "a", 0.9, 0, 2, 0, 0, 1, 0), (0, "a", 0.9, 2, 3, 0, 2, 0, 0), (0, "a", 0.9, 1, 3, 0, 1, 1, 0)]
    assert kept(spark, rows, True) == {("a", 0, 2), ("a", 2, 3)}


def test_tied_classes(spark):
    d = spark.createDataFrame([(1, 0, "x", 1000.0), (1, 1, "y", 1000.0)], "id int, label_idx int, label string, logit double")
    assert decode.softmax_best(d, ["id"], last_wins=False).first()["label"] == "x"
    last = decode.softmax_best(d, ["id"], last_wins=True).first()
    assert last["label"] == "y" and last["score"] == 0.5


def test_relation_needs_head_and_tail(spark):
    r = ExtractionEngine().extract(df(spark, ["Anna Bell met Carl Jones"]), [T.relations("r", "from", "to")], "id", "text", 0.6).relations
    assert r.count() == 0


def test_raising_the_threshold_only_removes(spark):
    e = ExtractionEngine()
    w = e.words(df(spark, ["Anna Bell met Carl Jones of Acme-Works on 3 May"]), [T.entities("person")], "id", "text")
    low = {tuple(r[:5]) for r in spans.candidates(w, ["person"], e.backend, 0.5).collect()}
    high = {tuple(r[:5]) for r in spans.candidates(w, ["person"], e.backend, 0.95).collect()}
    assert high < low


def test_asof_with_keys(spark):
    a = spark.createDataFrame([("x", 5), ("x", 1), ("y", 9), (None, 3)], "k string, t int")
    b = spark.createDataFrame([("x", 2, "p"), ("x", 4, "q"), ("y", 10, "r")], "k string, u int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in joins.asof(a, b, "t", "u", ["v"], by=["k"]).collect()}
    assert got == {("x", 5): "q", ("x", 1): None, ("y", 9): None, (None, 3): None}


@pytest.mark.parametrize("keyed", [False, True])
def test_asof_in_ranges_equals_brute_force(spark, keyed):
    rng = random.Random(5)
    left = [(rng.choice("xxxxy"), rng.choice([17, 17, 17, rng.randrange(200)]), k) for k in range(500)] + [("x", None, 500), (None, 9, 501)]
    right = [(rng.choice("xyz"), rng.randrange(5, 200), rng.randrange(99)) for _ in range(120)] + [("x", None, 1), (None, 8, 7)]
    if not keyed:
        left, right = [r for r in left if r[0]], [r for r in right if r[0]]
    a, b = spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, u int, v int")

    def true(k, t):
        seen = [(u, v) for x, u, v in right if u is not None and t is not None and u <= t and (not keyed or (x == k and k is not None))]
        return max(seen)[1] if seen else None

    many = joins.asof(a, b, "t", "u", ["v"], by=["k"] if keyed else (), most_broadcast=0, target=20)
    assert {r["id"]: r["v"] for r in many.collect()} == {i: true(k, t) for k, t, i in left}
    assert many.columns == ["k", "t", "id", "v"]
    if not keyed:
        assert {r["id"]: r["v"] for r in joins.asof(a, b, "t", "u", ["v"]).collect()} == {i: true(k, t) for k, t, i in left}
        assert spark.createDataFrame(left, "k string, t int, id int").count() == many.count()


def stand_in():
    """A class of its own, which goes to the workers by value."""

    class StandIn:
        """Fragments that compute what the lexical backend does, of either generation; pieces are found again by their first subword."""

        pieces: dict = {}
        order: list = []

        def __init__(self, labels, semantics, split_spans=False):
            self.labels, self.semantics, self.split_spans = labels, semantics, split_spans

        @classmethod
        def encode(cls, pieces):
            out = []
            for p in pieces:
                if p not in cls.pieces:
                    cls.pieces[p] = 10 + len(cls.order)
                    cls.order.append(p)
                out.append([cls.pieces[p]] + [1] * (max(1, -(-len(p) // 4)) - 1))
            return out

        def inputs(self, name):
            v1 = {"encoder": ["input_ids"], "count_pred": ["x"], "count_lstm": ["pc_emb", "gold_count_val"], "span_rep": ["last_hidden_state", "span_start_idx", "span_end_idx"]}
            if self.semantics == "v1" and (name != "span_rep" or self.split_spans):
                return v1[name]
            return {"span_rep": ["hidden_states", "span_idx"]}[name]

        def features(self, w):
            import regex

            from weftline.backends.lexical import FEATURES

            return [1, *[int(bool(regex.search(j, w))) for _, j, _ in FEATURES], int(len(w) >= 8)]

        def run(self, name, x):
            import numpy as np

            from weftline.backends.lexical import weights

            if name == "encoder":
                ids = x["input_ids"][0].tolist()
                words = [self.order[i - 10] if i >= 10 else None for i in ids]
                text = words.index("[SEP_TEXT]")
                upper = sum(bool(w) and w[0].isupper() and k > text for k, w in enumerate(words[:-1]))
                mean = np.array([self.features(w) for w in words[text + 1 : -1] if w]).mean(axis=0)
                # features, what it is called, the count of the text, the mean of its words
                h = [[*(self.features(w) if w else [0] * 8), self.pieces.get(w, 0), upper, *mean] for w in words]
                return {"last_hidden_state": np.array([h], dtype=np.float64)}
            if name == "token_gather":
                return {"text_embs": x["last_hidden_state"][:, x["word_indices"]]}
            if name == "span_rep":
                words = x.get("hidden_states", x.get("last_hidden_state"))[0][:, :8]
                a, b = (x["span_idx"][0, :, 0], x["span_idx"][0, :, 1]) if "span_idx" in x else (x["span_start_idx"][0], x["span_end_idx"][0])
                return {"span_embeddings": np.concatenate([words[a], words[b], (1 - np.abs(b - a - 1))[:, None], np.ones((len(a), 1))], axis=1)[None]}
            if name == "schema_gather":
                g = x["last_hidden_state"][0, x["schema_indices"]]
                return {"pc_emb": g[:1], "field_embs": g[1:]}
            if name == "count_pred_argmax":
                return {"pred_count": np.array([min(20, int(x["pc_emb"][0, 9]))])}
            if name == "count_pred":
                return {"count_logits": -np.abs(np.arange(21)[None] - min(20, x["x"][0, 9]))}
            if name in ("count_lstm_fixed", "count_lstm"):
                names = [self.order[int(i) - 10] for i in x.get("field_embs", x.get("pc_emb"))[:, 8]]
                slots = 20 if name == "count_lstm_fixed" else int(x["gold_count_val"])
                return {"struct_proj" if slots == 20 and name == "count_lstm_fixed" else "count_embeddings": np.array([[[*weights(n)[0], *weights(n)[1], 1, -2 * c] for n in names] for c in range(slots)], dtype=np.float64)}
            if name == "scorer":
                return {"entity_scores": 1 / (1 + np.exp(-np.einsum("wkh,cmh->cwkm", x["span_embeddings"][0], x["struct_proj"])))}
            assert name == "classifier" and not x["span_embeddings"][:, :, 1:].any()
            rows = x["span_embeddings"][0, :, 0]
            return {"logits": np.array([np.dot(weights(self.order[int(r[8]) - 10])[0], r[10:]) for r in rows])[None, :, None, None]}

    return StandIn


@pytest.mark.parametrize(("semantics", "split_spans"), [("v2", False), ("v1", False), ("v1", True)])
def test_graphs_give_what_the_lexical_plan_gives(spark, semantics, split_spans):
    from weftline.backends.onnx import GraphBackend

    tasks = [T.entities("person", "date"), T.relations("works_with", "head", "tail"), T.classifications("topic", "finance", "legal")]
    d = df(spark, ["Anna Bell met Carl Jones of Acme-Works on 3 May", "nothing here", "Rome", "", None, "Is  it\nMonday, 4 July?"])
    made = stand_in()
    graph = GraphBackend(runner=lambda: made(tasks, semantics, split_spans), encoder=lambda: made.encode)

    def rows(backend):
        e = ExtractionEngine(semantics=semantics, **({"backend": backend} if backend else {})).extract(d, tasks, "id", "text", 0.8)
        found = {(r["id"], r["label"], r["text"], round(r["score"], 5), r["rank"], r["c_idx"], r["start_tok"], r["end_tok"], r["char_start"], r["byte_end"], r["is_padding"]) for r in e.entities.collect()}
        pairs = {(r["id"], r["c_idx"], r["head"]["text"], r["tail"]["text"], r["relation_type"], r["task_name"]) for r in e.relations.collect()}
        return found, pairs, {(r["id"], r["label"], round(r["score"], 5), r["task_name"]) for r in e.classifications.collect()}, e.results.count()

    assert rows(graph) == rows(None)


def test_disagreeing_fragments_raise():
    import numpy as np

    from weftline.backends.onnx import build_sequence, run_fragments, span_indexes

    assert span_indexes(2, 2).tolist() == [[0, 0], [0, 1], [1, 1], [0, 0]]
    seq = build_sequence([[5], [6, 7]], [1], [[0]], [[8, 9], [3]], (1, 2))
    assert seq.ids == [1, 5, 6, 7, 8, 9, 3, 2] and seq.heads == [2] and seq.fields == [[1]] and seq.starts == [4, 6] and seq.ends == [6, 7]

    class Bad:
        def inputs(self, name):
            return ["hidden_states", "span_idx"]

        def run(self, name, x):
            return {
                "encoder": {"last_hidden_state": np.ones((1, 8, 2))}, "token_gather": {"text_embs": np.ones((1, 2, 2))}, "span_rep": {"span_embeddings": np.ones((1, 2, 2, 2))},
                "schema_gather": {"pc_emb": np.ones((1, 2)), "field_embs": np.ones((1, 2))}, "count_pred_argmax": {"pred_count": np.array([1])}, "count_lstm_fixed": {"struct_proj": np.ones((20, 1, 3))},
            }[name]

    with pytest.raises(ValueError):
        list(run_fragments(Bad(), seq, [T.entities("a")], 2, "v2"))


def test_threshold_and_mode_of_each_text(spark):
    d = spark.createDataFrame([(0, "Anna Bell met Carl Jones", 0.5, False), (1, "Anna Bell met Carl Jones", 0.95, True), (2, "Anna Bell met Carl Jones", 1.0, True)], "id bigint, text string, t double, f boolean")
    tasks = [T.entities("person", "organization")]
    got = {(r["id"], r["label"], r["text"], r["score"]) for r in ExtractionEngine().extract(d, tasks, "id", "text", F.col("t"), F.col("f")).entities.collect()}
    each = set()
    for i, t, f in ((0, 0.5, False), (1, 0.95, True)):
        each |= {(r["id"], r["label"], r["text"], r["score"]) for r in ExtractionEngine().extract(d.filter(f"id = {i}"), tasks, "id", "text", t, f).entities.collect()}
    assert got == each and got


def test_tokenizer_file_sequences(spark):
    import public_tokenizers

    from weftline.operators.prompt import encode_pieces

    d = spark.createDataFrame([(1, ["(", "person", "Acme-Works"]), (2, [])], "id int, pieces array<string>")
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    one = lambda x: tok.encode(x, add_special_tokens=False).ids
    for r in encode_pieces(d, "pieces", path).collect():
        want, at = one("[CLS]")[:1], []
        for p in r["pieces"]:
            at.append(len(want))
            want += one(p)
        assert r["input_ids"] == want + one("[SEP]")[:1] and r["piece_starts"] == at and r["attention_mask"] == [1] * len(r["input_ids"])


def test_model_folder(tmp_path):
    from weftline.sources.texts import model_files, model_version

    assert model_version(str(tmp_path)) == "v1"
    for n in ("encoder", "token_gather", "span_rep", "schema_gather", "count_pred_argmax", "count_lstm_fixed", "scorer", "classifier"):
        (tmp_path / f"{n}_fp32.onnx").touch()
    (tmp_path / "encoder_fp16.onnx").touch()
    assert model_version(str(tmp_path)) == "v2" and model_files(str(tmp_path))["encoder"].endswith("encoder_fp16.onnx")


def test_sources_and_sinks(spark, tmp_path):
    from weftline.sources.texts import read_texts, write_extraction, write_texts

    rows = [(1, 'He said "a, b"\nand left', "en"), (2, "", None), (3, None, "it"), (4, " spaced ", "de")]
    d = spark.createDataFrame(rows, "id bigint, text string, language string")
    for fmt in ("parquet", "json", "csv", "orc"):
        got = read_texts(spark, write_texts(d, fmt, str(tmp_path / fmt)), fmt, "id bigint, text string, language string")
        assert sorted(map(tuple, got.collect())) == rows
    with pytest.raises(ValueError):
        read_texts(spark, "x", "avro2")
    out = ExtractionEngine().extract(d, [T.entities("person"), T.classifications("c", "a", "b")], "id", "text", 0.5)
    assert write_extraction(out, str(tmp_path / "out")) == ["entities", "classifications"]
    assert spark.read.parquet(str(tmp_path / "out/entities")).count() == out.entities.count() > 0


def test_sql_functions(spark):
    from weftline.functions.sql import register

    assert "wl_spans" in register(spark)
    r = spark.sql("SELECT wl_split_words('Anna met a.b@c.example') AS w, wl_argmax_first(array(1D, 3D, 3D)) AS a, wl_overlaps(0, 2, 2, 3) AS o, wl_dot(array(1D, 2D), array(3D, 4D)) AS d, wl_sigmoid(0D) AS s").first()
    assert r["w"] == ["Anna", "met", "a.b@c.example"] and r["a"] == 1 and not r["o"] and r["d"] == 11 and r["s"] == 0.5
    assert spark.sql("SELECT count(*) AS n, count_if(is_padding) AS p FROM wl_spans(10, 8)").first()[:] == (80, 28)


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    from weftline.streaming.extract import entity_counts, row_local_entities

    src = str(tmp_path / "in")
    for k, day in enumerate(("2025-01-01", "2025-01-10", "2025-01-10", "2025-01-01", "2025-02-01")):
        spark.sql(f"SELECT {k}L AS id, 'Anna met him' AS text, timestamp'{day} 10:00:00' AS at").coalesce(1).write.mode("append").parquet(f"{src}/{k}")
    stream = spark.readStream.schema("id bigint, text string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    rows = entity_counts(row_local_entities(stream, "id", "text", T.entities("person"), 0.9, keep=["at"]), "at", "1 day", "1 hour")
    rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    got = {str(r["window_start"])[:10]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    one = row_local_entities(spark.createDataFrame([(1, "Anna met him")], "id bigint, text string"), "id", "text", T.entities("person"), 0.9).count()
    assert got == {"2025-01-01": one, "2025-01-10": 2 * one}  # the fourth file came too late, the last window is open


def test_v1_drops_spans_without_subwords(spark):
    from weftline.backends.onnx import GraphBackend

    class Empty(GraphBackend):
        def span_scores(self, words, *_):
            w = words.select("id", "pos", "char_start", "char_end", "byte_start", "byte_end", "start_tok", "end_tok", "word")
            ends = F.when(F.col("pos") == 0, F.col("start_tok")).otherwise(F.col("end_tok"))
            return w.select("id", F.lit(0).alias("c_idx"), F.col("pos").alias("start"), F.lit(0).alias("width_idx"), F.lit(0).alias("task_idx"), F.lit(0).alias("label_idx"), F.lit("x").alias("label"), F.lit(0.9).alias("score"), "char_start", "char_end", "byte_start", "byte_end", "start_tok", ends.alias("end_tok"), F.col("word").alias("text"))

    d = df(spark, ["one two three"])
    n = {s: ExtractionEngine(Empty(), semantics=s).extract(d, [T.entities("x")], "id", "text").entities.count() for s in ("v1", "v2")}
    assert n == {"v1": 2, "v2": 3}


def test_frozen_scores(spark):
    """Worked by hand from the stated weights: first word + last word + width; neither the weights nor the SQL are asked."""
    e = ExtractionEngine(padding="mask").extract(df(spark, ["Anna Bell paid 3 EUR on 12/05/1990"]), [T.entities("person", "date")], "id", "text", 0.5).entities
    got = {(r["label"], r["text"]): (r["score"], r["start_tok"], r["end_tok"], r["char_start"], r["char_end"], r["c_idx"]) for r in e.collect()}
    # person: 2 + 2 + 1 over two words; date: 2 + 2 + 0 for one number, 2 + 2 + 1 for a number and the sign before the next
    assert got["person", "Anna Bell"] == (0.993307, 16, 18, 0, 9, 0)  # 1 + 15 subwords of [CLS] and prompt
    assert got["date", "3"][0] == 0.982014 or ("date", "3") not in got
    w = [r["word"] for r in word_table(df(spark, ["Anna Bell paid 3 EUR on 12/05/1990"]), "id", "text").orderBy("pos").collect()]
    assert w == ["Anna", "Bell", "paid", "3", "EUR", "on", "12", "/", "05", "/", "1990"]
    r = ExtractionEngine().extract(df(spark, ["Anna Bell met him"]), [T.relations("r", "head", "tail")], "id", "text", 0.5).relations.first()
    assert r["head"]["text"] == "Anna Bell" and r["head"]["score"] == 0.993307 and r["relation_type"] == "head" and r["task_name"] == "r"
    c = ExtractionEngine(semantics="v1").extract(df(spark, ["a"]), [T.classifications("x", "p", "p2")], "id", "text").classifications.first()
    assert c["label"] in ("p", "p2") and 0.5 <= c["score"] <= 1


@pytest.mark.parametrize("small", [True, False])
def test_asof_of_empty_sides_and_clashing_names(spark, small):
    a = spark.createDataFrame([("x", 5, 1)], "_t string, t int, _p int")
    b = spark.createDataFrame([(4, 7)], "u int, _v int")
    most = 100 if small else 0
    assert [tuple(r) for r in joins.asof(a, b, "t", "u", ["_v"], most_broadcast=most).collect()] == [("x", 5, 1, 7)]
    assert [tuple(r) for r in joins.asof(a, b.limit(0), "t", "u", ["_v"], most_broadcast=most).collect()] == [("x", 5, 1, None)]
    assert joins.asof(a.limit(0), b, "t", "u", ["_v"], most_broadcast=most).count() == 0
    late = spark.createDataFrame([(4, 7), (4, 9)], "u int, _v int")
    assert joins.asof(a, late, "t", "u", ["_v"], most_broadcast=most).first()["_v"] == 9


def test_texts_with_extra_columns_and_ties(spark):
    d = spark.createDataFrame([(1, "Anna Bell", "z", 3), (1, "Anna Bell", "z", 4), (None, "Carl Jones", None, 5)], "id bigint, text string, word string, pos int")
    e = ExtractionEngine().extract(d.filter("pos <> 4"), [T.entities("person")], "id", "text", 0.9).entities
    assert {r["id"] for r in e.collect()} == {1, None}


class Scores:
    """The lexical backend without its features."""

    def __init__(self):
        b = ExtractionEngine().backend
        for x in ("count_slots", "slot_step", "start_scores", "end_scores", "width_scores", "end_bounds", "counted"):
            setattr(self, x, getattr(b, x))


@pytest.mark.parametrize("mode", [{}, {"semantics": "v1"}, {"padding": "mask", "max_width": 3}, {"backend": Scores()}])
@pytest.mark.parametrize("flat", [False, True])
def test_results_of_all_tasks_without_sorting_candidates(spark, mode, flat):
    """One pass inside batches of words gives what the plans of single tasks give, and nothing that could be spilled."""
    d = df(spark, ["  Anna Bell   met　Carl Jones \n in Rome, 漢字 Éva Ω 12/05/1990 a.b@c.de ", "A", "only small words", " ", None, " ".join(["Anna Bell X12"] * 8), "Dora Fox"])
    tasks = [T.entities("person", "date", "person"), T.relations("r", "head", "tail", "head", "other"), T.classifications("c", "a", "b", "b2"), T.entities("person", "email")]
    threshold = F.array(*[F.lit(x) for x in (0.0, 0.9, 1.0)])[F.when(F.col("id") == 0, 0).when(F.col("id") == 1, 2).otherwise(1)]
    out = ExtractionEngine(**mode).extract(d, tasks, "id", "text", threshold, F.col("id") % 2 == 0 if flat else False)
    known = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # texts go on from batch to batch
    try:
        rows = out.results.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", known)
    own = ("id", "task_idx")
    each = [
        out.entities.selectExpr(*own, "'entity' kind", "label", "text", "score"),
        out.relations.selectExpr(*own, "'relation' kind", "relation_type label", "head.text || ' -> ' || tail.text text", "head.score score"),
        out.classifications.selectExpr(*own, "'class' kind", "label", "cast(null as string) text", "score"),
    ]
    assert sorted(map(repr, rows)) == sorted(repr(r) for e in each for r in e.collect())
    assert {r["kind"] for r in rows} >= ({"entity", "class"} if flat else {"entity", "relation", "class"})
    plan = out.results._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan
