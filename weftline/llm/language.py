"""Problem 1: the language of each text and of each single-language segment, with a confidence.

Multinomial naive Bayes over hashed character n-grams of words. The log-probability matrix
(languages x buckets, a fixed size) is broadcast; a batch of units is scored by one gather and one
segmented sum. What a sentence merely quotes says nothing about its language: names (capitalised
words inside a sentence), quoted titles, numbers, codes and addresses are left out of the features
as long as other words remain.

The labels it is fitted on are the table's own: rows whose label names a language, at most about
``per_language`` of each language, chosen by the hash of their id. Wrong labels and mixed texts are
cleaned by fitting again: units that a first model firmly gives to another language are dropped, and
labels that hardly any unit supports are no languages (``fit``). Priors are the rows of each label.
All rows are classified.

Defined results: null, empty and blank texts have no segments; units without any language have the
language null and confidence 0; equal scores go to the language with more labelled rows; repeated
texts are classified alike; without a single usable label there is nothing to fit and all languages
are null; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.sentences import HiddenEventModel, Tokens, unit_tokens, word_form
from weftline.llm.sentences import fit as fit_splitter

# Three-letter codes and names of languages, by two-letter code.
CODES = {
    "en": "eng english", "it": "ita italian italiano", "fr": "fra fre french français francais", "es": "spa spanish español espanol castellano",
    "de": "deu ger german deutsch", "pt": "por portuguese português portugues", "ja": "jpn japanese", "zh": "zho chi cmn chinese",
    "ru": "rus russian", "th": "tha thai", "hi": "hin hindi", "el": "ell gre greek", "nl": "nld dut dutch", "pl": "pol polish",
    "sv": "swe swedish", "da": "dan danish", "no": "nor norwegian", "fi": "fin finnish", "cs": "ces cze czech", "tr": "tur turkish",
    "ar": "ara arabic", "ko": "kor korean", "uk": "ukr ukrainian", "hu": "hun hungarian", "ro": "ron rum romanian", "he": "heb hebrew", "vi": "vie vietnamese",
}
# What is written where no language is named.
NO_LANGUAGE = ("und", "mul", "mis", "zxx", "unk", "unknown", "none", "null", "nil", "na", "xx", "xxx", "other", "undefined", "nan")

_OPEN = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", '"': '"', "‹": "›"}


def label_code(label: Column) -> Column:
    """The two-letter code a language label means; null if it names none.

    Case, surrounding space, region and script do not matter; an unlisted two- or three-letter code
    stands for itself, since it names some language.
    """
    primary = F.regexp_extract(F.lower(F.trim(F.regexp_replace(label, r"[\s ]+", " "))), r"^([\p{L}]+)(?:[-_ .].*)?$", 1)
    table = F.create_map(*[F.lit(x) for code, names in CODES.items() for n in (code, *names.split()) for x in (n, code)])
    listed = table[primary]
    return F.when(primary.isin("", *NO_LANGUAGE), None).when(listed.isNotNull(), listed).when(F.length(primary).between(2, 3), primary)


def content_words(t: Tokens, start: int, end: int) -> list[str]:
    """The words of a unit (tokens ``start`` to ``end`` of a text) that tell its language."""
    if not t.has_language(start, end):
        return []
    kept, every, stack = [], [], []
    first = True
    marks = {r for r, k in zip(t.raw[start:end], t.kind[start:end], strict=True) if k == "sign"}
    for raw, kind in zip(t.raw[start:end], t.kind[start:end], strict=True):
        if kind == "sign":
            if stack and raw == stack[-1]:
                stack.pop()
            elif raw in _OPEN and _OPEN[raw] in marks:
                stack.append(_OPEN[raw])
            continue
        if kind in ("word", "thai", "cjk"):
            w = word_form(raw)
            if kind != "word":
                (every if stack else kept).append(w)
                continue
            every.append(w)
            if not stack and (first or not w[:1].isupper()):
                kept.append(w)
            first = False
        elif kind in ("num", "addr", "dots"):
            first = False
    chosen = kept if sum(len(w) for w in kept) >= 4 else kept + every
    return [w.lower() for w in chosen]


def is_full_sentence(t: Tokens, start: int, end: int, followed_by_break: bool) -> bool:
    """Not a heading (short, without an end mark, on its own line) and not made of numbers, codes or addresses only."""
    if not t.has_language(start, end):
        return False
    kinds = t.kind[start:end]
    ended = "end" in kinds[-3:]
    dense = "thai" in kinds or "cjk" in kinds
    short = len(kinds) <= 1 + 2 * dense if dense else len(kinds) <= 7
    return not (short and not ended and followed_by_break)


def _hash(s: str, buckets: int) -> int:
    h = 2166136261
    for b in s.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) % buckets


@lru_cache(maxsize=1 << 17)
def word_grams(w: str, buckets: int) -> np.ndarray:
    """Hashed 1- to 4-grams of a padded word."""
    p = f"_{w}_"
    return np.array([_hash(p[i : i + n], buckets) for n in (1, 2, 3, 4) for i in range(len(p) - n + 1) if p[i : i + n] != "_"], dtype=np.int32)


class NaiveBayes:
    """Log-probabilities of hashed n-grams by language, and of the languages themselves."""

    def __init__(self, languages: list[str], logp: np.ndarray, prior: np.ndarray):
        self.languages, self.logp, self.prior = languages, logp, prior

    @property
    def buckets(self) -> int:
        return self.logp.shape[1]

    @staticmethod
    def fit(docs: list[list[str]], labels: list[str], rows: dict[str, int] | None = None, buckets: int = 1 << 18, alpha: float = 0.1) -> NaiveBayes:
        """Smoothing in proportion to what a language was fitted on, so that unseen n-grams favour none; priors from ``rows``, the rows of each label."""
        languages = sorted(set(labels))
        at = {x: i for i, x in enumerate(languages)}
        counts = np.zeros((len(languages), buckets), dtype=np.float32)
        words = [Counter() for _ in languages]
        for ws, y in zip(docs, labels, strict=True):
            words[at[y]].update(ws)
        for row, seen in zip(counts, words, strict=True):
            if seen:
                grams = [word_grams(w, buckets) for w in seen]
                row += np.bincount(np.concatenate(grams), np.repeat(list(seen.values()), [len(g) for g in grams]), buckets)
        counts += np.maximum(alpha * counts.sum(axis=1, keepdims=True) / buckets, 1e-6)
        n = np.array([(rows or Counter(labels))[x] for x in languages], dtype=np.float64) + 1
        return NaiveBayes(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), np.log(n / n.sum()))

    def score(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, -1 without features; confidence) of each document of a batch."""
        grams = [np.concatenate([word_grams(w, self.buckets) for w in ws]) if ws else np.zeros(0, np.int32) for ws in docs]
        n = np.array([len(g) for g in grams], dtype=np.int64)
        best, conf = np.full(len(docs), -1), np.zeros(len(docs))
        some = np.flatnonzero(n)
        if len(some) and self.languages:
            flat = np.concatenate([grams[i] for i in some])
            starts = np.r_[0, np.cumsum(n[some])[:-1]]
            sums = np.stack([np.add.reduceat(row[flat], starts) for row in self.logp]) + self.prior[:, None]
            best[some] = sums.argmax(axis=0)
            tempered = (sums - sums.max(axis=0)) / np.sqrt(n[some])
            conf[some] = 1 / np.exp(tempered).sum(axis=0)
        return best, conf


def fit(df: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int, splitter: HiddenEventModel, share: float = 0.001, firm: float = 0.2) -> NaiveBayes:
    """A model from the table's own labels.

    A label becomes a language if at least ``share`` of the labelled rows carry it, which bounds the
    number of languages, and if ``firm`` of its units are still its own after cleaning; other labels
    are dropped, and what they stand on goes to the languages that are left.
    """
    labelled = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), label_code(F.col(label_col)).alias("y")).filter(r"t rlike '\\S' and y is not null")
    counts = labelled.groupBy("y").agg(F.count("*").alias("n"))
    total = labelled.agg(F.count("*").alias("all"))
    n = {r["y"]: r["n"] for r in counts.join(F.broadcast(total)).filter(F.col("n") >= share * F.col("all")).collect()}  # one row; at most 1 / share languages
    if not n:
        return NaiveBayes([], np.zeros((0, 1), dtype=np.float32), np.zeros(0))
    rate = F.create_map(*[F.lit(x) for y, k in sorted(n.items()) for x in (y, min(1.0, per_language / k))])
    rows = labelled.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < F.coalesce(rate[F.col("y")], F.lit(0.0)) * (1 << 20)).select("t", "y").collect()
    docs, labels = [], []
    for x, y in sorted((r["t"], r["y"]) for r in rows):
        t = Tokens(x)
        for s, e in unit_tokens(t, splitter):
            if ws := content_words(t, s, e):
                docs.append(ws)
                labels.append(y)
    if not docs:
        return NaiveBayes([], np.zeros((0, 1), dtype=np.float32), np.zeros(0))
    model, given = NaiveBayes.fit(docs, labels, n), Counter(labels)
    for _ in range(2):
        best, conf = model.score(docs)
        keep = [i for i, (b, c) in enumerate(zip(best, conf, strict=True)) if model.languages[b] == labels[i] or c < 0.6 and labels[i] in model.languages]
        left = Counter(labels[i] for i in keep)
        keep = [i for i in keep if left[labels[i]] >= firm * given[labels[i]]] or keep
        model = NaiveBayes.fit([docs[i] for i in keep], [labels[i] for i in keep], n)
    return model


class Classifier:
    """The two models, fitted to a table and shipped to its workers."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int):
        splitter = fit_splitter(df, text_col)
        model = fit(df, id_col, text_col, label_col, per_language, splitter)
        self.shipped = df.sparkSession.sparkContext.broadcast((splitter.packed(), model.languages, model.logp, model.prior))

    def load(self) -> Callable[[list[str]], tuple[list[tuple], list[str | None], np.ndarray]]:
        """In a worker: texts -> ((text number, start, end, full sentence) of each unit, languages, confidences)."""
        packed, languages, logp, prior = self.shipped.value
        cut, nb = HiddenEventModel.unpacked(packed), NaiveBayes(languages, logp, prior)

        def run(texts: list[str]) -> tuple[list[tuple], list[str | None], np.ndarray]:
            rows, docs = [], []
            for i, x in enumerate(texts):
                t = Tokens(x)
                us = unit_tokens(t, cut)
                for k, (s, e) in enumerate(us):
                    after = x[t.span[e - 1][1] : t.span[e][0]] if k + 1 < len(us) else ""
                    rows.append((i, t.span[s][0], t.span[e - 1][1], is_full_sentence(t, s, e, "\n" in after)))
                    docs.append(content_words(t, s, e))
            best, conf = nb.score(docs)
            return rows, [languages[k] if k >= 0 else None for k in best], conf

        return run


def classify_units(
    df: DataFrame, id_col: str = "sent_id", text_col: str = "text", label_col: str = "language",
    per_language: int = 1000,
) -> DataFrame:
    """id, char_start, char_end, language, confidence, full_sentence of every sentence unit of every text."""
    models = Classifier(df, id_col, text_col, label_col, per_language)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = models.load()
        for big in batches:
            for at in range(0, len(big), 1000):
                b = big.iloc[at : at + 1000]
                rows, language, conf = classify(b["t"].tolist())
                out = pd.DataFrame(rows, columns=["id", "char_start", "char_end", "full_sentence"])
                out["id"] = b["id"].to_numpy()[out["id"].to_numpy(dtype=np.int64)]
                out["language"], out["confidence"] = language, conf
                yield out[["id", "char_start", "char_end", "language", "confidence", "full_sentence"]]

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter(r"t rlike '\\S'")
    out = rows.mapInPandas(run, f"id {kind}, char_start int, char_end int, language string, confidence double, full_sentence boolean")
    return out.withColumnRenamed("id", id_col)


def classify_texts(
    df: DataFrame, keep: dict[str, Column], id_col: str = "sent_id", text_col: str = "text", label_col: str = "language", per_language: int = 1000,
) -> DataFrame:
    """Every row of ``df`` with the columns ``keep`` and found string, confidence double, languages and full array<string>.

    ``found`` is the language with the most characters (null if there is none), ``confidence`` that of its
    units times its share of the text, ``languages`` those of all units and ``full`` those of full
    sentences. A text stays in its row, so nothing is shuffled or joined.
    """
    models = Classifier(df, id_col, text_col, label_col, per_language)
    rows = df.select(F.col(text_col).alias("_t"), *[c.alias(n) for n, c in keep.items()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = models.load()
        for big in batches:
            for at in range(0, len(big), 1000):
                b = big.iloc[at : at + 1000]
                units, language, conf = classify([t if isinstance(t, str) else "" for t in b["_t"]])
                per: list[dict[str, list[float]]] = [{} for _ in range(len(b))]
                full: list[set[str]] = [set() for _ in range(len(b))]
                total = [0] * len(b)
                for (i, s, e, whole), x, c in zip(units, language, conf.tolist(), strict=True):
                    total[i] += e - s
                    if x is not None:
                        cell = per[i].setdefault(x, [0, 0.0])
                        cell[0] += e - s
                        cell[1] += c * (e - s)
                        if whole:
                            full[i].add(x)
                best = [max(p, key=lambda x, p=p: (p[x][0], p[x][1])) if p else None for p in per]
                out = b.drop(columns="_t")
                out["found"] = best
                out["confidence"] = [p[x][1] / n if x else 0.0 for x, p, n in zip(best, per, total, strict=True)]
                out["languages"], out["full"] = [sorted(p) for p in per], [sorted(f) for f in full]
                yield out

    kinds = rows.drop("_t")._jdf.schema().toDDL()
    return rows.mapInPandas(run, f"{kinds}, found string, confidence double, languages array<string>, full array<string>")


def segments(units_: DataFrame, id_col: str = "sent_id") -> DataFrame:
    """Runs of units of one language: id, segment, char_start, char_end, language, confidence (mean by length)."""
    u = F.array_sort(F.collect_list(F.struct("char_start", "char_end", "language", "confidence")))
    zero = F.filter(F.col("u"), lambda x: F.lit(False))
    per = units_.groupBy(id_col).agg(u.alias("u"))
    merged = F.aggregate(
        "u", zero,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & F.try_element_at(acc, F.lit(-1))["language"].eqNullSafe(x["language"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(_joined(F.try_element_at(acc, F.lit(-1)), x))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return per.select(id_col, F.posexplode(merged).alias("segment", "s")).select(id_col, "segment", "s.*")


def _joined(a: Column, b: Column) -> Column:
    la, lb = a["char_end"] - a["char_start"], b["char_end"] - b["char_start"]
    conf = (a["confidence"] * la + b["confidence"] * lb) / (la + lb)
    return F.struct(a["char_start"].alias("char_start"), b["char_end"].alias("char_end"), a["language"].alias("language"), conf.alias("confidence"))


def text_languages(units_: DataFrame, id_col: str = "sent_id") -> DataFrame:
    """id, language, confidence: the language with the most characters in each text."""
    size = F.col("char_end") - F.col("char_start")
    per = units_.groupBy(id_col, "language").agg(F.sum(size).alias("n"), (F.sum(F.col("confidence") * size) / F.sum(size)).alias("c"))
    top = F.max_by(F.struct("language", "c"), F.struct(F.col("language").isNotNull(), "n", "c"))
    return per.groupBy(id_col).agg(top.alias("t"), F.sum("n").alias("all"), F.max(F.when(F.col("language").isNotNull(), F.col("n"))).alias("most")).select(
        id_col, F.col("t.language").alias("language"), F.coalesce(F.col("t.c") * F.col("most") / F.col("all"), F.lit(0.0)).alias("confidence")
    )


def mislabelled(df: DataFrame, id_col: str = "sent_id", text_col: str = "text", label_col: str = "language", **options) -> DataFrame:
    """(id, language) for every language of the full sentences of rows whose label is missing, wrong or too little."""
    t = classify_texts(df, {id_col: F.col(id_col), "_label": label_code(F.col(label_col))}, id_col, text_col, label_col, **options).filter("size(full) > 0")
    wrong = t.filter(F.col("_label").isNull() | ~F.array_contains("full", F.coalesce("_label", F.lit(""))) | (F.size("full") > 1))
    return wrong.select(id_col, F.explode("full").alias("language")).distinct()
