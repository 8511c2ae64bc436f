"""Problem 6: how many tokens each source, language and domain holds under an existing tokenizer.

Texts are split into pieces by the tokenizer's pattern inside the JVM and counted per slice before
anything is shuffled by piece, so the shuffled data grows with the vocabulary, not with the corpus.
Distinct pieces are partitioned into ranges of their order and sorted, which makes each partition a
prefix trie in depth-first order: neighbours share prefixes. Walking it, the exact tokenization state
(last token and number of tokens of every prefix) is kept on a stack and only the part beyond the
shared prefix is computed. Terminal counts are joined back to slices or documents.

The state is exact: the encoding of a prefix ends in the one token t for which the encoding of what
precedes t ends in a token that forms a valid pair with t (a pair whose joint encoding is itself).

Defined results: null and empty texts have 0 tokens; a language that is null, blank or names none is
replaced by the one found in the text, 'und' if there is none; a domain that is null or blank is
'unknown'; repeated texts all count; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import language
from weftline.llm.tokens import default_vocabulary, ranks
from weftline.session import written

#: The tokenizer's splitting pattern for Java, with Unicode classes.
JAVA_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Merges:
    """Byte-pair merges of short strings and the validity of token pairs."""

    def __init__(self, path: str):
        self.rank = ranks(path)
        self.longest = max(map(len, self.rank))
        self.valid = lru_cache(maxsize=1 << 20)(self._valid)
        self.sound = lru_cache(maxsize=1 << 17)(lambda t: self.encode(t) == [t])

    def encode(self, s: bytes) -> list[bytes]:
        parts = [s[i : i + 1] for i in range(len(s))]
        get, none = self.rank.get, 1 << 60
        while len(parts) > 1:
            best, at = min((get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if best == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _valid(self, a: bytes, b: bytes) -> bool:
        return self.encode(a + b) == [a, b]


class TrieWalk:
    """Token counts of sorted strings; what a string shares with the one before is not tokenized again."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.path = b""
        self.last: list[bytes] = [b""]
        self.count: list[int] = [0]

    def tokens(self, s: bytes) -> int:
        m, old = self.m, self.path
        k, n = 0, min(len(old), len(s))
        while k < n and old[k] == s[k]:
            k += 1
        last, count, rank = self.last, self.count, m.rank
        del last[k + 1 :], count[k + 1 :]
        for i in range(k + 1, len(s) + 1):
            for j in range(max(0, i - m.longest), i):
                t = s[j:i]
                if t in rank and m.sound(t) and (j == 0 or m.valid(last[j], t)):
                    last.append(t)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
        self.path = s
        return 1 if s in rank else count[len(s)]


def piece_tokens(pieces: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(piece, n_tokens) of distinct ``piece`` strings by prefix tries, one for each range of pieces in their order.

    Ranges are cut by number, so a prefix that many pieces share is cut as well.
    """
    path = vocabulary or default_vocabulary()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = TrieWalk(Merges(path))
        for b in batches:
            yield pd.DataFrame({"piece": b["piece"], "n_tokens": [w.tokens(p.encode()) for p in b["piece"]]})

    ranges = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces.sparkSession.sparkContext.defaultParallelism)
    spread = pieces.select("piece").repartitionByRange(ranges, "piece").sortWithinPartitions("piece")
    return spread.mapInPandas(walk, "piece string, n_tokens bigint")


def _exploded(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    return df.select(*keep, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(JAVA_PATTERN), F.lit(0))).alias("piece"))


def slice_tokens(df: DataFrame, by: list[str], text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``by``, n_texts, n_tokens: totals of every combination of ``by`` (nulls are a value of their own)."""
    counted = written(_exploded(df, by, text_col).groupBy(*by, "piece").agg(F.count("*").alias("n")), "pieces")
    counts = piece_tokens(written(counted.select("piece").distinct(), "distinct"), vocabulary)
    totals = counted.join(counts, "piece").groupBy(*by).agg(F.sum(F.col("n") * F.col("n_tokens")).alias("n_tokens"))
    texts = df.groupBy(*by).agg(F.count("*").alias("n_texts"))
    same = [texts[b].eqNullSafe(totals[b]) for b in by]
    joined = texts.join(totals, same, "left")
    return joined.select(*[texts[b] for b in by], "n_texts", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))


def document_tokens(df: DataFrame, id_col: str, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens) of every document.

    A piece that occurs in most documents would make one huge join key; its rows are spread over
    ``salt`` copies of its count.
    """
    salt = 16
    pieces = _exploded(df, [id_col], text_col).groupBy(id_col, "piece").agg(F.count("*").alias("n"))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(salt)).cast("int"))
    counts = piece_tokens(written(_exploded(df, [], text_col).distinct(), "distinct"), vocabulary)
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    sums = pieces.join(counts, ["piece", "salt"]).groupBy(id_col).agg(F.sum(F.col("n") * F.col("n_tokens")).alias("n_tokens"))
    every = df.select(id_col)
    return every.join(sums, id_col, "left").select(id_col, F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))


def token_budget(
    df: DataFrame, id_col: str = "sent_id", text_col: str = "text", source_col: str = "source",
    label_col: str = "language", domain_col: str = "domain", vocabulary: str | None = None,
) -> DataFrame:
    """source, language, domain, n_texts, n_tokens. The label counts where it fits the text, else the language found."""
    keep = {
        "source": F.col(source_col), "_label": language.label_code(F.col(label_col)), "domain": F.coalesce(F.when(F.trim(domain_col) != "", F.col(domain_col)), F.lit("unknown")), "text": F.col(text_col),
    }
    rows = language.classify_texts(df, keep, id_col, text_col, label_col)
    fits = F.array_contains("languages", F.coalesce("_label", F.lit("")))
    code = F.coalesce(F.when(fits, F.col("_label")), F.col("found"), F.col("_label"), F.lit("und"))
    d = written(rows.select("source", code.alias("language"), "domain", "text"), "labelled")
    return slice_tokens(d, ["source", "language", "domain"], "text", vocabulary)
