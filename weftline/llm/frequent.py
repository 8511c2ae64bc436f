"""Problem 5: the most frequent values of a column in bounded memory.

A majority-vote sketch of ``depth`` rows of ``width`` cells. A cell keeps the total of what was
hashed to it, a candidate and the candidate's vote surplus; two cells merge by vote cancellation.
For a value x and any row, with the cell's total V, candidate K and surplus C:

* upper bound: (V + C) / 2 if K = x, else (V - C) / 2; the smallest over the rows holds,
* lower bound: C if K = x, else 0; the largest over the rows holds.

Each task keeps one sketch, whatever it reads; the merge keeps one sketch as well, because partial
cells are merged in a stream. Values are counted as 64-bit hashes; the keys of the current candidates,
at most width * depth, travel with their cells, so that bounds need no second pass.

Completeness is certified, not assumed: a value that is nobody's candidate in a row counts at most
(V - C) / 2 of its cell there. If that is below the threshold for all cells of some row, the
candidates of that row hold every frequent value. Otherwise the sketch is built again, twice as
wide and with other hash functions, up to ``most_width``; what cannot be certified even then (a share
near 1 / most_width or below) is counted by an exact grouping, which shuffles and spills instead of
holding memory.

Defined results: rows with a null in any key column are not counted; empty strings are values;
values at exactly the threshold are frequent; an empty table gives no rows; ties are all reported;
other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
CELL = "cell int, v bigint, k bigint, c bigint"


def _cells(h: np.ndarray, row: int, width: int, seed: int) -> np.ndarray:
    x = h.view(np.uint64) ^ np.uint64((_MIX[(row + 3 * seed) % 8] * (2 * seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX[row % 8])
    x ^= x >> np.uint64(29)
    return row * width + (x % np.uint64(width)).astype(np.int64)


class Sketch:
    """The cells of all rows, laid out one row after another."""

    def __init__(self, width: int, depth: int, seed: int = 0):
        self.width, self.depth, self.seed = width, depth, seed
        self.v, self.k, self.c = (np.zeros(width * depth, dtype=np.int64) for _ in range(3))

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        """Count distinct hashes ``h`` with their weights ``n``."""
        for row in range(self.depth):
            cell = _cells(h, row, self.width, self.seed)
            order = np.lexsort((h, -n, cell))
            cs, hs, ns = cell[order], h[order], n[order]
            first = np.flatnonzero(np.r_[True, cs[1:] != cs[:-1]])
            total = np.add.reduceat(ns, first)
            # inside a batch the leader's votes are cancelled by all others
            self.merge(cs[first], total, hs[first], np.maximum(2 * ns[first] - total, 0))

    def merge(self, cell: np.ndarray, v: np.ndarray, k: np.ndarray, c: np.ndarray) -> None:
        """Merge cells (each at most once in ``cell``) by vote cancellation."""
        k0, c0 = self.k[cell], self.c[cell]
        same = k0 == k
        self.k[cell] = np.where(same | (c0 >= c), k0, k)
        self.c[cell] = np.where(same, c0 + c, np.abs(c0 - c))
        self.v[cell] += v

    def frame(self) -> pd.DataFrame:
        used = np.flatnonzero(self.v)
        return pd.DataFrame({"cell": used.astype(np.int32), "v": self.v[used], "k": self.k[used], "c": self.c[used]})

    def bounds(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the counts of ``h``."""
        lower, upper = np.zeros(len(h), dtype=np.int64), np.full(len(h), np.iinfo(np.int64).max)
        for row in range(self.depth):
            cell = _cells(h, row, self.width, self.seed)
            v, c, own = self.v[cell], self.c[cell], self.k[cell] == h
            lower = np.maximum(lower, np.where(own, c, 0))
            upper = np.minimum(upper, np.where(own, v + c, v - c) // 2)
        return lower, upper

    def complete_above(self) -> int:
        """Every value counted more often than this is the candidate of a cell."""
        return int(((self.v - self.c) // 2).reshape(self.depth, self.width).max(axis=1).min())


class Candidates(dict):
    """The keys of the candidates of a sketch, by hash."""

    def note(self, sketch: Sketch, h: np.ndarray, keys: pd.DataFrame) -> None:
        """Take the keys of those hashes that are candidates now; forget the others once they outnumber the cells."""
        at = np.flatnonzero(np.isin(h, sketch.k))
        for x, row in zip(h[at].tolist(), keys.iloc[at].itertuples(index=False, name=None), strict=True):
            self.setdefault(x, row)
        if len(self) > 2 * len(sketch.k):
            now = set(sketch.k.tolist())
            for x in [x for x in self if x not in now]:
                del self[x]

    def frame(self, sketch: Sketch, names: list[str]) -> pd.DataFrame:
        out = sketch.frame()
        rows = [self.get(x) or (None,) * len(names) for x in out["k"].tolist()]
        for i, n in enumerate(names):
            out[n] = pd.Series([r[i] for r in rows], index=out.index, dtype=object)
        return out


def build_sketch(hashes: DataFrame, width: int, depth: int, seed: int = 0) -> tuple[Sketch, Candidates]:
    """The sketch of column ``h`` (bigint) of ``hashes`` and the other columns of its candidates."""
    keys = hashes.drop("h")
    names = [f"key{i}" for i in range(len(keys.columns))]
    hashes = hashes.select("h", *[F.col(c).alias(n) for c, n in zip(keys.columns, names, strict=True)])
    schema = f"{CELL}, {hashes.drop('h')._jdf.schema().toDDL()}" if names else CELL

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, known = Sketch(width, depth, seed), Candidates()
        for b in batches:
            h, first, n = np.unique(b["h"].to_numpy(), return_index=True, return_counts=True)
            if len(h):
                s.add(h, n.astype(np.int64))
                known.note(s, h, b[names].iloc[first])
        yield known.frame(s, names)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, known = Sketch(width, depth, seed), Candidates()
        for b in batches:
            nth = b.groupby("cell").cumcount().to_numpy()
            for i in range(int(nth.max(initial=-1)) + 1):
                p = b[nth == i]
                s.merge(*(p[x].to_numpy(dtype=np.int64) for x in ("cell", "v", "k", "c")))
                known.note(s, p["k"].to_numpy(dtype=np.int64), p[names])
        yield known.frame(s, names)

    spark = hashes.sparkSession
    parts = min(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = hashes.mapInPandas(local, schema).repartition(parts, "cell").mapInPandas(merged, schema)
    out, known = Sketch(width, depth, seed), Candidates()
    got = cells.toPandas()  # at most width * depth rows
    out.merge(*(got[x].to_numpy(dtype=np.int64) for x in ("cell", "v", "k", "c")))
    known.note(out, got["k"].to_numpy(dtype=np.int64), got[names])
    return out, known


def heavy_hitters(df: DataFrame, keys: list[str], share: float, width: int = 4096, depth: int = 4, exact: bool = True, most_width: int = 1 << 18) -> DataFrame:
    """Values of ``keys`` that may hold at least ``share`` of the rows without nulls in ``keys``.

    Columns: the keys, ``lower``, ``upper`` and, with ``exact=True``, ``n`` from a second pass that
    counts the candidates only; then rows below the threshold are gone.
    """
    spark = df.sparkSession
    rows = df.select(*keys).na.drop("any")
    hashed = rows.withColumn("h", F.xxhash64(*keys))
    seed = 0
    while True:
        s, known = build_sketch(hashed, width, depth, seed)
        total = int(s.v.reshape(depth, width).sum(axis=1)[0])
        least = math.ceil(Fraction(str(share)) * total)
        if total == 0 or s.complete_above() < least:
            break
        if 2 * width > most_width:
            n = F.col("n")
            return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(n >= least).select(*keys, *([n] if exact else []), n.alias("lower"), n.alias("upper"))
        width, seed = 2 * width, seed + 1
    found = np.unique(s.k[s.v > 0])
    lower, upper = s.bounds(found)
    keep = upper >= max(least, 1)
    pdf = pd.DataFrame({"h": found[keep], "lower": lower[keep], "upper": upper[keep]})
    if not exact:
        for i, k in enumerate(keys):
            pdf[k] = pd.Series([known[x][i] for x in pdf["h"].tolist()], dtype=object)
        schema = ", ".join([rows._jdf.schema().toDDL(), "lower bigint", "upper bigint"])
        return spark.createDataFrame(pdf[[*keys, "lower", "upper"]].values.tolist(), schema)
    candidates = spark.createDataFrame(pdf, "h bigint, lower bigint, upper bigint")
    hits = hashed.join(F.broadcast(candidates), "h")  # at most width * depth rows
    out = hits.groupBy(*keys).agg(F.count("*").alias("n"), F.first("lower").alias("lower"), F.first("upper").alias("upper"))
    return out.filter(F.col("n") >= F.lit(least))
