"""Problem 7: items of varying length in containers of fixed capacity.

Cost-balanced packing: an item of n tokens costs n (linear layers) plus n * n / quadratic (attention).
Items are taken in descending length and go to the container with the lowest cost so far that still
has room; a container is opened only when none has. Items beyond the capacity are cut into full
containers and a remainder, the only items that are divided.

Sizes are computed once, without a shuffle, and written; what is shuffled afterwards is an id and a
number per item. Shards of about ``shard_tokens`` tokens are packed independently; they are formed by
a hash of the id, so no key can be hot, and each wastes at most part of its last containers.

Defined results: null and empty texts have no tokens and are placed nowhere; equal lengths are taken
in order of id; repeated ids are told apart by their text and their number; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import PieceCounts, default_vocabulary
from weftline.session import written


def text_sizes(df: DataFrame, id_col: str, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, h, n_tokens) per row; ``h`` is a hash of the text."""
    path = vocabulary or default_vocabulary()
    kind = dict(df.dtypes)[id_col]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(path)
        for b in batches:
            n = pa.array([counts.count(t) if t else 0 for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["id", "h", "n_tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col))
    return rows.mapInArrow(sizes, f"id {kind}, h bigint, n_tokens bigint")


def pack_items(sizes: list[int], capacity: int, quadratic: int) -> list[tuple[int, int, int, int]]:
    """(item, container, offset, tokens) for sizes in descending order.

    As many containers as the total needs are open from the start; a further one is opened only for
    an item that fits into none.
    """
    out: list[tuple[int, int, int, int]] = []
    parts: list[tuple[int, int]] = []
    whole = 0
    for k, n in enumerate(sizes):
        while n > capacity:
            out.append((k, whole, 0, capacity))
            whole, n = whole + 1, n - capacity
        if n > 0:
            parts.append((n, k))
    parts.sort(key=lambda x: (-x[0], x[1]))
    planned = -(-sum(n for n, _ in parts) // capacity) if parts else 0
    # Containers by cost; those too full for the current length are parked by room, since lengths only fall.
    heap = [(0.0, i) for i in range(planned)]
    room, cost = [capacity] * planned, [0.0] * planned
    parked: list[tuple[int, int]] = []
    for n, k in parts:
        while parked and parked[-1][0] >= n:
            r, i = parked.pop()
            heapq.heappush(heap, (cost[i], i))
        while heap and room[heap[0][1]] < n:
            i = heapq.heappop(heap)[1]
            if room[i]:
                insort(parked, (room[i], i))
        if heap:
            i = heapq.heappop(heap)[1]
        else:
            i = len(room)
            room.append(capacity)
            cost.append(0.0)
        out.append((k, whole + i, capacity - room[i], n))
        room[i] -= n
        cost[i] += n + n * n / quadratic
        if room[i] >= n:
            heapq.heappush(heap, (cost[i], i))
        elif room[i]:
            insort(parked, (room[i], i))
    return out


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, quadratic: int = 4096,
    shard_tokens: int = 16_000_000, vocabulary: str | None = None,
) -> DataFrame:
    """id, part, shard, container, position, n_tokens: where every item (or part of an oversized item) lies.

    ``container`` counts within ``shard``; ``position`` is the token offset inside the container.
    """
    sizes = written(text_sizes(df, id_col, text_col, vocabulary).filter("n_tokens > 0"), "sizes")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, round(total / shard_tokens))
    kind = dict(df.dtypes)[id_col]

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "h"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        got = pd.DataFrame(pack_items(pdf["n_tokens"].tolist(), capacity, quadratic), columns=["k", "container", "position", "n_tokens"])
        got["part"] = got.groupby("k").cumcount()
        got["id"] = pdf["id"].to_numpy()[got["k"].to_numpy()]
        got["shard"] = key[0]
        return got[["id", "part", "shard", "container", "position", "n_tokens"]]

    shard = F.pmod(F.xxhash64("id", "h"), F.lit(shards)).cast("int").alias("shard")
    out = sizes.select("id", "h", "n_tokens", shard).groupBy("shard").applyInPandas(place, f"id {kind}, part int, shard int, container int, position int, n_tokens int")
    return out.withColumnRenamed("id", id_col)
