"""A backend over stored vectors: dot product, sigmoid, arg-max."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.spans import sigmoid


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def dot_scores(vectors: DataFrame, labels: DataFrame, block: int = 10_000) -> DataFrame:
    """vec_id, q_id, dot, score of every vector with every label vector.

    Label vectors are a stated query set; they go out in blocks of at most ``block`` rows.
    """
    rows = labels.select("q_id", "b")
    n = rows.count()
    blocks = max(1, -(-n // block))
    out = None
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == k)
        x = vectors.join(F.broadcast(part)).withColumn("x", dot(F.col("embedding"), F.col("b")))
        x = x.select("vec_id", "q_id", F.round("x", 6).alias("dot"), F.round(sigmoid(F.col("x")), 6).alias("score"))
        out = x if out is None else out.unionByName(x)
    return out
