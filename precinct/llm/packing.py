"""Packing by optimal length buckets.

One aggregation gives the histogram of token counts over all documents; dynamic programming over it chooses at most
`n_buckets` upper bounds that make the padded total least, exactly. Distinct counts are at most the root of twice all tokens, so the histogram is small.
Documents stay whole. Batches form inside each bucket, in ascending doc_id order, of as many documents as the token
budget holds at the bucket's length, at least one.

Null and empty texts have 0 tokens and go to the lowest bucket. Equal ids and lengths are placed side by side; an
empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from precinct.blocks.shared import materialize

N_BUCKETS = 16
TOKEN_BUDGET = 65_536


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def optimal_bounds(lengths: list[int], counts: list[int], k: int) -> list[int]:
    """The at most k upper bounds, ascending, with the least padded total. Lines through (documents before,
    cost so far) and a lower hull make each layer linear."""
    m = len(lengths)
    if not m:
        return []
    before = [0]
    for c in counts:
        before.append(before[-1] + c)
    cost = [0] + [None] * m  # of the first i lengths, with the layers so far
    came: list[list[int]] = []
    best, layers = None, 0
    for layer in range(1, min(k, m) + 1):
        hull: list[tuple[int, int, int]] = []  # slope -before[i], intercept cost[i], i
        new, back, head = [None] * (m + 1), [0] * (m + 1), 0
        for j in range(1, m + 1):
            i = j - 1
            if cost[i] is not None:
                slope, at = -before[i], cost[i]
                while len(hull) - head >= 2 and (at - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                    hull.pop()
                hull.append((slope, at, i))
            x = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if head < len(hull):
                new[j] = hull[head][0] * x + hull[head][1] + x * before[j]
                back[j] = hull[head][2]
        came.append(back)
        cost = [None] + new[1:]
        if best is None or new[m] < best:
            best, layers = new[m], layer
    out, j = [], m
    for layer in range(layers, 0, -1):
        out.append(lengths[j - 1])
        j = came[layer - 1][j]
    return out[::-1]


def pack(docs: DataFrame, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET, length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch (number within the bucket), slot, pad (tokens of padding)."""
    spark = docs.sparkSession
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (word_count(F.col("text")) if length is None else length).alias("n_tokens"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("doc_id").asc_nulls_first()
    rows = materialize(counted.repartitionByRange(n, key).withColumns({"part": F.spark_partition_id(), "len": F.col("n_tokens")}), "packing")
    found = sorted((r["len"], r["n"]) for r in rows.groupBy("len").agg(F.count("*").alias("n")).collect())  # a row for each distinct length
    bounds = optimal_bounds([a for a, _ in found], [b for _, b in found], n_buckets)
    if not bounds:
        bounds = [0]
    of = {a: bisect_left(bounds, a) for a, _ in found}
    assert all(k < len(bounds) for k in of.values())
    bucket = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("len") <= bounds[k], k).otherwise(bucket)
    placed = rows.select("doc_id", "n_tokens", "part", bucket.alias("bucket"))
    # Where each part's share of a bucket begins: a row for each part and bucket, not for each document.
    shares = placed.groupBy("part", "bucket").agg(F.count("*").alias("n"))
    begins = shares.select("part", "bucket", (F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part", "bucket").orderBy(key, "n_tokens")) - 1
    bound = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    room = F.greatest(F.floor(F.lit(token_budget) / F.greatest(bound, F.lit(1))), F.lit(1)).cast("long")
    at = F.col("base") + F.col("rank")
    return (
        placed.withColumn("rank", rank).join(begins, ["part", "bucket"])
        .select("doc_id", "n_tokens", "bucket", bound.alias("bucket_len"), F.floor(at / room).cast("long").alias("batch"), (at % room).alias("slot"), (bound - F.col("n_tokens")).alias("pad"))
    )
