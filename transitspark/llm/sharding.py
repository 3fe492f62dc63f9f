"""A uniform shuffle into shards of exact size, in DataFrame expressions only.

Rows lie in blocks. How many rows each block sends to each shard is drawn first: the rows of the
communication matrix follow the multivariate hypergeometric law, so the counts are those of a uniform
permutation and the shard sizes are exact. Then every block is permuted on its own and dealt out by its
row of the matrix, and every shard is permuted again.

The matrix has blocks * shards cells and is drawn by the driver; there are `BLOCKS` blocks, or as many more as
keep them to about `BLOCK_ROWS` rows, so 10 billion rows and 40 shards are 100,000 cells. Ranks are counted on
row numbers alone, in shards in buckets of a random key, so no task sorts more than about `BLOCK_ROWS` of
them; the columns are joined to their places once, by row number.

Defined results: every row gets one place, repeated rows too; null texts have size 16 and the checksum of
an empty text; ids may be null; an empty table gives no rows; `shuffled` carries all columns along, but for its own `shard` and `slot`.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitspark.session import local_rows, rewritten

SHARDS, BLOCKS, BLOCK_ROWS, SEED = 40, 64, 4_000_000, 20_240_517


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """How many of `draws` without replacement are good, from a uniform u: inversion outward from the mode."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo >= hi:
        return lo
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = x = y = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = q = math.exp(choose(good, x) + choose(bad, draws - x) - choose(good + bad, draws))
    u -= p
    while u > 0 and (x > lo or y < hi):
        if y < hi:
            q *= (good - y) * (draws - y) / ((y + 1) * (bad - draws + y + 1))
            y += 1
            u -= q
            if u <= 0:
                return y
        if x > lo:
            p *= x * (bad - draws + x) / ((good - x + 1) * (draws - x + 1))
            x -= 1
            u -= p
            if u <= 0:
                return x
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """matrix[b][s]: rows that block b sends to shard s, drawn as a uniform permutation would."""
    draw, left = random.Random(seed), list(shards)
    matrix = []
    for size in blocks:
        row, rest, total = [], size, sum(left)
        for capacity in left:
            take = hypergeometric(capacity, total - capacity, rest, draw.random())
            row.append(take)
            rest -= take
            total -= capacity
        left = [a - b for a, b in zip(left, row)]
        matrix.append(row)
    return matrix


def even_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _ranked(df: DataFrame, by: str, key: Column, buckets: int, name: str) -> DataFrame:
    """`name`: the rank from 0 of each row within `by` in the order of a random key."""
    df = df.withColumn("_key", key).withColumn("_part", F.shiftrightunsigned("_key", 40) % buckets)
    before = df.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(by, "_part").orderBy("_key", "_row")) - 1
    return df.withColumn("_inside", inside).join(before, [by, "_part"]).withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_inside")).drop("_key", "_part", "_inside", "_before")


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The columns of `docs`, `shard` and `slot`: shards differ by one row at most, slots run from 0 without gaps.

    Rows are numbered as they are read and then written once, so a lost executor cannot number them anew.
    """
    spark = docs.sparkSession
    data = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")])
    kept = rewritten(docs.select(data.alias("_data"), F.monotonically_increasing_id().alias("_row")), "rows")
    total = kept.count()
    blocks = max(1, min(total, BLOCKS), -(-total // block_rows))
    rows = kept.select("_row").withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(blocks)).cast("int"))
    sizes = dict(rows.groupBy("_block").count().collect())
    matrix = communication_matrix([sizes.get(b, 0) for b in range(blocks)], even_sizes(total, shards), seed)
    ends = []
    for b, row in enumerate(matrix):
        at, upto = 0, []
        for n in row:
            at += n
            upto.append(at)
        ends.append((b, upto))
    bounds = local_rows(spark, T.StructType([T.StructField("_block", T.IntegerType()), T.StructField("_ends", T.ArrayType(T.LongType()))]), ends)
    first = _ranked(rows, "_block", F.xxhash64(F.lit(seed + 1), "_row"), 1, "_rank")
    dealt = first.join(bounds, "_block").withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int")).drop("_ends", "_block", "_rank")
    buckets = max(1, -(-total // shards // block_rows))
    places = _ranked(dealt, "shard", F.xxhash64(F.lit(seed + 2), "_row"), buckets, "slot").select("_row", "shard", F.col("slot").cast("long").alias("slot"))
    return kept.join(places, "_row").select("_data.*", "shard", "slot")


def shard_digests(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is `rows`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffled(slim, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
