"""Sharding by extendible hashing. DataFrame functions only.

A document's key hashes to 32 bits. The directory maps hash prefixes to shards: it starts with one bucket
of no bits, and only a bucket over the byte limit splits, on one more bit, until each fits. A document's
shard is thus the shortest prefix of its hash whose bucket fits.

Bytes are summed with map-side combining to cells of the depth that the total asks for; shorter prefixes
are sums of cells, and only cells still over the limit are summed again, deeper. The directory, its
entries spread to the cells' depth, stays a table that rows join by cell; it is never collected.

Rows that share a key share a hash, so no bit splits a 32-bit bucket that is over the limit (a key with a
third of all rows, say). Its rows are dealt over lanes and cut there by running bytes, lane by lane.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

BITS = 32
STEP = 4


def key_hash(doc_id: str = "doc_id") -> Column:
    """32 bits of the MD5 of the key's text; rows without a key hash as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def directory(sized: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """sized(h, bytes) -> [(cell depth, entries(cell, depth, prefix, shard_bytes))]; each hash meets one entry.

    A bucket of 32 bits ends up in the directory whether it fits or not.
    """
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    above, depth = -1, min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + STEP)
    out, rows = [], sized
    while True:
        cells = rows.groupBy(F.shiftright("h", BITS - depth).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        cells = materialise(cells, "cells")
        levels = F.array(*[
            F.struct(F.lit(d).alias("depth"), F.shiftright("cell", depth - d).alias("prefix")) for d in range(max(above, 0), depth + 1)
        ])
        each = cells.select("cell", "bytes", F.inline(levels))
        sums = each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
        fits = F.col("shard_bytes") <= limit
        if depth == BITS:
            fits = fits | (F.col("depth") == BITS)
        # the least depth at which a cell's bucket fits; what fitted above is not among these rows
        entries = (
            each.join(sums.where(fits & (F.col("depth") > above)), ["depth", "prefix"])
            .groupBy("cell")
            .agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("entry"))
            .select("cell", "entry.*")
        )
        out.append((depth, entries))
        if depth == BITS:
            return out
        deeper = cells.where(F.col("bytes") > limit).select(F.col("cell").alias("up"))
        if deeper.isEmpty():
            return out
        rows = rows.join(deeper, F.shiftright("h", BITS - depth) == F.col("up"), "left_semi")
        above, depth = depth, min(BITS, depth + 2 * STEP)


def assign(docs: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """documents -> (doc_id, bytes, depth, shard, shard_bytes), a row per row.

    bytes is the UTF-8 length of the text; null counts 0. shard is the hash prefix as ``depth`` bits ("" if
    all fits in one), with ".lane.part" added in 32-bit buckets over the limit; shard_bytes is the sum of
    the shard. A shard is over the limit only if it is one row that is. An empty table gives no rows.
    Columns other than doc_id and text are not read.
    """
    sized = docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("bytes"), key_hash().alias("h"))
    sized = materialise(sized.withColumn("row", F.monotonically_increasing_id()), "sized")  # written, so row stays the same
    found = None
    for depth, entries in directory(sized.select("h", "bytes"), limit):
        rows = sized.withColumn("cell", F.shiftright("h", BITS - depth)).join(entries, "cell").drop("cell")
        found = rows if found is None else found.unionByName(rows)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), BITS, "0"))
    named = found.withColumn("shard", F.when(F.col("depth") == 0, "").otherwise(F.right(bits, F.col("depth"))))
    columns = ("doc_id", "bytes", "depth", "shard", "shard_bytes")
    fit = named.where(F.col("shard_bytes") <= limit).select(*columns)

    # buckets of one hash over the limit: 64 limits a lane; pieces of half a limit, larger rows alone
    wide = named.where(F.col("shard_bytes") > limit)
    lanes = F.ceil(F.col("shard_bytes") / F.lit(64 * limit))
    wide = wide.withColumn("lane", F.pmod(F.xxhash64("row"), lanes))
    small = F.col("bytes") * 2 <= limit
    before = Window.partitionBy("shard", "lane").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum(F.when(small, F.col("bytes")).otherwise(0)).over(before), F.lit(0))
    part = F.when(small, F.floor(running * 2 / F.lit(limit)).cast("string")).otherwise(F.concat(F.lit("r"), F.col("row").cast("string")))
    cut = wide.withColumn("shard", F.concat_ws(".", "shard", F.col("lane").cast("string"), part))
    sums = cut.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    return fit.unionByName(cut.drop("shard_bytes").join(sums, "shard").select(*columns))


def oracle(limit: int = 1 << 20) -> str:
    """The same shards in SQL, for tables without a 32-bit bucket over the limit."""
    return f"""
WITH sized AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM documents),
levels AS (SELECT doc_id, bytes, h, CAST(d AS INTEGER) AS depth, h >> ({BITS} - d) AS prefix FROM sized, range(0, {BITS + 1}) r(d)),
sums AS (SELECT depth, prefix, CAST(sum(bytes) AS BIGINT) AS shard_bytes FROM levels GROUP BY depth, prefix),
fitting AS (
  SELECT l.doc_id, l.bytes, l.depth, l.prefix, s.shard_bytes, min(l.depth) OVER (PARTITION BY l.doc_id) AS least
  FROM levels l JOIN sums s ON l.depth = s.depth AND l.prefix = s.prefix WHERE s.shard_bytes <= {limit})
SELECT doc_id, bytes, depth, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), {BITS}, '0'), depth) END AS shard, shard_bytes
FROM fitting WHERE depth = least
"""
