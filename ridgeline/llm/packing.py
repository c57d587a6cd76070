"""Best-fit packing by large-item matching.

Texts become token ids and an end id; only longer ones are cut, at the capacity. Pieces above a third
of the capacity pair at most twice a sequence, by greedy matching (the longest takes the longest that
fits); shorter ones then go, longest first, each to the fullest sequence that still has room.

Lengths are whole numbers up to the capacity, so packing needs only a histogram of at most ``capacity``
rows, whatever the corpus: the driver packs counts of lengths, not documents, and emits runs "the
r-th to s-th pieces of length l go to sequences from q, k in each, from offset o on". Pieces get
their rank among equal lengths from bucket counts and a window per bucket, and join the runs.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty
from .tokenize import encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, salt long"
END = (0).to_bytes(4, "little")


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of packed ids."""
    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
        part = ids[at : at + 4 * capacity]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """documents -> one row per piece. Null texts count as empty: one piece, the end id alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, salt = encoder(vocabulary).encode, 0
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].astype("Int64"), encode(batch["text"].tolist())):
                for part in cut(ids + END, capacity):
                    rows.append((doc_id, *part, salt))
                    salt += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text")).mapInPandas(run, PIECES)


def plan(counts: dict[int, int], capacity: int = 2048) -> tuple[list[tuple], int]:
    """Runs (length, first, last, sequence, per_sequence, offset) and the number of sequences.

    Ranks first..last (inclusive, from 0) of a length fill sequences from ``sequence`` on.
    """
    left = {length: n for length, n in counts.items() if n}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple] = []
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, number)]
    sequences = 0

    def put(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n - 1, sequence, each, offset))
        used[length] += n
        left[length] -= n

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for i, length in enumerate(large):
        for partner in large[i:]:
            if not left[length]:
                break
            n = left[length] // 2 if partner == length else min(left[length], left[partner])
            if length + partner > capacity or not n:
                continue
            put(length, n, sequences, 1, 0)
            put(partner, n, sequences, 1, length)
            open_bins[capacity - length - partner].append((sequences, n))
            sequences += n
        if n := left[length]:
            put(length, n, sequences, 1, 0)
            open_bins[capacity - length].append((sequences, n))
            sequences += n

    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        for room in sorted(r for r in open_bins if r >= length):
            if not left[length]:
                break
            each, ranges = room // length, open_bins.pop(room)
            for k, (first, number) in enumerate(ranges):
                whole = min(number, left[length] // each)
                if whole:
                    put(length, whole * each, first, each, capacity - room)
                    open_bins[room - each * length].append((first, whole))
                first, number = first + whole, number - whole
                if number and (rest := left[length]):
                    put(length, rest, first, each, capacity - room)
                    open_bins[room - rest * length].append((first, 1))
                    first, number = first + 1, number - 1
                if number:
                    open_bins[room].append((first, number))
                if not left[length]:
                    open_bins[room].extend(ranges[k + 1 :])
                    break
        if n := left[length]:
            each = capacity // length
            put(length, n, sequences, each, 0)
            if whole := n // each:
                open_bins[capacity - each * length].append((sequences, whole))
            if rest := n % each:
                open_bins[capacity - rest * length].append((sequences + whole, 1))
            sequences += -(-n // each)
    return runs, sequences


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json", bucket_rows: int = 50_000) -> DataFrame:
    """documents -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    Every row of the input is packed, repeated ones and ones without doc_id too. An empty table gives
    no rows. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    parts = materialise(pieces(docs, capacity, vocabulary), "pieces")
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)

    shares = spark.createDataFrame([(k, -(-n // bucket_rows)) for k, n in counts.items()], "length int, buckets int")
    bucketed = parts.join(F.broadcast(shares), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.col("buckets")).cast("int")
    )
    sizes = bucketed.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "salt")
    ranked = bucketed.withColumn("place", F.row_number().over(within)).join(offsets, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("ahead") + F.col("place") - 1)

    # one row per length, its runs sorted by first rank: a lookup instead of a join on ranges
    by_length = defaultdict(list)
    for length, first, last, sequence, each, offset in runs:
        by_length[length].append((first, last, sequence, each, offset))
    table = spark.createDataFrame(
        [(length, sorted(found)) for length, found in by_length.items()],
        "length int, runs array<struct<first:long,last:long,sequence:long,each:int,at:int>>",
    )
    run = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") <= r["last"]))[0]
    placed = ranked.join(F.broadcast(table), "length").withColumn("run", run)
    step = F.col("rank") - F.col("run.first")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        (F.col("run.sequence") + F.floor(step / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + step % F.col("run.each") * F.col("length")).cast("long").alias("offset"),
    )
