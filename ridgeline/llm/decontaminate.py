"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only.

A mask picks some positions of a window of words and ignores the rest; two windows whose picked words
agree get the same hash although ignored words differ. Test items and documents are hashed at every
position under every mask, so unbroken overlaps of a mask's span always meet, and broken ones whenever
some mask ignores the substituted words of some window. Each hit is verified on its diagonal: of the
``verify`` words around it at least ``agreement`` must be equal. Items shorter than a span have no window;
they are met whole, word for word.

Each word is hashed once and windows combine these hashes. They are exploded inside one code-generated
stage: no shuffle before the join, and only verified hits are shuffled. The item seeds are broadcast
after their number has been checked against ``broadcast_seeds``; beyond that, Spark joins both sides by
hash: what is shuffled of a document is its id, position and hash, and its words only where a hash has met.

Recall, as tests measure it over all substitution patterns and alignments: unbroken runs of 11 words 1;
copies of a 15-word item with one word substituted 1, with two 0.99, with three 0.87.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: 1 picks the word, 0 ignores it. Weight 7 of span 11; each position is ignored by one at least.
MASKS = ("11101001011", "10110110101", "01111100110", "11010101101")
SPAN = len(MASKS[0])


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def word_hashes(tokens: str) -> Column:
    return F.transform(tokens, lambda word: F.xxhash64(word))


def window(at: str) -> list[Column]:
    """The word hashes of the window at a position, as columns: each is looked up once for all masks."""
    return [F.get("hashes", F.col(at) + k).alias(f"h{k}") for k in range(SPAN)]


def seeds() -> Column:
    """By mask, the hash of what it picks from window(); the mask's number is part."""
    return F.array(*[F.xxhash64(F.lit(m), *[F.col(f"h{k}") for k, bit in enumerate(mask) if bit == "1"]) for m, mask in enumerate(MASKS)])


def places(tokens: str, span: int = SPAN) -> Column:
    """Positions of whole windows; null, and so none when exploded, for a shorter array."""
    last = F.size(tokens) - span
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """benchmark(item_id, text) -> (seed, item_id, q): one row per item, window and mask."""
    items = benchmark.select("item_id", words(text_or_empty()).alias("item"))
    at = items.select("item_id", "item", word_hashes("item").alias("hashes")).select("item_id", "hashes", F.explode(places("item")).alias("q"))
    return at.select("item_id", "q", *window("q")).select("item_id", "q", F.explode(seeds()).alias("seed"))


def hits(docs: DataFrame, benchmark: DataFrame, verify: int = 15, agreement: float = 0.8, broadcast_seeds: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, position, equal): verified overlaps, at least one for each document and item that meet."""
    spread = item_seeds(benchmark)
    items = benchmark.select("item_id", words(text_or_empty()).alias("item"))
    n = F.size("item")
    counted = items.agg(F.sum(F.greatest(n - (SPAN - 1), F.lit(0)) * len(MASKS)), F.sum(F.when(n.between(1, SPAN - 1), 1)), F.collect_set(F.when(n.between(1, SPAN - 1), n)))
    n_seeds, n_short, lengths = counted.first()
    few = (n_seeds or 0) <= broadcast_seeds
    hint = F.broadcast if few else (lambda df: df)

    tokens = docs.select("doc_id", words(text_or_empty()).alias("tokens"))
    hashed = tokens.select("doc_id", "tokens", word_hashes("tokens").alias("hashes"))  # below the explode: once per word
    at = hashed.select("doc_id", "tokens", "hashes", F.explode(places("tokens")).alias("p"))
    carried = ["doc_id", "tokens"] if few else ["doc_id"]
    seeded = at.select(*carried, "p", *window("p")).select(*carried, "p", F.explode(seeds()).alias("seed"))
    met = seeded.join(hint(spread), "seed")
    if not few:  # a seed met more than once on a diagonal is one hit to verify; rows of one id are verified each
        met = met.select("doc_id", "item_id", "p", "q").distinct().join(tokens, "doc_id")
    met = met.join(hint(items.where(n >= SPAN)), "item_id")

    # the window to verify: as many words before as after the seed, moved inside the item
    length = F.least(n, F.lit(verify))
    first = F.greatest(F.lit(0), F.least(F.col("q") - (verify - SPAN) // 2, n - length))
    met = met.select("doc_id", "item_id", "tokens", "item", "p", first.alias("i"), (F.col("p") - F.col("q") + first).alias("d"), length.alias("n"))
    # counted by a function over positions: written out word by word, the stage's code is too long to be compiled
    same = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.get("tokens", F.col("d") + k) == F.get("item", F.col("i") + k))
    equal = F.size(same)
    found = met.withColumn("equal", equal).where(F.col("equal") >= F.ceil(F.col("n") * agreement)).select("doc_id", "item_id", F.col("p").alias("position"), "equal")
    if lengths:
        found = found.unionByName(short_hits(tokens, items.where(n.between(1, SPAN - 1)), sorted(lengths), n_short <= broadcast_seeds))
    return found


def short_hits(tokens: DataFrame, items: DataFrame, lengths: list[int], few: bool) -> DataFrame:
    """hits() of items of fewer words than a span: runs of a document of such a length, joined by the words themselves."""
    run = lambda df, at, n: F.array_join(F.slice(df, at + 1, n), " ")
    by = items.select("item_id", F.array_join("item", " ").alias("run"), F.size("item").alias("equal"))
    at = tokens.select("doc_id", "tokens", F.explode(places("tokens", lengths[0])).alias("p"))
    runs = F.array(*[F.when(F.col("p") + n <= F.size("tokens"), run("tokens", F.col("p"), F.lit(n))) for n in lengths])
    said = at.select("doc_id", F.col("p").alias("position"), F.explode(runs).alias("run"))
    return said.join(F.broadcast(by) if few else by, "run").select("doc_id", "item_id", "position", "equal")


def overlaps(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, n_hits, best): each document and benchmark item that share a passage, once.

    Null and empty texts and rows without ids take no part. Items shorter than a mask's span are found where
    all their words stand in a row.
    Repeated documents give one row for their doc_id. Empty tables give no rows. Other columns of either
    table are not read.
    """
    found = hits(docs.where("doc_id IS NOT NULL"), benchmark.where("item_id IS NOT NULL").dropDuplicates(["item_id", "text"]), **how)
    return found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_hits"), F.max("equal").cast("long").alias("best"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """documents without those that share a passage with a benchmark item; columns as they are."""
    dirty = overlaps(docs, benchmark, **how).select(F.col("doc_id").alias("__dirty")).distinct()
    return docs.join(dirty, docs["doc_id"] == dirty["__dirty"], "left_anti")
