"""SimHash near-duplicates found with a Gray-order hierarchical index.

Fingerprints: 64 bits, bit k is 1 when more than half of a text's shingle hashes have it. Links:
fingerprints that differ in at most ``max_diff`` bits. Components: what links reach.

Plan. Only distinct fingerprints are compared, so copies cost nothing. Fingerprints are dealt to cells of
about ``cell_codes`` members, and each cell is searched with an index in Gray order: its members sorted by
Gray rank, each node keeps the bits all below it share, less those a node above already holds, and a search
adds up differences level by level and drops a whole group once they exceed ``max_diff``, or once all of it
is known to be in the asking fingerprint's component. Single codes are compared at the leaves only. A cell
yields a spanning star of its links (at most one row a member, never all pairs).

Cells. Of ``max_diff + m`` bit blocks, two linked fingerprints agree on m at least; a fingerprint goes to
one cell for each choice of m blocks, keyed by as many of their bits as the number of fingerprints asks
for. No bits are needed for few of them (one cell); m grows when the blocks' bits run out, so that
cells stay of one size and the work in proportion to the input. Cells that still have more than
``cell_cap`` members are cut into chunks, and every pair of chunks becomes a cell of its own, so the
search stays exact and no task holds more than two chunks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot, materialise, text_or_empty
from .components import components

FANOUT = 8
FLUSH_ROWS = 200_000
#: Stands for a missing doc_id among nodes, which order by doc_id.
LAST = (1 << 63) - 1


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text; zero for one without words."""
    words = (text or "").encode("utf-8").lower().split()  # on bytes: A-Z only, space and \\x09-\\x0d only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], 42) for s, e in spans], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):  # a very long text needs no more memory than this many rows
        bits = np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """documents -> (doc_id, fp long). Whole texts; null and empty texts have fingerprint zero."""

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _print_of(shingle)(text_or_empty()).alias("fp"))


def _print_of(shingle: int):
    @F.pandas_udf(T.LongType())
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return fp


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the binary-reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Static index over distinct uint64 codes, for range search by Hamming distance."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        ones, zeros = self.codes, ~self.codes
        levels = [(np.full(len(codes), ~np.uint64(0)), self.codes)]
        while len(ones) > FANOUT:
            cuts = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            levels.append((ones | zeros, ones))
        self.levels = levels[::-1]  # from the top: (mask of shared bits, their values)
        self.residual = []
        above = np.zeros(1, dtype=np.uint64)
        for depth, (mask, _) in enumerate(self.levels):
            parent = above[np.arange(len(mask)) // FANOUT] if depth else np.zeros(len(mask), dtype=np.uint64)
            self.residual.append(mask & ~parent)
            above = mask

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """By level, the label that all codes below a node have; -1 where they differ."""
        low = high = labels[self.order]
        out = [low]
        for _ in self.levels[1:]:
            cuts = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            out.append(np.where(low == high, low, -1))
        return out[::-1]

    def search(self, queries: np.ndarray, max_diff: int, of: np.ndarray | None = None, settled: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query position, code position) of the pairs at most max_diff bits apart.

        With ``settled`` (see uniform), groups whose label is that of the query (``of``) are left out.
        """
        top = len(self.levels[0][0])
        q = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        spent = np.zeros(len(q), dtype=np.uint8)
        for depth, (_, value) in enumerate(self.levels):
            if depth:
                width = np.minimum(FANOUT, len(value) - node * FANOUT)
                parent = np.repeat(np.arange(len(node)), width)
                first = np.repeat(np.cumsum(width) - width, width)
                node = node[parent] * FANOUT + (np.arange(len(parent)) - first)
                q, spent = q[parent], spent[parent]
            spent = spent + np.bitwise_count((queries[q] ^ value[node]) & self.residual[depth][node])
            keep = spent <= max_diff
            if settled is not None:
                keep &= settled[depth][node] != of[q]
            q, node, spent = q[keep], node[keep], spent[keep]
        return q, self.order[node]


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-label union of the links (a, b) into labels, by hooking and pointer jumping."""
    while len(a):
        ra, rb = labels[a], labels[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped
    return labels


def cell_roots(codes: np.ndarray, max_diff: int) -> np.ndarray:
    """For each distinct code, the position of the first code of its component inside one cell."""
    labels = np.arange(len(codes))
    index = GrayIndex(codes)
    for at in range(0, len(codes), 256):
        block = index.order[at : at + 256]  # neighbours in Gray order share what they visit
        q, found = index.search(codes[block], max_diff, labels[block], index.uniform(labels))
        labels = merge(labels, block[q], found)
    return labels


def link_cells(cells: Iterator[pd.DataFrame], max_diff: int) -> Iterator[pd.DataFrame]:
    """Rows (cell, fp, doc) sorted by cell -> (doc, fp, to_doc, to_fp): each member of a component and its first member."""

    def flush(rows: pd.DataFrame) -> pd.DataFrame:
        cell, signed, doc = (rows[c].to_numpy() for c in ("cell", "fp", "doc"))
        cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
        labels = np.arange(len(signed))
        for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if stop - start > 1:
                labels[start:stop] = start + cell_roots(signed[start:stop].view(np.uint64), max_diff)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        to = labels[linked]
        return pd.DataFrame({"doc": doc[linked], "fp": signed[linked], "to_doc": doc[to], "to_fp": signed[to]})

    held: list[pd.DataFrame] = []
    rows = 0
    for batch in cells:
        held.append(batch)
        rows += len(batch)
        if rows >= FLUSH_ROWS:
            whole = pd.concat(held, ignore_index=True)
            last = int(np.searchsorted(-(whole["cell"].to_numpy() == whole["cell"].iloc[-1]).astype(int)[::-1], 0))
            cut = len(whole) - last
            if cut:
                yield flush(whole.iloc[:cut].reset_index(drop=True))
                whole = whole.iloc[cut:].reset_index(drop=True)
            held, rows = [whole], len(whole)
    if rows:
        yield flush(pd.concat(held, ignore_index=True))


def cell_keys(codes: int, cell_codes: int, max_diff: int) -> list[list[tuple[int, int]]]:
    """For each cell a fingerprint goes to, the (shift, width) of the bits that make its key."""
    bits = max(0, math.ceil(math.log2(max(codes, 1) / cell_codes)))
    if not bits:
        return [[]]
    m = next((m for m in range(1, 5) if m * (64 // (max_diff + m)) >= bits), 4)
    parts = max_diff + m
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    share = math.ceil(bits / m)
    return [[(edges[i], min(share, edges[i + 1] - edges[i])) for i in chosen] for chosen in itertools.combinations(range(parts), m)]


def cell_key(number: int, taken: list[tuple[int, int]]) -> Column:
    picked = [F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in taken]
    return F.xxhash64(F.lit(number), *picked)


def links(codes: DataFrame, total: int, max_diff: int = 4, cell_codes: int = 1024, cell_cap: int = 20_000) -> DataFrame:
    """codes(fp long, distinct; doc long) -> edges(a, b) of structs (doc, fp) whose components are those of all links.

    total is the number of codes, by which cells are laid out; any number gives the same components.
    """
    keys = F.array(*[cell_key(i, taken) for i, taken in enumerate(cell_keys(total, cell_codes, max_diff))])
    keyed = codes.select("fp", "doc", F.explode(keys).alias("key"))
    full = keyed.groupBy("key").count().where(F.col("count") > cell_cap).select("key", F.ceil(F.col("count") * 2 / cell_cap).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
    # a member of chunk c joins the cells {c, other} for every other chunk; one chunk: a single cell
    pairs = F.transform(
        F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1),
        lambda other: F.xxhash64("key", F.least("chunk", other), F.greatest("chunk", other)),
    )
    cells = keyed.join(full, "key", "left").withColumn("chunk", chunk).select("fp", "doc", F.explode(pairs).alias("cell"))
    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    found = dealt.select("cell", "fp", "doc").mapInPandas(lambda it: link_cells(it, max_diff), "doc long, fp long, to_doc long, to_fp long")
    return found.select(F.struct("doc", "fp").alias("a"), F.struct(F.col("to_doc").alias("doc"), F.col("to_fp").alias("fp")).alias("b"))


def groups(prints: DataFrame, max_diff: int = 4, **how) -> DataFrame:
    """(doc_id, fp) -> (fp, n, root): each distinct fingerprint, its rows, and its component's least node.

    A node is the struct (doc, fp) of a fingerprint's least doc_id (LAST without one) and the fingerprint.
    """
    least = F.coalesce(F.min("doc_id"), F.lit(LAST)).alias("doc")
    distinct = materialise(prints.groupBy("fp").agg(least, F.count(F.lit(1)).alias("n")), "distinct")
    found = components(links(distinct.select("fp", "doc"), distinct.count(), max_diff, **how))
    roots = found.select(F.col("node.fp").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").select("fp", "n", F.coalesce("root", F.struct("doc", "fp")).alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_diff: int = 4, **how) -> DataFrame:
    """documents -> (doc_id, fp, component_id), one row per input row.

    component_id is the least doc_id that links reach, the row itself included; rows without a doc_id
    take part and count last (a component of such rows only has a null id). Empty and null texts have
    fingerprint zero and link like any other. Repeated rows are each returned. An empty table gives no
    rows. Columns other than doc_id and text are not read.
    """
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    found = groups(prints, max_diff, **how)
    named = materialise(found.select("fp", "n", F.nullif("root.doc", F.lit(LAST)).alias("component_id")), "named")
    return join_hot(prints, named, "fp", prints.count()).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 4, max_diff: int = 4, **how) -> DataFrame:
    """One row of each near-duplicate component, columns as they are.

    The row of the component's least doc_id stays; rows without a doc_id come last, so one of them stays only
    where a component has no other. Of several such rows (repeated or missing ids) the one of the least
    fingerprint, then the least text, stays. Null and empty texts are one component. An empty table stays empty.
    """
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    stay = materialise(groups(prints, max_diff, **how).where("fp = root.fp").select(F.col("root.doc").alias("__doc"), F.col("fp").alias("__fp")), "stay")
    ids = materialise(prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"), F.min("fp").alias("__fp")), "ids")
    alone = ids.where("doc_id IS NOT NULL AND __n = 1")
    kept = alone.join(stay, (F.col("doc_id") == F.col("__doc")) & (alone["__fp"] == stay["__fp"])).select("__doc")
    once = docs.join(kept, docs["doc_id"] == F.col("__doc"), "left_semi")
    shared = ids.where("doc_id IS NULL OR __n > 1").select(F.coalesce("doc_id", F.lit(LAST)).alias("__doc"))
    if shared.isEmpty():
        return once
    # rows whose id does not tell them apart: by their own fingerprint, of which stay has one a component
    again = docs.withColumn("__doc", F.coalesce("doc_id", F.lit(LAST))).join(shared, "__doc", "left_semi")
    again = again.withColumn("__fp", _print_of(shingle)(text_or_empty())).join(stay, ["__doc", "__fp"])
    first = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), text_or_empty()).alias("__row")
    return once.unionByName(again.groupBy("__doc", "__fp").agg(first).select("__row.*"))


def fp_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
