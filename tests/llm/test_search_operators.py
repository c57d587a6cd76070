import itertools

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ridgeline.llm import multiindex, simhash
from ridgeline.llm.common import join_hot
from ridgeline.llm.components import components

from .conftest import ODD


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(fps)), 2):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    least = {}
    for (i, _), g in zip(fps, label):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [(i, f, least.get(g)) for (i, f), g in zip(fps, label)]


def test_near_duplicates(spark, docs):
    rng = np.random.default_rng(4)
    rows = list(ODD)
    for g in range(6):
        base = [f"w{x}" for x in rng.integers(0, 500, 300)]
        for k in range(6):
            words = list(base)
            for _ in range(k // 2):
                words[rng.integers(0, 300)] = f"edit{g}{k}"
            rows.append((100 - 10 * g - k, " ".join(words)))
    got = simhash.near_duplicates(docs(*rows)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    mine = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=key)
    assert mine == sorted(plain_components(rows), key=key)
    assert simhash.near_duplicates(docs((1, "a")).limit(0)).count() == 0


def test_links_of_crowded_cells(spark):
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    near = {int(centre) ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in (1, 2, 3, 5, 9) for _ in range(120)}
    codes = np.array(sorted(near | set(rng.integers(0, 2**63, 400, dtype=np.uint64).tolist())), dtype=np.uint64)
    label = np.arange(len(codes))
    for i in range(len(codes)):
        j = np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 4)
        label = simhash.merge(label, np.full(len(j), i), j)
    df = spark.createDataFrame([(int(x), int(x) >> 3) for x in codes.view(np.int64)], "fp long, doc long")
    for total, cap in ((len(codes), 20_000), (len(codes), 50), (10**5, 20_000), (10**8, 20_000), (10**8, 50), (10**10, 20_000)):  # few and many bits a key, cells cut into chunks and whole
        edges = simhash.links(df, total, cell_cap=cap).select("a.fp", F.col("b.fp").alias("to")).toPandas()
        at = {int(x): i for i, x in enumerate(codes.view(np.int64))}
        mine = simhash.merge(np.arange(len(codes)), edges["fp"].map(at).to_numpy(), edges["to"].map(at).to_numpy())
        assert (mine == label).all()


def test_cells_keep_one_size():
    for n in (10, 1024, 5_000, 10**6, 10**8, 10**10, 10**11):
        taken = simhash.cell_keys(n, 1024, 4)
        assert n / 2 ** sum(width for _, width in taken[0]) <= 1100
        for differ in itertools.combinations(range(0, 64, 5), 4):  # some cell's key holds none of any four bits
            assert any(not any(lo <= bit < lo + width for bit in differ for lo, width in key) for key in taken)


def test_whole_table_by_the_index_alone(spark, monkeypatch):
    """All pairs of the registered query's fingerprints on sf0.01, by brute force and by the index, which answers each cell."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    codes = np.unique(np.array([fp for fp, _ in got.values()], dtype=np.int64).view(np.uint64))
    a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4)
    label = simhash.merge(np.arange(len(codes)), a, b)
    of = dict(zip(codes.view(np.int64).tolist(), label.tolist()))
    least = {}
    for doc, (fp, _) in got.items():
        least[of[fp]] = min(least.get(of[fp], doc), doc)
    assert all(component == least[of[fp]] for fp, component in got.values())

    asked, search = [], simhash.GrayIndex.search
    monkeypatch.setattr(simhash.GrayIndex, "search", lambda self, queries, *how: (asked.append(len(queries)), search(self, queries, *how))[1])
    assert (simhash.cell_roots(codes, 4) == label).all() and sum(asked) == len(codes) and len(simhash.cell_keys(len(codes), 1024, 4)) == 1


def test_gray_index_equals_brute_force():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 2**20, 3000, dtype=np.uint64))
    q, found = simhash.GrayIndex(codes).search(codes[:60], 4)
    want = {(i, j) for i in range(60) for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 4).tolist()}
    assert set(zip(q.tolist(), found.tolist())) == want
    ranks = simhash.gray_rank(np.array([i ^ i >> 1 for i in range(1000)], dtype=np.uint64))
    assert (ranks == np.arange(1000)).all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (501, 501), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[501] == 500
    assert components(edges.limit(0)).count() == 0


def plain_search(rows, query):
    x = {i: np.array(v, dtype=float) for i, v in rows}
    d = sorted((float(np.sqrt(((x[query] - v) ** 2).sum())), i) for i, v in x.items() if i != query)
    return d[:10]


def test_search(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(v) for v in centres[i % 30] + 0.2 * rng.normal(size=16)]) for i in range(3000)]
    rows += [(9000, rows[100][1]), (9001, rows[100][1])]  # ties
    odd = [(9100, None), (9200, [0.0] * 16), (9300, [float("nan")] * 16), (9400, [1.0, None] * 8), (9500, [1.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    kept = [(i, np.float32(v).astype(float)) for i, v in rows]
    got = {}
    for r in multiindex.search(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(got) == {i for i, _ in rows if i % 100 == 0}
    hits = 0
    for query, found in got.items():
        found.sort()
        want = plain_search(kept, query)
        assert [n for n, *_ in found] == list(range(1, 11)) and all(a <= b for (_, a, _), (_, b, _) in zip(found, found[1:]))
        exact = dict((i, s) for s, i in plain_search(kept, query) + [(s, i) for _, s, i in found])
        assert all(abs(exact[i] - s) < 1e-12 for _, s, i in found)
        hits += len({i for _, _, i in found} & {i for _, i in want})
    assert hits / (10 * len(got)) >= 0.9
    assert [i for _, _, i in got[100][:2]] == [9000, 9001]
    few = multiindex.search(spark.createDataFrame(rows[:1] + rows[1:4], "vec_id long, embedding array<float>")).collect()
    assert len(few) == 3
    assert multiindex.search(df.limit(0)).count() == 0


def test_search_of_repeated_rows_and_hot_cells(spark):
    """Ids that ask twice, a third of all rows alike, parts of few rows and queries: equal to brute force, as all cells are visited."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(200)] + [(100, [0.5] * 8), (100, [0.5] * 8)] + [(1000 + i, [1.0] * 8) for i in range(100)]
    made = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, row string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in multiindex.search(made, recall=1.0, part_rows=40, part_queries=2).collect())
    want = []
    for at, (query, v) in enumerate(rows):
        if query % 100 == 0:
            d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for j, (i, w) in enumerate(rows) if j != at)
            want += [(query, n + 1, i, round(s, 9)) for n, (s, i) in enumerate(d[:10])]
    assert got == sorted(want)


def test_cells_prune_clustered_vectors():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=8) * 4 + 0.1 * rng.normal(size=(100, 8)) for _ in range(40)])
    books = multiindex.Codebooks(np.arange(len(x)), x, 20, 10, 0.96)
    assert books.share < 0.1
    first, number = multiindex.parts_of(np.array([5, 5, 50, 0, 3, 9]), 10)
    assert first.tolist() == [0, 0, 1, 6, 6, 7] and number.tolist() == [1, 1, 5, 1, 1, 1]


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(6), rng.random(7)
    order = multiindex.walk(a, b, np.ones(42, dtype=int), 42)
    assert order == sorted(range(42), key=lambda c: a[c // 7] + b[c % 7])


def test_joins_and_components_with_hubs(spark):
    big = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    plain, split = (sorted(map(tuple, join_hot(big, small, "k", 3000, least).select("k", "id", "top").collect())) for least in (10_000, 50))
    assert plain == split and len(plain) == 3000
    edges = spark.range(1, 12_000).selectExpr("CAST(0 AS BIGINT) AS a", "id AS b").union(spark.range(20_000, 20_050).selectExpr("id AS a", "id + 1 AS b"))
    assert {(r["root"], r["count"]) for r in components(edges).groupBy("root").count().collect()} == {(0, 12_000), (20_000, 51)}
