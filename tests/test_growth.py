"""What the roof queries do with many rows: work grows with what differs, is spread, and joins no table of buildings."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import footprints, lidar, roof
from ridgeline.plans import measurement, roles
from ridgeline.plans.catalogue import saltbox


def most_rows(df):
    """The rows of df and the largest number of rows that a step of its plan gave out."""
    rows = df.collect()

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from walk(p.plan())
        else:
            m = p.metrics().get("numOutputRows")
            if m.isDefined():
                yield m.get().value()
            for i in range(p.children().size()):
                yield from walk(p.children().apply(i))

    return rows, max(walk(df._jdf.queryExecution().executedPlan()))


def registry(spark, n):
    k = F.col("id")
    return spark.range(n).select(
        k.cast("int").alias("source_id"), F.when(k % 2 == 0, "A").otherwise("B").alias("county"), F.lit(True).alias("enabled"), F.lit("CC0").alias("license"), F.lit(date(2020, 1, 1)).alias("acquired_end"),
        F.lit(1.0).alias("coverage"), F.lit(8.0).alias("density"), F.lit(1).alias("priority"),
    )


def test_audit_is_spread_whatever_the_counties(spark):
    asked = spark.range(400).select(F.col("id").alias("request_id"), F.when(F.col("id") % 2 == 0, "A").alias("county")).coalesce(1)
    found = lidar.decide(asked, registry(spark, 10)).withColumn("part", F.spark_partition_id())
    rows = found.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "CANDIDATE").alias("good")).collect()
    assert len(rows) >= 4 and sum(r["n"] for r in rows) == 4000 and sum(r["good"] for r in rows) == 200 * 5


def test_audit_is_written_small(spark, tmp_path):
    asked = spark.range(500).select(F.col("id").alias("request_id"), F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 3 == 1, "B").alias("county"))
    lidar.decide(asked, registry(spark, 5999)).select("request_id", "source_id", "decision").write.option("compression", "snappy").parquet(str(tmp_path / "audit"))
    rows = spark.read.parquet(str(tmp_path / "audit"))
    assert rows.count() == rows.distinct().count() == 500 * 5999 and rows.where("decision = 'CANDIDATE'").count() == 167 * 5999
    assert sum(f.stat().st_size for f in (tmp_path / "audit").glob("*.parquet")) < 0.4 * 500 * 5999


@pytest.mark.parametrize("n", [0, 1, 256, 257, 770])
def test_audit_has_every_pair_once_for_each_copy(spark, n):
    k = F.col("id")
    asked = spark.range(30).select(F.when(k < 25, k % 7).alias("request_id"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "C").alias("county"), k.alias("row"))
    side = registry(spark, n).withColumn("source_id", F.when(F.col("source_id") % 5 > 0, F.col("source_id") % 50)).withColumn("priority", F.col("source_id"))
    side = side.withColumn("county", F.when(F.col("source_id") % 4 > 0, F.col("county"))).withColumn("coverage", F.when(F.col("source_id") % 3 == 0, 0.5).when(F.col("source_id") % 3 == 1, 1.0))
    judged = lambda a, b: "SKIPPED_DISABLED_OR_COUNTY" if a["county"] is None or a["county"] != b["county"] else "SOURCE_UNAVAILABLE" if b["coverage"] is None else "NO_COMPLETE_BUFFERED_COVERAGE" if b["coverage"] < 0.98 else "CANDIDATE"
    expected = sorted(str((a["row"], a["request_id"], b["source_id"], judged(a, b))) for a in asked.collect() for b in side.collect())
    for most in (100_000, 0):
        found = lidar.decide(asked, side, broadcast_rows=most)
        assert found.columns == ["request_id", "county", "row", "source_id", "source_county", *side.columns[2:], "decision"]
        assert sorted(str((r["row"], r["request_id"], r["source_id"], r["decision"])) for r in found.collect()) == expected


def test_selection_makes_no_pairs(spark):
    asked = spark.range(300).select(F.col("id").alias("request_id"), F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 3 == 1, "C").alias("county"))
    rows, most = most_rows(measurement.selections(asked, registry(spark, 300)))
    got = {r["request_id"]: (r["candidates"], r["first_source"], r["code"]) for r in rows}
    assert got == {k: (150, 0, None) if k % 3 == 0 else (0, None, "NO_LIDAR_COVERAGE") for k in range(300)} and most <= 600
    twice = asked.where("request_id < 2").union(asked.where("request_id = 0")).union(spark.createDataFrame([(0, "B")], "request_id long, county string"))
    assert {r["request_id"]: (r["candidates"], r["first_source"]) for r in measurement.selections(twice, registry(spark, 300)).collect()} == {0: (450, 0), 1: (0, None)}
    assert measurement.selections(asked, registry(spark, 0)).count() == 0


def test_copies_of_boxes_and_points_make_no_pairs(spark):
    points = spark.range(300).select(F.col("id").alias("pid"), (F.col("id") % 2 * 50.0).alias("x"), F.lit(1.0).alias("y"))
    boxes = spark.range(300).select((F.col("id") % 299).alias("id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.when(F.col("id") == 7, 60.0).otherwise(12.0).alias("x1"), F.lit(9.0).alias("y1"))
    rows, most = most_rows(footprints.counts_in_boxes(points, boxes, 16.0))
    got = {r["id"]: (r["n"], r["first_pid"]) for r in rows}
    assert got == {k: (300, 0) if k in (0, 7) else (150, 0) for k in range(299)} and most <= 600


def test_copies_of_places_and_outlines_make_no_pairs(spark):
    k = F.col("id")
    asked = spark.range(300).select(k.alias("request_id"), F.when(k < 299, 5.0).alias("px"), F.when(k % 2 == 0, 5.0).otherwise(500.0).alias("py"), F.lit(-82.0).alias("lon"), F.lit(26.5).alias("lat"))
    ring = roles.ring(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))
    bow = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 9.0))])
    outlines = spark.range(300).select((k + 5).alias("candidate_id"), F.when(k == 0, bow).when(k % 2 == 0, ring).otherwise(F.reverse(ring)).alias("ring"))
    rows, most = most_rows(measurement.located(asked, outlines))
    assert {r["request_id"]: (r["candidate_id"], r["code"]) for r in rows} == {i: (6, None) if i % 2 == 0 else (None, "BUILDING_FOOTPRINT_NOT_FOUND") for i in range(300)} and most <= 600


def plain_uses(facets, tolerance, least=0.10):
    """Uses of one building's facets, side by side and point by point."""
    points, nodes, keys, out, met = list(dict.fromkeys(tuple(p) for _, ring in facets for p in ring.tolist())), [], [], [], set()
    for p in points:
        near = [i for i, q in enumerate(nodes) if np.linalg.norm(np.subtract(q, p)) <= tolerance]
        keys.append(near[0] if near else len(nodes))
        if not near:
            nodes.append(p)
    for pos, ring in facets:
        for start, end in zip(ring, np.roll(ring, -1, axis=0)):
            side, length, on = end - start, np.linalg.norm(end - start), []
            if length <= least:
                continue
            for p, key in zip(points, keys):
                at = (p - start) @ side / length**2
                if abs(at - 0.5) <= 0.5 + tolerance / length and np.linalg.norm(p - start - at * side) <= tolerance:
                    on.append((min(1, max(0, at)), key))
            on.sort(key=lambda x: x[0])
            on = [x for i, x in enumerate(on) if not i or x[1] != on[i - 1][1]]
            for (at, i), (to, j) in zip(on, on[1:]):
                use = (min(i, j), max(i, j), pos)
                if (to - at) * length > least and use not in met:
                    met.add(use)
                    out.append((len(out), *use, start + at * side, start + to * side))
    return out


@pytest.mark.parametrize("pairs", [1, 250_000])
def test_buildings_of_a_batch_are_noded_as_one_by_one(monkeypatch, pairs):
    monkeypatch.setattr(roof, "PAIRS", pairs)
    random, buildings = np.random.default_rng(5), []
    for _ in range(40):
        grid = random.integers(0, 5, (random.integers(3, 9), 3)) + random.choice([0, 0, 0.03, 0.07], (1, 3))
        buildings.append([(k + 1, grid[random.choice(len(grid), random.integers(3, 6))] + random.choice([0, 0, 0.04], (1, 3))) for k in range(random.integers(1, 4))])
    flat = [(n, pos, ring) for n, b in enumerate(buildings) for pos, ring in b]
    found = roof.node_buildings(np.array([f[0] for f in flat]), np.array([f[1] for f in flat]), np.array([len(f[2]) for f in flat]), np.concatenate([f[2] for f in flat]), 0.10)
    uses = list(zip(*found))
    for n, facets in enumerate(buildings):
        mine, plain = [u[1:] for u in uses if u[0] == n], plain_uses(facets, 0.10)
        assert [tuple(map(int, u[:4])) for u in mine] == [u[:4] for u in plain]
        assert all(np.allclose(u[4:], v[4:]) for u, v in zip(mine, plain))


def test_buildings_are_measured_without_joins(spark):
    lines = spark.range(500).select(F.col("id").cast("string").alias("building_id"), F.when(F.col("id") == 3, "{}").otherwise(saltbox(4.0)).alias("value"))
    df = roof.measure(lines.union(lines.where("building_id = '7'")))
    got = {r["building_id"]: (r["code"], r["facets"], r["noded_edges"]) for r in df.collect()}
    assert got == {str(k): ("CITYJSON_FEATURE_COUNT_INVALID", None, None) if k in (3, 7) else (None, 2, 7) for k in range(500)}
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
