"""Views of the provided tables in the roles that the measurement operators need.

Every formula is written once here and once as SQL (``SQL``), over columns both engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLASSES = {"view": 2, "click": 6, "signup": 1, "error": 7, "purchase": 9}


def points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cls = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in CLASSES.items()], F.lit(0))
    return e.select(
        F.col("event_id").alias("pid"), F.col("user_id").alias("b"), cls.alias("cls"),
        (F.col("event_id") % 97 * F.lit(0.25)).alias("x"), (F.col("event_id") % 89 * F.lit(0.25)).alias("y"),
        F.col("value").cast("double").alias("z"), F.to_date("ts").alias("d"),
    )


def plane_points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("pid"), F.col("label").alias("g"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def rectangles(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = lambda x: x.cast("double")
    ax, ay, aw, ah = d(k % 50), d(c % 50), d(k % 7 + 10), d(c % 5 + 8)
    bx, by, bw, bh = ax + d(k % 4) * 0.5, ay + d(c % 4) * 0.5, d(c % 7 + 10), d(k % 5 + 8)
    return o.select(k.alias("id"), ring(ax, ay, aw, ah).alias("ra"), ring(bx, by, bw, bh).alias("rb"))


def ring(x, y, w, h):
    return F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + h), G.point(x, y + h))


def triangles(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    z0, z1, z2 = (k % 7).cast("double") * 0.5, (c % 7).cast("double") * 0.5, (k % 11).cast("double") * 0.25
    corner = F.array(G.point(F.lit(0), F.lit(0), z0), G.point(F.lit(10), F.lit(0), z1), G.point(F.lit(0), F.lit(8), z2))
    return o.select(k.alias("id"), c.alias("b"), z0.alias("z0"), z1.alias("z1"), z2.alias("z2"), corner.alias("ring"))


def sources(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("source_id"), F.col("s_nationkey").alias("county"), F.date_add(F.lit("2015-01-01").cast("date"), (k * 37 % 3650).cast("int")).alias("acquired_end"),
        (F.lit(90) + k % 11).cast("double").alias("cover100"), ((F.lit(90) + k % 11) / F.lit(100.0)).alias("coverage"), (k % 9 + 4).cast("double").alias("density"),
        (k % 5).alias("priority"), (k % 10 != 0).alias("enabled"), F.when(k % 13 == 0, "PENDING").otherwise("PUBLIC").alias("license"),
    )


def requests(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("request_id"), F.col("c_nationkey").alias("county"),
        (F.lit(-83.0) + (k % 250) / F.lit(100.0)).alias("lon"), (F.lit(25.5) + (k % 275) / F.lit(100.0)).alias("lat"),
        F.date_add(F.lit("2018-01-01").cast("date"), (k % 2000).cast("int")).alias("lidar_date"),
    )


#: The same views for the SQL side.
SQL = {
    "pts": """pts AS (SELECT event_id AS pid, user_id AS b,
  CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 6 WHEN 'signup' THEN 1 WHEN 'error' THEN 7 WHEN 'purchase' THEN 9 ELSE 0 END AS cls,
  (event_id % 97) * 0.25e0 AS x, (event_id % 89) * 0.25e0 AS y, CAST(value AS DOUBLE) AS z, CAST(ts AS DATE) AS d FROM events)""",
    "plane": """plane AS (SELECT vec_id AS pid, label AS g, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)""",
    "rect": """rect AS (SELECT o_orderkey AS id, CAST(o_orderkey % 50 AS DOUBLE) AS ax, CAST(o_custkey % 50 AS DOUBLE) AS ay,
  CAST(o_orderkey % 7 + 10 AS DOUBLE) AS aw, CAST(o_custkey % 5 + 8 AS DOUBLE) AS ah,
  (o_orderkey % 50) + (o_orderkey % 4) * 0.5e0 AS bx, (o_custkey % 50) + (o_custkey % 4) * 0.5e0 AS b_y,
  CAST(o_custkey % 7 + 10 AS DOUBLE) AS bw, CAST(o_orderkey % 5 + 8 AS DOUBLE) AS bh FROM orders)""",
    "tri": """tri AS (SELECT o_orderkey AS id, o_custkey AS b, (o_orderkey % 7) * 0.5e0 AS z0, (o_custkey % 7) * 0.5e0 AS z1, (o_orderkey % 11) * 0.25e0 AS z2 FROM orders),
trim AS (SELECT *, (z1 - z0) / 10 AS gx, (z2 - z0) / 8 AS gy FROM tri),
facet AS (SELECT *, sqrt(1 + gx * gx + gy * gy) AS n, 40 * sqrt(1 + gx * gx + gy * gy) AS area, degrees(acos(1 / sqrt(1 + gx * gx + gy * gy))) AS pitch,
  CAST(fmod(degrees(atan2(-gx, -gy)) + 360, 360) AS DOUBLE) AS azimuth FROM trim)""",
    "src": """src AS (SELECT s_suppkey AS source_id, s_nationkey AS county, DATE '2015-01-01' + CAST((s_suppkey * 37) % 3650 AS INTEGER) AS acquired_end,
  (90 + s_suppkey % 11) / 100.0e0 AS coverage, CAST(s_suppkey % 9 + 4 AS DOUBLE) AS density, s_suppkey % 5 AS priority, s_suppkey % 10 <> 0 AS enabled,
  CASE WHEN s_suppkey % 13 = 0 THEN 'PENDING' ELSE 'PUBLIC' END AS license FROM supplier)""",
    "req": """req AS (SELECT c_custkey AS request_id, c_nationkey AS county, -83.0e0 + (c_custkey % 250) / 100.0e0 AS lon, 25.5e0 + (c_custkey % 275) / 100.0e0 AS lat,
  DATE '2018-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS lidar_date FROM customer)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
