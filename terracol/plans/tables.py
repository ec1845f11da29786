"""The given tables as pixel, cell, point, line and score tables; the same definitions as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100
LON0, LAT0, STEP = -83.28, 42.23, 0.0004

SQL = {
    "grid": "SELECT (o_orderkey // 100)::INT AS row, (o_orderkey % 100)::INT AS col, -83.28::DOUBLE + (o_orderkey % 100) * 0.0004::DOUBLE AS lon, 42.23::DOUBLE + (o_orderkey // 100) * 0.0004::DOUBLE AS lat, o_totalprice AS value FROM orders",
    "bandpix": "SELECT (vec_id // 25)::INT AS row, (vec_id % 25)::INT AS col, embedding::DOUBLE[] AS bands, label FROM embeddings",
    "bandlong": "SELECT (vec_id // 25)::INT AS row, (vec_id % 25)::INT AS col, (unnest(range(len(embedding))))::INT AS band, unnest(embedding)::DOUBLE AS value FROM embeddings",
    "road": "SELECT (o_orderkey // 100)::INT AS row, (o_orderkey % 100)::INT AS col FROM orders WHERE o_orderstatus = 'F'",
    "gray": "SELECT (o_orderkey // 100)::INT AS row, (o_orderkey % 100)::INT AS col FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "classes": "SELECT (o_orderkey // 100)::INT AS row, (o_orderkey % 100)::INT AS col, (o_custkey % 7)::DOUBLE AS value FROM orders",
    "points": "SELECT event_id AS idx, -83.28::DOUBLE + ((event_id * 37) % 1000) * 0.00004::DOUBLE AS lon, 42.23::DOUBLE + ((event_id * 97) % 700) * 0.00008::DOUBLE AS lat, (event_id % 101)::DOUBLE AS pci, user_id AS seg_id FROM events",
    "verts": "SELECT c_nationkey AS line, c_custkey AS ord, (c_custkey % 100)::INT AS x, ((c_custkey * 7) % 90)::INT AS y FROM customer",
    "edges": "SELECT line, ord, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM (SELECT c_nationkey AS line, c_custkey AS ord, (c_custkey % 100)::INT AS x, ((c_custkey * 7) % 90)::INT AS y FROM customer) WINDOW w AS (PARTITION BY line ORDER BY ord)",
    "roads": "SELECT line, ord, x0, y0, x1, y1 FROM (SELECT line, ord, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM (SELECT c_nationkey AS line, c_custkey AS ord, -83.28::DOUBLE + (c_custkey % 100) * 0.0004::DOUBLE + 0.00013::DOUBLE AS x, 42.23::DOUBLE + ((c_custkey * 7) % 90) * 0.0004::DOUBLE + 0.00017::DOUBLE AS y FROM customer) WINDOW w AS (PARTITION BY line ORDER BY ord)) WHERE x1 IS NOT NULL",
    "road_verts": "SELECT c_nationkey AS line, c_custkey AS ord, -83.28::DOUBLE + (c_custkey % 100) * 0.0004::DOUBLE + 0.00013::DOUBLE AS x, 42.23::DOUBLE + ((c_custkey * 7) % 90) * 0.0004::DOUBLE + 0.00017::DOUBLE AS y FROM customer",
    "line_points": "SELECT c_nationkey AS line, c_custkey AS ord, (c_custkey % 100)::INT AS x, ((c_custkey * 7) % 90)::INT AS y FROM customer",
    "scores": "SELECT l_suppkey % 5 AS dataset_id, (l_quantity::INT % 5)::DOUBLE AS y_true, (l_linenumber % 5)::DOUBLE AS y_pred FROM lineitem",
    "size": "SELECT max(o_orderkey // 100)::INT + 1 AS h, 100 AS w FROM orders",
}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cell(key: str) -> list:
    return [F.floor(F.col(key) / WIDTH).cast("int").alias("row"), (F.col(key) % WIDTH).cast("int").alias("col")]


def grid(spark, d):
    row, col = F.floor(F.col("o_orderkey") / WIDTH), F.col("o_orderkey") % WIDTH
    return _t(spark, d, "orders").select(*_cell("o_orderkey"), (F.lit(LON0) + col * F.lit(STEP)).alias("lon"), (F.lit(LAT0) + row * F.lit(STEP)).alias("lat"), F.col("o_totalprice").alias("value"))


def height(spark, d) -> int:
    return _t(spark, d, "orders").agg(F.max(F.floor(F.col("o_orderkey") / WIDTH))).first()[0] + 1


def bandpix(spark, d):
    return _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 25).cast("int").alias("row"), (F.col("vec_id") % 25).cast("int").alias("col"), F.col("embedding").cast("array<double>").alias("bands"), "label")


def road(spark, d):
    return _t(spark, d, "orders").where("o_orderstatus = 'F'").select(*_cell("o_orderkey"))


def gray(spark, d):
    return _t(spark, d, "orders").where("o_orderpriority IN ('1-URGENT', '2-HIGH')").select(*_cell("o_orderkey"))


def classes(spark, d):
    return _t(spark, d, "orders").select(*_cell("o_orderkey"), (F.col("o_custkey") % 7).cast("double").alias("value"))


def points(spark, d):
    e = F.col("event_id")
    return _t(spark, d, "events").select(e.alias("idx"), (F.lit(LON0) + (e * 37) % 1000 * F.lit(0.00004)).alias("lon"), (F.lit(LAT0) + (e * 97) % 700 * F.lit(0.00008)).alias("lat"), (e % 101).cast("double").alias("pci"), F.col("user_id").alias("seg_id"))


def verts(spark, d):
    k = F.col("c_custkey")
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("line"), k.alias("ord"), (k % 100).cast("int").alias("x"), ((k * 7) % 90).cast("int").alias("y"))


def road_vertices(spark, d):
    """The lines' vertices as longitudes and latitudes."""
    place = lambda v, origin, off: F.lit(origin) + F.col(v) * F.lit(STEP) + F.lit(off)
    return verts(spark, d).select("line", "ord", place("x", LON0, 0.00013).alias("x"), place("y", LAT0, 0.00017).alias("y"))


def lut(spark, d):
    return _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("seg_id"), (F.col("n_regionkey") + 1).cast("double").alias("pci"))


def scores(spark, d):
    return _t(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("dataset_id"), (F.col("l_quantity").cast("int") % 5).cast("double").alias("y_true"), (F.col("l_linenumber") % 5).cast("double").alias("y_pred"))


def with_sql(body: str, *names: str) -> str:
    return "WITH " + ", ".join(f'"{n}" AS ({SQL[n]})' for n in names) + " " + body
