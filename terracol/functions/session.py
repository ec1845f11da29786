"""Written intermediates for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or set as checkpoint folder. Without one a local session gets a
    temporary folder of its own; a cluster session is refused, as its executors share no local folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="terracol-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def materialised(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, which cuts lineage and survives lost executors."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a written table that is read again."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def numbered(df: DataFrame, *order: str, by: tuple[str, ...] = (), name: str = "number") -> DataFrame:
    """df with ``name``: 1, 2, ... in order (within ``by``, if given). Rows are sorted in ranges, and a range adds the
    rows of those before it, so no task sorts more than its range; one row a range reaches the driver."""
    spark, keys = df.sparkSession, [*by, *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialised(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).cast("int")
    sizes = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts = [(p, sum(n for q, n in sizes.items() if q < p)) for p in sizes] or [(0, 0)]
    offsets = spark.createDataFrame(starts, "_part int, _start long")
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + inside + 1).drop("_part", "_start", "_id")
    if by:
        first = out.groupBy(*by).agg(F.min(name).alias("_first"))
        out = out.join(first, list(by)).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")
    return out
