"""Helpers shared by the training-text operators: table reads, written intermediates, Arrow batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of a text: a run of anything but ASCII white space. ``bytes.split()`` cuts UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or set as checkpoint folder. Without one a local session gets a
    temporary folder of its own; a cluster session is refused, as its executors share no local folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="terracol-"))
        named = sc.getCheckpointDir()
    return named


def unused(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each lengthened until no given column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, *by: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors. Rows of
    each value of the columns ``by`` stand in a folder of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terracol-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        files, jvm = table.inputFiles(), table.sparkSession.sparkContext._jvm
        if files:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
            folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Bits of row_bits, at most; there are 16 for each hash up to there.
ROW_BITS = 1 << 26


def row_bits(hashes: DataFrame) -> tuple[DataFrame, int]:
    """A bit for each value of the long column ``h``: (_word, _held) with words of 64 bits, ROW_BITS / 64 rows at most, and
    the number of bits. ``hashes`` is read twice."""
    bits = min(ROW_BITS, max(64, 1 << (16 * hashes.count()).bit_length()))
    at = f"(h & {bits - 1}L)"
    return hashes.selectExpr(f"shiftright({at}, 6) AS _word", f"shiftleft(1L, int({at} & 63L)) AS _bit").groupBy("_word").agg(F.bit_or("_bit").alias("_held")), bits


def by_row_bits(df: DataFrame, h: Column, table: tuple[DataFrame, int], how: str) -> DataFrame:
    """The rows of df whose hash h hits a bit of row_bits' table (left_semi), or those that hit none (left_anti). Every
    hash that the table was made of hits, and by chance a few others; no row of df is moved."""
    held, bits = table
    word, mask = unused(df.columns, "_word", "_held")
    at = h.bitwiseAND(F.lit(bits - 1))
    return df.join(F.broadcast(held.toDF(word, mask)), (F.shiftright(at, 6) == F.col(word)) & (F.getbit(mask, at.bitwiseAND(F.lit(63))) == 1), how)


def utf8(text: str = "text") -> Column:
    """Whole text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch, unless one row alone has more.
ARROW_BYTES = 1 << 24


def bounded_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Let Arrow batches of this session hold ``most`` bytes at most, where it allows more: rows that carry whole sets
    differ in size, and a batch is counted in rows otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not now.isdigit() or int(now) <= 0 or int(now) > most:
        spark.conf.set(key, str(most))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that only a few thousand texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], names=list(columns))


_known_words: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; a bounded table keeps those of common words."""
    get = _known_words.get
    found = [get(w) for w in words]
    if None in found:
        for i, x in enumerate(found):
            if x is None:
                found[i] = x = xxhash.xxh64_intdigest(words[i])
                if len(_known_words) < 250_000:
                    _known_words[words[i]] = x
    return np.array(found, dtype=np.uint64)
