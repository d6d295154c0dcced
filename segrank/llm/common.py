"""What the training-data operators share: the shared folder, materialised tables and key filters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of one BIGINT key that may be broadcast; about 16 bytes a row once hashed.
MAX_BROADCAST_KEYS = 500_000
#: Bytes of a table that may be broadcast, as far as its texts are counted.
MAX_BROADCAST_BYTES = 64 << 20
#: Rows of one key from which a join deals them to several tasks, and tasks at most.
HOT_ROWS, MOST_SALTS = 1000, 256
#: ASCII white space of the words in the contracts, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without one, a fixed local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith(("local[", "local")) or spark.conf.get("spark.master", "").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "/tmp/checkpoints/segrank"
    os.makedirs(path, exist_ok=True)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/segrank-{uuid.uuid4().hex[:16]}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._segrank_path = path  # for release()
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by materialize(), through Hadoop's file system, when nothing reads it any more."""
    path = getattr(df, "_segrank_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def require(df: DataFrame, *columns: str) -> None:
    """Raise unless all columns are there; needs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def keep_or_drop(df: DataFrame, key: str, keys: DataFrame, how: str, max_broadcast: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """Semi or anti join on one key; ``keys`` is a materialised one-column table.

    Its rows are counted first: up to ``max_broadcast`` keys are broadcast, so that the wide side isn't shuffled; more are joined by a shuffle.
    """
    keys = keys.select(F.col(keys.columns[0]).alias(key))
    small = keys.limit(max_broadcast + 1).count() <= max_broadcast
    return df.join(F.broadcast(keys) if small else keys, key, how)


def small_enough(df: DataFrame, texts: Column | None = None) -> bool:
    """Whether ``df`` may be broadcast: its rows and the bytes of ``texts``, both counted."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(texts if texts is not None else F.lit(0)), F.lit(0))).first()
    return n <= MAX_BROADCAST_KEYS and size <= MAX_BROADCAST_BYTES


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], by: str, rows: str = "n") -> DataFrame:
    """Inner join of ``big`` with ``small``, which has each key once and in column ``rows`` how many rows of ``big`` have it.

    Keys of more than HOT_ROWS rows, at most a thousandth as many as there are rows, are dealt to several tasks by the
    hash of column ``by``; their rows of ``small`` are repeated for each.
    """
    salts = F.least(F.lit(MOST_SALTS), F.ceil(F.col(rows) / F.lit(HOT_ROWS)).cast("int"))
    hot = small.where(F.col(rows) > HOT_ROWS).select(*keys, salts.alias("_salts"))
    hot = F.broadcast(hot) if small_enough(hot) else hot
    left = big.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"))).drop("_salts")
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(rows) > HOT_ROWS, salts).otherwise(F.lit(1)) - 1))).drop(rows)
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def arrow_rows(df: DataFrame, columns: list[str], schema: str, work: Callable[[Iterator[tuple]], Iterator[tuple]], names: list[str], types: list[pa.DataType], flush: int = 2048) -> DataFrame:
    """Run a generator over rows, Arrow batch by Arrow batch; ``flush`` rows are sent back at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 512):  # few values at a time as Python objects
                    part = b.slice(at, 512)
                    yield from zip(*(part.column(i).to_pylist() for i in range(len(columns))), strict=True)

        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for row in work(rows()):
            out.append(row)
            if len(out) >= flush:
                yield batch()
                out = []
        if out:
            yield batch()

    return df.select(*columns).mapInArrow(run, schema)
