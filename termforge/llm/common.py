"""What the training-data operators share: the shared folder, written tables, bounded Arrow batches, joins with hot keys."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.shared import shared_dir

BITS = 26  # cells of a bitmap of hashes: 2**BITS


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables of one computation, deleted by name after their last reader or all together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_dir(self.spark, name)
        out = written(df, name, path)
        self.drop(name)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        """Delete these tables, and let Spark notice that nothing refers any more to the shuffle files that led to them."""
        for path in (found := [self.paths.pop(n) for n in names if n in self.paths]):
            remove(self.spark, path)
        if found:
            self.release()

    def release(self) -> None:
        """Let Spark delete the shuffle files of what is written, which else stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def clear(self) -> None:
        self.drop(*list(self.paths))


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has each ``key`` once, dealing out a key that has very many rows.

    A key with more rows than an even share of a partition counts as hot, so there are fewer hot keys than partitions and
    their table is broadcast. A hot key's row of ``one`` is repeated for every share of its rows.
    ``many`` is read twice: it should be a written table.
    """
    spark, n = many.sparkSession, pieces(many.sparkSession)
    share = -(-many.count() // n)
    hot = many.groupBy(key).count().where(F.col("count") > max(share, 1)).select(F.col(key).alias("_hot"), F.ceil(F.col("count") / max(share, 1)).cast("int").alias("_copies")).collect()
    if not hot:
        return many.join(one, key, how)
    table = F.broadcast(spark.createDataFrame(hot, many.select(F.col(key).alias("_hot"), F.lit(1).alias("_copies")).schema))
    salt = F.when(F.col("_copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(*many.columns), F.col("_copies"))).cast("int")
    left = many.join(table, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_copies")
    right = one.join(table, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_hot", "_copies")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of 2**BITS cells in which the 64-bit ``hashes`` (column h) are set."""
    cell = F.shiftrightunsigned("h", 64 - BITS)
    words = hashes.select(F.shiftright(cell, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words["w"].to_numpy()] = words["m"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    cell = h >> np.uint64(64 - BITS)
    return (bitmap[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Bound the Arrow batches that go to Python in rows and in bytes, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(spark: SparkSession) -> int:
    """Partitions for a shuffle whose rows are then handed to Python."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
