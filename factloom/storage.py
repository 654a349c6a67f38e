"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local one that goes with the driver, but only if driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Named intermediate tables of one job, written as Parquet so that a lost executor costs no recomputation.

    ``save`` writes a table and returns it reread; ``drop`` deletes one that later steps no longer read.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/factloom/{job}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, compression: str = "zstd", rows: int | None = None) -> DataFrame:
        """``rows``: at most so many in a row group. Readers hold one at a time, of up to 4,096 rows, so large rows need small ones."""
        path = f"{self.root}/{name}"
        held = {} if rows is None else {"parquet.block.row.count.limit": str(rows)}
        df.write.options(compression=compression, **held).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def listed(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A short list as a table of known size. Spark takes rows of Python for a table of unknown size and shuffles what it joins, by its few keys."""
    return spark.createDataFrame(pa.table(list(map(list, zip(*rows, strict=True))), names=[c.split()[0] for c in schema.split(", ")]), schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
