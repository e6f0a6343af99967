"""Tables between two jobs, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it isn't set, Spark's folder of tables on one
    machine; an error on a cluster, whose executors need not see that folder."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/shared"
    return root.rstrip("/")


_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Staged tables of this block are deleted at its end; results that read them
    have to be written before. Without a block they stay."""
    folder = f"{scratch(spark)}/scope-{uuid.uuid4().hex}"
    before = _SCOPE.set(folder)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: computed once, safe from lost executors."""
    path = f"{_SCOPE.get() or scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
