"""What executors need from the driver."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made: list[str] = []
#: Bytes of one Arrow batch, where the session sets none: bounds a Python worker's memory, however long the texts.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the Python workers, once per application, through Spark's own file server."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "chronofold"), "zip", os.path.dirname(root), os.path.basename(root))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
        if not context.getConf().contains(ARROW_BATCH[0]):
            spark.conf.set(*ARROW_BATCH)
    return spark


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where that is unset, below one made here if all runs on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="chronofold-"))
        base = spark.sparkContext.getCheckpointDir()
    _made.append(f"{base.rstrip('/')}/chronofold/{kind}-{uuid.uuid4().hex}")
    return _made[-1]


def materialise(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: lineage ends there."""
    path = shared_dir(ship(df.sparkSession), kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it, for plain paths and any URI known to Arrow."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def clean(spark: SparkSession) -> None:
    """Delete all that this session wrote below the shared folder; results that still read it must be written first."""
    context = spark.sparkContext
    while _made:
        path = context._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
