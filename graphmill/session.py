"""Session helpers: where shared intermediate results live and how tables are read."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made and registered if Spark runs in one process
    (tests); a cluster gets an error, never a machine-local path.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="graphmill-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return f"{shared_dir(spark)}/graphmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by writing ``df`` once to the shared folder and reading it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable (never local) checkpoint in the shared folder."""
    spark = df.sparkSession
    root = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Files:
    """Small-file access through the cluster's own file system (manifests, pointers)."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def read_json(self, p: str):
        stream = self.fs.open(self.path(p))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def write_json(self, p: str, value) -> None:
        out = self.fs.create(self.path(p), False)
        try:
            out.write(bytearray(json.dumps(value).encode("utf-8")))
        finally:
            out.close()

    def rename(self, a: str, b: str) -> bool:
        return self.fs.rename(self.path(a), self.path(b))

    def names(self, p: str) -> list[str]:
        if not self.exists(p):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(p))]
