"""Repository snapshots: landed folders and archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.paths import DENIED, MAX_PARSE_BYTES, MAX_SCAN_BYTES, SCANNED, denied, language_of, suffix


def scan_folder(spark: SparkSession, root: str, service: str) -> DataFrame:
    """``(service, file_path, content, size_bytes, mtime)`` of all files below ``root``.

    Files of no bytes hold no symbols; the binary reader does not list them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^\\Q{base}\\E/?", "")
    return files.select(F.lit(service).alias("service"), rel.alias("file_path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))


def outcomes(files: DataFrame, max_bytes: int = MAX_PARSE_BYTES) -> DataFrame:
    """What a parse run does with each file: ``denied``, ``tracked``, ``unsupported``, ``oversized``, ``failed`` or ``parsed``."""
    path = F.col("file_path")
    kind = language_of(path)
    return files.withColumn(
        "outcome",
        F.when(denied(path), "denied").when(kind.isin("html", "css", "csv"), "tracked").when(kind.isNull(), "unsupported").when(F.col("size_bytes") > max_bytes, "oversized").when(F.col("content").isNull(), "failed").otherwise("parsed"),
    )


def scannable(files: DataFrame) -> DataFrame:
    """Files small and textual enough for a reference scan."""
    return files.where(~denied(F.col("file_path")) & F.lower(suffix(F.col("file_path"))).isin(SCANNED) & (F.col("size_bytes") <= MAX_SCAN_BYTES))


def unpack_zip(archives: DataFrame) -> DataFrame:
    """``archives(service, content)`` -> files; the first path part is dropped, links skipped.

    A path that leaves the archive's folder is an error, not a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for service, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names, blobs = [], []
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for info in z.infolist():
                        if info.is_dir() or (info.external_attr >> 16) & 0o170000 == 0o120000:
                            continue
                        parts = info.filename.split("/")[1:]
                        if ".." in parts or info.filename.startswith("/"):
                            raise ValueError(f"path leaves the archive: {info.filename}")
                        if parts and not set(parts[:-1]) & set(DENIED):
                            names.append("/".join(parts))
                            blobs.append(z.read(info))
                yield pa.RecordBatch.from_arrays([pa.array([service] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(blobs, pa.binary()), pa.array([len(x) for x in blobs], pa.int64())], names=["service", "file_path", "content", "size_bytes"])

    return archives.select("service", "content").mapInArrow(run, "service string, file_path string, content binary, size_bytes bigint")


def fingerprint(files: DataFrame) -> DataFrame:
    """Order-independent digest of a snapshot's paths, sizes and times, by service.

    Each file gives a digest; digests are sorted and hashed in two levels, so a large service is
    digested in 256 even parts first.
    """
    each = files.select("service", F.sha1(F.concat_ws("\t", "file_path", F.col("size_bytes").cast("string"), F.col("mtime").cast("string"))).alias("d"))
    part = each.groupBy("service", F.substring("d", 1, 2).alias("p")).agg(F.sha1(F.array_join(F.sort_array(F.collect_list("d")), "")).alias("d"))
    return part.groupBy("service").agg(F.sha1(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda s: s["d"]), "")).alias("fingerprint"))
