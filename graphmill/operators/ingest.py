"""Ingestion as set operations over all services at once: chunks, embeddings, full and incremental runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.paths import chunk_name
from graphmill.operators.maintain import prune, rename, upsert

#: Size of a chunk, of an embedding request, and the waits between tries.
CHUNK_CHARS, BATCH_ITEMS, BATCH_CHARS, WAITS = 700, 100, 200_000, (5, 15, 30, 60)


def line_groups(text: Column, limit: int) -> Column:
    """Array of pieces of at most ``limit`` characters, cut between lines; a longer line is a piece of its own."""
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + 1 + F.length(x) <= limit), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("\n"), x)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.split(text, "\n"), F.array().cast("array<string>"), step)


def chunk_functions(functions: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """``functions(service, qualified_name, file_path, signature, source_snippet, language)`` to chunks.

    A function of at most ``limit`` characters is one chunk; a longer one gives several, each opened by
    its signature. Functions without a snippet have none.
    """
    whole = F.length("source_snippet") <= limit
    parts = F.when(whole, F.array("source_snippet")).otherwise(F.transform(line_groups(F.col("source_snippet"), limit), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce("signature", F.lit("")), F.lit("\n"), p))))
    f = functions.where("source_snippet is not null").select("service", F.col("qualified_name").alias("function_qualified_name"), "file_path", "language", F.posexplode(parts).alias("chunk_index", "text"))
    return f.withColumn("qualified_name", chunk_name(F.col("function_qualified_name"), F.col("chunk_index")))


def embed(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], retryable: Callable[[Exception], bool] = lambda e: True, waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``(key, embedding)`` through an injected model, in requests of at most 100 texts or 200,000 characters.

    A request is tried again after each wait; if it still fails, its texts go one by one, and a text
    that fails alone is left out, so one bad text never costs the others.
    """
    kind = rows.schema[key].dataType.simpleString()

    def ask(texts: list[str]):
        for wait in (*waits, None):
            try:
                return model(texts)
            except Exception as e:
                if wait is None or not retryable(e):
                    raise
                sleep(wait)

    def flush(keys, texts):
        try:
            return list(zip(keys, ask(texts)))
        except Exception:
            out = []
            for k, t in zip(keys, texts):
                try:
                    out.append((k, ask([t])[0]))
                except Exception:
                    continue
            return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, texts, size = [], [], 0
        for f in frames:
            for k, t in zip(f["k"], f["t"]):
                if texts and (len(texts) == BATCH_ITEMS or size + len(t) > BATCH_CHARS):
                    yield pd.DataFrame(flush(keys, texts), columns=["k", "embedding"])
                    keys, texts, size = [], [], 0
                keys.append(k)
                texts.append(t)
                size += len(t)
        if texts:
            yield pd.DataFrame(flush(keys, texts), columns=["k", "embedding"])

    src = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInPandas(run, f"k {kind}, embedding array<double>").withColumnRenamed("k", key)


def full_ingest(existing: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """A table after a full run: parsed rows merged over existing ones, what is gone pruned."""
    return prune(upsert(existing, parsed, keys), parsed, keys)


def incremental_ingest(existing: DataFrame, parsed: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A table keyed within files after a change feed ``(service, file_path, action, previous_path)``.

    Deleted files lose their rows, relabelled ones keep them under the new path, reparsed ones have
    exactly their parsed rows; all other rows stay.
    """
    moved = changes.where("action = 'relabel'").select("service", F.col("previous_path").alias("old_path"), F.col("file_path").alias("new_path"))
    gone = changes.where("action in ('delete', 'reparse')").select("service", "file_path").distinct()
    kept = rename(existing, moved).join(gone, ["service", "file_path"], "left_anti")
    fresh = parsed.join(changes.where("action = 'reparse'").select("service", "file_path").distinct(), ["service", "file_path"], "left_semi")
    return upsert(kept.select(*existing.columns), fresh, keys)
