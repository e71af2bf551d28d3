"""Snapshot maintenance as set operations: merge, prune, rename, change classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``incoming`` merged over ``existing`` by key; a null or absent incoming value keeps the old one."""
    cols = existing.columns
    old = existing.select(*keys, F.struct(*[c for c in cols if c not in keys]).alias("o"))
    have = [c for c in cols if c not in keys and c in incoming.columns]
    new = incoming.select(*keys, F.struct(F.lit(1).alias("__in"), *have).alias("n"))
    both = old.join(new, keys, "full_outer")
    return both.select(*[c if c in keys else (F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in have else F.col(f"o.{c}")).alias(c) for c in cols])


def prune(existing: DataFrame, current: DataFrame, keys: list[str], scope: str = "service") -> DataFrame:
    """Rows whose key is still current; services that ``current`` doesn't speak of stay whole."""
    spoken = current.select(scope).distinct()
    kept = existing.join(current.select(*keys).distinct(), keys, "left_semi")
    return kept.unionByName(existing.join(spoken, scope, "left_anti"))


def rename(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """``renames(service, old_path, new_path)`` applied to ``file_path``; qualified names stay."""
    r = renames.select("service", F.col("old_path").alias("file_path"), "new_path").dropDuplicates(["service", "file_path"])
    return rows.join(r, ["service", "file_path"], "left").withColumn("file_path", F.coalesce("new_path", "file_path")).drop("new_path")


def replace_edges(calls: DataFrame, wanted: DataFrame, services: DataFrame) -> DataFrame:
    """Outgoing edges of the sources in ``wanted(source, target)`` replaced; unknown services are ignored."""
    known = services.select("name").distinct()
    new = wanted.join(known.withColumnRenamed("name", "source"), "source", "left_semi").join(known.withColumnRenamed("name", "target"), "target", "left_semi")
    return calls.join(wanted.select("source").distinct(), "source", "left_anti").select("source", "target").unionByName(new.select("source", "target")).distinct()


def diff_snapshots(base: DataFrame, head: DataFrame) -> DataFrame:
    """Change feed between two snapshots ``(service, file_path, blob_sha)``: added, removed, modified, renamed.

    A path that is new and holds the content of one path that is gone is that path renamed (the
    smallest gone path of equals).
    """
    b, h = base.select("service", "file_path", F.col("blob_sha").alias("old")), head.select("service", "file_path", F.col("blob_sha").alias("new"))
    j = b.withColumn("b", F.lit(1)).join(h.withColumn("h", F.lit(1)), ["service", "file_path"], "full_outer")
    gone = j.where("h is null").groupBy("service", F.col("old").alias("new")).agg(F.min("file_path").alias("previous_path"))
    came = j.where("b is null").join(gone, ["service", "new"], "left")
    first = came.where("previous_path is not null").groupBy("service", "previous_path").agg(F.min("file_path").alias("file_path"))
    came = came.join(first.withColumn("taken", F.lit(1)), ["service", "previous_path", "file_path"], "left")
    moved = came.where("taken = 1")
    out = came.select("service", "file_path", F.when(F.col("taken") == 1, "renamed").otherwise("added").alias("status"), F.when(F.col("taken") == 1, F.col("previous_path")).alias("previous_path"))
    removed = j.where("h is null").join(moved.select("service", F.col("previous_path").alias("file_path")), ["service", "file_path"], "left_anti")
    out = out.unionByName(removed.select("service", "file_path", F.lit("removed").alias("status"), F.lit(None).cast("string").alias("previous_path")))
    changed = j.where("b = 1 and h = 1 and not (old <=> new)")
    return out.unionByName(changed.select("service", "file_path", F.lit("modified").alias("status"), F.lit(None).cast("string").alias("previous_path")))


def classify_changes(changes: DataFrame, stored: DataFrame, language) -> DataFrame:
    """What to do with each changed file: delete, relabel, skip, reparse or only record it."""
    s = stored.where("blob_sha is not null").select("service", "file_path", F.col("blob_sha").alias("have"))
    p = s.select("service", F.col("file_path").alias("previous_path"), F.col("have").alias("before"))
    j = changes.join(s, ["service", "file_path"], "left").join(p, ["service", "previous_path"], "left")
    action = (
        F.when(F.col("status") == "removed", "delete")
        .when((F.col("status") == "renamed") & (F.col("sha") == F.col("before")), "relabel")
        .when(F.col("sha") == F.col("have"), "skip")
        .when(language.isNull(), "record")
        .otherwise("reparse")
    )
    return j.select("service", "file_path", "status", action.alias("action"))


def next_action(heads: DataFrame, state: DataFrame) -> DataFrame:
    """Per service: up to date, incremental from the last commit, or a full ingest."""
    j = heads.join(state, "service", "left")
    return j.select("service", F.when(F.col("commit_sha").isNull(), "full").when(F.col("commit_sha") == F.col("head_sha"), "up_to_date").otherwise("incremental").alias("action"))


def retire(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A table without retired columns; columns it never had are no error."""
    return rows.drop(*columns)


def commit_state(state: DataFrame, commits: DataFrame) -> DataFrame:
    """``state(service, commit_sha, committed_at, fingerprint)`` after ``commits(service, commit_sha, at[, fingerprint])``.

    The commit and its ISO instant replace a service's older ones; its fingerprint is cleared unless given.
    """
    given = F.col("fingerprint") if "fingerprint" in commits.columns else F.lit(None).cast("string")
    new = commits.select("service", "commit_sha", F.date_format(F.col("at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("committed_at"), given.alias("fingerprint"))
    return state.join(new.select("service"), "service", "left_anti").unionByName(new)


def in_scope(services: DataFrame, names: list[str], column: str = "name") -> DataFrame:
    """Services of some names in whatever letter case; no names mean all."""
    return services.where(F.lower(column).isin([n.strip().lower() for n in names])) if names else services


def symbols_of(classes: DataFrame, functions: DataFrame, services: list[str]) -> DataFrame:
    """Classes and functions of some services in one table with ``kind``, without their source."""
    both = classes.withColumn("kind", F.lit("class")).unionByName(functions.withColumn("kind", F.lit("function")), allowMissingColumns=True)
    return both.where(F.col("service").isin(services)).drop("source_snippet")


def service_references(files: DataFrame) -> DataFrame:
    """``(service, references)``: distinct and sorted references of all files of a service; null lists count as none."""
    each = files.select("service", F.explode("references").alias("r")).where("r is not null").distinct()
    return each.groupBy("service").agg(F.sort_array(F.collect_list("r")).alias("references"))


def missing_keys(expected: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """Expected keys that were not returned, each once."""
    return expected.select(key).distinct().join(returned.select(key), key, "left_anti")


def file_rows(symbols: DataFrame, tracked: DataFrame, blobs: DataFrame, key: list[str]) -> DataFrame:
    """File rows of runs ``(*key, file_path, language, blob_sha)``.

    A file with symbols has their language (the smallest of several), any other tracked file the one its
    tracking says; files without a known blob have none.
    """
    path = [*key, "file_path"]
    own = symbols.groupBy(*path).agg(F.min("language").alias("language"))
    rest = tracked.select(*path, "language").distinct().join(own.select(*path), path, "left_anti")
    return own.unionByName(rest).join(blobs, path, "left")
