"""References to services in text: a name near a word of networking, or in a URL's host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words, the window and where a host ends.
KEYWORDS = ["url", "uri", "endpoint", "graphql", "gateway"]
WINDOW = 60
NOT_HOST = r"/:'\"\\\s?#"
ALNUM = r"[\p{L}\p{N}]"


def positions(text: Column, name: Column) -> Column:
    """0-based starts of the non-overlapping occurrences of ``name``."""
    parts = F.split(text, F.concat(F.lit("\\Q"), name, F.lit("\\E")), -1)
    n = F.length(name)
    ends = F.transform(parts, lambda p, i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda s, x: s + F.length(x)) + i * n)
    return F.slice(ends, 1, F.size(parts) - 1)


def refers(text: Column, name: Column) -> Column:
    """Whether a lower-cased text refers to a lower-cased service name."""

    def at(p: Column) -> Column:
        n = F.length(name)
        before, after = F.substring(text, p, F.lit(1)), F.substring(text, p + n + 1, F.lit(1))
        bounded = ~(F.when(p > 0, before).otherwise("").rlike(ALNUM)) & ~after.rlike(ALNUM)
        start = F.greatest(p - WINDOW, F.lit(0))
        window = F.substring(text, start + 1, p - start + n + WINDOW)
        word = window.rlike(f"(?<!{ALNUM})(" + "|".join(KEYWORDS) + f")(?!{ALNUM})")
        host = F.substring(text, start + 1, p - start).rlike(f"https?://[^{NOT_HOST}]*\\z")
        return bounded & (word | host)

    return F.exists(positions(text, name), at)


def service_references(texts: DataFrame, services: DataFrame) -> DataFrame:
    """``texts(service, file_path, text)`` -> ``(service, file_path, reference)``, self-references left out.

    A name's first word must stand in a text, so texts and names meet by an equi-join on words. Only a
    text's key travels with its words; the text itself is joined back to the matching pairs, which alone
    are tested for their surroundings. Null texts refer to nothing.
    """
    names = services.select(F.lower("name").alias("reference")).distinct().withColumn("w", F.regexp_extract("reference", f"({ALNUM}+)", 1))
    t = texts.where("text is not null").select("service", "file_path", F.lower("text").alias("text")).withColumn("k", F.xxhash64("service", "file_path", "text"))
    keyed = t.select("k", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({ALNUM}+)"), 1))).alias("w"))
    pairs = t.join(keyed.join(names, "w").select("k", "reference").distinct(), "k").where(~F.lower("service").eqNullSafe(F.col("reference")) & F.contains("text", F.col("reference")))
    return pairs.where(refers(F.col("text"), F.col("reference"))).select("service", "file_path", "reference").distinct()
