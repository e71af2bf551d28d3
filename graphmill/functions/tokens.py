"""Keyword tokens for lexical ranking, as native expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word runs and camel-case sub-words of the keyword ranker.
WORD = "[A-Za-z0-9]+"
SUBWORD = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
DOUBLED = "^(.+([bcdfghjklmnpqrstvwxyz]))\\2$"


def normalize(word: Column) -> Column:
    """Light suffix stripping: plural and -ing/-ed endings, undoing a doubled last consonant."""
    n = F.length(word)

    def cut(k: int) -> Column:
        return F.substring(word, F.lit(1), n - k)

    def undouble(stem: Column) -> Column:
        return F.when(F.length(stem) > 2, F.regexp_replace(stem, DOUBLED, "$1")).otherwise(stem)

    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & word.endswith("ing"), undouble(cut(3)))
        .when((n > 4) & word.endswith("ed"), undouble(cut(2)))
        .when((n > 3) & word.endswith("es"), cut(2))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def tokenize(text: Column) -> Column:
    """Distinct lower-case runs, their normal forms, and camel-case parts (if more than one) with theirs.

    Null gives an empty array.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)
    parts = F.flatten(F.transform(runs, lambda r: F.filter(F.regexp_extract_all(r, F.lit(f"({SUBWORD})"), 1), lambda _: F.size(F.regexp_extract_all(r, F.lit(f"({SUBWORD})"), 1)) > 1)))
    words = F.transform(F.concat(runs, parts), lambda w: F.lower(w))
    return F.array_distinct(F.concat(words, F.transform(words, normalize)))


def overlap(a: Column, b: Column) -> Column:
    """Number of tokens two token sets share."""
    return F.size(F.array_intersect(a, b))
