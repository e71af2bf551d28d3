"""Token counts of texts under a public tokenizer, in Arrow batches.

The vocabulary file is a parameter and stays outside the repository. Its rank file and split pattern
define the tokens; a count only needs the pieces the pattern splits off, and pieces repeat, so each
worker keeps the counts of pieces it has met (bounded) and asks the tokenizer for new ones only.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: white space as the tokenizer's own pattern engine sees it.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WIDE = regex.compile(PATTERN.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
_PLAIN = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII)


class Counter(dict):
    """Piece -> number of tokens."""

    LIMIT = 500_000

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, (_PLAIN if text.isascii() else _WIDE).findall(text)))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's own counter for a vocabulary."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def with_token_counts(df: DataFrame, keep: dict, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of ``keep`` (name -> Column) with ``n_tokens bigint``; a null or empty text has 0.

    Only these columns and the text enter the worker; the text does not come back.
    """
    rows = df.select(*[c.alias(n) for n, c in keep.items()], F.col(text).cast("string").alias("__text"))
    schema = rows.drop("__text").schema.add("n_tokens", "long")
    names = [*keep, "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for b in batches:
            n = pa.array([count(t) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=names)

    return rows.mapInArrow(run, schema)
