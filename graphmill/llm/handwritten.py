"""Generated, minified, vendored and bulk-data files among hand-written source.

* Notices in the comments before and after all code label files: generator notices, other owners'
  copyright lines and upstream references. File names of shipped bundles and bodies of nearly nothing
  but literals are further weak labels. Those comments are cut off before any feature is computed.
* A random forest over compression ratio, token entropy, identifier lengths, comment density and
  similar features of the body decides, for labelled and unlabelled files alike. A label alone decides
  only where the forest disagrees with a notice.
* Code taken over from other projects looks hand-written, so no forest can find it: it is found by
  notices of other owners and, without one, by the share of a file's four-line shingles that also
  stand in files with such a notice. The file with the notice is the owner's copy, so the direction is known.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.session import materialize

#: What generators write into the head of their output.
GENERATED = re.compile(
    r"generated by\b|\bauto-?generated\b|@generated\b|\bdo not (edit|modify|change)\b|automatically (generated|created|produced)|(generated|produced|created) automatically|\bgenerated (on|from|at)\b|generated file\b|machine[- ]generated"
    r"|output of \S+\. changes belong|any edit is overwritten|manual changes (will be|are) lost|changes .{0,30}(will be|are) overwritten|this file was (produced|created|generated|emitted|written) (automatically|by)"
    r"|(wurde|automatisch) .{0,60}(erzeugt|generiert|erstellt)|nicht (von hand|manuell) (bearbeiten|ändern|geändert)|archivo (creado|generado)|no (modificar|editar) (a mano|manualmente)|generado (por|autom)|généré (par|autom)|ne pas (modifier|éditer)|gerado (por|autom)",
    re.I,
)
BY_HAND = re.compile(r"(maintained|written|edited|kept) by hand", re.I)
#: Marks of a file that belongs to another project.
FOREIGN = re.compile(r"\bthe [\w.-]+ (authors|contributors|developers|project)\b|part of the [\w.-]+ (project|library|package)|see LICENSE-|\bupstream:\s*\S+|^\W*[\w.-]+ v\d+\.\d+(\.\d+)? - |^\W*@(license|preserve)\b|vendored from|copied from https?:|taken from https?:", re.I | re.M)
COPYRIGHT = re.compile(r"copyright\b.*", re.I)
BUNDLE = re.compile(r"[.-](min|bundle|packed)\.(js|mjs|css)$", re.I)
#: Names outside literals (log1p) that a file of nothing but data has at most.
DATA_NAMES = math.log1p(14)
#: Places of two features.
LITERAL_SHARE, NAMES_OUTSIDE = 12, 22

_PIECE = re.compile(
    r"[A-Za-z_$][\w$]*+|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`|(?<![\w.])-?\d[\w.]*+"
    r"|/\*.*?\*/|<!--.*?-->|(?<![:\"'\w])//[^\n]*|(?m:^[ \t]*#[^\n{]*)|[^\w\s]",
    re.S,
)
_FLOW = frozenset("if else elif for while return when switch case try catch except raise throw await yield and or not in of with do".split())
_SKIPPED = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or b == 95)


def readable(content: bytes) -> str:
    """Text of a file in UTF-8, else in UTF-16 where its mark says so, else in a one-byte code."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else "cp1252", "replace")


_LEAD = re.compile(r"﻿?\s*(?:/\*.*?\*/|<!--.*?-->|//[^\n]*|#[^\n{]*(?=\n|\Z)|<\?xml[^>]*\?>|@charset[^\n]*|<!doctype[^>]*>|['\"]use strict['\"];?)", re.S | re.I)


def split_notes(text: str) -> tuple[str, str]:
    """(comments before and after all code, body)."""
    at, n = 0, len(text)
    while at < n and (m := _LEAD.match(text, at)):
        at = m.end()
    end = max(at, len(text.rstrip()))
    while end > at:
        if text.endswith("*/", at, end):
            start = text.rfind("/*", at, end)
        elif text.endswith("-->", at, end):
            start = text.rfind("<!--", at, end)
        else:
            start = max(at, text.rfind("\n", at, end) + 1)
            if "{" in text[start:end] or not text[start:end].lstrip().startswith(("//", "#")):
                break
        if start < at or text[max(at, text.rfind("\n", at, start) + 1) : start].strip():
            break
        end = at + len(text[at:start].rstrip())
    return text[:at] + "\n" + text[end:].lstrip(), text[at:end]


def notice(head: str, own: tuple[str, ...]) -> str | None:
    """What the comments around the code say: ``generated``, ``vendored`` or nothing."""
    if GENERATED.search(head) and not BY_HAND.search(head):
        return "generated"
    for line in COPYRIGHT.findall(head):
        if not any(o in line.lower() for o in own) and re.search(r"\d{4}|\(c\)|©", line, re.I):
            return "vendored"
    if re.match(r"\s*/\*!", head) or FOREIGN.search("\n".join(x for x in head.splitlines() if not any(o in x.lower() for o in own))):
        return "vendored"
    return None


def features(body: str) -> list[float]:
    """Numbers that describe a body's looks.

    The body is cut once into names, literals, comments and marks; all sums run over the distinct ones.
    Shapes are the lines with everything but their marks left out.
    """
    n = max(1, len(body))
    raw = body.encode("utf-8", "surrogatepass")
    count = Counter(_PIECE.findall(body))
    total = max(1, sum(count.values()))
    names = letters = short = numbered = distinct = flow = nums = literals = literal = longest = comments = comment = 0
    for t, c in count.items():
        f = t[0]
        if f.isalpha() or f in "_$":
            names += c
            k = len(t)
            letters += k * c
            distinct += 1
            if k < 3:
                short += c
            if t[-1].isdigit():
                numbered += c
            if t in _FLOW:
                flow += c
        elif len(t) == 1 and not f.isdigit():
            continue
        elif f in "\"'`":
            literals += c
            literal += len(t) * c
            longest = max(longest, len(t))
        elif f.isdigit() or f == "-":
            nums += c
            literal += len(t) * c
            longest = max(longest, len(t))
        else:
            comments += c
            comment += len(t) * c
    freq = np.fromiter(count.values(), float, len(count)) / total
    entropy = float(-(freq * np.log2(freq)).sum())
    sizes = list(map(len, body.split("\n")))
    shapes = Counter(map(bytes.strip, raw.translate(None, _SKIPPED).split(b"\n")))
    shapes.pop(b"", None)
    filled = max(1, sum(shapes.values()))
    compact = len("".join(body.split()))
    dense = max(1, compact - body.count(",") - body.count(";"))
    k = max(1, names)
    return [
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        entropy,
        entropy / math.log2(total + 1),
        letters / k,
        short / k,
        numbered / k,
        distinct / k,
        comment / n,
        comments / filled,
        math.log1p(len(body) / len(sizes)),
        math.log1p(max(sizes)),
        sum(s for s in sizes if s > 200) / n,
        literal / dense,
        longest / n,
        (nums + literals) / total,
        len(shapes) / filled,
        max(shapes.values(), default=0) / filled,
        (len(body) - compact) / n,
        flow / k,
        (total - names - nums - literals - comments) / total,
        math.log1p(n),
        math.log1p(filled),
        math.log1p(names),
    ]


def shingles(body: str, size: int = 4) -> list[int]:
    """Hashes of runs of ``size`` lines that hold more than three characters besides blanks at their ends.

    Each line is hashed once; a run's hash is rolled from its lines' by a polynomial modulo 2^64.
    """
    import xxhash

    lines = [xxhash.xxh3_64_intdigest(x) for x in map(str.strip, body.split("\n")) if len(x) > 3]
    if len(lines) < size:
        return []
    h = np.array(lines, np.uint64)
    run = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        run = run * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(run)]
    return np.unique(run.view(np.int64)).tolist()


def _is_json(body: str) -> bool:
    try:
        json.loads(body)
    except ValueError:
        return False
    return True


def file_facts(files: DataFrame, own: tuple[str, ...], record_chars: int = 4_000) -> DataFrame:
    """``(file_id, service, language, label, x, shingles)`` of files with content, csv left out.

    Files in other encodings than UTF-8 are read as what they seem to be; syntax does not matter. Labels
    only teach the forest: ``record`` (a JSON document of under ``record_chars`` characters) is a known
    negative, ``data`` a body of nearly nothing but literals.
    """
    src = files.where(F.col("content").isNotNull() & (F.coalesce(F.lower("language"), F.lit("")) != "csv")).select(F.col("file_id").cast("bigint").alias("file_id"), F.coalesce("service", F.lit("")).alias("service"), "language", F.coalesce("file_path", F.lit("")).alias("file_path"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, xs, shs = [], [], []
            for path, content in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                notes, body = split_notes(readable(content).replace("\r\n", "\n"))
                x = features(body)
                label = notice(notes, own)
                if label is None and BUNDLE.search(path):
                    label = "minified"
                if label is None and body[:1] in ("{", "[") and len(body) < record_chars and _is_json(body):
                    label = "record"
                if label is None and x[LITERAL_SHARE] >= 0.8 and x[NAMES_OUTSIDE] < DATA_NAMES:
                    label = "data"
                labels.append(label)
                xs.append(x)
                shs.append(shingles(body))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(labels, pa.string()), pa.array(xs, pa.list_(pa.float64())), pa.array(shs, pa.list_(pa.int64()))], names=["file_id", "service", "language", "label", "x", "shingles"])

    return src.mapInArrow(run, "file_id bigint, service string, language string, label string, x array<double>, shingles array<bigint>")


def fit_forest(facts: DataFrame, max_rows: int = 20_000, trees: int = 40, depth: int = 9, doubt: float = 0.2):
    """Forest for "like the labelled files", on at most about ``max_rows`` rows in even hash order.

    Files of the same kind without a notice are among the unlabelled rows. So that no forest learns them
    as hand-written, two smaller ones are fitted on one half of the unlabelled rows each, and rows that
    the other half's forest scores ``doubt`` or more stay out of the final fit. Labels of taken-over
    code say nothing about its looks, so those rows take no part. Null without labelled or unlabelled rows.
    """
    rows = facts.where("label is null or label <> 'vendored'").select((F.col("label").isNotNull() & (F.coalesce("label", F.lit("")) != "record")).cast("double").alias("y"), F.coalesce(F.col("label") == "record", F.lit(False)).alias("known"), F.pmod(F.xxhash64("file_id", F.lit("half")), F.lit(2)).alias("half"), "file_id", array_to_vector("x").alias("v"))
    n = facts.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("file_id"), F.lit(1 << 20)) < F.lit(int(max_rows / n * (1 << 20))))
    count = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if not count.get(0.0) or not count.get(1.0):
        return None
    rows = rows.withColumn("w", F.when(F.col("y") == 1, F.lit(max(1.0, min(5.0, count[0.0] / count[1.0] / 2)))).otherwise(1.0)).persist()
    grow = lambda d, k: RandomForestClassifier(featuresCol="v", labelCol="y", weightCol="w", numTrees=k, maxDepth=depth, seed=5, minInstancesPerNode=2).fit(d)
    p = vector_to_array("probability")[1]
    sure = rows.where((F.col("y") == 1) | F.col("known"))
    for half in (0, 1):
        rest = rows.where((F.col("half") != half) & (F.col("y") == 0) & ~F.col("known"))
        judged = grow(rows.where((F.col("y") == 1) | F.col("known") | (F.col("half") == half)), max(1, trees // 2)).transform(rest)
        sure = sure.unionByName(judged.where(p < doubt).select(rows.columns))
    model = grow(sure, trees)
    rows.unpersist()
    return model


def not_handwritten(files: DataFrame, own: tuple[str, ...], too_large: int = 2_000_000, share: float = 0.5, cut: float = 0.5) -> DataFrame:
    """``(file_id, service, language, reason, score)`` of files that were not written by hand.

    ``own`` are the owner's names in lower case, as copyright lines give them. Rows over ``too_large``
    bytes are cases whatever they hold; other rows without content and csv files are none. ``reason`` is
    the first that holds of ``oversized``, ``vendored`` (a notice of another owner), ``forest`` (score of
    at least ``cut``), ``copied`` (at least ``share`` of the file's shingles also occur in files with such
    a notice) and the label of a file that the forest does not see as one. Repeated rows come out
    repeatedly, an empty table gives no row.
    """
    facts = materialize(file_facts(files, own), "p6-facts")
    model = fit_forest(facts)
    base = facts.select("file_id", "service", "language", "label", "shingles", array_to_vector("x").alias("v"))
    score = F.round(vector_to_array("probability")[1], 6) if model is not None else F.lit(0.0)
    scored = (model.transform(base) if model is not None else base).select("file_id", "service", "language", "label", "shingles", score.alias("score"))
    case = F.when(F.col("label") == "vendored", "vendored").when(F.col("score") >= cut, "forest").when(F.col("label") != "record", F.col("label"))
    judged = scored.select("file_id", "service", "language", case.alias("reason"), "score")
    foreign = facts.where("label = 'vendored'").select(F.explode("shingles").alias("h"), F.lit(1.0).alias("foreign")).distinct()
    rest = scored.where(case.isNull()).select("file_id", F.explode("shingles").alias("h"))
    # A mean, so that repeated rows of one file count as one.
    copied = rest.join(foreign, "h", "left").groupBy("file_id").agg(F.avg(F.coalesce("foreign", F.lit(0.0))).alias("part")).where(F.col("part") >= share).select("file_id")
    taken = judged.where("reason is null").join(copied, "file_id", "left_semi").withColumn("reason", F.lit("copied"))
    small = judged.where("reason is not null").unionByName(taken)
    big = files.where(F.col("size_bytes") > too_large).select(F.col("file_id").cast("bigint").alias("file_id"), F.coalesce("service", F.lit("")).alias("service"), "language", F.lit("oversized").alias("reason"), F.lit(1.0).alias("score"))
    return big.unionByName(small.join(big.select("file_id"), "file_id", "left_anti"))
