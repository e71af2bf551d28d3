"""Deeply nested JSON to related flat tables, through Arrow buffers.

Payload texts of a batch are read into nested Arrow arrays by Arrow's JSON reader. The arrays are
then flattened column by column: a list's offsets give its children's parent index and position, the
child array is taken as a whole, and keys and paths of the parents follow by vectorised ``take``.
Before that each text is decoded once, to tell complete JSON from other text and to open a string that
holds JSON. Numbers are read as the text they are written as, so that no value depends on its batch.
Texts whose types clash within one Arrow column (``1`` here, ``{}`` there) are split into groups until
each group has one schema; a single text that clashes with itself is laid out level by level as offsets
and parent indices over a frontier of Python values.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = pa.map_(pa.string(), pa.string())
# A number and all that stands before it since the last one; with a number at the end the matches are seamless.
_NUMBER = re.compile(r'((?:[^"\d\-]++|"(?:[^"\\]|\\.)*+")*+)(-?\d[\d.eE+\-]*+)', re.S)


def numbers_quoted(text: str) -> str:
    """JSON text with each number as a string."""
    return _NUMBER.sub(r'\1"\2"', text + "0")[:-3]


def _reject(_: str):
    raise ValueError("not a JSON number")


def opened(text: str | None) -> tuple[str, object] | None:
    """A payload that is an object or array as one line of JSON and its value, else null.

    A JSON string that holds JSON is opened once. Incomplete text, NaN and infinities give null. Numbers
    stand as their text in the value.
    """
    if text is None:
        return None
    try:
        text = text.lstrip("\ufeff")
        value = json.loads(text, parse_constant=_reject, parse_int=str, parse_float=str)
        if isinstance(value, str):
            text = value
            value = json.loads(text, parse_constant=_reject, parse_int=str, parse_float=str)
        if not isinstance(value, (dict, list)):
            return None
        # Strings hold no raw line ends in JSON, so these can only stand between tokens.
        return text.replace("\n", " ").replace("\r", " ").strip(), value
    except (ValueError, RecursionError):
        return None


class _Sink:
    """Collected node rows of one batch, column by column."""

    def __init__(self, with_fields: bool):
        self.with_fields, self.row, self.path, self.parent, self.pattern, self.fields = with_fields, [], [], [], [], []

    def add(self, row, path, parent, pattern: str, fields) -> None:
        self.row.append(row)
        self.path.append(path)
        self.parent.append(parent)
        self.pattern.append(pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(row), np.int32)), pa.array([pattern])).cast(pa.string()))
        if self.with_fields:
            self.fields.append(fields)


def _text(a: pa.Array) -> pa.Array:
    return pc.cast(a, pa.string())


def _scalars(a: pa.StructArray) -> pa.Array:
    """map<string,string> of an object's scalar fields, those of plain nested objects under dotted names."""
    names, values = [], []

    def walk(x: pa.StructArray, prefix: str, alive) -> None:
        for k in range(x.type.num_fields):
            f, name = x.field(k), prefix + x.type.field(k).name
            ok = pc.is_valid(f) if alive is None else pc.and_(alive, pc.is_valid(f))
            if pa.types.is_struct(f.type):
                walk(f, name + ".", ok)
            elif not pa.types.is_list(f.type) and not pa.types.is_null(f.type):
                names.append(name)
                values.append(pc.if_else(ok, _text(f), pa.scalar(None, pa.string())))

    walk(a, "", None)
    n = len(a)
    if not names:
        return pa.MapArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()), pa.array([], pa.string()))
    order = np.arange(n * len(names)).reshape(len(names), n).T.ravel()
    flat = pa.concat_arrays(values).take(pa.array(order))
    keep = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    counts = keep.reshape(n, len(names)).sum(1)
    keys = pa.array(names).take(pa.array(np.tile(np.arange(len(names)), n)[keep]))
    return pa.MapArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), keys, flat.filter(pa.array(keep)))


def _visit(a: pa.Array, row: pa.Array, path: pa.Array, parent: pa.Array, pattern: str, sink: _Sink) -> None:
    """Emit the array elements below ``a``; ``row``, ``path`` and ``parent`` run beside it."""
    if pa.types.is_struct(a.type):
        for k in range(a.type.num_fields):
            f = a.field(k)
            if not (pa.types.is_struct(f.type) or pa.types.is_list(f.type)):
                continue
            idx = pa.array(np.flatnonzero(pc.and_(pc.is_valid(a), pc.is_valid(f)).to_numpy(zero_copy_only=False)))
            if len(idx):
                key = a.type.field(k).name
                _visit(f.take(idx), row.take(idx), pc.binary_join_element_wise(path.take(idx), "." + key, ""), parent.take(idx), f"{pattern}.{key}", sink)
    elif pa.types.is_list(a.type):
        item = a.type.value_type
        if not (pa.types.is_struct(item) or pa.types.is_list(item)):
            return
        up = pc.list_parent_indices(a).to_numpy()
        child = a.flatten()
        starts = a.offsets.to_numpy()
        lengths = np.diff(starts)
        lengths = np.where(pc.is_valid(a).to_numpy(zero_copy_only=False), lengths, 0)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        pos = np.arange(len(child)) - first[up]
        ok = np.flatnonzero(pc.is_valid(child).to_numpy(zero_copy_only=False))
        if not len(ok):
            return
        up, pos, child = pa.array(up[ok]), pa.array(pos[ok]), child.take(pa.array(ok))
        row, above = row.take(up), parent.take(up)
        at = pc.binary_join_element_wise(path.take(up), "[", _text(pos), "]", "")
        if pa.types.is_struct(item):
            sink.add(row, at, above, pattern + "[]", _scalars(child) if sink.with_fields else None)
            above = at
        _visit(child, row, at, above, pattern + "[]", sink)


def _untimed(t: pa.DataType) -> pa.DataType:
    """The inferred type with texts left as texts (the reader likes to see timestamps)."""
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, _untimed(f.type)) for f in t])
    if pa.types.is_list(t):
        return pa.list_(_untimed(t.value_type))
    return pa.string() if pa.types.is_temporal(t) else t


def _read(lines: list[str], with_fields: bool) -> pa.Array:
    data = "\n".join('{"v":' + (numbers_quoted(x) if with_fields else x) + "}" for x in lines).encode("utf-8")
    opts = pj.ReadOptions(use_threads=False, block_size=len(data) + 64)
    t = pj.read_json(io.BytesIO(data), read_options=opts)
    if with_fields and (want := _untimed(t.schema.field("v").type)) != t.schema.field("v").type:
        t = pj.read_json(io.BytesIO(data), read_options=opts, parse_options=pj.ParseOptions(explicit_schema=pa.schema([("v", want)])))
    return t.column("v").combine_chunks()


def _frontier(value, row: int, sink: _Sink) -> None:
    """One text whose own types clash: level by level, values beside their row, path and parent."""
    values, paths, parents, patterns = [value], ["$"], ["$"], ["$"]
    while values:
        nxt = ([], [], [], [])
        for v, p, up, pat in zip(values, paths, parents, patterns):
            if isinstance(v, dict):
                kids = [(x, f"{p}.{k}", up, f"{pat}.{k}") for k, x in v.items()]
            else:
                kids = [(x, f"{p}[{i}]", up, pat + "[]") for i, x in enumerate(v)]
                objs = [(q, w) for (x, q, w, _) in kids if isinstance(x, dict)]
                if objs:
                    fields = pa.array([list({k: (y if isinstance(y, str) else json.dumps(y)) for k, y in x.items() if y is not None and not isinstance(y, (dict, list))}.items()) for x in v if isinstance(x, dict)], FIELDS) if sink.with_fields else None
                    sink.add(pa.array([row] * len(objs)), pa.array([q for q, _ in objs]), pa.array([w for _, w in objs]), pat + "[]", fields)
                kids = [(x, q, q if isinstance(x, dict) else w, pp) for (x, q, w, pp) in kids]
            for kid in kids:
                if isinstance(kid[0], (dict, list)):
                    for out, y in zip(nxt, kid):
                        out.append(y)
        values, paths, parents, patterns = nxt


def _kinds(value, path: str) -> set[str]:
    """Kinds of the values at the path an Arrow message names, nulls left out."""
    level = [value]
    for step in path.split("/")[1:]:
        if step == "[]":
            level = [x for v in level if isinstance(v, list) for x in v]
        else:
            level = [v[step] for v in level if isinstance(v, dict) and step in v]
    return {"o" if isinstance(v, dict) else "a" if isinstance(v, list) else "b" if isinstance(v, bool) else "s" for v in level if v is not None}


def _group(lines: list[str], values: list, rows: np.ndarray, sink: _Sink) -> None:
    try:
        a = _read(lines, sink.with_fields)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, UnicodeEncodeError) as e:
        if len(lines) == 1:
            return _frontier(values[0], int(rows[0]), sink)
        found = re.search(r"Column\(/v(.*?)\) (?:changed|was)", str(e))
        parts: dict[str, list[int]] = {}
        for i, x in enumerate(values):
            parts.setdefault("".join(sorted(_kinds(x, found[1]))) if found else "", []).append(i)
        if len(parts) == 1 and len(next(iter(parts))) < 2:  # no clash that can be named: halves
            half = len(lines) // 2
            parts = {"a": list(range(half)), "b": list(range(half, len(lines)))}
        for kinds, own in parts.items():
            if len(kinds) > 1:  # clashes with itself
                for i in own:
                    _frontier(values[i], int(rows[i]), sink)
            else:
                _group([lines[i] for i in own], [values[i] for i in own], rows[own], sink)
        return None
    root = pa.array(["$"]).take(pa.array(np.zeros(len(a), np.int64)))
    _visit(a, pa.array(rows), root, root, "$", sink)


def flatten_batch(ids: pa.Array, texts: pa.Array, field: str, with_fields: bool) -> pa.RecordBatch | None:
    found = [opened(t) for t in texts.to_pylist()]
    # Only texts with an object inside an array can have nodes.
    rows = np.array([i for i, x in enumerate(found) if x is not None and "[" in x[0] and "{" in x[0]], np.int64)
    sink = _Sink(with_fields)
    # Objects and arrays at the top have different Arrow types.
    for top in (dict, list):
        own = [i for i in rows if isinstance(found[i][1], top)]
        if own:
            _group([found[i][0] for i in own], [found[i][1] for i in own], np.array(own, np.int64), sink)
    if not sink.row:
        return None
    row = pa.concat_arrays(sink.row)
    n = len(row)
    cols = {"delivery_id": ids.take(row), "payload_field": pa.array([field]).take(pa.array(np.zeros(n, np.int64))), "node_path": pa.concat_arrays(sink.path), "parent_path": pa.concat_arrays(sink.parent), "entity": pa.concat_arrays(sink.pattern)}
    if with_fields:
        cols["fields"] = pa.concat_arrays(sink.fields)
    return pa.RecordBatch.from_pydict(cols)


def nested_nodes(df: DataFrame, key: str, fields: list[str], with_fields: bool = False) -> DataFrame:
    """One row per JSON object that is an array element, linked to its event and its parent.

    ``(delivery_id, payload_field, node_path, parent_path, entity[, fields])``: ``entity`` is the path
    without positions (one flat table each), ``fields`` the object's scalar values as text. Null
    payloads, scalars and incomplete texts yield nothing; repeated rows yield their nodes again.
    Other columns of ``df`` never enter the Python worker, so their names cannot clash.
    """
    schema = "delivery_id bigint, payload_field string, node_path string, parent_path string, entity string" + (", fields map<string,string>" if with_fields else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, f in enumerate(fields):
                out = flatten_batch(b.column(0), b.column(k + 1), f, with_fields)
                if out is not None:
                    yield out

    return df.select(F.col(key).cast("bigint").alias("k"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]).mapInArrow(run, schema)


def flat_table(nodes: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """One related table: the nodes of ``entity`` with chosen scalar fields as columns."""
    return nodes.where(F.col("entity") == entity).select("delivery_id", "payload_field", "node_path", "parent_path", *[F.col("fields").getItem(c).alias(c.replace(".", "_")) for c in columns])
