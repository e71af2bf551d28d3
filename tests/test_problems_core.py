"""Nested payloads and redelivered messages against brute force, with every awkward input."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphmill.operators.components import connected_components
from graphmill.operators.nested import flat_table, nested_nodes, numbers_quoted
from graphmill.operators.redelivery import MessageStore, repeated_deliveries

EVENT = "delivery_id bigint, batch_no bigint, event_id string, event_source string, tenant_id string, provider_event_id string, received_at string"


def walk(v, path="$", up="$"):
    if isinstance(v, dict):
        for k, y in v.items():
            yield from walk(y, f"{path}.{k}", up)
    elif isinstance(v, list):
        for i, y in enumerate(v):
            q = f"{path}[{i}]"
            if isinstance(y, dict):
                yield q, up
                yield from walk(y, q, q)
            else:
                yield from walk(y, q, up)


PAYLOADS = [
    '{"a":[{"x":1},{"x":{"y":[{}]}}]}', '[1,{"a":[{"b":1},2,null,{}]}]', '{"a":5}', '{"a":[[{"q":1}],[],[{"q":"s"}]]}', '"{\\"a\\":[{\\"z\\":1}]}"', '{"a":[{"b"', None, "", "5", "null",
    '{"a b.c":[{"":[{"k":1}]}]}', '{"t":[{"d":"2024-01-01T00:00:00Z","n":123456789012345678901234}]}', '{"a":[],"b":{}}', '{\n "a": [\r\n {"x": [ {"y": null} ] } ]\n}', '[{"a":NaN}]', '{"a":[{"u":"\\ud83d\\ude00 \u2603"}]}',
    '{"a":[{"k":1,"k":2}]}', '{"deep":' * 30 + '[{"x":1}]' + "}" * 30, json.dumps({"a": [{"i": i, "b": [{"j": j} for j in range(20)]} for i in range(300)]}),
]


def test_nested_nodes_equal_a_walk(spark):
    rows = [(i % 18, p, p if i % 2 else None, i) for i, p in enumerate(PAYLOADS * 2)]
    df = spark.createDataFrame(rows, "delivery_id bigint, raw_payload string, structured_payload string, node_path int")
    got = sorted(map(tuple, nested_nodes(df, "delivery_id", ["raw_payload", "structured_payload"]).select("delivery_id", "payload_field", "node_path", "parent_path").collect()))
    want = []
    for d, r, s, _ in rows:
        for f, t in (("raw_payload", r), ("structured_payload", s)):
            try:
                v = json.loads(t, parse_constant=lambda c: 1 / 0)
                v = json.loads(v) if isinstance(v, str) else v
            except (TypeError, ValueError, ZeroDivisionError):
                continue
            want += [(d, f, q, up) for q, up in walk(v)]
    assert got == sorted(want)


def test_flat_table_keeps_values_as_text(spark):
    df = spark.createDataFrame([(1, '{"commits":[{"id":"a","n":1,"ok":true,"o":{"at":"2024-01-01T00:00:00Z"},"files":[{"path":"p","status":null}]}]}')], "delivery_id bigint, raw_payload string")
    nodes = nested_nodes(df, "delivery_id", ["raw_payload"], with_fields=True)
    c = flat_table(nodes, "$.commits[]", ["id", "n", "ok", "o.at"]).first()
    assert (c.id, c.n, c.ok, c.o_at) == ("a", "1", "true", "2024-01-01T00:00:00Z")
    f = flat_table(nodes, "$.commits[].files[]", ["path", "status"]).first()
    assert (f.parent_path, f.path, f.status) == ("$.commits[0]", "p", None)


def test_numbers_are_kept_as_written(spark):
    assert numbers_quoted('{"a-1":-1.50e+3,"s":"x \\"5, 6\\" -7","b":[1,2.0],"c":true}') == '{"a-1":"-1.50e+3","s":"x \\"5, 6\\" -7","b":["1","2.0"],"c":true}'
    assert numbers_quoted('{"s":"no 5"}') == '{"s":"no 5"}' and numbers_quoted("[]") == "[]"
    texts = ['{"a":[{"big":9007199254740993}]}', '{"a":[{"big":1.5}]}', '{"a":[{"big":"7"},{"big":{"x":1e400}}]}', '{"a":[{"big":[1,{}]}, {"big":10000000000000000000001}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "delivery_id bigint, raw_payload string").coalesce(1)
    got = {(r.delivery_id, r.node_path): r.fields for r in nested_nodes(df, "delivery_id", ["raw_payload"], with_fields=True).collect()}
    assert got[(0, "$.a[0]")] == {"big": "9007199254740993"} and got[(1, "$.a[0]")] == {"big": "1.5"} and got[(2, "$.a[0]")] == {"big": "7"} and got[(3, "$.a[1]")] == {"big": "10000000000000000000001"}


def test_nested_empty_table(spark):
    df = spark.createDataFrame([], "delivery_id bigint, raw_payload string")
    assert nested_nodes(df, "delivery_id", ["raw_payload"]).count() == 0


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    from datetime import datetime

    for d, _, e, s, t, p, _ in rows:
        find(("d", d))
        if e is not None:
            parent[find(("d", d))] = find(("e", e))
        if p is not None and s is not None and t is not None and p.strip().lower() not in ("", "null", "undefined"):
            parent[find(("d", d))] = find(("p", s, t, p.strip().lower()))
    best = {}
    for d, *_, at in rows:
        k = find(("d", d))
        v = ((0, datetime.fromisoformat(at)) if at else (1, datetime.fromisoformat("2999-01-01T00:00:00+00:00")), d)
        best[k] = min(best.get(k, v), v)
    return {r[0] for r in rows} - {v[1] for v in best.values()}


def test_redelivery_equals_union_find(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        e = rng.choice([None, f"e{rng.randrange(160)}", f"e{i}"])
        p = rng.choice([None, "", " ", "null", "Undefined", f"p{rng.randrange(150)}", f" P{rng.randrange(150)} "])
        at = rng.choice([None, f"2025-03-{rng.randrange(1, 9):02d}T10:00:00.{rng.randrange(5)}+02:00", f"2025-03-0{rng.randrange(1, 9)}T08:00:00Z"])
        rows.append((i, rng.choice([None, *range(8)]), e, rng.choice(["a", "b", None]), rng.choice(["t", None]), p, at))
    rows += rows[:20]  # the very same deliveries again
    df = spark.createDataFrame(rows, EVENT).withColumn("label", F.lit("x")).withColumn("day", F.lit(1))
    got = repeated_deliveries(df, f"file://{tmp_path}/store")
    assert got.columns == ["delivery_id"]
    assert {r[0] for r in got.collect()} == brute(rows)


def test_redelivery_in_a_hot_chain_over_batches(spark, tmp_path):
    """Links through old copies merge two messages that history knew apart; only touched days are rewritten."""
    store = MessageStore(spark, f"file://{tmp_path}/s")
    day = "2025-03-0{}T00:00:00Z"
    first = [(1, 0, "a", "s", "t", "x", day.format(1)), (2, 0, "b", "s", "t", "y", day.format(2)), (3, 0, "c", "s", "t", None, day.format(3)), (4, 0, None, "s", "t", None, day.format(4))]
    store.apply(spark.createDataFrame(first, EVENT))
    before = store.manifest()["parts"]
    store.apply(spark.createDataFrame([(5, 1, "a", "s", "t", "Y ", day.format(5))], EVENT))
    assert sorted(r.delivery_id for r in store.winners().collect()) == [1, 3, 4]
    after = store.manifest()
    assert {d for d in before if before[d] != after["parts"].get(d)} == {"2025-03-01", "2025-03-02"}
    store.apply(spark.createDataFrame([(6, 2, "b", "s", "t", None, day.format(1))], EVENT))
    assert sorted(r.delivery_id for r in store.winners().collect()) == [1, 3, 4]
    store.apply(spark.createDataFrame([], EVENT))
    assert store.winners().count() == 3


def test_redelivery_empty_table(spark, tmp_path):
    assert repeated_deliveries(spark.createDataFrame([], EVENT), f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {"chain": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 60)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]}[shape]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame([*edges, (None, 1), (5, 5)], "u bigint, v bigint")).collect()}
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: label[n] for n in linked}
