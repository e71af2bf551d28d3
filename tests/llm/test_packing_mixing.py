"""Token counts, packs and mixes."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from graphmill.llm.mixing import distinct_texts, plan_sources, training_order
from graphmill.llm.packing import pack_items, sum_of_squares
from graphmill.llm.tokens import VOCABULARY, counter, with_token_counts

TEXTS = ["Hello world", "  two  spaces\n\n\ttabs ", "it's they'll 123 4567", "Grüße, señor — 東京 ½ ² 😀", "x" * 5000, "def f(a_b):\n    return a_b[1:]\r\n", "\x1c odd \x85 blanks　here", "'S 'll", " \n \n", "é" * 3000]


@pytest.mark.parametrize("t", TEXTS)
def test_counts_equal_the_tokenizer(t):
    c = counter(VOCABULARY)
    assert c.count(t) == len(c.encoding.encode_ordinary(t))


def test_counts_on_rows(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*TEXTS, None, ""])], "doc_id bigint, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in with_token_counts(df, {"doc_id": F.col("doc_id")}).collect()}
    assert got[len(TEXTS)] == 0 and got[len(TEXTS) + 1] == 0 and got[0] == counter(VOCABULARY).count(TEXTS[0])


def plain_sum_of_squares(sizes, cap):
    """The rule itself, recomputing the whole sum for every choice."""
    bins, out = [], []
    for s in sizes:
        def total(extra):
            return sum(v * v for g, v in collections.Counter(extra).items() if g > 0)

        best = min([(total(bins[:i] + [g - s] + bins[i + 1 :]), i) for i, g in enumerate(bins) if g >= s] + [(total([*bins, cap - s]), len(bins) + 0.5)])
        if best[1] == int(best[1]):
            bins[int(best[1])] -= s
        else:
            bins.append(cap - s)
        out.append(total(bins))
    return out


def test_sum_of_squares_is_minimal_at_each_step():
    rng = random.Random(1)
    sizes, cap = [rng.randrange(1, 31) for _ in range(120)], 30
    packs, offsets = sum_of_squares(sizes, cap)
    fill, sums = collections.Counter(), []
    for s, p, o in zip(sizes, packs, offsets):
        assert fill[p] == o and o + s <= cap
        fill[p] += s
        sums.append(sum(v * v for g, v in collections.Counter(cap - f for f in fill.values()).items() if g > 0))
    assert len(sums) == len(plain_sum_of_squares(sizes, cap))
    # Each step reaches the least sum that its own state allows.
    gaps = []
    for s, p in zip(sizes, packs):
        def total(x):
            return sum(v * v for g, v in collections.Counter(x).items() if g > 0)

        choices = [total([*gaps, cap - s])] + [total(gaps[:i] + [g - s] + gaps[i + 1 :]) for i, g in enumerate(gaps) if g >= s]
        if p == len(gaps):
            gaps.append(cap - s)
        else:
            gaps[p] -= s
        assert total(gaps) == min(choices)


def test_packs_hold_everything_once(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, None, 1, 7, 100, 512, 513, 1030, rng.randrange(1, 400)])) for i in range(800)] + [(7, 7), (7, 7), (None, 5)]
    sizes = spark.createDataFrame([("s", 512), ("m", 1000), ("bad", 0), ("none", None)], "pack_name string, capacity_tokens int")
    df = spark.createDataFrame([(a, b, "x") for a, b in items], "doc_id bigint, n_tokens bigint, pack_id string")
    got = pack_items(df, sizes, items_per_group=300).collect()
    assert {r.pack_name for r in got} == {"s", "m"}
    for name, cap in (("s", 512), ("m", 1000)):
        mine = [r for r in got if r.pack_name == name]
        by_pack = collections.defaultdict(list)
        for r in mine:
            if r.pack_id is not None:
                by_pack[r.pack_id].append((r.pack_offset, r.piece_tokens))
        for pieces in by_pack.values():
            end = 0
            for o, n in sorted(pieces):
                assert o == end and n > 0
                end += n
            assert end <= cap
        total = sum(n or 0 for _, n in items)
        assert sum(r.piece_tokens for r in mine) == total
        cut = collections.Counter(r.doc_id for r in mine if r.piece > 0 or r.piece_tokens == cap)
        assert all((dict(items).get(d) or 0) >= cap or d == 7 for d in cut)
        assert len([r for r in mine if r.pack_id is None]) == sum(not n for _, n in items)
        assert name == "m" or total / (len(by_pack) * cap) > 0.9  # two of the many 513 never share a pack of 1000


def test_packs_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert pack_items(df, spark.createDataFrame([("s", 5)], "pack_name string, capacity_tokens int")).count() == 0


def mix(spark, docs, targets, **k):
    d = spark.createDataFrame(docs, "doc_id bigint, source string, tid bigint, n_tokens bigint").withColumn("position", F.lit("x"))
    t = spark.createDataFrame(targets, "source string, target_weight double, max_repeats int")
    texts = distinct_texts(d, t)
    plan = plan_sources(texts, t, **k)
    return training_order(texts, plan, bucket_rows=50), plan


def test_mix_reaches_weights_within_repeats(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["a", " A", "b", "c", None, "other"]), i % 900, rng.randrange(1, 60)) for i in range(2000)]
    targets = [("a", 0.5, 1), ("B ", 0.3, 4), ("c", 0.1, 2), ("ghost", 0.1, 3), (None, 0.5, 1)]
    rows, plan = mix(spark, docs, targets)
    got = rows.collect()
    share = collections.Counter()
    for r in got:
        share[r.source] += r.n_tokens
    total = sum(share.values())
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(share[s] / total - w / 0.9) < 0.01
    uses = collections.Counter((r.source, r.doc_id) for r in got)
    cap = {"a": 1, "b": 4, "c": 2}
    assert all(n <= cap[s] for (s, _), n in uses.items())
    p = {r.source: r for r in plan.collect()}
    assert p["ghost"].tokens == 0 and p["ghost"].demand == 0 and abs(sum(r.weight for r in p.values()) - 1) < 1e-9
    # Early positions lean to the source with the larger tilt, late ones away from it.
    first, last = max(p.values(), key=lambda r: r.tilt if r.tokens else -9), min(p.values(), key=lambda r: r.tilt if r.tokens else 9)
    half = max(r.position for r in got) / 2
    early = collections.Counter(r.source for r in got if r.position < half)
    late = collections.Counter(r.source for r in got if r.position >= half)
    assert early[first.source] / late[first.source] > early[last.source] / late[last.source]


def test_reposts_count_as_one_text(spark):
    rows, _ = mix(spark, [(i, "a", 1, 10) for i in range(50)] + [(100, "a", 2, 10), (101, "a", 3, None), (None, "a", 4, 5)], [("a", 1.0, 2)])
    assert collections.Counter(r.doc_id for r in rows.collect()) == {0: 2, 100: 2}


def test_mix_empty(spark):
    rows, plan = mix(spark, [], [("a", 1.0, 1)])
    assert rows.count() == 0 and plan.first().demand == 0
