"""Long spans that stand verbatim in more than one text, by seeds, anchors and collinear chains.

1. Seeds: every window of ``min_len`` characters contributes its minimal k-mer (robust minimizers over
   rolling hashes, all in numpy). Two equal windows have the same minimizer, so a shared span of
   ``min_len`` characters always shows as a shared seed. Identical texts count once.
2. Seeds of two or more texts are kept (one aggregation with map-side combine).
3. Anchors: around a shared seed the window of ``min_len - 16`` characters at every 17th offset is a
   key, its 16 characters to the left and right are context. Any shared span of ``min_len`` contains
   such a window, and left and right agreement together must reach 16. Equal key and context is a
   match; other members of a key are matched by each split ``o`` of the 16 characters. Both steps are
   groupings with map-side combine, so a passage in a third of all texts is no hot spot, and each text
   gets a partner for each anchor without pairs inside a group.
4. Chains: a text's anchors are merged along their diagonal and chained against each partner with
   linear gap costs through a Fenwick tree; a chain is a passage, exact inside its anchors and fuzzy
   in the gaps, which ``aligned_passages`` aligns by edit distance.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.session import materialize

STEP = 17
SIDE = STEP - 1
BASE = 0x9E3779B97F4A7C15
POS_BITS = 22


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Rolling:
    """Polynomial hashes of all windows of any length, by doubling."""

    def __init__(self, cp: np.ndarray):
        self.pow = {1: (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)}

    def _double(self, m: int) -> np.ndarray:
        if m not in self.pow:
            h = self._double(m // 2)
            b = np.uint64(pow(BASE, m // 2, 1 << 64))
            self.pow[m] = h[: -(m // 2)] * b + h[m // 2 :] if len(h) > m // 2 else h[:0]
        return self.pow[m]

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the windows of ``length`` at ``starts``."""
        out, off, bit = np.zeros(len(starts), np.uint64), 0, 1 << (length.bit_length() - 1)
        while bit:
            if length & bit:
                out = out * np.uint64(pow(BASE, bit, 1 << 64)) + self._double(bit)[starts + off]
                off += bit
            bit >>= 1
        return _mix(out)

    def all(self, length: int) -> np.ndarray:
        """Hashes of all windows; ``length`` is a power of two."""
        return _mix(self._double(length))


def minimizers(roll: Rolling, n: int, k: int, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-mer, position of the minimal k-mer of each window of ``min_len``)."""
    h = roll.all(k)
    w = min_len - k + 1
    low = np.uint64((1 << POS_BITS) - 1)
    # The position in the low bits makes minima unique; it wraps only in texts of 4 million characters, checked by the caller.
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: -(w - span)], m[w - span :])
    return h, (m & low).astype(np.int64)


def _pieces(cp: np.ndarray, min_len: int, piece: int = 1 << (POS_BITS - 1)) -> Iterator[tuple[int, np.ndarray]]:
    """A very long text in overlapping pieces, so that every window is whole in one of them."""
    for start in range(0, max(1, len(cp) - min_len + 1), piece):
        yield start, cp[start : start + piece + min_len - 1]


def shared_passages(docs: DataFrame, min_len: int = 200, k: int = 64, gap_cost: float = 0.1, max_gap: int = 400) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` -> (passages, members).

    ``passages(tid, start, stop, partner, partner_start, partner_stop, exact, segments, runs)`` with code
    point positions (``runs`` are the exact parts); ``members(tid, doc_id, n_chars, copies)`` maps texts to documents (``tid`` is the
    64-bit hash of a text, ``copies`` the documents with that very text). Null and shorter texts have
    no passages; repetition inside one text is none. Repeated ``doc_id`` rows with one text are one
    document; extra columns are ignored. Empty input gives empty tables.
    """
    if k & (k - 1) or min_len < k + STEP:
        raise ValueError("k must be a power of two, and min_len at least k + 17")
    key_len = min_len - SIDE
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= min_len)).withColumn("tid", F.xxhash64("text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, hs, ts, ps = set(), [], [], []
            for tid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if tid in done:
                    continue
                done.add(tid)
                got = []
                for off, cp in _pieces(points(text), min_len):
                    h, m = minimizers(Rolling(cp), len(cp), k, min_len)
                    pos = m[np.concatenate([[True], np.diff(m) != 0])]
                    got.append((h[pos].astype(np.int64), pos + off))
                # One row for a k-mer that repeats in the text: its positions are found again later.
                h = np.unique(np.concatenate([g[0] for g in got]))
                hs.append(h)
                ts.append(np.full(len(h), tid))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(ts))], names=["h", "tid"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for tid, text, shared in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                want = np.sort(shared.values.to_numpy())
                cps = points(text)
                for off, cp in _pieces(cps, min_len):
                    roll = Rolling(cp)
                    h, m = minimizers(roll, len(cp), k, min_len)
                    hm = h[m].astype(np.int64)
                    at = np.minimum(np.searchsorted(want, hm), len(want) - 1)
                    x = np.flatnonzero(want[at] == hm)
                    if not len(x):
                        continue
                    s = np.unique(m[x] - (m[x] - x) // STEP * STEP)
                    keys = roll.at(s, key_len).astype(np.int64)
                    s = s + off
                    out[0] += keys.tolist()
                    out[1] += [tid] * len(s)
                    out[2] += s.tolist()
                    out[3] += [text[max(0, i - SIDE) : i] for i in s.tolist()]
                    out[4] += [text[i + key_len : i + key_len + SIDE] for i in s.tolist()]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3]), pa.array(out[4])], names=["key", "tid", "s", "l", "r"])

    members = src.select("tid", "doc_id", F.length("text").alias("n_chars")).distinct()
    reps = members.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    seeded = materialize(src.select("tid", "text").mapInArrow(seeds, "h bigint, tid bigint"), "p10-seeds")
    both = seeded.groupBy("h").agg(F.min("tid").alias("a"), F.max("tid").alias("b")).where("a < b").select("h")
    shared = seeded.join(both, "h", "left_semi").groupBy("tid").agg(F.collect_set("h").alias("hs")).join(reps, "tid").select("doc_id", "tid", "hs")
    texts = src.select("doc_id", "text").join(shared, "doc_id").select("tid", "text", "hs")
    rows = materialize(texts.mapInArrow(windows, "key bigint, tid bigint, s int, l string, r string"), "p10-windows").distinct()
    pos = F.struct("tid", "s")
    classes = materialize(rows.groupBy("key", "l", "r").agg(F.min(pos).alias("lo"), F.max(pos).alias("hi")), "p10-classes")
    whole = classes.where((F.col("lo.tid") < F.col("hi.tid")) & (F.length("l") + F.length("r") >= SIDE))
    whole = whole.select("key", "l", "r", F.length("l").alias("left"), F.length("r").alias("right"), "lo", "hi")
    # Keys with several contexts: match them by each split of the 16 characters.
    many = classes.groupBy("key").agg(F.count("*").alias("n"), F.min("lo.tid").alias("a"), F.max("hi.tid").alias("b")).where("n > 1 and a < b").select("key")
    split = classes.join(many, "key", "left_semi").select("*", F.explode(F.sequence(F.lit(0), F.lit(SIDE))).alias("o"))
    split = split.where((F.length("l") >= F.col("o")) & (F.length("r") >= SIDE - F.col("o")))
    split = split.select("key", "l", "r", "lo", "hi", "o", F.expr("right(l, o)").alias("lt"), F.expr(f"left(r, {SIDE} - o)").alias("rt"))
    part = split.groupBy("key", "o", "lt", "rt").agg(F.min("lo").alias("plo"), F.max("hi").alias("phi")).where("plo.tid < phi.tid")
    partial = split.select("key", "l", "r", "o", "lt", "rt").join(part, ["key", "o", "lt", "rt"])
    partial = partial.groupBy("key", "l", "r").agg(F.max("o").alias("left"), F.max(SIDE - F.col("o")).alias("right"), F.min("plo").alias("lo"), F.max("phi").alias("hi"))
    # A class may match as a whole and reach other classes by a split; both give anchors.
    matched = whole.unionByName(partial.withColumns({"left": F.col("left"), "right": F.col("right")}))
    anchors = rows.join(matched, ["key", "l", "r"]).withColumn("p", F.when(F.col("lo.tid") != F.col("tid"), F.col("lo")).otherwise(F.col("hi"))).where("p.tid <> tid")
    anchors = anchors.select("tid", (F.col("s") - F.col("left")).alias("x"), (F.col("s") + key_len + F.col("right")).alias("x1"), F.col("p.tid").alias("partner"), (F.col("p.s") - F.col("left")).alias("y"))

    def chain(t: pa.Table) -> pa.Table:
        return _chains(t, gap_cost, max_gap)

    passages = anchors.groupBy("tid").applyInArrow(chain, "tid bigint, start int, stop int, partner bigint, partner_start int, partner_stop int, exact int, segments int, runs array<struct<x:int,x1:int,y:int>>")
    return passages, members.join(reps.select("tid", "copies"), "tid")


class Fenwick:
    """Range maxima of (score, index) under point assignments, so that entries can also be taken out."""

    NONE = (-1e18, -1)

    def __init__(self, n: int):
        self.own = [self.NONE] * (n + 1)
        self.best = [self.NONE] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        self.own[i] = value
        while i < len(self.best):
            top, k = self.own[i], 1
            while k < i & -i:
                top = max(top, self.best[i - k])
                k *= 2
            self.best[i] = top
            i += i & -i

    def get(self, lo: int, hi: int) -> tuple[float, int]:
        """Largest of positions lo..hi."""
        lo, hi, out = lo + 1, hi + 1, self.NONE
        while hi >= lo:
            if hi - (hi & -hi) + 1 >= lo:
                out = max(out, self.best[hi])
                hi -= hi & -hi
            else:
                out = max(out, self.own[hi])
                hi -= 1
        return out


def chain_segments(segments: list[tuple[int, int, int]], gap_cost: float, max_gap: int) -> list[list[int]]:
    """Chains of ``(x, x1, y)`` segments that rise in both texts; gaps cost by their length.

    Dynamic programming in order of ``x``: a segment may follow any that ended at most ``max_gap`` before
    it in both texts. ``score + gap_cost * (end_x + end_y)`` makes the best predecessor a maximum over a
    range of ``end_y``; segments that ended too far back in ``x`` are taken out of the tree.
    """
    n = len(segments)
    end_y = [y + x1 - x for x, x1, y in segments]
    place = sorted(range(n), key=lambda i: (end_y[i], i))  # a place of its own for each segment
    rank = {j: r for r, j in enumerate(place)}
    ys = [end_y[j] for j in place]
    order = sorted(range(n), key=lambda i: segments[i][0])
    ends = sorted(range(n), key=lambda i: segments[i][1])
    tree, score, prev, entered, left = Fenwick(n), [0.0] * n, [-1] * n, 0, 0
    for i in order:
        x, x1, y = segments[i]
        while entered < n and segments[ends[entered]][1] <= x:
            j = ends[entered]
            tree.put(rank[j], (score[j] + gap_cost * (segments[j][1] + end_y[j]), j))
            entered += 1
        while left < entered and segments[ends[left]][1] < x - max_gap:
            tree.put(rank[ends[left]], Fenwick.NONE)
            left += 1
        score[i] = x1 - x
        s, j = tree.get(bisect_left(ys, y - max_gap), bisect_right(ys, y) - 1)
        if j >= 0 and s - gap_cost * (x + y) > 0:
            score[i] += s - gap_cost * (x + y)
            prev[i] = j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        if used[i]:
            continue
        c = []
        while i >= 0 and not used[i]:
            used[i] = True
            c.append(i)
            i = prev[i]
        out.append(c[::-1])
    return out


def edits(a: str, b: str) -> int:
    """Edit distance (insertions, deletions, replacements), one numpy row a character of ``a``."""
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    q = points(b)
    at = np.arange(len(q) + 1)
    row = at.copy()
    for i, c in enumerate(points(a), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (q != c))
        row = np.minimum.accumulate(new - at) + at  # insertions run along the row
    return int(row[-1])


def aligned_passages(docs: DataFrame, min_len: int = 200) -> DataFrame:
    """``shared_passages`` with ``(doc_id, start, stop, partner_doc_id, partner_start, partner_stop, exact, segments, edits, identity)``.

    Texts are named by their smallest document. The gaps between a chain's exact runs are aligned:
    ``edits`` is their edit distance, ``identity`` the share of the longer side that stands unchanged.
    """
    passages, members = shared_passages(docs, min_len)
    passages = materialize(passages, "p10-chains")
    names = members.groupBy("tid").agg(F.min("doc_id").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(names, "doc_id").where("xxhash64(text) = tid").select("tid", "doc_id", "text").dropDuplicates(["tid"])
    fuzzy = passages.where("segments > 1").select("tid", "start", "stop", "partner", "partner_start", "partner_stop", "runs", F.monotonically_increasing_id().alias("n"))
    fuzzy = materialize(fuzzy, "p10-fuzzy")
    mine = fuzzy.join(texts.select("tid", F.col("text").alias("t")), "tid").select("n", "partner", "runs", F.expr("substring(t, start + 1, stop - start)").alias("a"), F.col("start").alias("x"), "partner_start", "partner_stop")
    both = mine.join(texts.select(F.col("tid").alias("partner"), F.col("text").alias("t")), "partner").select("n", "runs", "x", F.col("partner_start").alias("y"), "a", F.expr("substring(t, partner_start + 1, partner_stop - partner_start)").alias("b"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs, x, y, a, b in zip(*(batch.column(c).to_pylist() for c in ("runs", "x", "y", "a", "b"))):
                pairs = zip(runs, runs[1:])
                out.append(sum(edits(a[p["x1"] - x : q["x"] - x], b[p["y"] + p["x1"] - p["x"] - y : q["y"] - y]) for p, q in pairs))
            yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(out, pa.int32())], names=["n", "edits"])

    found = both.mapInArrow(align, "n bigint, edits int")
    key = ["tid", "start", "stop", "partner", "partner_start", "partner_stop"]
    found = fuzzy.join(found, "n").groupBy(*key).agg(F.min("edits").alias("edits"))
    out = passages.join(found, key, "left").join(names, "tid").join(names.withColumnsRenamed({"tid": "partner", "doc_id": "partner_doc_id"}), "partner")
    e, longer = F.coalesce("edits", F.lit(0)), F.greatest(F.col("stop") - F.col("start"), F.col("partner_stop") - F.col("partner_start"))
    return out.select("doc_id", "start", "stop", "partner_doc_id", "partner_start", "partner_stop", "exact", "segments", e.alias("edits"), F.round(1 - e / longer, 6).alias("identity"))


def _chains(t: pa.Table, gap_cost: float, max_gap: int) -> pa.Table:
    cols = {c: t.column(c).to_numpy() for c in ("tid", "x", "x1", "partner", "y")}
    out: list[tuple] = []
    tid = int(cols["tid"][0])
    order = np.lexsort((cols["x"], cols["x"] - cols["y"], cols["partner"]))
    groups: dict[int, list[list[int]]] = {}
    for i in order:
        p, x, x1, y = (int(cols[c][i]) for c in ("partner", "x", "x1", "y"))
        segs = groups.setdefault(p, [])
        if segs and segs[-1][0] - segs[-1][2] == x - y and x <= segs[-1][1]:
            segs[-1][1] = max(segs[-1][1], x1)  # the same diagonal: one exact run
        else:
            segs.append([x, x1, y])
    for p, segs in groups.items():
        for c in chain_segments([tuple(s) for s in segs], gap_cost, max_gap):
            first, last = segs[c[0]], segs[c[-1]]
            out.append((tid, first[0], last[1], p, first[2], last[2] + last[1] - last[0], sum(segs[i][1] - segs[i][0] for i in c), len(c), [dict(zip(("x", "x1", "y"), segs[i])) for i in c]))
    names = ["tid", "start", "stop", "partner", "partner_start", "partner_stop", "exact", "segments", "runs"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.struct([(c, pa.int32()) for c in ("x", "x1", "y")]))]
    return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(names, kinds))})


def documents_with_shared_spans(docs: DataFrame, min_len: int = 200) -> DataFrame:
    """``(doc_id)`` of documents with a span of ``min_len`` characters that stands in another one too."""
    passages, members = shared_passages(docs, min_len)
    hit = members.join(passages.select("tid").distinct(), "tid", "left_semi").unionByName(members.where("copies > 1"))
    return hit.select("doc_id").distinct()


def shared_report(docs: DataFrame, min_len: int = 200) -> DataFrame:
    """``(doc_id, n_chars, shared_chars, shared_share, passages)`` for every document, zeros included."""
    passages, members = shared_passages(docs, min_len)
    passages = materialize(passages, "p10-passages")
    cover = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", "stop"))),
        F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("int").alias("sum")),
        lambda a, s: F.struct(F.greatest(a["end"], s["stop"]).alias("end"), (a["sum"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["end"], s["start"]))).alias("sum")),
    )["sum"]
    per = passages.groupBy("tid").agg(cover.alias("covered"), F.count("*").alias("passages"))
    m = members.join(per, "tid", "left").select("doc_id", F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).alias("shared_chars"), F.coalesce("passages", F.lit(0)).alias("passages"))
    m = m.groupBy("doc_id").agg(F.max("shared_chars").alias("shared_chars"), F.max("passages").alias("passages"))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).alias("n_chars")).groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    out = base.join(m, "doc_id", "left")
    shared = F.coalesce("shared_chars", F.lit(0))
    return out.select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("shared_share"), F.coalesce("passages", F.lit(0)).alias("passages"))
