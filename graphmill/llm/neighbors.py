"""The k most similar vectors of every vector: all pairs of blocks, or vantage-point trees per shard.

With a floor and ``relax=1`` every block of vectors meets every other, so the result is exact. A pair is
compared in a few rotated dimensions and the length of the rest, which bound its cosine from above
(Cauchy-Schwarz); where that reaches the floor, the cosine is computed in double precision.
Comparisons grow with the square of the collection. Smaller factors search trees in shards instead:

1. Shards are k-means cells, fitted on a bounded sample; near a border a vector is also copied to the
   next cells, at most ``probes`` in all. Their number grows with the collection, their size does not.
2. Each shard builds several vantage-point trees over all its vectors. A node splits its vectors at
   the median distance to a vantage point. A query goes down both sides unless
   ``|d(q, vp) - median| > relax * radius``, where ``radius`` is its k-th best distance found so far, or
   the floor's. ``relax=1`` is the triangle inequality itself: no neighbour in the shard can be missed.
   Smaller factors prune more; several trees with other vantage points make up for it.
3. Shard results of one vector are merged to its k best.

Exact copies are searched once: a copy group is represented by its six (k + 1) smallest ids, found
with a rank filter that is applied before the shuffle, so a group of a third of all rows stays cheap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.session import materialize

FULL_CIRCLE = 2.0  # largest distance between unit vectors


def unit_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit vectors of the usable values: ``dims`` finite numbers, not all zero."""
    column = column if not isinstance(column, pa.ChunkedArray) else column.combine_chunks()
    starts = column.offsets.to_numpy()
    ok = np.flatnonzero((np.diff(starts) == dims) & column.is_valid().to_numpy(zero_copy_only=False))
    if not len(ok):
        return ok, np.zeros((0, dims))
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[starts[ok][:, None] + np.arange(dims)]
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    ok, x = ok[good], x[good]
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return ok, x / np.sqrt((x * x).sum(1, keepdims=True))


def distance(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ p)))


class Cells:
    """Centres of cosine k-means over a sample; a vector belongs to the cells of its nearest centres."""

    def __init__(self, sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7):
        f = sample.astype(np.float32)
        c = f[np.random.default_rng(seed).choice(len(f), cells, replace=False)]
        for _ in range(rounds):
            own = np.concatenate([np.argmax(f[i : i + 4096] @ c.T, axis=1) for i in range(0, len(f), 4096)])
            order = np.argsort(own, kind="stable")
            there, start = np.unique(own[order], return_index=True)
            c[there] = np.add.reduceat(f[order], start, axis=0)
            c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-9)
        self.centres = c

    def route(self, x: np.ndarray, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for up to ``probes`` nearest centres, those at most ``margin`` farther away than the nearest."""
        f, probes = x.astype(np.float32), min(probes, len(self.centres))
        rows, cells = [], []
        for i in range(0, len(f), 1024):
            s = f[i : i + 1024] @ self.centres.T
            near = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
            d = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(s, near, 1)))
            r, c = np.nonzero(d <= d.min(1, keepdims=True) + margin)
            rows.append(i + r)
            cells.append(near[r, c])
        return np.concatenate(rows), np.concatenate(cells)


def search_all(x: np.ndarray, k: int, block: int = 512, width: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``search_shard`` without a floor, by comparing all with all; exact."""
    n, k = len(x), min(k, len(x) - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    f, out = x.astype(np.float32), []
    for i in range(0, n, block):
        s = f[i : i + block] @ f.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -9
        # The k-th largest of group maxima bounds the k-th largest of all from below.
        groups = s[:, : n // width * width].reshape(len(s), -1, width).max(2) if n >= 4 * k * width else s
        bound = -np.partition(-groups, k - 1, axis=1)[:, k - 1]
        r, b = np.nonzero(s >= bound[:, None] - 3e-6)  # single precision, and equal after rounding
        cos = np.round(np.einsum("ij,ij->i", x[i + r], x[b]), 6)
        order = np.lexsort((b, -cos, r))
        r, b, cos = r[order], b[order], cos[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((i + r[keep], b[keep], cos[keep]))
    a, b, cos = (np.concatenate(c) for c in zip(*out))
    return a, b, cos


def _top(a: np.ndarray, b: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest cosines of each ``a``, ties by ``b``."""
    order = np.lexsort((b, -cos, a))
    a, b, cos = a[order], b[order], cos[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], cos[keep]


def outline(x: np.ndarray, kept: int = 31) -> np.ndarray:
    """``kept`` rotated dimensions and the length of the rest: their products are no smaller than the cosines."""
    dims = x.shape[1]
    if dims <= kept + 1:
        return x.astype(np.float32)
    z = x @ np.linalg.qr(np.random.default_rng(3).normal(size=(dims, dims)))[0][:, :kept]
    return np.column_stack([z, np.sqrt(np.maximum(0, 1 - (z * z).sum(1)))]).astype(np.float32)


def join_blocks(x: np.ndarray, y: np.ndarray | None, k: int, min_sim: float, rows: int = 128, width: int = 2048) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(query, neighbour, cosine)`` of unit vectors, k best of each row of ``x`` in ``y``, then of each row of ``y`` in ``x``.

    Without ``y``, of each row of ``x`` among the others, and nothing second. Exact; ties by position.
    """
    other = x if y is None else y
    a, b = outline(x), outline(other)
    b = np.ascontiguousarray(np.concatenate([b, np.zeros((-len(b) % 8, b.shape[1]), np.float32)]).T)
    least = np.float32(min_sim - 2e-5)  # slack for single precision and rounding
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    there, back, waiting = [none], [none], 0
    for i in range(0, len(a), rows):
        hits = []
        for j in range(0, b.shape[1], width):
            near = a[i : i + rows] @ b[:, j : j + width] >= least
            w = np.flatnonzero(near.reshape(-1).view(np.uint64))  # eight at a time
            if len(w):
                at, bit = np.nonzero(near.reshape(-1, 8)[w])
                hits.append(np.stack(np.divmod(w[at] * 8 + bit, near.shape[1])) + [[i], [j]])
        if not hits:
            continue
        q, n = np.concatenate(hits, axis=1)
        keep = (n < len(other)) & ((q != n) | (y is not None))
        q, n = q[keep], n[keep]
        cos = np.concatenate([np.einsum("ij,ij->i", x[q[s : s + 65536]], other[n[s : s + 65536]]) for s in range(0, len(q), 65536)] or [np.zeros(0)])
        cos = np.round(cos, 6)
        keep = cos >= min_sim
        q, n, cos = q[keep], n[keep], cos[keep]
        there.append(_top(q, n, cos, k))
        if y is not None:
            back.append(_top(n, q, cos, k))
            waiting += len(back[-1][0])
            if waiting > 1_000_000:
                back = [_top(*map(np.concatenate, zip(*back)), k)]
                waiting = 0
    return tuple(map(np.concatenate, zip(*there))), _top(*map(np.concatenate, zip(*back)), k)


def exact_lists(hashed: DataFrame, count: int, k: int, min_sim: float, dims: int, block_rows: int) -> DataFrame:
    """``(h1, h2, neighbor, cos)``: at least the k nearest ids of each distinct vector of ``(id, v, h1, h2)``, its own copies among them.

    Blocks of up to ``block_rows`` vectors, copies within a task's share taken once with their k + 1
    smallest ids, are written once; the pairs of blocks are made by reading them again, without a shuffle.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        held: list[list[np.ndarray]] = []

        def fold() -> None:
            """One group of rows for each distinct vector, of which the k + 1 smallest ids stay."""
            ids, h1, h2, v = map(np.concatenate, zip(*held))
            order = np.lexsort((ids, h2, h1))
            ids, h1, h2 = ids[order], h1[order], h2[order]
            new = np.ones(len(ids), bool)
            new[1:] = (np.diff(h1) != 0) | (np.diff(h2) != 0)
            once = new.copy()
            once[1:] |= np.diff(ids) != 0
            order, ids, h1, h2, new = order[once], ids[once], h1[once], h2[once], new[once]
            start = np.flatnonzero(new)
            keep = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids)))) <= k
            held[:] = [[ids[keep], h1[keep], h2[keep], v[order[keep]]]]

        def block(start: int, stop: int) -> pa.RecordBatch:
            nonlocal at
            ids, h1, h2, v = (c[start:stop] for c in held[0])
            new = np.ones(len(ids), bool)
            new[1:] = (np.diff(h1) != 0) | (np.diff(h2) != 0)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(ids)))
            order = np.argsort(ids[first], kind="stable")  # ties go to the smaller id
            first, size = first[order], size[order]
            rows = np.repeat(first, size) + np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
            at += 1
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(pa.array([c], t) for c, t in ((v[first].reshape(-1), pa.list_(pa.float64())), (h1[first], pa.list_(pa.int64())), (h2[first], pa.list_(pa.int64())), (ids[rows], pa.list_(pa.int64())), (size, pa.list_(pa.int64()))))], names=["block", "v", "h1", "h2", "ids", "size"])

        for b in batches:
            if not b.num_rows:
                continue
            ids, h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            held.append([ids, h1, h2, b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)])
            if sum(len(h[0]) for h in held) < 2 * block_rows:
                continue
            fold()
            n = len(held[0][0])
            for start in range(0, n - block_rows, block_rows):
                yield block(start, start + block_rows)
            held[:] = [[c[(n - 1) // block_rows * block_rows :] for c in held[0]]]
        if held:
            fold()
            n = len(held[0][0])
            for start in range(0, n, block_rows):
                yield block(start, min(n, start + block_rows))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for r in range(t.num_rows):
                one, two = ([t.column(side + i)[r].values.to_numpy(zero_copy_only=False) for i in range(1, 6)] for side in (0, 6))
                same = t.column(0)[r] == t.column(6)[r]
                x = unit_rows(pa.FixedSizeListArray.from_arrays(pa.array(one[0]), dims).cast(pa.list_(pa.float64())), dims)[1]
                y = None if same else unit_rows(pa.FixedSizeListArray.from_arrays(pa.array(two[0]), dims).cast(pa.list_(pa.float64())), dims)[1]
                there, back = join_blocks(x, y, k, min_sim)
                parts = [(one, there, two), (two, back, one)]
                if same:  # copies are neighbours of each other
                    own = np.flatnonzero(one[4] > 1)
                    parts.append((one, (own, own, np.ones(len(own))), one))
                for (_, h1, h2, _, _), (a, b, cos), (_, _, _, ids, size) in parts:
                    if len(a):
                        c = size[b]
                        n = np.repeat((np.cumsum(size) - size)[b], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h1[a], c)), pa.array(np.repeat(h2[a], c)), pa.array(ids[n]), pa.array(np.repeat(cos, c))], names=["h1", "h2", "neighbor", "cos"])

    columns = "block bigint, v array<double>, h1 array<bigint>, h2 array<bigint>, ids array<bigint>, size array<bigint>"
    blocks = materialize(hashed.select("id", "v", "h1", "h2").coalesce(max(1, math.ceil(count / block_rows))).mapInArrow(pack, columns), "p2-blocks")
    second = blocks.select(*(F.col(c).alias(f"{c}_b") for c in blocks.columns))
    return blocks.hint("shuffle_replicate_nl").join(second, F.col("block") <= F.col("block_b")).mapInArrow(join, "h1 bigint, h2 bigint, neighbor bigint, cos double")


def _best(sims: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest rounded values of at least ``floor``, ties by id (columns come in id order)."""
    hit = sims >= floor
    hit &= own[:, None] != ids[None, :]
    many = hit.sum(1) > k
    r, c = np.nonzero(hit & ~many[:, None])
    for i in np.flatnonzero(many):
        j = np.flatnonzero(hit[i])
        j = j[np.argsort(-np.round(sims[i, j], 6), kind="stable")[:k]]
        r, c = np.concatenate([r, np.full(len(j), i)]), np.concatenate([c, j])
    return r, c


def search_shard(x: np.ndarray, k: int, min_sim: float | None, relax: float, trees: int, leaf: int = 96, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, cosine) with positions into ``x`` (rows in id order), k best of each query at most.

    A first tree is descended without backtracking: the k-th best of a query's own leaf bounds how far
    away its neighbours can be, and the later trees prune with that radius instead of the floor's.
    """
    n = len(x)
    floor = -np.inf if min_sim is None else min_sim - 1e-6
    f = x.astype(np.float32)
    reach = np.full(n, FULL_CIRCLE if min_sim is None else math.sqrt(max(0.0, 2 - 2 * min_sim)), np.float32)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(trees + 1):
        rng = np.random.default_rng(seed + t)
        margin = relax * reach  # as the trees before left it
        stack = [(np.arange(n), np.arange(n))]
        while stack:
            own, ask = stack.pop()
            if len(own) <= leaf:
                own = np.sort(own)
                sims = f[ask] @ f[own].T
                r, c = _best(sims, own, ask, k, floor)
                found.append((ask[r], own[c]))
                if len(own) > k:
                    sims[ask[:, None] == own[None, :]] = -9
                    kth = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
                    # Slack for single precision and for cosines that are equal after rounding.
                    reach[ask] = np.minimum(reach[ask], np.sqrt(np.maximum(0, 2 - 2 * (kth - 4e-6))))
                continue
            p = f[own[rng.integers(len(own))]]
            d = np.sqrt(np.maximum(0, 2 - 2 * (f[own] @ p)))
            half = len(own) // 2
            part = np.argpartition(d, half)
            cut = d[part[half]]
            low, high = own[part[:half]], own[part[half:]]
            if t == 0:
                stack += [(low, low), (high, high)]
                continue
            da = d if ask is own else np.sqrt(np.maximum(0, 2 - 2 * (f[ask] @ p)))
            # The halves may share the border distance, so both tests include it.
            stack += [(low, ask[da <= cut + margin[ask]]), (high, ask[da >= cut - margin[ask]])]
    a, b = np.concatenate([q for q, _ in found]), np.concatenate([q for _, q in found])
    # A link found from one end serves both ends.
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    pair = np.unique(a.astype(np.int64) * n + b)
    a, b = pair // n, pair % n
    cos = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
    cos = np.round(cos, 6)
    if min_sim is not None:
        keep = cos >= min_sim
        a, b, cos = a[keep], b[keep], cos[keep]
    order = np.lexsort((b, -cos, a))
    a, b, cos = a[order], b[order], cos[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1]) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return a[rank < k], b[rank < k], cos[rank < k]


def similar_vectors(df: DataFrame, id_col: str, vec_col: str, k: int = 5, min_sim: float | None = None, dims: int = 64, relax: float = 0.1, trees: int = 2, shard_rows: int = 16_000, sample_rows: int = 20_000, probes: int = 3, margin: float = 0.07, cell_rows: int = 2_000) -> DataFrame:
    """``(id, neighbor, cosine, rank)``: the k most similar others of every usable vector.

    Cosines are rounded to 6 decimals, equal ones go to the smaller id. ``min_sim`` drops weaker
    neighbours and, as the radius of the search, lets the triangle inequality prune. Vectors that are
    null, of another length, all zero or not finite take no part. Repeated ids with one vector count
    once; an id is never its own neighbour. Empty input gives no rows.

    With ``min_sim`` and ``relax`` of at least 1 the result is exact: blocks of ``shard_rows`` vectors are
    compared all with all, and the parameters of trees and routing have no effect. Otherwise shards are cosine k-means cells of about ``shard_rows`` vectors. A vector goes to the shard of its
    nearest centre and to those of up to ``probes`` centres at most ``margin`` farther away, so a vector
    is copied ``probes`` times at most however many shards there are. The centres are fitted on
    ``sample_rows`` rows or eight a shard, whichever is more; every row is indexed. Without ``min_sim``
    the triangle inequality prunes next to nothing: vectors then go to the four nearest of cells of about
    ``cell_rows``, and each cell compares all with all.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(f"id is not null and size(v) = {dims} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    hashed = src.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(17))})
    if min_sim is not None and relax >= 1:
        return _ranked(hashed, exact_lists(hashed, df.count(), k, min_sim, dims, shard_rows), k)
    n = src.count()
    cells = math.ceil(n / (shard_rows if min_sim is not None else cell_rows))
    reach = (probes, margin) if min_sim is not None else (4, FULL_CIRCLE)
    tree = None
    if cells > (1 if min_sim is not None else 4):
        # An even sample by hash; its size is bounded by the parameter and the number of shards.
        sample_rows = max(sample_rows, 8 * cells)
        rate = min(1.0, sample_rows / n)
        rows = hashed.where(F.pmod("h1", F.lit(1 << 20)) < F.lit(int(rate * (1 << 20)) + 1)).select("v").limit(2 * sample_rows).toArrow()
        _, x = unit_rows(rows.column("v"), dims)
        x = np.unique(x, axis=0)
        # Where few vectors are distinct, copies make the table large; they are searched once.
        cells = min(cells, len(x) // 4)
        tree = Cells(x, cells) if cells > 1 else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = unit_rows(b.column(1), dims)
            if not len(ok):
                continue
            ids, h1, h2 = (b.column(i).to_numpy(zero_copy_only=False)[ok] for i in (0, 2, 3))
            # One row for each distinct vector of the batch, under its smallest id.
            order = np.lexsort((ids, h2, h1))
            first = np.ones(len(order), bool)
            first[1:] = (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
            keep = order[first]
            x, ids, h1, h2 = x[keep], ids[keep], h1[keep], h2[keep]
            row, shard = tree.route(x, *reach) if tree is not None else (np.arange(len(x)), np.zeros(len(x), np.int64))
            f = np.ascontiguousarray(x[row].astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(h1[row]), pa.array(h2[row]), pa.array(ids[row]), pa.Array.from_buffers(pa.binary(4 * dims), len(f), [None, pa.py_buffer(f)]).cast(pa.binary())], names=["shard", "h1", "h2", "id", "x"])

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, h1, h2 = (t.column(c).to_numpy() for c in ("id", "h1", "h2"))
        order = np.lexsort((ids, h2, h1))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
        keep = order[first]
        keep = keep[np.argsort(ids[keep], kind="stable")]
        ids, h1, h2 = ids[keep], h1[keep], h2[keep]
        x = np.frombuffer(b"".join(t.column("x").take(pa.array(keep)).to_pylist()), np.float32).reshape(-1, dims).astype(np.float64)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        a, b, cos = search_all(x, k) if min_sim is None else search_shard(x, k, min_sim, relax, trees)
        return pa.table({"h1": h1[a], "h2": h2[a], "g1": h1[b], "g2": h2[b], "cos": cos})

    routed = hashed.select("id", "v", "h1", "h2").mapInArrow(assign, "shard int, h1 bigint, h2 bigint, id bigint, x binary")
    pairs = routed.groupBy("shard").applyInArrow(search, "h1 bigint, h2 bigint, g1 bigint, g2 bigint, cos double")
    # The k + 1 smallest ids of each copy group (the rank filter runs before the shuffle too).
    low = hashed.select("id", "h1", "h2").distinct().withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1)
    members = materialize(low.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")), "p2-members")
    near = pairs.join(members.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "ids"), ["g1", "g2"]).select("h1", "h2", F.explode("ids").alias("neighbor"), "cos")
    copies = members.where(F.size("ids") > 1).select("h1", "h2", F.explode("ids").alias("neighbor"), F.lit(1.0).alias("cos"))
    return _ranked(hashed, near.unionByName(copies), k)


def _ranked(hashed: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """The k first of ``(h1, h2, neighbor, cos)`` for every id of ``hashed``, itself left out."""
    best = F.struct((-F.col("cos")).alias("m"), F.col("neighbor"))
    lists = near.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.collect_set(best)), 1, k + 1).alias("near"))
    rows = hashed.select("id", "h1", "h2").distinct().join(lists, ["h1", "h2"])
    ranked = rows.select("id", F.posexplode(F.slice(F.filter("near", lambda s: s["neighbor"] != F.col("id")), 1, k)).alias("rank", "s"))
    return ranked.select("id", F.col("s.neighbor").alias("neighbor"), (-F.col("s.m")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def mutual_pairs(neighbors: DataFrame) -> DataFrame:
    """Unordered pairs of which at least one is among the most similar of the other."""
    return neighbors.select(F.least("id", "neighbor").alias("a"), F.greatest("id", "neighbor").alias("b")).distinct()
