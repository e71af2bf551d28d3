"""Fixed-capacity packs filled by the sum-of-squares rule.

Items are spread evenly over independent groups (``items_per_group`` on average, whatever the total),
and each group packs its items alone, so the work is one task per group and pack size. In a group the
longest items come first; each goes where the sum over gaps of (open packs with that gap) squared
becomes smallest, which keeps many different gaps open and so finds exact fits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = np.int64(1) << 40
#: Pack sizes are a short list of settings, not data.
MOST_SIZES = 1000


def sum_of_squares(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(pack, offset in the pack) of each size, in the order given; sizes lie in 1..capacity."""
    count = np.zeros(capacity + 1, np.int64)  # open packs by gap
    open_packs: list[list[int]] = [[] for _ in range(capacity + 1)]
    packs, offsets, made = [], [], 0
    for s in sizes:
        before = count[s:]
        # Moving a pack from gap g to g - s changes the sum by 2 (N[g-s] - N[g]) + 2; a pack that closes only leaves.
        change = np.where(before > 0, 2 * (count[: capacity + 1 - s] - before + 1), NEVER)
        if before[0]:
            change[0] = 1 - 2 * before[0]
        gap, least = -1, 2 * count[capacity - s] + 1 if s < capacity else 0
        best = int(change.argmin())
        if change[best] <= least:
            gap = best + s
        if gap < 0:
            p, gap = made, capacity
            made += 1
        else:
            p = open_packs[gap].pop()
            count[gap] -= 1
        packs.append(p)
        offsets.append(capacity - gap)
        if gap > s:
            open_packs[gap - s].append(p)
            count[gap - s] += 1
    return packs, offsets


def pack_items(items: DataFrame, sizes: DataFrame, items_per_group: int = 25_000) -> DataFrame:
    """``items(doc_id, n_tokens)``, ``sizes(pack_name, capacity_tokens)`` -> one row per placed piece.

    ``(pack_name, capacity_tokens, pack_id, doc_id, piece, piece_start, piece_tokens, pack_offset)``.
    An item longer than the capacity is cut into full packs and a rest; no other item is cut. Items of
    no tokens need no room: they come out with a null ``pack_id``. Null sizes count as 0. Packs with a
    null or non-positive capacity are left out. Repeated rows are packed as often as they occur.
    """
    n = items.count()
    groups = max(1, math.ceil(n / items_per_group))
    src = items.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n"))
    kinds = sizes.select("pack_name", F.col("capacity_tokens").cast("int").alias("cap")).where("cap > 0").distinct().orderBy("cap", "pack_name").take(MOST_SIZES + 1)
    if len(kinds) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} pack sizes")
    # Each item is wanted once for each pack size.
    each = [F.struct(F.lit(k[0]).cast("string").alias("pack_name"), F.lit(k[1]).alias("cap")) for k in kinds]
    both = src.select("doc_id", "n", F.explode(F.array(*each)).alias("k")).select("k.pack_name", "k.cap", "doc_id", "n") if each else src.select(F.lit("").alias("pack_name"), F.lit(1).alias("cap"), "doc_id", "n").where("false")
    empty = both.where("n <= 0").select("pack_name", F.col("cap").alias("capacity_tokens"), F.lit(None).cast("bigint").alias("pack_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("piece_start"), F.lit(0).alias("piece_tokens"), F.lit(0).alias("pack_offset"))

    def pack(t: pa.Table) -> pa.Table:
        cap, group = t.column("cap")[0].as_py(), t.column("g")[0].as_py()
        ids, size = t.column("doc_id").to_numpy(zero_copy_only=False), t.column("n").to_numpy()
        full = size // cap
        rest = size - full * cap
        # Full pieces fill a pack each; what remains is packed.
        owner = np.repeat(np.arange(len(size)), full)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        order = np.lexsort((t.column("h").to_numpy(), -rest))
        order = order[rest[order] > 0]
        packs, offsets = sum_of_squares(rest[order].tolist(), cap)
        base = (max(packs) + 1) if packs else 0
        pack_id = np.concatenate([np.array(packs, np.int64), base + np.arange(len(owner))]) + (np.int64(group) << 32)
        who = np.concatenate([order, owner]).astype(np.int64)
        nth = np.concatenate([full[order], piece]).astype(np.int64)
        m = len(who)
        return pa.table(
            {
                "pack_name": pa.array([t.column("pack_name")[0].as_py()] * m, pa.string()),
                "capacity_tokens": pa.array(np.full(m, cap, np.int32)),
                "pack_id": pa.array(pack_id),
                "doc_id": t.column("doc_id").take(pa.array(who)),
                "piece": pa.array(nth.astype(np.int32)),
                "piece_start": pa.array(nth * cap),
                "piece_tokens": pa.array(np.concatenate([rest[order], np.full(len(owner), cap)]).astype(np.int32)),
                "pack_offset": pa.array(np.concatenate([np.array(offsets, np.int32), np.zeros(len(owner), np.int32)])),
            }
        )

    keyed = both.where("n > 0").select("pack_name", "cap", "doc_id", "n", F.xxhash64("doc_id", "n").alias("h")).withColumn("g", F.pmod("h", F.lit(groups)).cast("int"))
    placed = keyed.groupBy("pack_name", "cap", "g").applyInArrow(pack, "pack_name string, capacity_tokens int, pack_id bigint, doc_id bigint, piece int, piece_start bigint, piece_tokens int, pack_offset int")
    return placed.unionByName(empty)
