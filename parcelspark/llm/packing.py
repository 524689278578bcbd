"""Filling containers of fixed capacity with documents (problem 8).

Items are dealt to shards by a hash, so a shard is an even mixture whatever source or group of copies is large. A shard is
packed by best fit in falling order of size, copies before all others: bins are kept in order of the room left, the successor of an item's size is
the tightest bin, and the search goes on until a compatible one is found. A bin carries two bitmaps, its sources and its
duplicate clusters; an item conflicts if its cluster, or a source that must stay apart from its own, is already there.

If a cluster has more copies than there are containers by volume, keeping them apart would leave containers empty. Then some
share one, as evenly as they can, and their rows say so (``forced``); with ``strict`` they don't, at the price of more containers.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "shard int, bin int, doc_id long, piece int, n_tokens long, source string, doc_tokens long, forced boolean"


def _clusters(items: list[tuple[int, int, int]], bins: int | None) -> list[int]:
    """A conflict bit (or 0) per item (size, cluster, position). Copies are dealt to as many groups as it takes for a group to
    have no more copies than ``bins``: with fewer bins than copies some copies must share one, and this shares them evenly.
    Without ``bins`` all copies of a cluster conflict."""
    count: dict[int, int] = {}
    for _, c, _ in items:
        count[c] = count.get(c, 0) + 1
    groups = {c: -(-n // max(1, bins)) if bins is not None else 1 for c, n in count.items() if n > 1}
    seen: dict[int, int] = {}
    bit: dict[tuple[int, int], int] = {}
    out = []
    for size, c, _ in items:
        if c not in groups or size == 0:
            out.append(0)
            continue
        k = seen.get(c, 0)
        seen[c] = k + 1
        out.append(1 << bit.setdefault((c, k % groups[c]), len(bit)))
    return out


def pack(sizes: list[int], clusters: list[int], sources: list[str | None], capacity: int, apart: tuple[tuple[str, str], ...] = (), strict: bool = False) -> list[tuple[int, int, int, int]]:
    """(item, piece, size of the piece, bin). Only items larger than ``capacity`` have more than one piece.

    Full pieces of a large item take a bin each; its rest is an item like others. Empty items take no room.
    """
    out, items = [], []
    bins = 0
    for i, n in enumerate(sizes):
        full = n // capacity if n > capacity else 0
        for p in range(full):
            out.append((i, p, capacity, bins))
            bins += 1
        if rest := n - full * capacity:
            items.append((rest, clusters[i], i, full))
        elif not full:
            items.append((0, clusters[i], i, 0))
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    least = math.ceil(sum(x[0] for x in items) / capacity)
    conflict = _clusters([(x[0], x[1], x[2]) for x in items], None if strict else least)
    number = {s: k for k, s in enumerate(dict.fromkeys(sources))}
    enemy = dict.fromkeys(number, 0)
    for a, b in apart:
        if a in number and b in number:
            enemy[a] |= 1 << number[b]
            enemy[b] |= 1 << number[a]
    order: list[int] = []  # room << 32 | bin, ascending
    held_clusters: dict[int, int] = {}
    held_sources: dict[int, int] = {}
    # copies first, while there are bins enough without another; all others then fill what is left
    for (size, _, i, piece), bit in sorted(zip(items, conflict), key=lambda x: x[1] == 0):
        src = sources[i]
        at = bisect_left(order, size << 32)
        while at < len(order):
            b = order[at] & 0xFFFFFFFF
            if not (held_clusters[b] & bit or held_sources[b] & enemy[src]):
                break
            at += 1
        if at < len(order):
            room = (order.pop(at) >> 32) - size
        else:
            b, room = bins, capacity - size
            bins += 1
            held_clusters[b] = held_sources[b] = 0
        held_clusters[b] |= bit
        held_sources[b] |= 1 << number[src]
        insort(order, room << 32 | b)
        out.append((i, piece, size, b))
    return out


def packed(sizes: DataFrame, documents: int, capacity: int, shard_rows: int = 20_000, apart: tuple[tuple[str, str], ...] = (), strict: bool = False) -> DataFrame:
    """Where each document goes: (shard, bin, doc_id, piece, n_tokens, source, doc_tokens, forced), one row per piece.

    ``sizes`` as from ``token_sizes``, ``documents`` their number; (shard, bin) names a container. Null and empty texts are
    items of size 0 and have a row too. Repeated doc_ids are items of their own. The room lost to sharding is less than one
    open bin per shard. ``forced``: another copy of the text is in the same container. ``apart``: pairs of sources that are never
    in one container. No rows, no containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    shards = max(1, -(-documents // shard_rows))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        n, c, s = (t[x].to_pylist() for x in ("n_tokens", "cluster", "source"))
        rows = pack(n, c, s, capacity, apart, strict)
        held: dict[tuple[int, int], int] = {}
        for k, _, size, b in rows:
            if size:
                held[b, c[k]] = held.get((b, c[k]), 0) + 1
        i = pa.array([r[0] for r in rows], pa.int64())
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                "bin": pa.array([r[3] for r in rows], pa.int32()),
                "doc_id": t["doc_id"].take(i),
                "piece": pa.array([r[1] for r in rows], pa.int32()),
                "n_tokens": pa.array([r[2] for r in rows], pa.int64()),
                "source": t["source"].take(i),
                "doc_tokens": t["n_tokens"].take(i),
                "forced": pa.array([size > 0 and held[b, c[k]] > 1 for k, _, size, b in rows]),
            }
        )

    shard = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(8)), F.lit(shards)).cast("int")
    n = min(shards, 8 * sizes.sparkSession.sparkContext.defaultParallelism)
    return sizes.withColumn("shard", shard).repartition(n, "shard").groupBy("shard").applyInArrow(run, _OUT)


def oversize(rows: DataFrame, capacity: int) -> DataFrame:
    """Documents that had to be split because they exceed a container by themselves."""
    return rows.filter(F.col("doc_tokens") > capacity).select("doc_id").distinct()


def fill_report(rows: DataFrame, capacity: int) -> DataFrame:
    """(source, documents, containers, tokens) per source and, with source null, in all, and the share of room used there."""
    per = rows.groupBy("shard", "bin", "source").agg(F.sum("n_tokens").alias("t"), F.count_if(F.col("piece") == 0).alias("d"))
    total = per.groupBy("shard", "bin").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    cols = [F.sum("d").alias("documents"), F.count("*").alias("containers"), F.sum("t").alias("tokens")]
    return per.groupBy("source").agg(*cols, F.lit(None).cast("double").alias("fill")).unionByName(
        total.agg(F.lit("(all)").alias("source"), *cols, (F.sum("t") / (F.count("*") * F.lit(capacity))).alias("fill"))
    )


def invariants(sizes: DataFrame, rows: DataFrame, capacity: int, apart: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(check, n): what there is, and what must not be, in a packing of ``sizes``."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    per = rows.groupBy("shard", "bin").agg(F.sum("n_tokens").alias("t"), F.collect_set("source").alias("s"))
    doc = rows.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("t"), F.max("doc_tokens").alias("size"))
    both = F.lit(False)
    for a, b in apart:
        both = both | (F.array_contains("s", a) & F.array_contains("s", b))
    return (
        one("documents", doc)
        .unionByName(one("containers above capacity", per.filter(F.col("t") > capacity)))
        .unionByName(one("split though they fit", doc.filter((F.col("pieces") > 1) & (F.col("size") <= capacity))))
        .unionByName(one("tokens lost or added", doc.join(sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("all")), "doc_id", "full").filter(~F.col("t").eqNullSafe(F.col("all")))))
        .unionByName(one("sources together that are apart", per.filter(both)))
    )
