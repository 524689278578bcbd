"""Long exact spans shared between documents (problem 10), by relative Lempel-Ziv parsing.

Every document is a reference for every other. The reference is indexed by blocks that its own content selects: every window
of ``span`` characters selects the block in it with the least hash, the first of equal ones, so equal windows select equal
blocks at the same place. The windows that select one block make a *region*; regions cover a text without a gap, and the text of
a region, once for all documents that have it, is a *reference block* of the index.

Documents are factored against the reference blocks greedily: a factor goes on as long as the next region continues at the same
source, then the next one begins. At factor boundaries a region ends early in one of two texts, so there is a block in common but
not the region; only there the windows themselves are compared, by 128-bit hashes, each once per reference block. What a window
or a region is found in, is listed from the index: a class of documents. So a document that shares only part of a factor with
another than its source isn't lost, and copies, however many, are one row each in a class and never paired before the end.

A periodic text selects a block in each window, all with the same region; such neighbours are one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import merged_ranges
from ..session import written

_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_MIXES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Characters that are hashed at a time; bounds a task's memory whatever the length of a text.
_CHUNK = 1 << 19
#: Bits of the filter that drops documents whose text isn't asked for. Its size is fixed: 4 MB, 2^19 words on the driver.
_FILTER_BITS = 25


@dataclass(frozen=True)
class Params:
    """``span``: the least shared length. ``block``: length of the blocks that index it; at most ``span``."""

    span: int = 200
    block: int = 64

    @property
    def half(self) -> int:
        return (self.span - self.block) // 2


@dataclass
class Index:
    """``occurrences`` (h, ctx, doc_id, lo, n, hi): regions whose block other documents have, ``n`` windows each.
    ``references`` (h, ctx, a, b, n, l, r): distinct regions, with the least and the greatest (document, place). ``windows`` (k1, k2, h, ctx, j_lo, j_hi): windows of such regions that are in more than one of them."""

    params: Params
    occurrences: DataFrame
    references: DataFrame
    windows: DataFrame


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _slide_min(a: np.ndarray, w: int) -> np.ndarray:
    n = len(a)
    b = np.concatenate([a, np.full(-n % w, np.iinfo(a.dtype).max, a.dtype)]).reshape(-1, w)
    head = np.minimum.accumulate(b, axis=1).ravel()
    tail = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


class Hasher:
    """Two independent hashes of any stretch of an array of code points; equal text gives equal hashes at any position."""

    def __init__(self, size: int):
        self.up = [_powers(b, size + 1) for b in _BASES]
        self.down = [_powers(pow(b, -1, 1 << 64), size + 1) for b in _BASES]

    def sums(self, codes: np.ndarray, k: int) -> np.ndarray:
        m = (codes.astype(np.uint64) + np.uint64(0x51ED27 + k)) * np.uint64(_MIXES[k])
        m ^= m >> np.uint64(32)
        m *= self.up[k][: len(m)]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(m, dtype=np.uint64)])

    def of(self, sums: np.ndarray, k: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = (sums[hi] - sums[lo]) * self.down[k][lo] + (hi - lo).astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


class Selector:
    """Cuts texts into regions."""

    def __init__(self, p: Params):
        self.p = p
        self.hasher = Hasher(_CHUNK + p.span)

    def select(self, texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        """(index of text, h, ctx, lo, n, hi, l, r) of regions. Short texts share a chunk, long ones are cut with overlap.

        ``l`` and ``r``: hashes of the block with half of what a window has beside it, to the left and to the right; 0 where the
        region has no window that reaches so far. Two regions with a window in common have one of the two in common."""
        group: list[tuple[int, int, str]] = []
        size = 0
        step = _CHUNK - self.p.span + 1
        for i, t in enumerate(texts):
            for s in range(0, len(t) - self.p.span + 1, step):
                piece = t[s : s + _CHUNK]
                if size + len(piece) > _CHUNK and group:
                    yield self._chunk(group)
                    group, size = [], 0
                group.append((i, s, piece))
                size += len(piece)
        if group:
            yield self._chunk(group)

    def _chunk(self, group: list[tuple[int, int, str]]) -> tuple[np.ndarray, ...]:
        p, w = self.p, self.p.span - self.p.block + 1
        codes = np.frombuffer("".join(g[2] for g in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(g[2]) for g in group])
        part = np.repeat(np.arange(len(group)), length)
        at = np.arange(len(codes) - p.block + 1)
        h = self.hasher.of(self.hasher.sums(codes, 0), 0, at, at + p.block)
        least = _slide_min(h, w)
        start = np.flatnonzero(part[: len(least)] == part[p.span - 1 :])  # windows within one text
        # the block each window selects: the first at or after its start that has the least hash
        pad, floor = np.zeros(w - 1, np.uint64), np.zeros(len(least), np.uint64)
        floor[start] = least[start]
        is_min = ~_slide_min(~np.concatenate([pad, floor, pad]), w) == h  # greatest of the minima of the windows around each block
        some = np.flatnonzero(is_min)
        k = np.searchsorted(some, start)
        left = np.arange(len(start))
        while len(left):
            left = left[h[some[k[left]]] != least[start[left]]]
            k[left] += 1
        x = some[k]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (start[1:] != start[:-1] + 1)
        a = np.flatnonzero(new)
        lo, n, x = start[a], np.diff(np.append(a, len(x))), x[a]
        hi = lo + n - 1 + p.span
        sums = self.hasher.sums(codes, 1)
        half, rest = p.half, p.span - p.block - p.half
        l, r = (np.where(b - a == k + p.block, self.hasher.of(sums, 1, a, b) | np.uint64(1), np.uint64(0)) for a, b, k in ((np.maximum(lo, x - half), x + p.block, half), (x, np.minimum(hi, x + p.block + rest), rest)))
        ctx = self.hasher.of(sums, 1, lo, hi) + (x - lo).astype(np.uint64) * np.uint64(_BASES[0])
        g, hx = part[lo], h[x]
        # neighbours of a periodic text that are the same region again
        same = np.zeros(len(lo), bool)
        same[1:] = (g[1:] == g[:-1]) & (hx[1:] == hx[:-1]) & (ctx[1:] == ctx[:-1]) & (lo[1:] <= lo[:-1] + w)
        first = np.flatnonzero(~same)
        hi = hi[np.append(first[1:], len(lo)) - 1] if len(lo) else hi
        lo, n, hx, ctx, g, l, r = (v[first] for v in (lo, n, hx, ctx, g, l, r))
        off = np.array([y[1] for y in group])[g] - (np.cumsum(length) - length)[g]
        return np.array([y[0] for y in group])[g], hx, ctx, lo + off, n, hi + off, l, r


def _regions(p: Params, wanted: bool):
    """Regions of documents, without their ``ctx``; or with it, of those whose block is in the list ``hs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sel = Selector(p)
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            hs = [np.unique(np.array(x, np.int64)) for x in b.column("hs").to_pylist()] if wanted else None
            for i, h, ctx, lo, n, hi, l, r in sel.select(texts):
                h, ctx, l, r = (v.view(np.int64) for v in (h, ctx, l, r))
                if wanted:
                    ok = np.zeros(len(i), bool)
                    for k in np.unique(i):
                        s, e = np.searchsorted(i, [k, k + 1])
                        ok[s:e] = np.isin(h[s:e], hs[k])
                    i, h, ctx, lo, n, hi, l, r = (v[ok] for v in (i, h, ctx, lo, n, hi, l, r))
                ints = [pa.array(v, pa.int32()) for v in (lo, n, hi)]
                if wanted:
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ctx), ids.take(pa.array(i)), *ints, pa.array(l), pa.array(r)], names=["h", "ctx", "doc_id", "lo", "n", "hi", "l", "r"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(h), ids.take(pa.array(i))], names=["h", "doc_id"])

    return run


def _texts(documents: DataFrame, p: Params) -> DataFrame:
    return documents.filter(F.col("doc_id").isNotNull() & (F.length("text") >= p.span)).select("doc_id", "text")


def _asked(texts: DataFrame, per_doc: DataFrame) -> DataFrame:
    """``texts`` joined to ``per_doc``; most of those that aren't asked for are dropped before the shuffle, by a filter of fixed size."""
    spark = texts.sparkSession
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << _FILTER_BITS))
    words = per_doc.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {1 << _FILTER_BITS}) & 63 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2^19 rows
    table = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    table[got["w"].to_numpy()] = got["b"].to_numpy()
    sent = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("bit").to_numpy()
            yield b.filter(pa.array((sent.value[k >> 6] >> (k & 63)) & 1 == 1)).select(["doc_id", "text"])

    return texts.select("doc_id", "text", bit.alias("bit")).mapInArrow(run, "doc_id long, text string").join(per_doc, "doc_id")


def _windows(p: Params):
    """(k1, k2, h, ctx, j, a, b): windows of the regions in the list ``at`` that reach as far as what they have in common with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(_CHUNK + 2 * p.span)

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            text, h, ctx, n, a, b, left, right = zip(*rows)
            length, n = np.array([len(t) for t in text]), np.array(n)
            codes = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
            row = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            lo = (np.cumsum(length) - length)[row] + j
            lo = np.minimum(lo, len(codes) - p.span)
            k1, k2 = (hasher.of(hasher.sums(codes, k), k, lo, lo + p.span).view(np.int64) for k in (0, 1))
            cols = [np.array(c, np.int64)[row] for c in (h, ctx)] + [j.astype(np.int32)] + [np.array(c, np.int64)[row] for c in (a, b)]
            # a document that is there twice with different texts: only the text that the region is of
            end = np.cumsum(length)
            off = (np.array(ctx, np.int64).view(np.uint64) - hasher.of(hasher.sums(codes, 1), 1, end - length, end)) * np.uint64(pow(_BASES[0], -1, 1 << 64))
            ok = ((off < p.span) & (length == n + p.span - 1))[row]
            t = np.where(ok, off[row].astype(np.int64) - j, 0)
            ok &= (np.array(left)[row] & (t >= p.half)) | (np.array(right)[row] & (t <= p.half))
            k1, k2, cols = k1[ok], k2[ok], [c[ok] for c in cols]
            return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), *map(pa.array, cols)], names=["k1", "k2", "h", "ctx", "j", "a", "b"])

        for batch in batches:
            rows, size = [], 0
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist()):
                for r in at:
                    piece = text[r["lo"] : r["lo"] + r["n"] - 1 + p.span]
                    if len(piece) < p.span:
                        continue
                    if rows and size + len(piece) > _CHUNK:
                        yield flush(rows)
                        rows, size = [], 0
                    rows.append((piece, r["h"], r["ctx"], r["n"], r["a"], r["b"], r["left"], r["right"]))
                    size += len(piece)
            if rows:
                yield flush(rows)

    return run


def parsed(documents: DataFrame, p: Params = Params()) -> Index:
    """The index of what documents share. Texts below ``span`` characters, null texts and rows without doc_id share nothing.

    Rows of one doc_id are one document. Texts are read whole; only blocks that several documents have are looked at again.
    """
    texts = _texts(documents, p)
    blocks = written(texts.mapInArrow(_regions(p, False), "h long, doc_id long"), "blocks")
    many = blocks.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter(F.col("a") < F.col("b")).select("h")
    per = written(blocks.join(many, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("hs")), "asked")  # as many as a text has
    occ = written(_asked(texts, per).mapInArrow(_regions(p, True), "h long, ctx long, doc_id long, lo int, n int, hi int, l long, r long"), "regions")
    place = F.struct("doc_id", "lo", "hi")
    refs = occ.groupBy("h", "ctx").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("n").alias("n"), F.max("l").alias("l"), F.max("r").alias("r"))
    refs = written(refs, "references")
    both = refs.select("h", "ctx", "a", "b", "n", "l", "r", F.explode(F.array(F.struct(F.lit(True).alias("left"), F.col("l").alias("k")), F.struct(F.lit(False).alias("left"), F.col("r").alias("k")))).alias("s")).filter("s.k <> 0")
    other = both.groupBy("h", "s").agg(F.min("ctx").alias("_c"), F.max("ctx").alias("_d"), F.min("a.doc_id").alias("_a"), F.max("b.doc_id").alias("_b")).filter("_c < _d and _a < _b").select("h", "s")
    edge = both.join(other, ["h", "s"], "left_semi").groupBy("h", "ctx").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("n").alias("n"), F.bool_or("s.left").alias("left"), F.bool_or(~F.col("s.left")).alias("right"))
    at = F.struct("h", "ctx", F.col("a.lo").alias("lo"), "n", F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), "left", "right")
    asked = edge.groupBy(F.col("a.doc_id").alias("doc_id")).agg(F.collect_list(at).alias("at"))  # regions of one text
    rows = _asked(texts, written(asked, "asked")).mapInArrow(_windows(p), "k1 long, k2 long, h long, ctx long, j int, a long, b long")
    keyed = written(rows.groupBy("k1", "k2", "h", "ctx").agg(F.min("j").alias("j_lo"), F.max("j").alias("j_hi"), F.min("a").alias("a"), F.max("b").alias("b")), "windows")
    shared = keyed.groupBy("k1", "k2").agg(F.min("ctx").alias("c"), F.max("ctx").alias("d"), F.min("a").alias("a"), F.max("b").alias("b"))
    shared = shared.filter((F.col("c") < F.col("d")) & (F.col("a") < F.col("b"))).select("k1", "k2")
    return Index(p, occ, refs, written(keyed.join(shared, ["k1", "k2"], "left_semi").drop("a", "b"), "boundaries"))


def _one_per_set(rows: DataFrame, cls: list[str], member: str) -> DataFrame:
    """Of classes with the same members one, by a signature of the set; ``rows`` are distinct. Classes of one member go."""
    sign = rows.groupBy(*cls).agg(F.count("*").alias("n"), F.min(member).alias("a"), F.bit_xor(F.xxhash64(member)).alias("x"), F.bit_xor(F.xxhash64(member, F.lit(1))).alias("y"))
    one = sign.filter("n > 1").groupBy("n", "a", "x", "y").agg(F.min(F.struct(*cls)).alias("c")).select("c.*")
    return rows.join(one, cls, "left_semi")


def document_classes(index: Index) -> DataFrame:
    """(c1, c2, doc_id): classes of documents that have one and the same span. Two documents share a span if and only if some
    class has both. Classes with the same documents are one, so a long passage in many documents is one class of them."""
    docs = index.occurrences.select("h", "ctx", "doc_id").distinct()
    whole = docs.join(index.references.filter("a.doc_id < b.doc_id").select("h", "ctx"), ["h", "ctx"], "left_semi").select(F.col("h").alias("c1"), F.col("ctx").alias("c2"), "doc_id")
    some = _one_per_set(index.windows.select("k1", "k2", "h", "ctx"), ["k1", "k2"], "ctx")
    parts = some.join(docs, ["h", "ctx"]).select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "doc_id").distinct()
    return _one_per_set(written(whole.unionByName(parts), "members"), ["c1", "c2"], "doc_id")


def class_report(index: Index) -> DataFrame:
    """(class, doc_id, documents): membership of each document, with the least document as the name of a class's first source."""
    c = written(document_classes(index), "classes")
    n = c.groupBy("c1", "c2").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
    return c.join(n, ["c1", "c2"]).select(F.hex(F.xxhash64("c1", "c2")).alias("class"), "doc_id", "first_doc", "documents")


def shared_pairs(index: Index) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: documents that share a span of ``span`` or more characters. Pairs are made of the
    classes only here, as the result asks for them; ``class_report`` has the same without pairs."""
    c = written(document_classes(index), "classes")
    l, r = c.alias("l"), c.alias("r")
    on = (F.col("l.c1") == F.col("r.c1")) & (F.col("l.c2") == F.col("r.c2")) & (F.col("l.doc_id") < F.col("r.doc_id"))
    return l.join(r, on).select(F.col("l.doc_id").alias("doc_id_a"), F.col("r.doc_id").alias("doc_id_b")).distinct()


_FACTOR = "doc_id long, lo int, hi int, source long, source_lo int"


def _factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greedy parse of regions sorted by (doc_id, lo). Each has two sources to follow, the least and the greatest that isn't itself."""
    out: list[tuple] = []
    # the open factors of the document at hand, as source -> (lo, hi): each candidate of the first region is followed
    live: dict[tuple[int, int], tuple[int, int]] = {}
    doc = None

    def close() -> None:
        if live:
            (src, shift), (lo, hi) = max(live.items(), key=lambda x: (x[1][1] - x[1][0], x[0]))
            out.append((doc, lo, hi, src, lo + shift))

    for b in batches:
        for d, lo, n, hi, a, z in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lo", "n", "hi", "a", "b"))):
            # of a periodic stretch a factor is as long as the source has it
            new = {(s["doc_id"], s["lo"] - lo): (lo, min(hi, s["hi"] - s["lo"] + lo)) for s in (a, z) if s["doc_id"] != d}
            on = {k: (live[k][0], v[1]) for k, v in new.items() if k in live and lo <= live[k][1]} if d == doc else {}
            if not on:
                close()
            live, doc = on or new, d
            if len(out) >= 4096:
                yield _factors(out)
                out = []
    close()
    if out:
        yield _factors(out)


def _factors(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "lo", "hi", "source", "source_lo"])


def factors(index: Index) -> DataFrame:
    """(doc_id, lo, hi, source, source_lo): the factors of each document, of ``span`` or more characters. Boundaries overlap, as
    a factor begins with the first window that isn't in the one before."""
    refs = index.references.filter("a.doc_id < b.doc_id").select("h", "ctx", "a", "b")
    rows = index.occurrences.join(refs, ["h", "ctx"]).select("doc_id", "lo", "n", "hi", "a", "b")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "lo").mapInArrow(_factor, _FACTOR)


def shared_lengths(documents: DataFrame, index: Index) -> DataFrame:
    """(doc_id, n_chars, spans, shared_chars, shared) for every document: how much of it lies in spans found elsewhere.

    Factors, and the windows at their boundaries that other documents have. Overlapping spans count once; ``spans`` are the
    stretches left. A null or empty text has length 0 and shares nothing.
    """
    part = index.windows.groupBy("h", "ctx").agg(F.min("j_lo").alias("j_lo"), F.max("j_hi").alias("j_hi"))
    ends = index.occurrences.join(part, ["h", "ctx"]).select("doc_id", (F.col("lo") + F.col("j_lo")).alias("lo"), (F.col("lo") + F.col("j_hi") + index.params.span).alias("hi"))
    runs = index.occurrences.filter(F.col("hi") > F.col("lo") + F.col("n") - 1 + index.params.span)  # as long as they are, whatever the source has
    runs = runs.join(index.references.filter("a.doc_id < b.doc_id").select("h", "ctx"), ["h", "ctx"], "left_semi")
    cut = factors(index).select("doc_id", "lo", "hi").unionByName(ends).unionByName(runs.select("doc_id", "lo", "hi"))
    spans = merged_ranges(cut.select(F.col("doc_id").cast("string").alias("id"), "lo", "hi"))
    per = spans.groupBy(F.col("id").cast("long").alias("doc_id")).agg(F.count("*").alias("spans"), F.sum(F.col("hi") - F.col("lo")).alias("shared_chars"))
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    docs = documents.select("doc_id", n.alias("n_chars")).join(per, "doc_id", "left").fillna(0, ["spans", "shared_chars"])
    return docs.withColumn("shared", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
