"""Mixing sources to target shares of the tokens (problem 9).

Every document of a source gets the same expected number of copies. Its whole part is certain; the fractions are rounded by
the pivotal method: two fractional documents exchange token mass at random until one of them is whole, so that the source's
token sum stays the same and every document keeps its expectation. Blocks of documents are rounded on their own, leave at
most one fractional document each, and these residuals are rounded again in a tree of blocks until one per source is left.

That one is rounded last, so a source misses its tokens by less than the weight of one document. Which one it is can't be
chosen: if a document is heavier than all others together, it stays to the end. Where that leaves a source off by more than the
tolerance, documents lighter than what is missing (or too much) are taken again (or less often), within the cap, by the same
rounding. Of a source so corrected, light documents have another expectation than the heavy ones.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

_ROW = "plan string, source string, block long, doc_id long, n_tokens long, base int, frac double"


def pivotal(weight: np.ndarray, prob: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round ``prob`` keeping sum(weight * prob); at most one entry stays fractional. Weightless entries round on their own.

    Entries meet in falling order of weight.
    """
    p = prob.astype(float).copy()
    free = (weight <= 0) & (p > 0) & (p < 1)
    p[free] = rng.random(int(free.sum())) < p[free]
    live = np.flatnonzero((p > 0) & (p < 1))
    live = live[np.argsort(-weight[live], kind="stable")]
    w, q, u = weight[live].tolist(), p[live].tolist(), rng.random(len(live)).tolist()
    i = 0
    for j in range(1, len(q)):
        if not 0 < q[i] < 1:
            i = j
            continue
        up_i, down_i, up_j, down_j = w[i] * (1 - q[i]), w[i] * q[i], w[j] * (1 - q[j]), w[j] * q[j]
        up, down = min(up_i, down_j), min(down_i, up_j)
        if u[j] * (up + down) < down:  # mass moves from j to i
            a, b = (1.0 if up_i <= down_j else q[i] + up / w[i]), (0.0 if down_j <= up_i else q[j] - up / w[j])
        else:
            a, b = (0.0 if down_i <= up_j else q[i] - down / w[i]), (1.0 if up_j <= down_i else q[j] + down / w[j])
        q[i], q[j] = (round(x) if abs(x - round(x)) < 1e-12 else x for x in (a, b))
        if not 0 < q[i] < 1:
            i = j
    p[live] = q
    return p


def plan_rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | str | None = None) -> DataFrame:
    """Per plan and source: tokens and documents there are, and ``rate``, the expected copies of each document.

    ``total_tokens`` is the size of the mixture; ``"listed"``: as many tokens as a plan's sources have. Without it, it is the
    largest at which every source that exists and may be used can give its share: the least of tokens * max_repeats /
    target_share. A source that is too small gives all it may; one that is absent or has no tokens gives nothing. Null shares or
    repeats count as 0; repeated targets of a source are added up and the greatest cap counts.
    """
    t = targets.filter(F.col("plan").isNotNull() & F.col("source").isNotNull()).groupBy("plan", "source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    r = t.join(have, "source", "left").fillna(0, ["tokens", "documents"])
    plan = Window.partitionBy("plan")
    room = F.when((F.col("target_share") > 0) & (F.col("tokens") > 0) & (F.col("max_repeats") > 0), F.col("tokens") * F.col("max_repeats") / F.col("target_share"))
    if total_tokens == "listed":
        total = F.sum(F.when(F.col("target_share") > 0, F.col("tokens"))).over(plan).cast("double")
    else:
        total = F.min(room).over(plan) if total_tokens is None else F.lit(float(total_tokens))
    want = F.col("target_share") * F.coalesce(total, F.lit(0.0))
    rate = F.when(F.col("tokens") > 0, F.least(want / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return written(r.select("plan", "source", "target_share", "max_repeats", "tokens", "documents", want.alias("wanted"), rate.alias("rate")), "rates")


def _round(seed: int, level: int, last: bool):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        name = "|".join(str(k.as_py()) for k in key)
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{level}|{name}".encode()))
        p = pivotal(t["n_tokens"].to_numpy().astype(float), t["frac"].to_numpy(), rng)
        if last:
            p = np.where((p > 0) & (p < 1), rng.random(len(p)) < p, p)
        whole = p >= 1
        base = t["base"].to_numpy() + whole
        return t.set_column(5, "base", pa.array(base, pa.int32())).set_column(6, "frac", pa.array(np.where(whole, 0.0, p)))

    return run


def _rounded(rows: DataFrame, most: int, seed: int, fan: int) -> DataFrame:
    """``rows`` with whole ``base``, by rounding ``frac`` in a tree of blocks; ``most``: blocks of the largest source."""
    done, level = None, 0
    while True:
        last = most <= 1
        n = min(max(1, most), 8) * rows.sparkSession.sparkContext.defaultParallelism
        rows = written(rows.repartition(n, "plan", "source", "block").groupBy("plan", "source", "block").applyInArrow(_round(seed, level, last), _ROW), "mix")
        whole_rows = rows.filter(F.col("frac") == 0)
        done = whole_rows if done is None else done.unionByName(whole_rows)
        if last:
            return done
        most = -(-most // fan)
        rows = rows.filter(F.col("frac") > 0).withColumn("block", F.floor(F.col("block") / fan).cast("long"))
        level += 1


def _parts(base: Column, copies: Column) -> list[Column]:
    """``base`` and the whole and fractional part of ``copies``, as whole and fractional copies; the sum may be less than base."""
    c = base + copies
    whole = F.floor(c + 1e-9)
    frac = c - whole
    return [whole.cast("int").alias("base"), F.when(frac > 1e-9, frac).otherwise(0.0).alias("frac")]


#: A source is ``met`` if it misses its tokens by at most this share of its plan.
TOLERANCE = 0.005


def mixture(sizes: DataFrame, rates: DataFrame, seed: int = 0, block_rows: int = 20_000, fan: int = 1024, tolerance: float = TOLERANCE, corrections: int = 3) -> DataFrame:
    """(plan, source, doc_id, n_tokens, copies) with copies > 0. The same input and seed give the same result.

    A source's tokens are its rate times what it has, to within one document. Where that is more than ``tolerance`` of the plan,
    up to ``corrections`` further passes over that source's documents lighter than the gap (or, where these don't reach, its
    document nearest to the gap) bring it closer; 0 leaves it.
    Documents of unlisted sources, or without a source, aren't used. Repeated doc_ids are documents of their own. Blocks are
    made by a hash of doc_id, so a source with a third of all rows is as many blocks as it needs.
    """
    r = rates.filter(F.col("rate") > 0).select("plan", "source", "rate", "max_repeats", "wanted", F.greatest(F.lit(1), F.ceil(F.col("documents") / block_rows)).cast("long").alias("blocks"))
    most = r.agg(F.max("blocks")).first()[0] or 1
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks"))
    rows = sizes.join(r, "source").select("plan", "source", block.alias("block"), "doc_id", "n_tokens", *_parts(F.lit(0), F.col("rate")))
    done = _rounded(rows, most, seed, fan)
    cap = r.join(rates.groupBy("plan").agg(F.sum("wanted").alias("plan_tokens")), "plan").join(rates.select("plan", "source", "tokens"), ["plan", "source"])
    for k in range(corrections):
        used = done.groupBy("plan", "source").agg(F.sum(F.col("n_tokens") * F.col("base")).alias("used"))
        gap = F.least("wanted", F.col("tokens") * F.col("max_repeats")) - F.col("used")
        off = written(cap.join(used, ["plan", "source"]).withColumn("gap", gap).filter(F.abs("gap") > tolerance * F.col("plan_tokens")), "off")
        if off.isEmpty():
            break
        j = written(done.join(off.select("plan", "source", "gap", "max_repeats", "blocks"), ["plan", "source"]), "light")
        free = F.when(F.col("n_tokens") > 0, F.when(F.col("gap") > 0, F.col("max_repeats") - F.col("base")).otherwise(F.col("base"))).otherwise(0)
        size = F.abs("gap")
        best = F.min(F.when((free > 0) & (F.col("n_tokens") < 2 * size), F.struct(F.abs(F.col("n_tokens") - size).alias("left"), "doc_id", "n_tokens")))
        room = j.groupBy("plan", "source").agg(F.sum(F.when(F.col("n_tokens") <= size, F.col("n_tokens") * free).otherwise(0)).alias("room"), best.alias("best"), F.max(size).alias("_size"))
        # light documents alone don't reach: the document nearest to the gap first, the light ones in the next pass
        room = room.filter(F.col("best").isNotNull()).withColumn("one", (F.col("room") < F.col("_size")) & (F.col("best.left") < F.col("_size") - F.col("room"))).drop("_size")
        j = j.join(room, ["plan", "source"])
        share = F.least(F.lit(1.0), size / F.col("room"))
        many = F.when(F.col("n_tokens") <= size, free * share).otherwise(0.0)
        single = ((F.col("doc_id") == F.col("best.doc_id")) & (F.col("n_tokens") == F.col("best.n_tokens")) & (free > 0)).cast("double")
        step = F.signum("gap") * F.when(F.col("one"), single).otherwise(many)
        again = j.select("plan", "source", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).alias("block"), "doc_id", "n_tokens", *_parts(F.col("base"), step))
        done = written(done.join(room, ["plan", "source"], "left_anti").unionByName(_rounded(again, most, seed + 1 + k, fan)), "mix")
    return done.filter(F.col("base") > 0).select("plan", "source", "doc_id", "n_tokens", F.col("base").alias("copies"))


def share_report(mix: DataFrame, rates: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """What each plan reached: tokens and share per source beside the target, also for sources that gave nothing.

    ``outcome``: ``absent`` without tokens, ``too small`` if all its tokens, repeated as often as allowed, are less than wanted,
    ``met`` if what was used is within ``tolerance`` of the plan's tokens, else ``off``."""
    got = mix.groupBy("plan", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.sum("copies").cast("long").alias("used_documents"), F.max("copies").alias("most_copies"))
    j = rates.join(got, ["plan", "source"], "left").fillna(0, ["used_tokens", "used_documents", "most_copies"])
    w = Window.partitionBy("plan")
    share = F.when(F.sum("used_tokens").over(w) > 0, F.col("used_tokens") / F.sum("used_tokens").over(w)).otherwise(0.0)
    close = F.abs(F.col("used_tokens") - F.col("wanted")) <= tolerance * F.sum("wanted").over(w)
    reason = F.when(F.col("tokens") == 0, "absent").when(F.col("wanted") > F.col("tokens") * F.col("max_repeats") + 0.5, "too small").when(close, "met").otherwise("off")
    return j.select("plan", "source", "target_share", share.alias("reached_share"), F.round("wanted").cast("long").alias("wanted_tokens"), "used_tokens", "used_documents", "most_copies", "max_repeats", reason.alias("outcome"))


def invariants(sizes: DataFrame, mix: DataFrame, report: DataFrame) -> DataFrame:
    """(check, violations) of what must hold whatever was drawn: no violation each."""
    one = lambda name, df: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    per_doc = mix.groupBy("plan", "source", "doc_id", "n_tokens").agg(F.sum("copies").alias("copies"))
    cap = report.select("plan", "source", "max_repeats", "used_tokens", "reached_share")
    sums = mix.groupBy("plan", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"))
    w = Window.partitionBy("plan")
    share = report.withColumn("sum", F.sum("used_tokens").over(w)).filter((F.col("sum") > 0) & (F.abs(F.col("reached_share") * F.col("sum") - F.col("used_tokens")) > 0.5))
    return (
        one("used more often than allowed", per_doc.join(cap, ["plan", "source"]).filter(F.col("copies") > F.col("max_repeats")))
        .unionByName(one("not a document of its source", per_doc.join(sizes, ["source", "doc_id", "n_tokens"], "left_anti")))
        .unionByName(one("tokens of a source differ from its documents", sums.join(report.filter("used_tokens > 0"), ["plan", "source"], "full").filter(~F.col("t").eqNullSafe(F.col("used_tokens")))))
        .unionByName(one("share differs from the tokens", share))
    )
