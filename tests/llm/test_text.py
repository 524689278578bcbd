import random
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelspark.llm import garbled, mixing, packing, spans, tokens

# ------------------------------------------------------------------------------------------------ 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 260), st.integers(0, 5), st.sampled_from(["x", "y", None])), max_size=80))
def test_packing_keeps_every_token_and_conflict(items):
    sizes, clusters, sources = ([i[k] for i in items] for k in range(3))
    out = packing.pack(sizes, clusters, sources, 100, (("x", "y"),))
    assert sorted((i, p) for i, p, *_ in out) == sorted((i, p) for i, n in enumerate(sizes) for p in range(max(1, -(-n // 100))))
    used, srcs = {}, {}
    for i, p, n, b in out:
        used[b] = used.get(b, 0) + n
        if n < 100 or sizes[i] <= 100:
            srcs.setdefault(b, set()).add(sources[i])
    assert all(v <= 100 for v in used.values()) and sum(used.values()) == sum(sizes)
    assert not any({"x", "y"} <= s for s in srcs.values())


def test_packing_is_tight_and_spreads_copies():
    rng = random.Random(1)
    sizes = [rng.randint(20, 900) for _ in range(3000)]
    out = packing.pack(sizes, list(range(3000)), ["s"] * 3000, 4096)
    bins = {b for *_, b in out}
    assert sum(sizes) / (len(bins) * 4096) > 0.995
    # a third are copies: still tight, and no container holds more of them than it must
    clusters = [0 if k % 3 == 0 else k for k in range(3000)]
    sizes = [300 if k % 3 == 0 else n for k, n in enumerate(sizes)]
    assert len({b for *_, b in packing.pack(sizes, clusters, ["s"] * 3000, 4096, strict=True)}) >= 1000
    out = packing.pack(sizes, clusters, ["s"] * 3000, 4096)
    per = {}
    for i, _, _, b in out:
        per[b] = per.get(b, 0) + (clusters[i] == 0)
    assert sum(sizes) / (len(per) * 4096) > 0.98 and max(per.values()) <= -(-1000 // (sum(sizes) // 4096)) + 1


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens long, shard int, bin string")


def test_packed_table(spark):
    rows = [(k, "word " * (k % 50), ["a", None][k % 2], 0, 0, "") for k in range(200)] + [(1000, None, "a", 0, 0, ""), (1001, "", "a", 0, 0, ""), (1002, "x y z " * 3000, "b", 0, 0, ""), (5, "again", "a", 0, 0, "")]
    df = docs(spark, rows)
    out = packing.packed(tokens.token_sizes(df), len(rows), 500, 60)
    assert {r.doc_id for r in packing.oversize(out, 500).collect()} == {1002}
    assert out.filter("piece = 0").count() == len(rows)
    assert out.groupBy("shard", "bin").agg(F.sum("n_tokens").alias("t")).filter("t > 500").count() == 0
    total = packing.fill_report(out, 500).filter("source = '(all)'").first()
    assert total.documents == len(rows) and 0.5 < total.fill <= 1
    assert packing.packed(tokens.token_sizes(df.limit(0)), 0, 500).count() == 0
    # twenty copies in a container for four: they are told, unless they must not
    many = docs(spark, [(k, "one text " * 10, "a", 0, 0, "") for k in range(20)])
    assert packing.packed(tokens.token_sizes(many), 20, 100).filter("forced").count() == 20
    strict = packing.packed(tokens.token_sizes(many), 20, 100, strict=True)
    assert strict.filter("forced").count() == 0 and strict.select("shard", "bin").distinct().count() == 20
    sizes = tokens.token_sizes(df.filter("doc_id <> 5"))
    apart = packing.packed(sizes, len(rows), 500, 60, (("a", "b"),))
    assert {r["check"]: r.n for r in packing.invariants(sizes, apart, 500, (("a", "b"),)).collect()} == {"documents": 202, "containers above capacity": 0, "split though they fit": 0, "tokens lost or added": 0, "sources together that are apart": 0}


# ------------------------------------------------------------------------------------------------ 9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.floats(0, 1)), max_size=60), st.integers(0, 9))
def test_pivotal_keeps_the_sum(items, seed):
    w, p = np.array([i[0] for i in items], float), np.array([i[1] for i in items])
    q = mixing.pivotal(w, p, np.random.default_rng(seed))
    assert ((q > 0) & (q < 1)).sum() <= 1 and ((q >= 0) & (q <= 1)).all()
    assert abs((w * q).sum() - (w * p).sum()) < 1e-6 * (1 + w.sum())


def test_pivotal_keeps_expectations():
    w, p = np.array([5.0, 90, 40, 7, 300, 1, 0]), np.array([0.3, 0.3, 0.8, 0.5, 0.3, 0.9, 0.25])
    rng = np.random.default_rng(5)
    mean = np.mean([mixing.pivotal(w, p, rng) for _ in range(20_000)], axis=0)
    assert np.abs(mean - p).max() < 0.02


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(k, None, "big" if k % 3 else "small", rng.randint(1, 400), 0, "") for k in range(3000)] + [(9000, None, None, 50, 0, ""), (9001, None, "other", 50, 0, ""), (9002, None, "small", 0, 0, "")]
    df = docs(spark, rows).select("doc_id", "source", "n_tokens")
    t = spark.createDataFrame([("p", "big", 0.5, 1), ("p", "small", 0.4, 3), ("p", "absent", 0.1, 5), ("q", "small", 1.0, 2), ("z", "big", 0.0, 1), ("n", "big", None, None)], "plan string, source string, target_share double, max_repeats int")
    rates = mixing.plan_rates(df, t)
    mix = mixing.mixture(df, rates, block_rows=100, fan=3)
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, mixing.mixture(df, rates, block_rows=100, fan=3).collect()))
    rep = {(r.plan, r.source): r for r in mixing.share_report(mix, rates).collect()}
    big, small = rep["p", "big"], rep["p", "small"]
    assert {(r["check"], r.violations) for r in mixing.invariants(df, mix, mixing.share_report(mix, rates)).collect() if r.violations} == set()
    assert abs(big.reached_share - 5 / 9) < 0.002 and abs(small.reached_share - 4 / 9) < 0.002 and rep["p", "absent"].outcome == "absent"
    assert big.most_copies <= 1 and small.most_copies <= 3 and rep["q", "small"].used_tokens == 2 * sum(r[3] for r in rows if r[2] == "small") and rep["z", "big"].used_tokens == 0
    short = mixing.plan_rates(df, t, 10**9)
    got = {(r.plan, r.source): r.outcome for r in mixing.share_report(mixing.mixture(df, short), short).collect()}
    assert got["p", "big"] == "too small" and mixing.mixture(df.limit(0), mixing.plan_rates(df.limit(0), t)).count() == 0


def test_a_heavy_document_leaves_a_source_off_or_corrected(spark):
    """One document of a source is heavier than all others together: by rounding alone it misses its share by far."""
    rows = [(0, None, "small", 37_769, 0, "")] + [(k, None, "small", 500, 0, "") for k in range(1, 15)] + [(100 + k, None, "big", 400, 0, "") for k in range(1000)]
    df = docs(spark, rows).select("doc_id", "source", "n_tokens")
    t = spark.createDataFrame([("p", "small", 0.2, 3), ("p", "big", 0.8, 3)], "plan string, source string, target_share double, max_repeats int")
    rates = mixing.plan_rates(df, t, 283_000)  # 56,600 of them from the source that has 44,769
    plain = {r.source: r for r in mixing.share_report(mixing.mixture(df, rates, corrections=0), rates).collect()}
    assert plain["small"].outcome == "off" and abs(plain["small"].used_tokens - 56_600) > 10_000 and plain["big"].outcome == "met"
    mix = mixing.mixture(df, rates)
    got = {r.source: r for r in mixing.share_report(mix, rates).collect()}
    assert abs(got["small"].used_tokens - 56_600) <= 1500 and got["small"].most_copies <= 3
    assert got["big"].used_tokens == plain["big"].used_tokens
    listed = {r.source: r.outcome for r in mixing.share_report(mixing.mixture(df, mixing.plan_rates(df, t, "listed")), mixing.plan_rates(df, t, "listed")).collect()}
    assert listed["big"] == "met"
    none = spark.createDataFrame([("p", "small", 0.5, 0), ("p", "big", 0.5, 1)], t.schema)
    assert {r.source: r.outcome for r in mixing.share_report(mixing.mixture(df, mixing.plan_rates(df, none)), mixing.plan_rates(df, none)).collect()} == {"small": "too small", "big": "met"}


# ------------------------------------------------------------------------------------------------ 10


def brute_spans(texts, n):
    at, pairs, cover = {}, set(), {}
    for i, t in texts.items():
        for k in range(len(t or "") - n + 1):
            at.setdefault(t[k : k + n], []).append((i, k))
    for places in at.values():
        ids = sorted({i for i, _ in places})
        if len(ids) > 1:
            pairs |= {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :]}
            for i, k in places:
                cover.setdefault(i, set()).update(range(k, k + n))
    return pairs, {i: len(c) for i, c in cover.items()}


def text_set(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab \n") if rng.random() < 0.7 else rng.choice("é€😀xyz") for _ in range(n))
    shared = [word(rng.choice([18, 19, 20, 21, 35, 80])) for _ in range(6)] + ["=" * 30, "ab" * 25]
    texts = {k: "".join(rng.choice(shared) if rng.random() < 0.5 else word(rng.randint(0, 40)) for _ in range(rng.randint(0, 8))) for k in range(40)}
    return texts | {100: None, 101: "", 102: "x" * 19, 103: "=" * 20, 104: "=" * 300}


def test_spans_against_brute_force(spark):
    for seed, p in enumerate((spans.Params(20, 12), spans.Params(20, 20), spans.Params(20, 1))):
        texts = text_set(seed)
        df = docs(spark, [(i, t, "s", 0, 0, "") for i, t in texts.items()]).repartition(4)
        pairs, cover = brute_spans(texts, 20)
        index = spans.parsed(df, p)
        assert {tuple(r) for r in spans.shared_pairs(index).collect()} == pairs, (seed, p)
        got = spans.shared_lengths(df, index).collect()
        assert {r.doc_id: r.shared_chars for r in got if r.shared_chars} == cover and len(got) == len(texts), (seed, p)
        classes = {}
        for r in spans.class_report(index).collect():
            classes.setdefault(r["class"], []).append(r)
        assert {(a.doc_id, b.doc_id) for c in classes.values() for a in c for b in c if a.doc_id < b.doc_id} == pairs
        assert all(r.documents == len(c) and r.first_doc == min(x.doc_id for x in c) for c in classes.values() for r in c)
        for f in spans.factors(index).collect():
            assert f.source != f.doc_id and f.hi - f.lo >= 20 and texts[f.doc_id][f.lo : f.hi] == texts[f.source][f.source_lo : f.source_lo + f.hi - f.lo]


def test_a_copied_document_is_one_factor(spark):
    rng = random.Random(8)
    a = "".join(rng.choice(string.ascii_letters) for _ in range(4000))
    df = docs(spark, [(1, a, "s", 0, 0, ""), (2, "x" * 50 + a, "s", 0, 0, ""), (3, a[:900] + a[2000:], "s", 0, 0, ""), (4, a, "s", 0, 0, ""), (4, "another text of the same number " * 20, "s", 0, 0, "")])
    index = spans.parsed(df)
    got = sorted(tuple(r) for r in spans.factors(index).collect())
    whole = [x for x in got if x[0] in (1, 4)]
    assert [x[:3] for x in whole] == [(1, 0, 4000), (4, 0, 4000)] and whole[1][3:] == (1, 0)
    assert [x[0] for x in got].count(3) == 2
    assert {tuple(r) for r in spans.shared_pairs(index).collect()} == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(spans, "_CHUNK", 256)
    rng = random.Random(4)
    a = "".join(rng.choice(string.ascii_letters) for _ in range(5000))
    texts = {1: a, 2: "q" * 777 + a[1234:1274] + "w" * 500, 3: a[3000:3039] + "!", 4: None}
    p = spans.Params(40, 24)
    df = docs(spark, [(i, t, "s", 0, 0, "") for i, t in texts.items()])
    assert {tuple(r) for r in spans.shared_pairs(spans.parsed(df, p)).collect()} == {(1, 2)}


def test_periodic_texts_are_few_rows(spark):
    """A long line of dashes in many documents, each with its own text around."""
    df = spark.range(100, 400).select(F.col("id").alias("doc_id"), F.concat(F.expr("repeat(cast(id as string) || ' ', 100)"), F.repeat(F.lit("-"), 100_000), F.expr("repeat(' ' || cast(id as string), 100)")).alias("text")).repartition(8)
    index = spans.parsed(df)
    assert index.occurrences.count() < 300_000
    classes = spans.document_classes(index).collect()
    assert max(Counter((c.c1, c.c2) for c in classes).values()) == 300 and len(classes) < 300 * 10  # those that begin alike are classes too
    got = spans.shared_lengths(df, index).agg(F.min("shared_chars"), F.max("shared_chars")).first()
    assert got[0] >= 100_000 and got[1] < 100_010


def test_no_documents(spark):
    df = docs(spark, [])
    index = spans.parsed(df)
    assert spans.shared_pairs(index).count() == 0 and spans.shared_lengths(df, index).count() == 0 and spans.class_report(index).count() == 0


# ------------------------------------------------------------------------------------------------ 2

WORDS = ["Forêt", "Montée", "Fossé", "Près", "Chênes", "Cœur", "Côte", "Hôtel", "Gué", "Étang", "Île", "Château", "Bœufs", "Théâtre", "Noël", "Où"]


def damage(t, written, decoded, times=1):
    for _ in range(times):
        t = t.encode(written).decode(decoded)
    return t


def test_undoing_each_chain():
    c = garbled.Codecs()
    t = "Montée du Château d'été"
    for w, d in (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("mac_roman", "cp1252"), ("cp850", "cp1252")):
        assert t in garbled.repairs(damage(t, w, d), c, lambda a, b: True).values(), (w, d)
    assert t in garbled.repairs(damage(t, "utf-8", "latin-1", 2), c, lambda a, b: True).values()
    for w, d in (("cp1252", "iso8859-5"), ("cp1252", "iso8859-7")):
        assert "Forêt" in garbled.repairs(damage("Forêt", w, d), c, lambda a, b: True).values(), (w, d)
    twice = damage(damage("Forêt", "utf-8", "cp1252"), "cp1252", "cp850")
    assert "Forêt" in garbled.repairs(twice, c, lambda a, b: True).values()
    assert garbled.repairs("plain", c, lambda a, b: True) == {} and garbled.repairs("", c, lambda a, b: True) == {}


def test_found_and_repaired(spark):
    rng = random.Random(6)
    strange = ["Łąka", "Straße am Fluß", "Δ 4", "São Bréal", "Þór", "LOT 2 ¼", "Ångle", "Kůň"]
    chains = [("utf-8", "cp1252", 1), ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 1), ("cp1252", "mac_roman", 1), ("cp1252", "cp850", 1), ("utf-8", "cp850", 1)]
    rows, truth = [], {}
    for k in range(4000):
        t = " ".join(rng.choice(WORDS) for _ in range(3)) + f" {k % 97}"
        v = t
        if k % 25 == 0:
            w, d, n = rng.choice(chains)
            try:
                v = damage(t, w, d, n)
            except UnicodeError:
                v = t
        elif k % 25 == 1:
            v = rng.choice(strange)
        elif k % 400 == 7:
            v = t.encode("latin-1", "replace").decode("utf-8", "replace")
        if v != t and k % 25 != 1:
            truth[f"o{k}", "TEX"] = t if "�" not in v else None
        rows.append((f"arch{k % 40}", 1, f"o{k}", "T", {"TEX": v, "NUM": str(k), "NIL": None}, k))
    rows += [("arch1", 1, "empty", "T", {}, 0), ("arch1", 1, "null", "T", None, 0), (None, None, None, None, {"TEX": "\n", "": "é"}, 0), rows[0]]
    df = spark.createDataFrame(rows, "archive_name string, vec_seq int, feature_id string, feature_type string, properties map<string,string>, value int")
    got = {(r.feature_id, r.prop): r for r in garbled.found(garbled.damaged_values(df)).collect()}
    missed, extra = truth.keys() - got.keys(), got.keys() - truth.keys()
    assert len(missed) <= 0.03 * len(truth) and len(extra) <= 0.03 * len(truth), (missed, extra)
    right = [k for k in truth.keys() & got.keys() if truth[k] is not None and got[k].written == truth[k]]
    assert len(right) >= 0.93 * sum(v is not None for v in truth.values())
    assert garbled.damaged_values(df.limit(0)).count() == 0


def test_often_damaged_value_is_found(spark):
    """60 damaged copies of a text whose 1500 right copies are the only support of its letters."""
    right = "Mûrêtôle fîgée"
    wrong = damage(right, "cp850", "cp1252")
    texts = [right] * 1500 + [wrong] * 60 + [f"{WORDS[k % len(WORDS)]} {WORDS[k * 7 % len(WORDS)]}" for k in range(3000)]
    df = spark.createDataFrame([(f"A{k % 50}", 0, f"O_{k}", "X_id", {"TEX": t}) for k, t in enumerate(texts)], "archive_name string, vec_seq int, feature_id string, feature_type string, properties map<string,string>")
    got = garbled.found(garbled.damaged_values(df)).collect()
    assert {(r.value, r.written) for r in got} == {(wrong, right)} and len(got) == 60


def test_copies_of_a_damaged_value_drop_no_chain():
    right = "Mur d'Noçeonillé"
    wrong = damage(right, "cp850", "cp1252")
    m = garbled.Model()
    m.add([wrong, *WORDS], np.array([400.0] + [1.0] * len(WORDS)))
    batch = pa.RecordBatch.from_pydict({"value": [wrong]})
    rows = [r for b in garbled._options(type("Sent", (), {"value": m.packed()}))(iter([batch])) for r in b.to_pylist()]
    assert rows and right in rows[0]["texts"]
