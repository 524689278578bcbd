"""The pN_ queries of the text problems, with SQL where it can say the result; tests hold the others against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written
from . import garbled, mixing, packing, spans, tokens


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.found(garbled.damaged_values(table(spark, d, "features"))).select("archive_name", "vec_seq", "feature_id", "prop").distinct()


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    rows = garbled.found(garbled.damaged_values(table(spark, d, "features")))
    return rows.select("archive_name", "vec_seq", "feature_id", "prop", "value", "chain", "written", F.round("damaged", 3).alias("damaged"))


def p2_sources(spark: SparkSession, d: str) -> DataFrame:
    """Damaged values per declared encoding and chain."""
    rows = garbled.found(garbled.damaged_values(table(spark, d, "features")))
    said = table(spark, d, "thf_data").groupBy("archive_name").agg(F.max("encoding").alias("encoding"))
    return rows.join(said, "archive_name", "left").groupBy("encoding", "chain").agg(F.count("*").alias("damaged_values"))


#: Sources that p8_apart and p8_checks keep out of each other's containers: a project and its forks.
APART = (("forge_main", "forge_forks"),)


def _packed(spark: SparkSession, d: str, apart: tuple[tuple[str, str], ...] = ()) -> tuple[DataFrame, int, DataFrame]:
    docs = table(spark, d, "documents")
    capacity = table(spark, d, "containers").filter(F.col("container") == "ctx_4k").first()["capacity_tokens"]
    sizes = tokens.token_sizes(docs)
    if apart:
        sizes = written(sizes, "sizes")
    return packing.packed(sizes, docs.count(), capacity, apart=apart), capacity, sizes


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversize(*_packed(spark, d)[:2])


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0]


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    rows, capacity, _ = _packed(spark, d)
    return packing.fill_report(written(rows, "packed"), capacity)


def p8_apart(spark: SparkSession, d: str) -> DataFrame:
    """As p8_fill, with sources kept apart."""
    rows, capacity, _ = _packed(spark, d, APART)
    return packing.fill_report(written(rows, "packed"), capacity)


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing."""
    rows, capacity, sizes = _packed(spark, d, APART)
    return packing.invariants(sizes, written(rows, "packed"), capacity, APART)


def _mixture(spark: SparkSession, d: str, total: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = written(tokens.token_sizes(table(spark, d, "documents")), "sizes")
    rates = mixing.plan_rates(sizes, table(spark, d, "mix_targets"), total)
    return mixing.mixture(sizes, rates), rates, sizes


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(*_mixture(spark, d)[:2])


def p9_budget(spark: SparkSession, d: str) -> DataFrame:
    """The shares where a plan is to have as many tokens as its sources: small ones come out as too small."""
    return mixing.share_report(*_mixture(spark, d, "listed")[:2])


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a mixture; as p9_budget, where caps are reached."""
    mix, rates, sizes = _mixture(spark, d, "listed")
    mix = written(mix, "mix")
    return mixing.invariants(sizes, mix, written(mixing.share_report(mix, rates), "shares"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(spans.parsed(table(spark, d, "documents")))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return spans.shared_lengths(docs, spans.parsed(docs))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Membership of documents in classes of a span in common, without pairs."""
    return spans.class_report(spans.parsed(table(spark, d, "documents")))


def p10_factors(spark: SparkSession, d: str) -> DataFrame:
    """The factors of each document with their sources."""
    return spans.factors(spans.parsed(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p2_found, p2_repaired, p2_sources, p8_found, p8_packing, p8_fill, p8_apart, p8_checks, p9_mix, p9_shares, p9_budget, p9_checks, p10_found, p10_shared, p10_classes, p10_factors)}

_GRAMS = """g as (select doc_id, i, hash(substr(text, i, 200)) h from (select doc_id, text, unnest(range(1, length(text) - 198)) i from documents where length(text) >= 200)),
k as (select h from g group by h having count(distinct doc_id) > 1), s as (select g.* from g semi join k using (h))"""

#: p8_found: no document is near the limit, so its characters tell on which side it is.
ORACLE = {
    "p8_found": "select doc_id from documents where length(text) > 12000",
    "p8_checks": """select 'documents' as "check", count(*) n from documents union all select unnest(['containers above capacity', 'split though they fit', 'tokens lost or added', 'sources together that are apart']), 0""",
    "p9_checks": """select unnest(['used more often than allowed', 'not a document of its source', 'tokens of a source differ from its documents', 'share differs from the tokens']) as "check", 0 violations""",
    "p10_found": f"with {_GRAMS}, d as (select distinct h, doc_id from s) select distinct a.doc_id doc_id_a, b.doc_id doc_id_b from d a join d b on a.h = b.h and a.doc_id < b.doc_id",
    "p10_shared": f"""with {_GRAMS}, m as (select doc_id, i, lag(i) over (partition by doc_id order by i) p from s),
r as (select *, sum(case when p is null or i > p + 200 then 1 else 0 end) over (partition by doc_id order by i) run from m),
c as (select doc_id, count(*) spans, sum(n) shared_chars from (select doc_id, run, max(i) - min(i) + 200 n from r group by all) group by 1)
select doc_id, coalesce(length(text), 0) n_chars, coalesce(spans, 0) spans, coalesce(shared_chars, 0)::bigint shared_chars, case when length(text) > 0 then coalesce(shared_chars, 0) / length(text) else 0.0 end shared from documents left join c using (doc_id)""",
}
