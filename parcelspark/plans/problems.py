"""The pN_ queries of the core problems and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, intervals, references, snapshots, spatial
from ..session import table, table_path, written


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spatial.parcel_neighbourhood(table(spark, d, "parcelles"), table(spark, d, "sections"), table(spark, d, "communes"))


def p1_spots(spark: SparkSession, d: str) -> DataFrame:
    return spatial.spot_report(table(spark, d, "parcelles"))


def p1_claims(spark: SparkSession, d: str) -> DataFrame:
    """Per declared commune: located parcels, those the map puts into it, and those it puts only elsewhere or nowhere."""
    parcels = table(spark, d, "parcelles")
    located = written(spatial.current_locations(parcels), "located")
    spots, members = spatial.coded_points(located)
    inside = spatial.with_members(spatial.within(spots, spatial.open_regions(table(spark, d, "communes"), "commune"), spatial.pieces(spots, 50_000)), members, "id_a")
    said = parcels.filter(F.col("valid_to").isNull() & F.col("geometry").isNotNull()).groupBy("id").agg(F.max_by("commune_id", F.struct("valid_from", "row_id")).alias("said"))
    claims = located.select("id").join(said, "id").select(F.col("id").alias("id_a"), "said")
    per = claims.join(inside.select("id_a", "id_b"), "id_a", "left").groupBy("id_a", "said").agg(F.max((F.col("id_b") == F.col("said")).cast("int")).alias("agrees"))
    return per.groupBy("said").agg(F.count("*").alias("located"), F.sum(F.coalesce("agrees", F.lit(0))).alias("agreeing"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    files, ledger = (os.path.join(d, f"{n}.parquet") for n in ("archive_files", "archive_checksums"))
    return incremental.archive_delta(spark, files, ledger, table(spark, d, "import_runs"), table_path(spark, "archives")).select("file_seq").distinct()


def p3_run_takes(spark: SparkSession, d: str) -> DataFrame:
    return incremental.run_takes(table(spark, d, "archive_files"), table(spark, d, "archive_checksums"), table(spark, d, "import_runs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.coverage(table(spark, d, "parcelles"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.history_text(table(spark, d, "parcelles_livraisons"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(table(spark, d, "vec_references"), table(spark, d, "vec_objects")).select("origin", "key_id", "rid").distinct()


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(table(spark, d, "vec_references"), table(spark, d, "vec_objects"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes_text(table(spark, d, "parcelles_livraisons"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "parcelles_livraisons")).groupBy("departement", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), "change").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_spots, p1_claims, p3_found, p3_run_takes, p4_found, p5_found, p6_found, p6_counts, p7_found, p7_counts)}

_CURRENT = """
cur as (select archive_name, file_seq, nullif(lower(regexp_replace(checksum, '^\\s+|\\s+$', '', 'g')), '') c from archive_files
  qualify row_number() over (partition by coalesce(archive_name, 'no name ' || file_seq) order by delivered_at desc nulls last, file_seq desc) = 1),
led as (select a.archive_name, nullif(lower(regexp_replace(a.checksum, '^\\s+|\\s+$', '', 'g')), '') c from archive_checksums a
  where a.run_id in (select run_id from import_runs where status = 'Success')
  qualify row_number() over (partition by a.archive_name order by a.imported_at desc nulls last, a.run_id desc, a.checksum desc) = 1)
"""

_DELIVERED = """
v as (select *, row_number() over (partition by departement order by valid_from) k, lead(valid_from) over (partition by departement order by valid_from) nxt
  from (select departement, valid_from, max(delivery_no) last_no from parcelles_livraisons where valid_from is not null group by all)),
d as (select p.departement, v.k, v.nxt, p.valid_from, upper(regexp_replace(p.id, '^\\s+|\\s+$', '', 'g')) id, p.geometry_hash h, p.contenance c, p.section_id s
  from parcelles_livraisons p join v on p.departement = v.departement and p.valid_from = v.valid_from and p.delivery_no = v.last_no
  where p.geometry_hash is not null and p.id is not null
  qualify row_number() over (partition by p.departement, p.valid_from, upper(regexp_replace(p.id, '^\\s+|\\s+$', '', 'g')) order by p.created_at desc nulls last, p.row_id desc) = 1)
"""

_CHANGES = f"""with {_DELIVERED},
f as (select b.departement, b.id, b.valid_from, case when a.id is null then 'added' else 'changed' end change
  from d b left join d a on a.departement = b.departement and a.id = b.id and a.k = b.k - 1 where b.k > 1 and (a.id is null or a.h <> b.h)
  union all select a.departement, a.id, a.nxt, 'removed' from d a left join d b on a.departement = b.departement and a.id = b.id and b.k = a.k + 1 where a.nxt is not null and b.id is null)
"""

_ORPHANS = """with live as (select distinct archive_name, vec_seq, rty, rid from vec_objects where deleted_at is null),
refs as (select 'reference' origin, ref_id key_id, regexp_replace(rid, '^\\s+|\\s+$', '', 'g') rid, archive_name, vec_seq, rty, loaded_at from vec_references where trim(rty) <> ''
  union all select 'face', obj_id, regexp_replace(a, '^\\s+|\\s+$', '', 'g'), archive_name, vec_seq, 'PAR', loaded_at
  from (select obj_id, unnest(arcs) a, archive_name, vec_seq, loaded_at from vec_objects where rty = 'PFE' and deleted_at is null)),
o as (select distinct origin, key_id, rid, coalesce(strftime(loaded_at, '%Y-%m'), 'none') period from refs r where rid <> '' and not exists
  (select 1 from live l where l.archive_name = r.archive_name and l.vec_seq = r.vec_seq and l.rty = r.rty and l.rid = r.rid))
"""

_NUMBERS = r"list_transform(regexp_extract_all({0}, '[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?'), lambda v: round(v::double * 100)::bigint)"
_BODY = r"regexp_replace(geometry, '(?i)^\s*srid\s*=\s*[0-9]+\s*;', '')"
_POINTS = f"""cur as (select id, commune_id, {_BODY} g from parcelles where valid_to is null and id is not null and geometry like '%(%' qualify row_number() over (partition by id order by valid_from desc nulls last, row_id desc) = 1),
p as (select id, list_min(xs) + list_max(xs) x, list_min(ys) + list_max(ys) y from (select id, list_filter(v, lambda a, i: i % 2 = 1) xs, list_filter(v, lambda a, i: i % 2 = 0) ys from (select id, {_NUMBERS.format('g')} v from cur))),
c as (select *, x // 2400 cx, y // 2400 cy from p),
near as (select a.id id_a, b.id id_b from (select *, cx + i nx, cy + j ny from c, (values (-1), (0), (1)) t(i), (values (-1), (0), (1)) u(j)) a join c b on b.cx = a.nx and b.cy = a.ny and a.id < b.id
  where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2400 * 2400)"""
_INSIDE = f"""r as (select kind, id, row_number() over () k, unnest(regexp_extract_all(g, '\\(([^()]*)\\)', 1)) ring from (select 'section' kind, id, {_BODY} g from sections where valid_to is null and geometry is not null union all select 'commune', id, {_BODY} from communes where valid_to is null and geometry is not null)),
v as (select kind, id, k, list_filter(n, lambda a, i: i % 2 = 1) xs, list_filter(n, lambda a, i: i % 2 = 0) ys from (select kind, id, k, list_transform({_NUMBERS.format('ring')}, lambda a: 2 * a) n from r)),
b as (select k, min(list_min(xs)) x0, max(list_max(xs)) x1, min(list_min(ys)) y0, max(list_max(ys)) y1 from v group by 1),
e as (select kind, id, k, xs[i] ax, ys[i] ay, xs[i + 1] bx, ys[i + 1] by_ from (select *, unnest(range(1, len(xs))) i from v)),
t as (select e.kind, e.id region, p.id, ay, by_, p.y, (bx - ax) * (p.y - ay) - (by_ - ay) * (p.x - ax) side, e.k,
  least(ax, bx) <= p.x and p.x <= greatest(ax, bx) and least(ay, by_) <= p.y and p.y <= greatest(ay, by_) box from b join p on p.x between x0 and x1 and p.y between y0 and y1 join e on e.k = b.k),
inside as (select distinct kind, id id_a, region id_b from t group by kind, id, region, k having count(*) filter ((ay <= y and by_ > y and side > 0) or (by_ <= y and ay > y and side < 0)) % 2 = 1 and count(*) filter (side = 0 and box) = 0)"""

ORACLE = {
    "p1_found": f"with {_POINTS}, {_INSIDE} select 'near' kind, id_a, id_b from near union all select kind, id_a, id_b from inside",
    "p1_spots": f"""with {_POINTS}, s as (select x, y, min(id) spot, count(*) n from p group by all), q as (select *, x // 2400 cx, y // 2400 cy from s),
m as (select a.spot, count(*) spots, sum(b.n) around from (select *, cx + i nx, cy + j ny from q, (values (-1), (0), (1)) t(i), (values (-1), (0), (1)) u(j)) a join q b on b.cx = a.nx and b.cy = a.ny and a.spot <> b.spot where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2400 * 2400 group by 1)
select spot, n parcels, coalesce(spots, 0) spots_near, (coalesce(around, 0) + n - 1)::bigint parcels_near from s left join m using (spot)""",
    "p1_claims": f"""with {_POINTS}, {_INSIDE}, said as (select id, commune_id said from parcelles where valid_to is null and geometry is not null and id is not null qualify row_number() over (partition by id order by valid_from desc nulls last, row_id desc) = 1)
select said, count(*) located, count(*) filter (exists (select 1 from inside where kind = 'commune' and id_a = p.id and id_b = said)) agreeing from p join said using (id) group by 1""",
    "p3_found": f"with {_CURRENT} select distinct file_seq from cur left join led using (archive_name) where cur.c is null or led.c is null or cur.c <> led.c",
    "p3_run_takes": """with ok as (select run_id, finished_at from import_runs where status = 'Success' and finished_at is not null),
f as (select r.run_id, a.archive_name, a.file_seq, nullif(lower(trim(a.checksum)), '') c from import_runs r join archive_files a on a.delivered_at <= r.started_at
  qualify row_number() over (partition by r.run_id, a.archive_name order by a.delivered_at desc, a.file_seq desc) = 1),
l as (select r.run_id, s.archive_name, nullif(lower(trim(s.checksum)), '') c from import_runs r join ok on ok.finished_at <= r.started_at join archive_checksums s on s.run_id = ok.run_id
  qualify row_number() over (partition by r.run_id, s.archive_name order by ok.finished_at desc, s.imported_at desc) = 1)
select distinct f.run_id, f.file_seq, f.archive_name, case when l.archive_name is null then 'added' else 'changed' end as change
from f left join l using (run_id, archive_name) where l.archive_name is null or f.c is null or l.c is null or f.c <> l.c""",
    "p4_found": """with i as (select id, valid_from lo, coalesce(valid_to, date '9999-12-31') hi from parcelles where id is not null and valid_from < coalesce(valid_to, date '9999-12-31')),
m as (select *, max(hi) over (partition by id order by lo, hi rows between unbounded preceding and 1 preceding) top from i),
g as (select *, sum(case when top is null or lo > top then 1 else 0 end) over (partition by id order by lo, hi rows unbounded preceding) n from m),
p as (select id, n, min(lo) lo, max(hi) hi from g group by id, n),
q as (select *, lag(hi) over (partition by id order by lo) before from p),
t as (select id, 'period' kind, lo, hi from q union all select id, 'gap', before, lo from q where before is not null)
select id, kind, strftime(lo, '%Y-%m-%d') date_from, case when hi = date '9999-12-31' then '' else strftime(hi, '%Y-%m-%d') end date_to from t""",
    "p5_found": f"""with {_DELIVERED},
g as (select *, case when lag(k) over w = k - 1 and lag(h) over w = h and lag(c) over w is not distinct from c and lag(s) over w is not distinct from s then 0 else 1 end fresh
  from d window w as (partition by departement, id order by k)),
n as (select *, sum(fresh) over (partition by departement, id order by k rows unbounded preceding) run from g)
select distinct id, strftime(min(valid_from), '%Y-%m-%d') valid_from, coalesce(strftime(arg_max(nxt, k), '%Y-%m-%d'), '') valid_to from
 (select * replace (coalesce(nxt, date '9999-12-31') as nxt) from n) group by departement, id, run""".replace("coalesce(strftime(arg_max(nxt, k), '%Y-%m-%d'), '')", "case when arg_max(nxt, k) = date '9999-12-31' then '' else strftime(arg_max(nxt, k), '%Y-%m-%d') end"),
    "p6_found": _ORPHANS + "select distinct origin, key_id, rid from o",
    "p6_counts": _ORPHANS + "select origin, period, count(*) as orphans from o group by all",
    "p7_found": _CHANGES + "select distinct id, strftime(valid_from, '%Y-%m-%d') valid_from, change from f",
    "p7_counts": _CHANGES + "select departement, strftime(valid_from, '%Y-%m-%d') valid_from, change, count(*) as n from f group by all",
}
