"""Versions of objects: append-only, mark and upsert, close and insert, merging, and questions about them.

Tables have id, valid_from, valid_to, geometry_hash and any other columns. Each operator is a join or window by key; ids with
many versions cost one shuffle row per version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(df: DataFrame, day: Column | str) -> DataFrame:
    """Rows valid on a day: from valid_from up to but not including valid_to; null valid_to is open."""
    d = F.to_date(F.lit(day)) if isinstance(day, str) else day
    return df.filter((F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (F.col("valid_to") > d)))


def active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("valid_to").isNull())


def ended_at(df: DataFrame, day: str) -> DataFrame:
    return df.filter(F.col("valid_to") == F.to_date(F.lit(day)))


def latest(df: DataFrame, *tie: str) -> DataFrame:
    """The row of each id with the greatest valid_from; ``tie`` columns decide between equal ones, greatest first."""
    cols = F.struct(*df.columns)
    return df.groupBy("id").agg(F.max_by(cols, F.struct("valid_from", *tie)).alias("r")).select("r.*")


def known_hashes(df: DataFrame) -> DataFrame:
    """Distinct 32-byte hashes of all history."""
    return df.filter(F.col("geometry_hash").isNotNull() & (F.octet_length("geometry_hash") == 32)).select("geometry_hash").distinct()


def new_by_hash(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose geometry isn't anywhere in the table yet. A row without a hash is new."""
    return incoming.join(known_hashes(existing), "geometry_hash", "left_anti")


def merge_absent(incoming: DataFrame, target: DataFrame, key: tuple[str, ...] = ("departement", "id", "valid_from"), order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``incoming`` whose key isn't in ``target``, one per key: the least by ``order`` (all columns if none is given).

    A null in a key never equals, as in a unique constraint: such rows are all kept.
    """
    whole = incoming.filter(F.expr(" and ".join(f"{k} is not null" for k in key)))
    rest = incoming.filter(F.expr(" or ".join(f"{k} is null" for k in key)))
    plain = [c for c, t in incoming.dtypes if "map" not in t]
    one = whole.groupBy(*key).agg(F.min_by(F.struct(*incoming.columns), F.struct(*(order or plain))).alias("_r")).select("_r.*")
    return one.join(target.select(*key), list(key), "left_anti").select(*incoming.columns).unionByName(rest)


def append_versions(incoming: DataFrame, existing: DataFrame, day: str, hashed: bool = True) -> DataFrame:
    """What an append-only import adds: geometries not seen before, open from ``day``, that the key doesn't have yet."""
    rows = new_by_hash(incoming, existing) if hashed else incoming
    rows = rows.withColumn("valid_from", F.to_date(F.lit(day))).withColumn("valid_to", F.lit(None).cast("date"))
    return merge_absent(rows, existing)


def _actions(current: DataFrame, incoming: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    cur = current.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("geometry_hash").alias("_old"), F.lit(True).alias("_has"))
    on = [incoming[k] == cur[f"_c_{k}"] for k in keys]
    kind = F.when(F.col("_has").isNull(), "Inserted").when(F.col("_old").eqNullSafe(F.col("geometry_hash")), "Unchanged").otherwise("Updated")
    return incoming.join(cur, on, "left").withColumn("action", kind).drop(*[f"_c_{k}" for k in keys], "_old", "_has")


def mark_and_upsert(table: DataFrame, incoming: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """One step of marking: every open row ends at ``day``; ids that come again reopen their latest row, with the new geometry
    in place; new ids open at ``day``. (new table, (id, action)).

    ``incoming`` has one row per id: id, geometry, geometry_hash. History of geometries is not kept, as the name of this way says.
    """
    d = F.to_date(F.lit(day))
    marked = table.withColumn("valid_to", F.coalesce("valid_to", d))
    w = Window.partitionBy("id").orderBy(F.col("valid_from").desc_nulls_last(), F.col("geometry_hash"))
    marked = marked.withColumn("_rn", F.row_number().over(w))
    acts = _actions(marked.filter("_rn = 1"), incoming, ("id",))
    n = acts.select(F.col("id").alias("_id"), F.col("geometry").alias("_g"), F.col("geometry_hash").alias("_h"), "action")
    j = marked.join(n, (marked["id"] == n["_id"]) & (marked["_rn"] == 1), "left")
    again = F.col("action").isNotNull()
    kept = (
        j.withColumn("valid_to", F.when(again, F.lit(None)).otherwise(F.col("valid_to")))
        .withColumn("geometry", F.when(F.col("action") == "Updated", F.col("_g")).otherwise(F.col("geometry")))
        .withColumn("geometry_hash", F.when(F.col("action") == "Updated", F.col("_h")).otherwise(F.col("geometry_hash")))
        .select(*table.columns)
    )
    new = acts.filter("action = 'Inserted'").withColumn("valid_from", d).withColumn("valid_to", F.lit(None).cast("date"))
    missing = [c for c in table.columns if c not in new.columns]
    for c in missing:
        new = new.withColumn(c, F.lit(None).cast(table.schema[c].dataType))
    return kept.unionByName(new.select(*table.columns)), acts.select("id", "action")


def close_and_insert(table: DataFrame, incoming: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """One step of slowly changing history: a changed geometry closes the open row at ``day`` and opens another; new ids open,
    unchanged and vanished ids stay. (new table, (id, action)).

    A row that would have no length (opened and closed on the same day) is dropped, so valid_to is always after valid_from.
    """
    d = F.to_date(F.lit(day))
    acts = _actions(latest(active(table)), incoming, ("id",))
    closed = table.join(acts.filter("action = 'Updated'").select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left")
    closed = closed.withColumn("valid_to", F.when(F.col("_id").isNotNull() & F.col("valid_to").isNull(), d).otherwise(F.col("valid_to")))
    closed = closed.filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")) | F.col("_id").isNull()).select(*table.columns)
    new = acts.filter("action in ('Inserted', 'Updated')").withColumn("valid_from", d).withColumn("valid_to", F.lit(None).cast("date"))
    for c in [c for c in table.columns if c not in new.columns]:
        new = new.withColumn(c, F.lit(None).cast(table.schema[c].dataType))
    return closed.unionByName(new.select(*table.columns)), acts.select("id", "action")


def scd2_history(states: DataFrame, keys: tuple[str, ...], state: str, at: str) -> DataFrame:
    """``close_and_insert`` over many vintages at once: a row per change of ``state``, valid until the next change."""
    w = Window.partitionBy(*keys).orderBy(at)
    changed = states.withColumn("_prev", F.lag(F.struct(F.col(state).alias("s"))).over(w)).filter(F.col("_prev").isNull() | ~F.col("_prev.s").eqNullSafe(F.col(state)))
    return changed.drop("_prev").withColumnRenamed(at, "valid_from").withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from")))


def action_counts(actions: DataFrame, by: str | None = None) -> DataFrame:
    """Entities per action, per ``by`` if given."""
    return actions.groupBy(*([by] if by else []), "action").agg(F.count("*").alias("entities"))


def status(fatal: Column, errors: Column, successes: Column) -> Column:
    """Outcome of an import from its counts."""
    return F.when(fatal > 0, "Failed").when((errors > 0) & (successes > 0), "PartialSuccess").when(errors > 0, "Failed").otherwise("Success")
