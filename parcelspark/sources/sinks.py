"""Sinks: GeoJSON collections, delimited rows, and a database over JDBC."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def write_collections(rows: DataFrame, out: str) -> DataFrame:
    """Write (folder, file, epsg, vec_seq, link_pos, json) as ``out``/folder/file.geojson; (file, features) of what was written.

    A task sorts its rows by file and streams them; a file is renamed into place when whole, so a repeated task replaces it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[str, str, object, int] | None = None
        done: list[tuple[str, int]] = []

        def close() -> None:
            if open_:
                at, tmp, f, n = open_
                f.write("]}")
                f.close()
                os.replace(tmp, at)
                done.append((at, n))

        for b in batches:
            for folder, name, epsg, text in zip(*(b.column(c).to_pylist() for c in ("folder", "file", "epsg", "json"))):
                at = os.path.join(out, folder, f"{name}.geojson")
                if open_ is None or open_[0] != at:
                    close()
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    tmp = f"{at}.{uuid.uuid4().hex}"
                    f = open(tmp, "w", encoding="utf-8")  # noqa: SIM115
                    f.write('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::%d"}},"features":[' % epsg)
                    open_ = (at, tmp, f, 0)
                open_[2].write(("," if open_[3] else "") + text)
                open_ = (*open_[:3], open_[3] + 1)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["file", "features"])

    sorted_ = rows.repartition("folder", "file").sortWithinPartitions("folder", "file", "vec_seq", "link_pos")
    return written(sorted_.select("folder", "file", "epsg", "json").mapInArrow(run, "file string, features long"), "collections")


def delimited(df: DataFrame) -> DataFrame:
    """One text column of '|'-separated rows for bulk loading: null is nothing, texts with marks are quoted, quotes doubled."""

    def cell(name: str, kind: str):
        c = F.col(name)
        if kind == "binary":
            return F.coalesce(F.concat(F.lit("\\x"), F.lower(F.hex(c))), F.lit(""))
        t = c.cast("string")
        quoted = F.concat(F.lit('"'), F.regexp_replace(t, '"', '""'), F.lit('"'))
        return F.coalesce(F.when((t == "") | t.rlike(r'[|"\r\n]'), quoted).otherwise(t), F.lit(""))

    return df.select(F.concat_ws("|", *[cell(n, k) for n, k in df.dtypes]).alias("value"))


@dataclass
class Database:
    """Connection of a database sink; unset fields come from the PG* environment variables."""

    host: str = os.environ.get("PGHOST", "localhost")
    port: int = int(os.environ.get("PGPORT", "5432"))
    database: str = os.environ.get("PGDATABASE", "cadastre")
    user: str = os.environ.get("PGUSER", "postgres")
    password: str = os.environ.get("PGPASSWORD", "")
    ssl: str = os.environ.get("PGSSLMODE", "disable")

    def options(self, table: str) -> dict[str, str]:
        return {"url": f"jdbc:postgresql://{self.host}:{self.port}/{self.database}?sslmode={self.ssl}", "dbtable": table, "user": self.user, "password": self.password, "driver": "org.postgresql.Driver", "reWriteBatchedInserts": "true"}

    def write(self, df: DataFrame, table: str, mode: str = "append") -> None:
        """Append rows over JDBC; needs the driver's jar on the cluster. Geometries go as EWKT text."""
        df.write.format("jdbc").options(**self.options(table)).mode(mode).save()
