"""Archives as a source: .tar.bz2 files to features and errors.

One narrow stage: files are read as binary, untarred, parsed and built in the task that read them; nothing is shuffled.
"""

from __future__ import annotations

import io
import os
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records, text
from ..functions.blake3 import blake3
from ..functions.geometry import GEOM

FEATURES = f"archive_name string, path string, department string, epsg int, year int, vec_seq int, link_pos int, feature_id string, feature_type string, geom {GEOM}, properties map<string,string>"
_PARSED = FEATURES + ", error struct<level:string,code:string,entity_id:string,message:string>, archive boolean, checksum string"


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` (or the file itself) whose name ends in .bz2: path, modificationTime, length. No content is read."""
    glob = "*.bz2" if not path.endswith(".bz2") else "*"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return df.select("path", F.regexp_extract(F.col("path"), "([^/]*)$", 1).alias("archive_name"), "modificationTime", "length")


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``list_archives``, with ``content``; a list names files."""
    glob = "*.bz2" if isinstance(path, str) and not path.endswith(".bz2") else "*"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return df.select("path", F.regexp_extract(F.col("path"), "([^/]*)$", 1).alias("archive_name"), "modificationTime", "length", "content")


def members(content: bytes) -> dict:
    """THF, GEO, QAL (the last of each) and the list of VEC members by their order in the archive."""
    out: dict = {"VEC": []}
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:bz2") as tar:
        for m in tar:
            ext = os.path.splitext(m.name.upper())[1][1:]
            if m.isfile() and ext in ("THF", "GEO", "QAL", "VEC"):
                data = tar.extractfile(m).read()
                if ext == "VEC":
                    out["VEC"].append(data)
                else:
                    out[ext] = data
    for need in ("THF", "GEO", "VEC"):
        if not out.get(need):
            raise records.RecordError("MissingFile", f"no {need} member")
    return out


def parse_archive(content: bytes, types: frozenset[str] | None = None) -> Iterator[tuple[int, int, int, records.Feature | records.RecordError]]:
    """(epsg, year, number of the VEC member, feature or error). ``types``: normalised feature types wanted, None for all."""
    m = members(content)
    codec, year = records.parse_thf(m["THF"])
    epsg, _ = records.parse_geo(m["GEO"])
    quality = records.parse_qal(m.get("QAL", b""))
    for seq, data in enumerate(m["VEC"], 1):
        try:
            vec = records.parse_vec(data.decode(codec, "replace"))
            for f in records.features(vec, quality):
                if isinstance(f, records.RecordError) or types is None or normal(f.kind) in types:
                    yield epsg, year, seq, f
        except Exception as e:  # noqa: BLE001 - a bad VEC costs that file only
            yield epsg, year, seq, records.RecordError("ParseError", f"{type(e).__name__}: {e}")


def normal(kind: str) -> str:
    return kind.strip().upper().removesuffix("_ID")


def _rows(path: str, name: str, content: bytes, types: frozenset[str] | None) -> Iterator[dict]:
    base = {"archive_name": name, "path": path}
    yield base | {"archive": True}
    try:
        for epsg, year, seq, f in parse_archive(content, types):
            row = base | {"epsg": epsg, "year": year, "vec_seq": seq}
            if isinstance(f, records.RecordError):
                yield row | {"error": {"level": "Warning" if f.code == "InvalidGeometry" else "Error", "code": f.code, "entity_id": None, "message": str(f)}}
            else:
                yield row | {"link_pos": f.link, "feature_id": f.id, "feature_type": f.kind, "geom": f.geom, "properties": list(f.properties.items())}
    except records.RecordError as e:
        yield base | {"error": {"level": "Error", "code": e.code, "entity_id": None, "message": str(e)}}
    except Exception as e:  # noqa: BLE001 - an unreadable archive is an error row, not a failed job
        yield base | {"error": {"level": "Error", "code": "InvalidArchive", "entity_id": None, "message": f"{type(e).__name__}: {e}"}}


def parse_files(files: DataFrame, types: frozenset[str] | None = None, department: str | None = None) -> DataFrame:
    """Rows of ``files`` (path, archive_name, content) to features and errors in one table, see ``only_features`` and ``only_errors``.

    Each archive also has a row of its own with ``archive`` true, so that one without features isn't lost, and a column
    ``checksum`` of ``files`` is kept.

    ``department``: a code for all, 'fromFile' to take overseas departments' three digits from the name, None for two.
    """
    schema = pa.schema(
        [("archive_name", pa.string()), ("path", pa.string()), ("epsg", pa.int32()), ("year", pa.int32()), ("vec_seq", pa.int32()), ("link_pos", pa.int32()), ("feature_id", pa.string()), ("feature_type", pa.string()),
         ("geom", pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))])), ("properties", pa.map_(pa.string(), pa.string())),
         ("error", pa.struct([(c, pa.string()) for c in ("level", "code", "entity_id", "message")])), ("archive", pa.bool_()), ("checksum", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, name, content, hashed in zip(*(b.column(c).to_pylist() for c in ("path", "archive_name", "content", "checksum"))):
                rows = []
                for r in _rows(path, name, content, types):
                    rows.append(r | {"checksum": hashed} if hashed else r)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = files if "checksum" in files.columns else files.withColumn("checksum", F.lit(None).cast("string"))
    out = files.select("path", "archive_name", "content", "checksum").mapInArrow(run, _PARSED.replace("department string, ", ""))
    name = F.col("archive_name")
    dep = text.department_from_file(name) if department == "fromFile" else F.lit(department) if department else text.department(name)
    return out.withColumn("department", dep)


def only_features(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull() & F.col("archive").isNull())


def only_errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull())


def checksum(content_column: str = "content"):
    """BLAKE3 of a binary column as hex; computed before anything is unpacked."""

    @F.arrow_udf("string")
    def run(c: pa.Array) -> pa.Array:
        return pa.array([blake3(b.as_py()).hex() if b.is_valid else None for b in c], pa.string())

    return run(F.col(content_column))


def write_archive(path: str, codec: str, year: int, projection: str, vecs: list[str], quality: str = "") -> None:
    """A .tar.bz2 archive of the given texts; for tests and benchmarks."""
    names = {"latin-1": "8859-1", "iso8859-15": "8859-15", "cp1254": "8859-9"}
    parts = [("E.THF", f"CSETCC06:{names.get(codec, codec)}\r\nTDASDP08:{year}0101\r\n".encode()), ("E.GEO", f"RELSACC06:{projection}\r\n".encode())]
    parts += [("E.QAL", quality.encode())] if quality else []
    parts += [(f"E{i}.VEC", v.encode(codec)) for i, v in enumerate(vecs, 1)]
    with tarfile.open(path, "w:bz2") as tar:
        for name, data in parts:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
