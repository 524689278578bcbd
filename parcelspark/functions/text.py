"""Scalar functions on attribute texts and names, as Column expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The projection names of the exchange format and their EPSG codes.
PROJECTIONS = {
    "LAMB93": 2154,
    **{f"RGF93CC{n}": 3900 + n for n in range(42, 51)},
    "GUAD48UTM20": 2970,
    "MART38UTM20": 2973,
    "RGFG95UTM22": 2972,
    "RGR92UTM": 2975,
    "RGM04": 32738,
}

#: Charset by declared name; every other name, and none, is ISO-8859-15.
CHARSETS = {**{f"8859-{n}": f"iso8859-{n}" for n in range(2, 9)}, "8859-9": "cp1254"}

#: Output types of configured columns; unknown names are text.
TYPES: dict[str, T.DataType] = {
    "text": T.StringType(), "varchar": T.StringType(), "integer": T.IntegerType(), "int": T.IntegerType(), "smallint": T.ShortType(), "bigint": T.LongType(),
    "float": T.DoubleType(), "double": T.DoubleType(), "double precision": T.DoubleType(), "boolean": T.BooleanType(), "bool": T.BooleanType(), "date": T.DateType(),
}

_SPACE = r"(?U)^\s+|\s+$"


def trim(c: Column) -> Column:
    """Without outer Unicode white space."""
    return F.regexp_replace(c, _SPACE, "")


def charset(thf: Column) -> Column:
    """The codec that a THF text asks for: the value after the first CSET."""
    said = F.upper(trim(F.regexp_extract(thf, r"CSET[^:]*:([^\r\n]*)", 1)))
    out = F.lit("iso8859-15")
    for name, codec in CHARSETS.items():
        out = F.when(said == name, codec).otherwise(out)
    return out


def thf_year(thf: Column) -> Column:
    """Year of the data, 2020 where the text doesn't say."""
    return F.coalesce(F.regexp_extract(thf, r"TDASD[^:]*:([0-9]{4})", 1).try_cast("int"), F.lit(2020))


def epsg(geo: Column) -> Column:
    """EPSG code of a GEO text, null if it names none that is known.

    The value after the first RELSA and the next colon counts; only without one, the first line that has a known name does, and
    in it the first name of the list.
    """
    name = F.upper(trim(F.regexp_extract(geo, r"RELSA[^:]*:([^\r\n]*)", 1)))
    by_name = F.lit(None).cast("int")
    for n, code in PROJECTIONS.items():
        by_name = F.when(name == n, code).otherwise(by_name)
    in_line = lambda line: F.coalesce(*[F.when(line.contains(n) & ~line.contains(f"{n}X"), code) for n, code in PROJECTIONS.items()])
    anywhere = F.try_element_at(F.filter(F.transform(F.split(geo, "\n"), in_line), lambda c: c.isNotNull()), F.lit(1))
    return F.when(geo.rlike(r"RELSA[^:]*:"), by_name).otherwise(anywhere)


def reference(value: Column) -> Column:
    """struct<sid, gid, rty, rid> of a ';'-separated reference; missing parts are empty, more are dropped."""
    p = F.split(value, ";")
    return F.struct(*[F.coalesce(F.try_element_at(p, F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(("sid", "gid", "rty", "rid"))])


_FLOAT = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"


def scheme_type(vec: Column, rid: Column) -> Column:
    """Type of an object from raw VEC text: fourth part of the first SCPCP within 500 characters after its id, or null."""
    near = vec.substr(F.position(rid, vec), F.lit(500))
    kind = F.regexp_extract(near, r"SCPCP[^:]*:[^;\r\n]*;[^;\r\n]*;[^;\r\n]*;([^;\r\n]*)", 1)
    return F.when((F.position(rid, vec) > 0) & (kind != ""), trim(kind))


def coordinate(value: Column) -> Column:
    """struct<x, y> of 'x;y' with optional leading plus signs and a trailing ';', or null."""
    p = F.split(value, ";")
    num = lambda i: F.regexp_replace(trim(F.try_element_at(p, F.lit(i))), r"^\++", "")
    x, y = num(1), num(2)
    return F.when(x.rlike(_FLOAT) & y.rlike(_FLOAT), F.struct(x.try_cast("double").alias("x"), y.try_cast("double").alias("y")))


def number(value: Column) -> Column:
    """A number as the format writes them: '+1895.' is 1895, '01' is 1. Null if it isn't one."""
    t = F.regexp_replace(F.regexp_replace(trim(value), r"^\++", ""), r"\.$", "")
    return F.when(t.rlike(_FLOAT), t.try_cast("double"))


def integer(value: Column) -> Column:
    """``number`` cut toward zero; null outside bigint."""
    n = number(value)
    return F.when(F.abs(n) < 2.0**63, F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)))


def clean_text(value: Column) -> Column:
    """Missing text is empty, line ends are spaces."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[\r\n]", " ")


def cast_attribute(value: Column, data_type: str) -> Column:
    """A configured column of its type. Dates and booleans that aren't are null."""
    t = TYPES.get(data_type.lower(), T.StringType())
    if isinstance(t, (T.IntegerType, T.ShortType, T.LongType)):
        return integer(value).try_cast(t)
    if isinstance(t, T.DoubleType):
        return number(value)
    if isinstance(t, (T.DateType, T.BooleanType)):
        return trim(value).try_cast(t)
    return clean_text(value)


def department_prefix(value: Column, department: Column, prefix: bool) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(department, value)).otherwise(value) if prefix else value


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", ""), r"\.tar$", "")


def department(name: Column) -> Column:
    """Department of an archive's name, '00' if it has none: the two characters after an upper-case prefix as they are, else
    two digits or 2A/2B after the first dash."""
    s = _stem(name)
    free, strict = F.regexp_extract(s, r"EDIGEO-(..)", 1), F.regexp_extract(s, r"^[^-]*-([0-9]{2}|2[AB])", 1)
    return F.when(free != "", free).when(strict != "", strict).otherwise("00")


def department_from_file(name: Column) -> Column:
    """As ``department``, with the third digit of overseas departments, for lower-case names."""
    s = F.regexp_extract(F.regexp_extract(name, r"([^/]*)$", 1), r"^edigeo-(2[AB]|9[78][0-9]|[0-9]{2})", 1)
    return F.when(s != "", s).otherwise(department(name))


def basename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.(tar\.bz2|bz2|tar)$", "")


def normal_type(feature_type: Column) -> Column:
    """A feature type without case, blanks and the suffix _ID, as routing compares them."""
    return F.regexp_replace(F.upper(trim(feature_type)), "_ID$", "")


def legacy_table(feature_type: Column) -> Column:
    """Table of a feature type by the first name that it contains, parcelles for all others."""
    t = F.upper(feature_type)
    out = None
    for part, name in (("PARCELLE", "parcelles"), ("SECTION", "sections"), ("COMMUNE", "communes"), ("BATI", "batiments"), ("LIEU", "lieux_dits"), ("SUBDFISC", "subdivisions_fiscales")):
        out = F.when(t.contains(part), name) if out is None else out.when(t.contains(part), name)
    return out.otherwise("parcelles")


def vintage(text: str) -> str:
    """First day of a month given as yyyy-MM, between 1900 and 2100; anything else is an error."""
    m = re.fullmatch(r"([0-9]{4})-([0-9]{2})", text)
    if not m or not 1900 <= int(m[1]) <= 2100 or not 1 <= int(m[2]) <= 12:
        raise ValueError(f"a vintage is written yyyy-MM, not {text!r}")
    return f"{text}-01"
