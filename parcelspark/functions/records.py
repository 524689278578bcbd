"""Records of the exchange format: texts to entities, and entities of one file to features. Plain Python, no Spark.

A file's links only name objects of the same file, so everything here is local to an archive and needs no shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..operators import topology
from .text import CHARSETS, PROJECTIONS


class RecordError(ValueError):
    """``code`` is one of the error kinds that a report distinguishes."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def lines(text: str) -> Iterator[tuple[str, str]]:
    """(three-letter key, trimmed value after the first colon) of each line that has a colon."""
    for line in text.split("\n"):
        key, colon, value = line.removesuffix("\r").partition(":")
        if colon:
            yield key[:3], value.strip()


def after_colon(text: str, mark: str) -> str | None:
    """The rest of the line after the first colon that follows ``mark``."""
    at = text.find(mark)
    at = text.find(":", at) if at >= 0 else -1
    return None if at < 0 else re.split("[\r\n]", text[at + 1 :], maxsplit=1)[0].strip()


def parse_thf(data: bytes) -> tuple[str, int]:
    """(codec, year)."""
    text = data.decode("latin-1")
    codec = CHARSETS.get((after_colon(text, "CSET") or "").upper(), "iso8859-15")
    year = (after_colon(text, "TDASD") or "")[:4]
    return codec, int(year) if re.fullmatch("[0-9]{4}", year) else 2020


def parse_geo(data: bytes) -> tuple[int, str]:
    """(EPSG code, name of the projection)."""
    text = data.decode("utf-8", "replace")
    name = after_colon(text, "RELSA")
    if name is not None:
        if name.upper() not in PROJECTIONS:
            raise RecordError("UnknownProjection", f"unknown projection {name!r}")
        return PROJECTIONS[name.upper()], name.upper()
    for line in text.split("\n"):  # the first line that has a known name, and in it the first name of the list
        for n, code in PROJECTIONS.items():
            if n in line and f"{n}X" not in line:
                return code, n
    raise RecordError("UnknownProjection", "no projection named")


def blocks(text: str) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """(type, id, lines) of each record that has an id."""
    for block in text.split("RTYSA03:")[1:]:
        kind, _, body = block.partition("\n")
        rest = list(lines(body))
        rid = next((v for k, v in rest if k == "RID"), None)
        if rid is not None:
            yield kind.strip(), rid, rest


@dataclass
class Quality:
    created: str | None = None
    updated: str | None = None
    update_type: str | None = None


def parse_qal(data: bytes) -> dict[str, Quality]:
    out = {}
    for block in data.decode("utf-8", "replace").split("RTYSA03:"):
        rows = block.splitlines()
        if len(rows) < 2 or not rows[0].startswith("QUP"):
            continue
        v = dict(lines("\n".join(rows[2:])))
        parts = rows[1].split(":")
        if len(parts) > 1:
            out[parts[1].strip()] = Quality(v.get("ODA"), v.get("UDA"), v.get("UTY"))
    return out


def parse_reference(value: str) -> tuple[str, str, str, str]:
    p = value.split(";")[:4]
    return tuple(p + [""] * (4 - len(p)))  # type: ignore[return-value]


_FLOAT = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[-+]?(?:inf|nan|infinity)", re.IGNORECASE)


def parse_coordinate(value: str) -> tuple[float, float] | None:
    p = value.split(";")
    if len(p) < 2:
        return None
    x, y = (s.strip().lstrip("+") for s in p[:2])
    return (float(x), float(y)) if _FLOAT.fullmatch(x) and _FLOAT.fullmatch(y) else None


@dataclass
class Business:
    """A FEA record: type from its scheme reference, attributes, and the id of its quality record."""

    kind: str
    attributes: dict[str, str] = field(default_factory=dict)
    quality: str | None = None


@dataclass
class Link:
    scheme: tuple[str, str, str, str]
    members: list[tuple[str, str, str, str]]


@dataclass
class VecFile:
    nodes: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    arcs: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    faces: dict[str, list[list[tuple[float, float]]]] = field(default_factory=dict)
    business: dict[str, Business] = field(default_factory=dict)
    links: dict[str, Link] = field(default_factory=dict)


def _business(rest: list[tuple[str, str]], kind: str) -> Business:
    out, key = Business(kind), None
    for k, v in rest:
        if k == "ATP":
            key = re.sub("(_id)+$", "", parse_reference(v)[3])
        elif k == "ATV" and key is not None:
            out.attributes[key] = v
            key = None
        elif k == "QAP":
            out.quality = parse_reference(v)[3]
    return out


def parse_vec(text: str) -> VecFile:
    """All records of a VEC text. A later record of the same type and id replaces an earlier one. Arcs are put into their
    faces by the links that say so, in order of the links."""
    out = VecFile()
    for kind, rid, rest in blocks(text):
        scheme = next((parse_reference(v) for k, v in reversed(rest) if k == "SCP"), None)
        if kind in ("PNO", "PAR"):
            target = out.nodes if kind == "PNO" else out.arcs
            target[rid] = [c for c in (parse_coordinate(v) for k, v in rest if k == "COR") if c]
        elif kind == "PFE":
            out.faces[rid] = []
        elif kind == "FEA":
            out.business[rid] = _business(rest, scheme[3] if scheme else "UNKNOWN")
        elif kind == "LNK" and scheme:
            out.links[rid] = Link(scheme, [parse_reference(v) for k, v in rest if k == "FTP"])
    for link in out.links.values():
        if "RCO_FAC" in link.scheme[3]:
            arc = next((m[3] for m in link.members if m[2] == "PAR"), None)
            face = next((m[3] for m in link.members if m[2] == "PFE"), None)
            if arc in out.arcs and face in out.faces:
                out.faces[face].append(out.arcs[arc])
    return out


@dataclass
class Feature:
    link: int
    id: str
    kind: str
    geom: dict
    properties: dict[str, str]


def features(vec: VecFile, quality: dict[str, Quality]) -> Iterator[Feature | RecordError]:
    """Features of a file in order of their links. What can't be built comes as an error, what isn't linked doesn't come.

    A link with faces makes polygons, else one with arcs makes lines, else one with nodes makes a point.
    """
    for pos, (lid, link) in enumerate(vec.links.items()):
        if link.scheme[2] != "REL":
            continue
        fid = next((m[3] for m in link.members if m[2] == "FEA"), None)
        fea = vec.business.get(fid)
        if fea is None:
            continue
        refs = {t: [m[3] for m in link.members if m[2] == t] for t in ("PFE", "PAR", "PNO")}
        try:
            if refs["PFE"]:
                geom = topology.polygon([a for f in refs["PFE"] for a in vec.faces.get(f, []) if a])
            elif refs["PAR"]:
                geom = topology.line([vec.arcs.get(a, []) for a in refs["PAR"]], len(refs["PAR"]) == 1)
            elif refs["PNO"]:
                geom = topology.point(vec.nodes.get(refs["PNO"][0], []))
            else:
                continue
        except topology.TopologyError as e:
            yield RecordError("InvalidGeometry", f"{fid} ({lid}): {e}")
            continue
        if geom is None:
            continue
        q = quality.get(fea.quality) if fea.quality else None
        extra = {k: v for k, v in (("createDate", q and q.created), ("updateDate", q and q.updated)) if v}
        yield Feature(pos, fea.attributes.get("IDU") or fid, fea.kind, geom, fea.attributes | extra)


# ------------------------------------------------------------------------------------------------ writing


def write_number(v: float) -> str:
    return f"{v:+.2f}" if math.isfinite(v) else "+0.00"


def write_vec(arcs: dict[str, list[tuple[float, float]]], faces: dict[str, list[str]], business: list[tuple[str, str, dict[str, str], str, list[str]]], nodes: dict[str, tuple[float, float]] | None = None) -> str:
    """A VEC text, the inverse of ``parse_vec``: ``faces`` names the arcs of each, ``business`` is (id, type, attributes, kind of
    the objects it is made of, their ids)."""
    out: list[str] = []

    def record(kind: str, rid: str, *rest: tuple[str, str]) -> None:
        out.extend(f"{k}{len(v):02d}:{v}" for k, v in (("RTYSA", kind), ("RIDSA", rid), *rest))

    coords = lambda cs: [("CORCC", f"{write_number(x)};{write_number(y)};") for x, y in cs]
    for rid, xy in (nodes or {}).items():
        record("PNO", rid, *coords([xy]))
    for rid, cs in arcs.items():
        record("PAR", rid, *coords(cs))
    links: list[tuple[tuple[str, str], ...]] = []
    for rid, names in faces.items():
        record("PFE", rid)
        links += [(("SCPCP", "E;SeSD;ASS;IND_RCO_FAC"), ("FTPCP", f"E;SeSD;PAR;{a}"), ("FTPCP", f"E;SeSD;PFE;{rid}")) for a in names]
    for rid, kind, attributes, made, of in business:
        record("FEA", rid, ("SCPCP", f"E;SeSD;OBJ;{kind}"), *[x for k, v in attributes.items() for x in (("ATPCP", f"E;SeSD;ATT;{k}_id"), ("ATVST", v))])
        links.append((("SCPCP", f"E;SeSD;REL;{kind}_{made}"), ("FTPCP", f"E;SeSD;FEA;{rid}"), *[("FTPCP", f"E;SeSD;{made};{o}") for o in of]))
    for i, rest in enumerate(links, 1):
        record("LNK", f"Lnk_{i}", *rest)
    return "\r\n".join(out) + "\r\n"
