"""Text decoded in the wrong charset (problem 2).

A value is seen through a latent chain of (charset written in, charset decoded with) steps, most often none. Undoing a chain
gives the text as it would have been written; a character model of the written text says how likely that is. Expectation-
maximisation runs over cells (value, source, field): each source and field has its own chain probabilities, latent like the
chains, shrunk to those of the source, and these to those of all sources. Every round scores the options of each value under the
model (E), gives each cell the posterior of its options under its source's and field's chains, and counts chains and repaired texts
anew, by their probabilities (M), until no more than a few records move. So weak evidence is pooled across the records of a source
and field, and each record is repaired by its posterior. No option of a value is dropped on the way.

The character model has a fixed size (hashed trigrams), so what each iteration brings to the driver is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import free_shuffles, release, written

#: Single-byte charsets that text is decoded with by mistake, and those that it was written in.
DECODED = ("cp1252", "latin-1", "iso8859-15", "cp850", "cp437", "mac_roman", "cp1250", "iso8859-2", "cp1254", *(f"iso8859-{n}" for n in range(3, 9)))
WRITTEN = ("cp1252", "iso8859-15", "cp850", "cp437", "mac_roman")
#: Texts that went through UTF-8 wrongly may have done so repeatedly.
DEPTH = 3
LOST = "lost"

_TRI, _BI, _UNI = 1 << 22, 1 << 20, 1 << 17


def _byte_table(name: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))  # undefined bytes pass as control characters
    return out


class Codecs:
    """Maps between characters and bytes of the single-byte charsets."""

    def __init__(self) -> None:
        self.chars = {n: _byte_table(n) for n in {*DECODED, *WRITTEN}}
        self.bytes = {n: {c: b for b, c in reversed(list(enumerate(t)))} for n, t in self.chars.items()}
        # single-byte pairs as translation tables of the characters that differ, and the characters they need
        self.pairs: dict[str, tuple[dict[int, str], frozenset[str], frozenset[str]]] = {}
        self.memo: dict[str, dict[str, str]] = {}
        for d in DECODED:
            for w in WRITTEN:
                if w != d:
                    t = {ord(c): self.chars[w][b] for b, c in enumerate(self.chars[d]) if b > 127 and self.chars[w][b] != c}
                    self.pairs[f"{w}>{d}"] = (t, frozenset(map(chr, t)), frozenset(self.chars[d]))
        self.high = {d: re.compile("[" + re.escape("".join(c for b, c in enumerate(self.chars[d]) if 0xC2 <= b <= 0xF4)) + "][" + re.escape("".join(c for b, c in enumerate(self.chars[d]) if 0x80 <= b <= 0xBF)) + "]{1,3}") for d in DECODED}

    def undo_utf8(self, text: str, d: str) -> str:
        """Replace every run of characters whose bytes in ``d`` are UTF-8 sequences; what isn't one stays."""
        table = self.bytes[d]

        def one(m: re.Match) -> str:
            s, out = m.group(), ""
            while s:
                lead = table[s[0]]
                n = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                try:
                    out += bytes(table[c] for c in s[:n]).decode()
                    s = s[n:]
                except (UnicodeDecodeError, KeyError):
                    out += s[0]
                    s = s[1:]
            return out

        return self.high[d].sub(one, text)

    def forms(self, word: str) -> dict[str, str]:
        """Chain -> word as written, for single-byte chains and those with a UTF-8 step before; each word is worked out once."""
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            odd, out = {c for c in word if ord(c) > 127}, {}
            for chain, (table, moved, known) in self.pairs.items():
                if odd and not odd.isdisjoint(moved) and odd <= known:
                    out[chain] = word.translate(table)
            for chain, u in list(out.items()):
                if _RUN.search(u):
                    for d in DECODED:
                        if (v := self.undo_utf8(u, d)) != u:
                            out[f"utf-8>{d}|{chain}"] = v
            self.memo[word] = out
        return self.memo[word]


#: UTF-8 sequences are at least two characters that aren't ASCII.
_RUN = re.compile("[^\x00-\x7f]{2}")
_CONTROL = re.compile("[\x80-\x9f]")


def control(text: str) -> bool:
    """Has C1 control characters, which no one writes; tabs and line ends are text."""
    return _CONTROL.search(text) is not None


#: Leads of UTF-8 whose following byte is a control character in Latin-1 and may have been dropped.
_BARE = re.compile("([ÃÅ])(?![\u0080-¿‐-⁄€ŠšŽžŒœŸƒˆ˜™])")


#: A character that some wrong decoding makes of the first byte of a UTF-8 sequence.
_LEADS = re.compile("[" + re.escape("".join(sorted({bytes([b]).decode(d, "ignore") for d in DECODED for b in range(0xC2, 0xF5)}))) + "]")


def repairs(text: str, codecs: Codecs, better) -> dict[str, str]:
    """Chain -> text as written, for every chain that could have made ``text``. ``better(a, b)``: is word a likelier than b."""
    out: dict[str, str] = {}
    seen: set[str] = set()
    # a no-break space, the second byte of à, may have become a space
    layer = {"": text.replace("Ã ", "Ã\xa0")} if _LEADS.search(text) and ("Ã " in text or _RUN.search(text)) else {}
    for _ in range(DEPTH):
        nxt = {}
        for chain, t in layer.items():
            for d in DECODED:
                u = codecs.undo_utf8(t, d)
                if u != t and u not in nxt.values():
                    nxt[f"{chain}{'|' if chain else ''}utf-8>{d}"] = u
        for chain, u in nxt.items():
            if not control(u) and u not in seen and u != text:
                seen.add(u)
                out[chain] = u
        layer = nxt
    if _BARE.search(text):
        # lead bytes that lost their control character: the likeliest letter of the 32 that it can have been
        for mark, t in (("", text), (",partly", next(iter(out.values()), text))):
            u = t
            while m := _BARE.search(u):  # from left to right, so that the next one sees the letter found
                u = u[: m.start()] + _fill(m, better) + u[m.end() :]
            if u != text and u not in seen:
                seen.add(u)
                out["utf-8>latin-1,dropped" + mark] = u
    words = text.split(" ")
    forms = [codecs.forms(w) for w in words]
    for chain in dict.fromkeys(c for f in forms for c in f):
        every = [f.get(chain, w) for f, w in zip(forms, words)]
        best = [v if v != w and better(v, w) else w for v, w in zip(every, words)]
        for u, mark in ((" ".join(every), ""), (" ".join(best), ",partly")):
            if u != text and u not in seen and not control(u):
                seen.add(u)
                out[chain + mark] = u
    return out


def _fill(m: re.Match, better) -> str:
    base = {"Ã": 0xC0, "Å": 0x140}[m.group(1)]
    s = m.string
    a, b = s.rfind(" ", 0, m.start()) + 1, s.find(" ", m.end())
    head, tail = s[a : m.start()], s[m.end() : b if b >= 0 else len(s)]
    best = None
    for k in range(32):
        c = chr(base + k)
        if c.isalpha() and c not in "ÃÅ" and (best is None or better(head + c + tail, head + best + tail)):
            best = c
    return best


# ------------------------------------------------------------------------------------------------ the model


def _codes(texts: list[str], end: str = "\x03") -> tuple[np.ndarray, np.ndarray]:
    """Hashed (tri, bi, previous, uni) bucket rows of all characters, and the text each belongs to. Digits are one symbol."""
    joined = "".join(f"\x02\x02{t}{end}" for t in texts)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = np.where((c >= 48) & (c <= 57), np.uint64(48), c)
    part = np.repeat(np.arange(len(texts)), [len(t) + 2 + len(end) for t in texts])
    at = np.flatnonzero(c != 2)
    at = at[at >= 2]
    a, b, x = c[at - 2], c[at - 1], c[at]
    mix = lambda v, n: ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(n)
    one = np.uint64(1)
    tri = mix((a << np.uint64(42)) ^ (b << np.uint64(21)) ^ x, _TRI)
    ctx = mix((a << np.uint64(21)) ^ b ^ (one << np.uint64(50)), _BI)
    bi = mix((b << np.uint64(21)) ^ x ^ (one << np.uint64(51)), _BI)
    prev = mix(b ^ (one << np.uint64(52)), _UNI)
    uni = mix(x ^ (one << np.uint64(53)), _UNI)
    return np.stack([tri, ctx, bi, prev, uni]).astype(np.int64), part[at]


_SIZES = (_TRI, _BI, _BI, _UNI, _UNI)


@dataclass
class Model:
    """Weighted counts of hashed trigrams, their contexts, bigrams, their contexts and single characters."""

    counts: list[np.ndarray] = field(default_factory=lambda: [np.zeros(n) for n in _SIZES])

    def packed(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The counts that aren't zero, as plain arrays: what is broadcast is as small as the alphabet's trigrams are few."""
        return [(at := np.flatnonzero(c).astype(np.uint32), c[at]) for c in self.counts]

    @classmethod
    def of(cls, packed: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        m = cls()
        for c, (at, v) in zip(m.counts, packed):
            c[at] = v
        return m

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of words, or of beginnings of words, inside a text."""
        return self.score([f" {w}" for w in words], end="")

    def score(self, texts: list[str], own: np.ndarray | None = None, end: str = "\x03") -> np.ndarray:
        """Log-likelihood of each text. ``own``: weight of the text itself in the counts, which is left out."""
        if not texts:
            return np.zeros(0)
        g, part = _codes(texts, end)
        return self.score_codes(g, part, len(texts), None if own is None else own[part])

    def score_codes(self, g: np.ndarray, part: np.ndarray, n: int, o: np.ndarray | None) -> np.ndarray:
        """As ``score`` for ``n`` texts by their codes; ``o``: weight left out per code, or per bucket row and code."""
        tri, ctx, bi, prev, uni = (self.counts[k][g[k]] for k in range(5))
        if o is not None:
            # sums of doubles in another order: what is left of nothing is no evidence
            tri, ctx, bi, prev, uni = (np.where(v - x > 1e-9 * v, v - x, 0.0) for v, x in zip((tri, ctx, bi, prev, uni), np.broadcast_to(o, g.shape)))
        total = float(self.counts[4].sum()) + 1
        pu = (uni + 0.1) / (total + 100)
        pb = (bi + 2 * pu) / (prev + 2)
        pt = (tri + 4 * pb) / (ctx + 4)
        return np.bincount(part, np.log(pt), n)

    def add(self, texts: list[str], weight: np.ndarray) -> None:
        g, part = _codes(texts)
        w = weight[part]
        for k, n in enumerate(_SIZES):
            self.counts[k] += np.bincount(g[k], w, n)


def posterior(value: str, chains: list[str], prior: dict[str, float], ll: np.ndarray, power: float = 1.0) -> np.ndarray:
    """Probabilities of no damage and of each chain, from log-likelihoods in that order. ``power`` tempers the prior.

    C1 control characters and U+FFFD are in no written text, so those values are damaged for sure.
    """
    known = lambda c: prior.get(c, 0) + 0.1 * prior.get(c.removesuffix(",partly"), 0) + 1e-5
    lp = power * np.log([known(c) for c in ("", *chains)]) + ll
    if control(value) or "\ufffd" in value:
        lp[0] = -1e9
    p = np.exp(lp - lp.max())
    return p / p.sum()


# ------------------------------------------------------------------------------------------------ on tables

_STAT = "part int, name string, bucket int, w double"
#: Log-odds for each UTF-8 sequence found in a text: written characters hardly ever happen to form one.
SEQUENCE = 3.5
#: Options that a word by word score puts this many nats behind the best count nothing in a round; they stay for the next.
MARGIN = 25.0
#: What is less than a billionth of a record is none.
NIL = 1e-9
#: How far the chains' estimated probabilities count in the first rounds. At first evidence decides alone, so that a frequent
#: kind of damage can't pass for spelling.
TEMPER = (0.0, 0.25, 0.5)
#: The rounds end when at most this share of the records, or one record, has moved, and after ``ROUNDS`` in any case.
SETTLED, ROUNDS = 1e-4, 20


def _emit(m: Model, sign: dict[str, float]) -> Iterator[pa.RecordBatch]:
    for k, c in enumerate(m.counts):
        at = np.flatnonzero(c)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.nulls(len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at].astype(float))], names=["part", "name", "bucket", "w"])
    if sign:
        n = len(sign)
        yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int32()), pa.array(list(sign)), pa.array([0] * n, pa.int32()), pa.array(list(sign.values()), pa.float64())], names=["part", "name", "bucket", "w"])


def _gather(stats: DataFrame, base: Model) -> tuple[Model, dict[str, float]]:
    """Sum the tasks' counts. At most the model's fixed number of buckets and one row per chain come to the driver."""
    t = stats.groupBy("part", "name", "bucket").agg(F.sum("w").alias("w")).toArrow()
    part, bucket, w = (t[c].to_numpy() for c in ("part", "bucket", "w"))
    m = Model([c.copy() for c in base.counts])
    for k in range(len(_SIZES)):
        m.counts[k][bucket[part == k]] += w[part == k]
        np.maximum(m.counts[k], 0, out=m.counts[k])
    names = t["name"].to_pylist()
    return m, {names[i]: float(w[i]) for i in np.flatnonzero(part == -1)}


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = Model()
    total = 0.0
    for b in batches:
        n = b.column("n").to_numpy().astype(float)
        total += n.sum()
        for s in range(0, b.num_rows, 2000):
            m.add(b.column("value").slice(s, 2000).to_pylist(), n[s : s + 2000])
    yield from _emit(m, {"": total})


_OPTIONS = "value string, chains array<string>, texts array<string>"


class Words:
    """Scores of words as they stand in a text, each worked out once in a task, many at a time."""

    def __init__(self, m: Model):
        self.m, self.known = m, {}

    def learn(self, words) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > 500_000:
            self.known.clear()
        for s in range(0, len(new), 5000):
            part = new[s : s + 5000]
            self.known.update(zip(part, self.m.words([w + " " for w in part]).tolist()))

    def score(self, word: str) -> float:
        if word not in self.known:
            self.learn([word])
        return self.known[word]

    def texts(self, texts: list[str]) -> np.ndarray:
        split = [t.split(" ") for t in texts]
        self.learn(w for t in split for w in t)
        return np.array([sum(map(self.score, t)) for t in split])


def _options(model):
    """All options of each value that has any, or is damaged for sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs, words = Codecs(), Words(Model.of(model.value))
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                values = b.column("value").slice(s, 1000).to_pylist()
                seen = {w for v in values for w in v.split(" ")}
                words.learn(x for w in seen for x in (w, *codecs.forms(w).values()))
                found = [(v, repairs(v, codecs, lambda x, y: words.score(x) > words.score(y))) for v in values]
                rows = [(v, list(f), list(f.values())) for v, f in found if f or control(v) or "\ufffd" in v]
                if rows:
                    c = list(zip(*rows))
                    types = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, types)], names=["value", "chains", "texts"])

    return run


def _sequences(value: str, chains: list[str], texts: list[str]) -> np.ndarray:
    """What the UTF-8 sequences that each option undoes are worth; the first entry is for no damage."""
    return np.array([0.0, *(SEQUENCE * (len(value) - len(t)) if c.startswith("utf-8") else 0.0 for c, t in zip(chains, texts))])


def _left_out(g: np.ndarray, of: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What the texts of value ``of``, each counting by ``weight``, add to the bucket of each code: per bucket row and code."""
    out = np.empty(g.shape)
    for k in range(len(g)):
        _, at = np.unique(of * _TRI + g[k], return_inverse=True)
        out[k] = np.bincount(at, weight)[at]
    return out


_SCORED = "value string, at array<int>, chains array<string>, ll array<double>"


def _likelihoods(model):
    """The options of each value that count, with their log-likelihoods; the first is the text as it stands.

    A value's own part in the model is left out: one occurrence of the text as it stands, as a text that recurs is evidence for
    itself; exactly what it added to its repairs (``w``, by option), which other values must support."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(model.value)
        words = Words(m)
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                b = whole.slice(s, 1000)
                values, chains, texts, ws = (b.column(c).to_pylist() for c in ("value", "chains", "texts", "w"))
                flat = [t for v, x in zip(values, texts) for t in (v, *x)]
                size = np.array([1 + len(x) for x in texts])
                of, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
                weight = np.zeros(len(flat))
                for k, w in zip(first, ws):
                    weight[k] = 1
                    for i, x in w or []:
                        weight[k + 1 + i] = x
                seq = np.concatenate([_sequences(v, c, t) for v, c, t in zip(values, chains, texts)])
                rough = words.texts(flat) + seq
                keep = (rough >= np.maximum.reduceat(rough, first)[of] - MARGIN) | (weight > 0)
                at = np.flatnonzero(keep)
                g, part = _codes([flat[i] for i in at])
                ll = m.score_codes(g, part, len(at), _left_out(g, of[at][part], weight[at][part])) + seq[at]
                cut = np.searchsorted(of[at], np.arange(len(size) + 1))
                place = at - first[of[at]] - 1
                rows = [(v, place[a + 1 : e].tolist(), [c[i] for i in place[a + 1 : e]], ll[a:e].tolist()) for v, c, a, e in zip(values, chains, cut, cut[1:])]
                c = list(zip(*rows))
                types = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, types)], names=["value", "at", "chains", "ll"])

    return run


def _local(own: dict[str, float], names: list[str], n: int, mass: dict[str, float], above: dict[str, float], alpha: float) -> dict[str, float]:
    """Chain probabilities of a group of ``n`` records, of which one is left out, shrunk to those ``above`` it."""
    n = max(1, n)
    out = {c: (max(0.0, mass.get(c, 0.0) - own.get(c, 0.0)) + alpha * above.get(c, 0.0)) / (n - 1 + alpha) for c in names}
    rest = n - 1 - sum(mass.values()) + sum(own.values())
    return out | {"": (max(0.0, rest) + alpha * above.get("", 0.0)) / (n - 1 + alpha)}


_CELL = "source string, field string, value string, n long, n_sf long, n_s long, own array<struct<chain:string,p:double>>, at array<int>, p array<double>, moved double"


def _posteriors(prior: dict[str, float], power: float, alpha: float):
    """The cells with the probabilities of their options (``p``, the text as it stands first) under their source's and field's chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("value", "n", "n_sf", "n_s", "own", "at", "chains", "ll", "m_sf", "m_s")]
            owns, ats, ps, moved = [], [], [], []
            for v, n, nsf, ns, own, at, chains, ll, msf, ms in zip(*cols):
                before = {x["chain"]: x["p"] for x in own or []}
                names = list(dict.fromkeys([*chains, *(c.removesuffix(",partly") for c in chains)]))
                here = _local(before, names, nsf, dict(msf or []), _local(before, names, ns, dict(ms or []), prior, alpha), alpha) if power else prior
                p = posterior(v, chains, here, np.array(ll), power)
                some = np.flatnonzero(p[1:] > NIL)
                ats.append([at[i] for i in some])
                ps.append([float(p[0]), *p[1:][some].tolist()])
                now: dict[str, float] = {}
                for c, x in zip(chains, p[1:]):
                    now[c] = now.get(c, 0.0) + float(x)
                now = {c: x for c, x in now.items() if x > NIL}
                owns.append([{"chain": c, "p": x} for c, x in now.items()])
                moved.append(n * abs(sum(before.values()) - sum(now.values())))
            names = ["source", "field", "value", "n", "n_sf", "n_s"]
            item = pa.list_(pa.struct([("chain", pa.string()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(owns, item), pa.array(ats, pa.list_(pa.int32())), pa.array(ps, pa.list_(pa.float64())), pa.array(moved, pa.float64())], names=[*names, "own", "at", "p", "moved"])

    return run


def _maximise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The change that the repaired texts make to the first model."""
    delta = Model()
    for whole in batches:
        for s in range(0, whole.num_rows, 1000):
            texts, weight = [], []
            for v, t, w in zip(*(whole.column(x).slice(s, 1000).to_pylist() for x in ("value", "texts", "w"))):
                if w:
                    texts += [v, *(t[i] for i, _ in w)]
                    weight += [-sum(x for _, x in w), *(x for _, x in w)]
            if texts:
                delta.add(texts, np.array(weight))
    yield from _emit(delta, {})


_LETTERS = "".join(c for c in map(chr, range(0xC0, 0x180)) if c.isalpha()) + "’°"


def fill_lost(text: str, model: Model, width: int = 24) -> str:
    """Best guess for each U+FFFD, by the model. The bytes are gone, so no search finds them for sure; ``width`` prefixes are kept."""
    words = text.split(" ")
    for k, w in enumerate(words):
        if "\ufffd" in w:
            beam = [w]
            while "\ufffd" in beam[0]:
                nxt = [b.replace("\ufffd", c, 1) for b in beam for c in _LETTERS]
                # what is still unknown is cut off while prefixes are compared
                after = "\x03" if k == len(words) - 1 else " "
                ll = model.words([x.split("\ufffd")[0] if "\ufffd" in x else x + after for x in nxt])
                beam = [nxt[i] for i in np.argsort(-ll)[:width]]
            words[k] = beam[0]
    return " ".join(words)


_DECIDED = "source string, field string, value string, damaged double, chain string, written string"


def _decide(model):
    """What a cell's values are: the probability of damage, the likeliest chain and the text as written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(model.value)
        for b in batches:
            out = []
            for v, at, p, chains, texts in zip(*(b.column(c).to_pylist() for c in ("value", "at", "p", "chains", "texts"))):
                k = int(np.argmax(p[1:])) if at else -1
                if "\ufffd" in v:
                    out.append((1.0, LOST, fill_lost(texts[at[k]] if k >= 0 and p[1 + k] > 0.5 else v, m)))
                elif k < 0:
                    out.append((1.0 - p[0], LOST, None))
                else:
                    out.append((1.0 - p[0], chains[at[k]], texts[at[k]]))
            c = list(zip(*out)) if out else [[], [], []]
            names = ["source", "field", "value"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(c[0], pa.float64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.string())], names=[*names, "damaged", "chain", "written"])

    return run


def occurrences(features: DataFrame) -> DataFrame:
    """(archive_name, vec_seq, feature_id, prop, value) of the values that aren't null, repeated rows once."""
    return features.select("archive_name", "vec_seq", "feature_id", F.explode("properties").alias("prop", "value")).filter(F.col("value").isNotNull()).distinct()


def damaged_values(features: DataFrame, alpha: float = 20.0) -> DataFrame:
    """Every occurrence that may be damaged: with the probability that it is, the likeliest chain and the text as written.

    ``written`` is a guess where bytes were lost (chain ``lost``), null where there is none. Values that no chain could have
    made, ASCII among them, have no row. Null and empty properties give none. ``alpha``: how many records the prior of all
    sources weighs against a source's own, and a source's against a field's of it.
    """
    spark = features.sparkSession
    cores = max(2, spark.sparkContext.defaultParallelism)
    occ = written(occurrences(features).withColumn("source", F.coalesce("archive_name", F.lit("\x00"))).withColumnRenamed("prop", "field"), "values")
    values = written(occ.groupBy("value").agg(F.count("*").alias("n")), "distinct")
    base, total = _gather(values.mapInArrow(_train, _STAT), Model())
    every = max(1.0, total.get("", 1.0))
    sent = spark.sparkContext.broadcast(base.packed())
    odd = values.filter(F.col("value").rlike(r"[^\x00-\x7F]")).select("value").repartition(2 * cores, "value")
    options = written(odd.mapInArrow(_options(sent), _OPTIONS), "options")
    of_field = occ.groupBy("source", "field").agg(F.count("*").alias("n_sf"))
    of_source = of_field.groupBy("source").agg(F.sum("n_sf").alias("n_s"))
    cells = occ.join(options.select("value"), "value", "left_semi").groupBy("source", "field", "value").agg(F.count("*").alias("n"))
    cells = cells.join(of_field, ["source", "field"]).join(of_source, "source").withColumn("own", F.lit(None).cast("array<struct<chain:string,p:double>>"))
    cells, weighted, prior = written(cells, "cells"), options.withColumn("w", F.lit(None).cast("map<int,double>")), {"": 1.0}
    w_now = None
    entries = lambda c, v: F.map_from_entries(F.collect_list(F.struct(c, v)))
    for k in range(ROUNDS):
        scored = weighted.mapInArrow(_likelihoods(sent), _SCORED)
        mass = cells.select("source", "field", "n", F.explode("own").alias("o")).groupBy("source", "field", F.col("o.chain").alias("chain")).agg(F.sum(F.col("n") * F.col("o.p")).alias("m"))
        by_field = mass.groupBy("source", "field").agg(entries("chain", "m").alias("m_sf"))  # as many entries as there are chains
        by_source = mass.groupBy("source", "chain").agg(F.sum("m").alias("m")).groupBy("source").agg(entries("chain", "m").alias("m_s"))
        state = cells.select("source", "field", "value", "n", "n_sf", "n_s", "own").join(scored, "value").join(by_field, ["source", "field"], "left").join(by_source, "source", "left")
        last = cells
        cells = written(state.mapInArrow(_posteriors(prior, TEMPER[k] if k < len(TEMPER) else 1.0, alpha), _CELL), "cells")
        release(last)  # a round needs the one before only
        shares = cells.select("n", F.explode("own").alias("o")).groupBy("o.chain").agg(F.sum(F.col("n") * F.col("o.p")).alias("m")).collect()  # one row per chain
        prior = {r["chain"]: r["m"] / every for r in shares}
        prior[""] = max(1e-6, 1 - sum(prior.values()))
        moved = cells.agg(F.sum("moved")).first()[0] or 0.0
        if k >= len(TEMPER) and moved <= max(1.0, SETTLED * every):
            break
        w = cells.select("value", "n", F.explode(F.arrays_zip("at", F.slice("p", 2, F.size("at")).alias("q"))).alias("o"))
        w = w.groupBy("value", F.col("o.at").alias("at")).agg(F.sum(F.col("n") * F.col("o.q")).alias("x")).groupBy("value").agg(entries("at", "x").alias("w"))
        w, before = written(w, "weights"), w_now
        w_now, weighted = w, options.join(w, "value", "left")
        model, _ = _gather(options.join(w, "value").mapInArrow(_maximise, _STAT), base)
        release(*([before] if before is not None else []))
        del state, scored, mass, by_field, by_source, last, before
        free_shuffles(spark)
        sent.unpersist()
        sent = spark.sparkContext.broadcast(model.packed())
    decided = cells.select("source", "field", "value", "at", "p").join(options, "value").mapInArrow(_decide(sent), _DECIDED)
    return occ.join(decided, ["source", "field", "value"]).select("archive_name", "vec_seq", "feature_id", F.col("field").alias("prop"), "value", "damaged", "chain", "written")


def found(rows: DataFrame, least: float = 0.5) -> DataFrame:
    return rows.filter(F.col("damaged") >= least)
