"""Secret scans through a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived, as
for code search: a text that matches must hold them.  For every block of documents
an inverted index of the queries' trigrams is built, postings are intersected and
united as the queries say, and only the candidates left are verified with the
regular expression.  A rule whose query is empty, such as a run of hex digits, scans
every text.  Blocks are independent, so nothing is shuffled.

Trigrams are of lower-cased ASCII bytes, so that one index serves rules with and
without case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from freightlens.llm import textvec as tv

_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret; of its matches those with at least ``least`` characters in ``group`` count."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 1


#: The kinds that every scan has, in this order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: Kinds that the method adds: formats that public providers and RFCs document.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{16,}=*", re.ASCII | re.IGNORECASE),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{3,100}@"),
)
RULES = BASE + MORE

# A query is True (every text), or ("and" | "or", parts) with trigrams (bytes) among the parts.
Query = bool | bytes | tuple


def _join(op: str, parts: list[Query]) -> Query:
    flat: list[Query] = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == op else [p]
    if op == "or" and any(p is True for p in flat):
        return True
    flat = list(dict.fromkeys(p for p in flat if p is not True))
    return True if not flat else flat[0] if len(flat) == 1 else (op, tuple(flat))


def _needs(strings: set[bytes]) -> Query:
    """The query of a text that holds one of these strings."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


@dataclass
class _Part:
    """What a piece of a pattern says: its exact strings if few, else what it begins and ends with."""

    exact: set[bytes] | None
    prefix: set[bytes]
    suffix: set[bytes]
    match: Query


def _cross(a: set[bytes], b: set[bytes]) -> set[bytes]:
    return {x + y for x in a for y in b}


def _concat(a: _Part, b: _Part) -> _Part:
    match = _join("and", [a.match, b.match])
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= _MOST_STRINGS:
        return _Part(_cross(a.exact, b.exact), set(), set(), match)
    match = _join("and", [match, *(_needs(x.exact) for x in (a, b) if x.exact is not None)])
    left, right = (a.exact if a.exact is not None else a.suffix), (b.exact if b.exact is not None else b.prefix)
    if len(left) * len(right) <= _MOST_STRINGS:
        match = _join("and", [match, _needs(_cross(left, right))])
    prefix = _cross(a.exact, right) if a.exact is not None and len(a.exact) * len(right) <= _MOST_STRINGS else a.exact or a.prefix
    suffix = _cross(left, b.exact) if b.exact is not None and len(left) * len(b.exact) <= _MOST_STRINGS else b.exact or b.suffix
    return _Part(None, {x[:2] for x in prefix}, {x[-2:] for x in suffix}, match)


def _any() -> _Part:
    return _Part(None, {b""}, {b""}, True)


def _of(tree) -> _Part:
    from re import _constants as c

    done = _Part({b""}, set(), set(), True)
    for op, arg in tree:
        if op is c.LITERAL:
            part = _Part({chr(arg).lower().encode()}, set(), set(), True)
        elif op is c.IN and all(o is c.LITERAL for o, _ in arg):
            part = _Part({chr(v).lower().encode() for _, v in arg}, set(), set(), True)
        elif op is c.SUBPATTERN:
            part = _of(arg[-1])
        elif op is c.BRANCH:
            sides = [_of(x) for x in arg[1]]
            if all(x.exact is not None for x in sides) and sum(len(x.exact) for x in sides) <= _MOST_STRINGS:
                part = _Part(set().union(*(x.exact for x in sides)), set(), set(), True)
            else:
                part = _Part(None, {b""}, {b""}, _join("or", [_join("and", [x.match, _needs(x.exact)]) if x.exact is not None else x.match for x in sides]))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            low, high, inner = arg
            one = _of(inner)
            if (low, high) == (0, 1) and one.exact is not None:
                part = _Part(one.exact | {b""}, set(), set(), True)
            elif low == 0:
                part = _any()
            else:
                part = _any()
                for _ in range(min(low, 3)):
                    part = _concat(part, one) if part.exact is not None or part.match is not True or part.prefix != {b""} else one
                if high != low or low > 3:
                    part = _concat(part, _any())
        else:
            part = _any()
        done = _concat(done, part)
    return done


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """What any text that matches must hold, in lower-cased trigrams; True if nothing is sure."""
    from re import _parser

    part = _of(_parser.parse(pattern, flags))
    return _join("and", [part.match, _needs(part.exact)]) if part.exact is not None else part.match


def _trigrams(q: Query) -> set[bytes]:
    return {q} if isinstance(q, bytes) else set() if q is True else set().union(*map(_trigrams, q[1]))


class Index:
    """Postings, as sorted row numbers, of the wanted trigrams in a block of texts."""

    def __init__(self, wanted: list[bytes], data: np.ndarray, row_off: np.ndarray, table: np.ndarray):
        low = tv._LOWER[data].astype(np.int32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.int32)
        at = np.flatnonzero(table[code])
        rows = np.searchsorted(row_off, at, side="right") - 1
        inside = at + 3 <= row_off[rows + 1]
        at, rows = at[inside], rows[inside]
        keys = np.unique(table[code[at]].astype(np.int64) << 32 | rows)
        kind, self.n = keys >> 32, len(row_off) - 1
        cuts = np.searchsorted(kind, np.arange(1, len(wanted) + 2))
        self.post = {t: (keys[cuts[i] : cuts[i + 1]] & 0xFFFFFFFF) for i, t in enumerate(wanted)}

    def rows(self, q: Query) -> np.ndarray:
        if q is True:
            return np.arange(self.n)
        if isinstance(q, bytes):
            return self.post[q]
        got = [self.rows(p) for p in q[1]]
        out = got[0]
        for g in got[1:]:
            out = np.intersect1d(out, g, assume_unique=True) if q[0] == "and" else np.union1d(out, g)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        # a run that must be long is looked for as such; maximal runs of one class are the same either way
        one_class = re.compile(r"\[[^\]]+\]\+")
        self.regex = [re.compile(f"{r.pattern[:-1]}{{{r.least},}}" if one_class.fullmatch(r.pattern) and not r.group else r.pattern, r.flags) for r in rules]
        self.wanted = sorted(set().union(*map(_trigrams, self.queries)))
        self.table = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.wanted):
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i + 1

    def scan(self, col: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Spans (start, rule, end) of each text, in order; code points."""
        data, off = tv.text_buffer(col)
        index = Index(self.wanted, data, off, self.table)
        texts = col.to_pylist()
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query, regex) in enumerate(zip(self.rules, self.queries, self.regex)):
            for row in index.rows(query).tolist():
                for m in regex.finditer(texts[row] or ""):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[row].append((m.start(), k, m.end()))
        return [sorted(x) for x in found]


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document, in ``SCHEMA``; null text is empty, rows are independent.

    Rows with null or equal doc_id are scanned like others; an empty table gives an
    empty result; columns besides doc_id and text are not read.
    """
    tv.bounded_batches(docs.sparkSession)
    base = [r.kind for r in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for b in tv.slices(batches):
            ids, counts, sums, spans = b.column(0), [[], [], []], [], []
            for found in s.scan(b.column(1)):
                named = [(s.rules[k].kind, f"{s.rules[k].kind}:{x}:{y}") for x, k, y in found]
                for k, c in enumerate(counts):
                    c.append(sum(kind == base[k] for kind, _ in named))
                sums.append(hashlib.sha256(",".join(x for kind, x in named if kind in base).encode()).hexdigest())
                spans.append(",".join(x for _, x in named))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in counts], pa.array(sums, pa.string()), pa.array(spans, pa.string())], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents' columns, secrets in text replaced by a mark, n_chars counted anew where it was set."""
    tv.bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for b in tv.slices(batches):
            old, n = b.column(1).to_pylist(), b.column(4).to_pylist()
            new = [redact(t, f) if f else t for t, f in zip(old, s.scan(b.column(1)))]
            n = [len(x) if x is not None and x is not t else c for x, t, c in zip(new, old, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, b.schema.field(1).type), b.column(2), b.column(3), pa.array(n, b.schema.field(4).type)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
