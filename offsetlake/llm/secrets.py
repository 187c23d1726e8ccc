"""Secret scans over a trigram index.

Each rule's pattern is parsed into a Boolean query of trigrams that every match
must contain. Texts are taken in blocks; a block's index lists, for each trigram
that some query names, the texts that have it (the text in lower-case A-Z, so that
one index serves rules of either case). Postings are intersected and united as
the query says, and only the candidates see the rule's pattern, which decides. A
rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sliced, table, text_of

BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: Patterns and least lengths of the three base kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Public formats of tokens and keys that name themselves.
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

ANY = ("any",)


def _all(queries) -> tuple:
    """AND, flattened; a query without terms asks for nothing."""
    terms = {t for q in queries if q != ANY for t in (q[1] if q[0] == "and" else (q,))}
    return ANY if not terms else next(iter(terms)) if len(terms) == 1 else ("and", frozenset(terms))


def _one(queries) -> tuple:
    terms = set(queries)
    return ANY if ANY in terms else next(iter(terms)) if len(terms) == 1 else ("or", frozenset(terms))


def _of_strings(strings) -> tuple:
    """One of the strings stands in the text."""
    return _one(_all(("has", s[i : i + 3]) for i in range(len(s) - 2)) if len(s) > 2 else ANY for s in strings) if strings else ANY


class _Pattern:
    """The constructs of patterns that rules use, and what each must contain.

    Letters, escapes, classes, groups (also ``(?:...)``), alternatives, ``.``, ``^`` and
    ``$``, and counts. Anything else is refused, so that no query is derived wrongly.
    """

    SPACE = {"d": "0123456789", "s": " \t\n\r\f\v", "n": "\n", "t": "\t", "r": "\r"}

    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def _peek(self) -> str:
        return self.p[self.at : self.at + 1]

    def _take(self) -> str:
        c = self._peek()
        if not c:
            raise ValueError(f"{self.p!r} ends too early")
        self.at += 1
        return c

    def _escaped(self) -> set[str] | None:
        """The letters an escape stands for; None for a class that is not listed."""
        c = self._take()
        if c == "x":
            self.at += 2
            return {chr(int(self.p[self.at - 2 : self.at], 16))}
        if c in self.SPACE:
            return set(self.SPACE[c])
        if c in "wWDS":
            return None
        if c.isalnum():
            raise ValueError(f"\\{c} in {self.p!r}")
        return {c}

    def _class(self) -> set[str] | None:
        negated = self._peek() == "^"
        self.at += negated
        found: set[str] | None = set()
        first = True
        while first or self._peek() != "]":
            first = False
            c = self._take()
            letters = self._escaped() if c == "\\" else {c}
            if self._peek() == "-" and self.p[self.at + 1 : self.at + 2] not in ("]", "") and letters and len(letters) == 1:
                self._take()
                last = self._take()
                end = self._escaped() if last == "\\" else {last}
                if end is None or len(end) != 1:
                    raise ValueError(f"a range in {self.p!r}")
                letters = set(map(chr, range(ord(letters.pop()), ord(end.pop()) + 1)))
            found = None if letters is None or found is None else found | letters
        self._take()
        return None if negated else found

    def whole(self) -> tuple[set[bytes] | None, tuple]:
        out = self._ways()
        if self.at != len(self.p):
            raise ValueError(f"{self.p!r} has a bracket too many")
        return out

    def _ways(self) -> tuple[set[bytes] | None, tuple]:
        """The strings that alternatives can match, if they are few, and what every match contains."""
        ways = [self._row()]
        while self._peek() == "|":
            self._take()
            ways.append(self._row())
        if len(ways) == 1:
            return ways[0]
        if all(s is not None for s, _ in ways) and sum(len(s) for s, _ in ways) <= 64:
            return set().union(*(s for s, _ in ways)), ANY
        return None, _one(_of_strings(s) if s is not None else q for s, q in ways)

    def _row(self) -> tuple[set[bytes] | None, tuple]:
        run: set[bytes] = {b""}
        found, few = [], True
        while self._peek() not in ("", "|", ")"):
            strings, inner = self._counted(*self._one())
            if strings is not None and len(strings) * len(run) <= 64:
                run = {a + b for a in run for b in strings}
                continue
            found.append(_of_strings(run))
            few = False
            if strings is None:
                found.append(inner)
                run = {b""}
            else:
                run = strings
        return (run, _of_strings(run)) if few else (None, _all([*found, _of_strings(run)]))

    def _one(self) -> tuple[set[bytes] | None, tuple]:
        c = self._take()
        if c == "(":
            if self._peek() == "?":
                if self.p[self.at : self.at + 2] != "?:":
                    raise ValueError(f"a group in {self.p!r}")
                self.at += 2
            out = self._ways()
            if self._take() != ")":
                raise ValueError(f"{self.p!r} lacks a bracket")
            return out
        if c in "^$":
            return {b""}, ANY
        letters = self._class() if c == "[" else self._escaped() if c == "\\" else None if c == "." else {c}
        if letters is None or len(letters) > 8:
            return None, ANY
        return {x.lower().encode() for x in letters}, ANY

    def _counted(self, strings: set[bytes] | None, query: tuple) -> tuple[set[bytes] | None, tuple]:
        c = self._peek()
        least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (1, 1))
        if c and c in "?*+":
            self._take()
        elif c == "{":
            end = self.p.index("}", self.at)
            low, comma, high = self.p[self.at + 1 : end].partition(",")
            least, most = int(low or 0), int(high) if high else None if comma else int(low)
            self.at = end + 1
        else:
            return strings, query
        if self._peek() in ("?", "+"):
            self._take()
        if strings is not None and (least, most) == (0, 1):
            return strings | {b""}, ANY
        if strings is not None and least == most and len(strings) ** least <= 64:
            out = {b""}
            for _ in range(least):
                out = {a + b for a in out for b in strings}
            return out, ANY
        return None, ANY if least == 0 else _of_strings(strings) if strings is not None else query


def trigram_query(rule: Rule) -> tuple:
    """What every match of the rule contains: ``("any",)``, ``("has", trigram)``, ``("and"|"or", queries)``."""
    strings, query = _Pattern(rule.pattern).whole()
    return query if strings is None else _of_strings(strings)


def _terms(query) -> set[bytes]:
    return {query[1]} if query[0] == "has" else set() if query == ANY else set().union(*map(_terms, query[1]))


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r)) for r in rules]
        self.terms = sorted(set().union(*(_terms(q) for _, _, q in self.rules)))
        self.number = np.zeros(1 << 24, np.uint8)  # of a trigram among the terms, from 1
        if len(self.terms) > 255:
            self.number = self.number.astype(np.uint16)
        for i, t in enumerate(self.terms, 1):
            self.number[_code(t)] = i

    def postings(self, raw: list[bytes]) -> dict[bytes, np.ndarray]:
        """For each term, which texts of the block have it."""
        ends = np.cumsum([len(t) + 2 for t in raw])
        flat = np.frombuffer(b"\n\n".join(raw).lower() + b"\n\n", np.uint8)
        a = flat.astype(np.uint32)
        hit = self.number[a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]]
        at = np.flatnonzero(hit)
        has = np.zeros((len(self.terms) + 1, len(raw)), bool)
        has[hit[at], np.searchsorted(ends, at, "right")] = True
        return dict(zip(self.terms, has[1:], strict=True))

    def _ask(self, query, has: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        if query == ANY:
            return np.ones(n, bool)
        if query[0] == "has":
            return has[query[1]]
        found = [self._ask(q, has, n) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(found)

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Spans (kind, start, end) of each text, by start and then by the order of rules."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        first = 0
        while first < len(texts):
            raw, size, last = [], 0, first
            while last < len(texts) and (size < BLOCK_BYTES or last == first):
                raw.append(texts[last].encode())
                size += len(raw[-1])
                last += 1
            has = self.postings(raw)
            for k, (rule, pattern, query) in enumerate(self.rules):
                for i in np.flatnonzero(self._ask(query, has, len(raw))):
                    own = out[first + i]
                    for m in pattern.finditer(texts[first + i]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            own.append((m.start(), k, m.end()))
            first = last
        return [[(self.rules[k][0].kind, s, e) for s, k, e in sorted(own)] for own in out]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Secrets in every whole text: the id column and ``spans`` array<struct<kind, start, end>>.

    Offsets are code points, the end exclusive; spans are in order of start, then
    of the rules. A row for each row of ``docs``; a null text counts as empty and
    has no spans; ids pass through, null or repeated; other columns are not read.
    Nothing is shuffled. A task holds a slice of an Arrow batch (256 rows and 1 MB, or
    one text) and its index.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(rules)
        for b in sliced(batches):
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in own.scan(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, span)], names=["id", "spans"])

    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_column)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
