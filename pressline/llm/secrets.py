"""Secret scans with multipart credential linking.

Assignments, access keys and long hexadecimal runs are reported as their
expressions find them. Access identifiers, weak secret candidates and endpoints
are intervals within a scope (a paragraph); a weak candidate is reported only
where an interval join finds an identifier and an endpoint, or an access key,
in the same scope, at any distance; the distance lowers its score.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate
from math import inf, log2

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import id_text, slices

#: Expressions of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Parts that only count together.
IDENTIFIER = re.compile(r"\b(?:user(?:name)?|login|client_?id|account|access_?key_?id)\x20{0,8}[:=]\x20{0,8}[\"']?([A-Za-z0-9@._-]{3,})", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"\b(?:https?|ftp|ssh|jdbc|postgres|mysql|redis|mongodb|amqp)://[A-Za-z0-9._:/@-]{3,}")
WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "linked")
#: Characters between the parts of a credential that halve its score.
HALF = 200
#: Bits per character that a weak candidate has at least.
ENTROPY = 3.0


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    #: 1 for base kinds; less for a linked candidate the farther its parts lie.
    score: float = 1.0


def _base(text: str) -> list[Span]:
    out = [Span("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [Span("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [Span("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return out


def _entropy(s: str) -> float:
    return -sum(n / len(s) * log2(n / len(s)) for n in Counter(s).values())


def _weak(text: str):
    for m in WEAK.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and _entropy(s) >= ENTROPY:
            yield m.start(), m.end()


def _scopes(text: str) -> list[int]:
    """Where each scope but the first begins: after an empty line."""
    return [m.end() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]


def _distance(parts: list[tuple[int, int]], starts: list[int], start: int, end: int, low: int, high: int) -> float:
    """Characters from [start, end) to the nearest part of the scope [low, high), infinite without one. Parts are sorted and apart."""
    i = bisect_left(starts, start)
    return min((max(a - end, start - b, 0) for a, b in parts[max(0, i - 1) : i + 1] if low <= a and b <= high), default=inf)


def find(text: str) -> list[Span]:
    """Spans of a text, ends exclusive, by start, then kind."""
    spans = _base(text)
    endpoints = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    identifiers = [(m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
    keys = [(s.start, s.end) for s in spans if s.kind == "access"]
    if keys or endpoints and identifiers:
        cuts = _scopes(text)
        starts = {k: [a for a, _ in v] for k, v in (("e", endpoints), ("i", identifiers), ("k", keys))}
        edges = [0, *cuts, len(text)]
        taken = sorted([(s.start, s.end) for s in spans] + endpoints + identifiers)
        taken_starts, taken_until = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        for start, end in _weak(text):
            at = bisect_left(cuts, start + 1)
            low, high = edges[at], edges[at + 1]
            away = lambda parts, k: _distance(parts, starts[k], start, end, low, high)  # noqa: B023, E731
            i = bisect_left(taken_starts, end)
            covered = i > 0 and taken_until[i - 1] > start
            distance = min(away(keys, "k"), max(away(endpoints, "e"), away(identifiers, "i")))
            if not covered and distance < inf:
                spans.append(Span("linked", start, end, HALF / (HALF + distance)))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every whole text; a null or empty text has no spans.

    Repeated rows give repeated results; an empty table gives none; other columns
    are ignored.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in slices(batches):
            spans = [[s.__dict__ for s in find(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return id_text(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>")
