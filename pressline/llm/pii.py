"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are reported exactly as their expressions
and checks find them. Further kinds (iban, national) are reported when checksum
and context together reach a threshold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import id_text, slices

#: Characters before and after a span whose words count as its context.
CONTEXT_CHARS = 60
#: Score that a span of the further kinds needs.
REPORT_SCORE = 0.6

#: Expressions of the base kinds. A look-behind saves scanning a run of digits from each
#: of its places and changes no match; local parts of addresses are found from the sign.
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Further kinds.
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Words that raise the score of a kind when they stand near.
CONTEXT = {
    "email": {"email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt"},
    "ip": {"ip", "address", "host", "server", "login", "adresse"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta", "transfer"},
    "national": {"ssn", "social", "security", "identity", "passport", "ausweis"},
}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national")
#: Score without context, by kind: a checksum is worth more than a shape.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "national": 0.4}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = AT_DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = at = m.end()
        else:
            at += 1


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _by(pattern: re.Pattern, valid: Callable[[str], bool]):
    return lambda text: ((m.start(), m.end()) for m in pattern.finditer(text) if valid(m[0]))


#: Bounded before int(): a run of digits may be very long.
def _octets(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


FINDERS = {
    "email": _emails,
    "ip": _by(IP, _octets),
    "card": _by(CARD, lambda s: 13 <= len(d := _digits(s)) <= 19 and luhn(d)),
    "phone": _by(PHONE, lambda s: 9 <= len(_digits(s)) <= 15),
    "iban": _by(IBAN, lambda s: 15 <= len(c := s.replace(" ", "")) <= 34 and mod97(c)),
    "national": _by(NATIONAL, lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"),
}


def _context(text: str, start: int, end: int, kind: str) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    words = set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", near.lower()))
    return 0.3 if words & CONTEXT[kind] else 0.0


def find(text: str) -> list[Span]:
    """Spans of a text, ends exclusive, by kind and start; base kinds whatever their score."""
    out = []
    for kind in KINDS:
        for start, end in FINDERS[kind](text):
            score = min(1.0, PRIOR[kind] + _context(text, start, end, kind))
            if kind in BASE_KINDS or score >= REPORT_SCORE:
                out.append(Span(kind, start, end, round(score, 2)))
    return out


FOUND = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every whole text; a null or empty text has no spans.

    Repeated rows give repeated results; an empty table gives none; other columns
    are ignored. Every expression takes time in proportion to the text.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in slices(batches):
            spans = [[s.__dict__ for s in find(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return id_text(docs).mapInArrow(run, FOUND)


def digest(spans: list[Span]) -> str:
    """Digest of base spans as ``kind:start:end``, comma-joined."""
    return hashlib.sha256(",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans).encode()).hexdigest()
