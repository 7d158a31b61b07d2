"""Secrets, and credentials whose parts are told apart.

Strong secrets are found by their own form.  Weak parts, an account's name, a
value that looks drawn at random, a server's address, are each too common to
report.  They are joined as intervals: a part reaches ``REACH`` characters to
either side but not out of its scope (lines up to a blank one), and two parts of
complementary roles, neither within the other, belong together if one reaches
the other.  A weak identifier is
reported with a secret beside it, a weak secret with an identifier or an
endpoint, an endpoint with a secret.

The join sweeps over the parts of a text in the order of their places, so it
takes time in proportion to the parts and links that there are.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.runtime import per_text

BASE_KINDS = ("assign", "access", "hex")
#: What the method finds besides: weak identifiers, weak secrets, endpoints.
MORE_KINDS = ("login", "key_id", "weak_secret", "endpoint")
KINDS = BASE_KINDS + MORE_KINDS
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "login": "identifier", "key_id": "identifier", "weak_secret": "secret", "endpoint": "endpoint"}
#: What a weak part must have beside it.
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}
#: Characters that a part reaches to either side.
REACH = 200
#: Bits a character from which a value looks drawn at random.
MIN_ENTROPY = 3.0

_SEP = r"[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = re.compile(rf"(password|passwd|secret|token|api_?key){_SEP}([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEY_ID = re.compile(r"(?<![A-Z0-9])(?:A[KS]IA|A[GR]OA|AIDA)[A-Z0-9]{8,}")
LOGIN = re.compile(rf"(?<![A-Za-z0-9])(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?){_SEP}([A-Za-z0-9._@+-]{{2,}})", re.A | re.I)
WEAK = re.compile(rf"(?<![A-Za-z0-9])(?:pwd|pass|passphrase|pin|private_?key|access_?token|credentials?|auth|bearer){_SEP}([^\s\"',;<>]{{4,}})", re.A | re.I)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
ADDRESS = re.compile(r"(?:https?|s?ftp|ssh|ldaps?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|s3)://(?:([A-Za-z0-9._%+-]+):([^\s/@\"'<>]+)@)?[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*", re.A)
HOST = re.compile(rf"(?<![A-Za-z0-9])(?:host(?:name)?|server|endpoint|url|dsn){_SEP}((?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+(?::[0-9]+)?|localhost(?::[0-9]+)?)", re.A | re.I)
BLANK = re.compile(r"\n[ \t\r]*\n")


class Part(NamedTuple):
    start: int
    end: int
    kind: str


def base_spans(text: str) -> list[Part]:
    """The strong secrets, leftmost and without overlap within each kind; what fails its rule is passed over whole."""
    found = [Part(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [Part(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [Part(*m.span(), "hex") for m in HEX.finditer(text)]  # the whole runs of hexadecimal digits, as the first match in a run starts it
    return sorted(found, key=lambda p: (p.start, KINDS.index(p.kind)))


def looks_random(value: str) -> bool:
    """Digits and letters mixed, with as many different characters as a drawn value has."""
    kinds = sum(any(c in s for c in value) for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
    if kinds < 2 or not any(c.isdigit() for c in value):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= MIN_ENTROPY


def weak_spans(text: str, base: list[Part]) -> list[Part]:
    """Candidates that are not within a strong secret's span; of those of a role that overlap the first stays."""
    found = [Part(*m.span(), "key_id") for m in KEY_ID.finditer(text)]
    if ":" in text or "=" in text:
        found += [Part(*m.span(1), kind) for kind, cue in (("login", LOGIN), ("weak_secret", WEAK), ("endpoint", HOST)) for m in cue.finditer(text)]
    if "://" in text:
        for m in ADDRESS.finditer(text):
            found.append(Part(*m.span(), "endpoint"))
            if m[1]:
                found += [Part(*m.span(1), "login"), Part(*m.span(2), "weak_secret")]
    found += [Part(*m.span(), "weak_secret") for m in RANDOM.finditer(text) if looks_random(m[0])]
    starts, reach, far = [p.start for p in base], [], 0
    for p in base:
        far = max(far, p.end)
        reach.append(far)
    out: list[Part] = []
    ends = dict.fromkeys(set(ROLES.values()), 0)
    for p in sorted(found, key=lambda p: (p.start, KINDS.index(p.kind), p.end)):
        before = bisect_left(starts, p.end)
        if p.start >= ends[ROLES[p.kind]] and not (before and reach[before - 1] > p.start):
            ends[ROLES[p.kind]] = p.end
            out.append(p)
    return out


def links(text: str, parts: list[Part], reach: int = REACH) -> Iterator[tuple[Part, Part]]:
    """Pairs of parts of complementary roles, the earlier first, that lie in one scope with at most ``reach`` between them.

    A sweep: parts are met by their start, and those that reach no farther are
    let go; a part meets only parts that it is linked with or that have its role.
    """
    cuts = [m.start() for m in BLANK.finditer(text)] if parts else []
    scope = lambda p: bisect_left(cuts, p.start)
    open_: dict[str, list[Part]] = {role: [] for role in COMPLEMENTS}
    for p in sorted(parts, key=lambda p: (p.start, p.end)):
        for role in COMPLEMENTS[ROLES[p.kind]]:
            open_[role] = [q for q in open_[role] if q.end + reach >= p.start and scope(q) == scope(p)]
            yield from ((q, p) for q in open_[role] if q.end <= p.start)
        mine = ROLES[p.kind]
        open_[mine] = [q for q in open_[mine] if q.end + reach >= p.start and scope(q) == scope(p)]
        open_[mine].append(p)


def find(text: str, reach: int = REACH) -> tuple[list[Part], list[Part], list[tuple[Part, Part]]]:
    """Strong spans, weak ones that have what complements them, and the links."""
    base = base_spans(text)
    weak = weak_spans(text, base)
    if not weak and not (base and any(p.kind == "access" for p in base)):
        return base, [], []
    joined = list(links(text, base + weak, reach))
    linked = {p for pair in joined for p in pair}
    return base, [p for p in weak if p in linked], joined


def told(parts: list[Part]) -> str:
    return ",".join(f"{p.kind}:{p.start}:{p.end}" for p in sorted(parts, key=lambda p: (p.start, KINDS.index(p.kind), p.end)))


def _row(data: bytes | None):
    base, weak, _ = find(data.decode()) if data else ([], [], [])
    counts = Counter(p.kind for p in base)
    return *(counts[k] for k in BASE_KINDS), hashlib.sha256(told(base).encode()).hexdigest(), told(base + weak)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, counts of the strong kinds, ``base_sha256`` and ``spans`` of every row's whole text.

    Spans are ``kind:start:end`` in code points.  A null or empty text has none;
    repeated rows stay; an empty table gives none.  Other columns are not read.
    """
    return per_text(docs, id_col, text_col, _row, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _pairs(data: bytes | None):
    return (";".join(f"{told([a])},{told([b])}" for a, b in find(data.decode())[2]) if data else "",)


def credentials(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``first`` and ``second``: a row for each link between two parts, as ``kind:start:end``."""
    rows = per_text(docs, id_col, text_col, _pairs, "links string").where("links <> ''")
    pair = F.split("link", ",")
    return rows.select(id_col, F.explode(F.split("links", ";")).alias("link")).select(id_col, pair[0].alias("first"), pair[1].alias("second"))


def redact(text: str | None) -> str | None:
    """``text`` with each span replaced by its kind in brackets; of spans that overlap the first is named."""
    if text is None:
        return None
    base, weak, _ = find(text)
    out, at = [], 0
    for p in sorted(base + weak, key=lambda p: (p.start, KINDS.index(p.kind))):
        if p.start >= at:
            out += [text[at : p.start], f"[{p.kind}]"]
        at = max(at, p.end)
    return "".join([*out, text[at:]])
