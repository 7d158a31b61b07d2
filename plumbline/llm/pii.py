"""Personal data by anchors.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
schemes and words that announce an identifier.  From each anchor a local,
deterministic parser finds the boundaries and validates what is between them.
Every parser is linear in what it reads and starts behind what it has read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from plumbline.llm.runtime import per_text

BASE_KINDS = ("email", "ip", "card", "phone")
#: What the method finds besides.
MORE_KINDS = ("url", "iban", "account")
KINDS = BASE_KINDS + MORE_KINDS

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
SCHEMES = ("http://", "https://", "ftp://")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])")
ACCOUNT_CUES = ("account", "passport", "password", "api_key", "apikey", "secret", "token", "ssn")
ACCOUNT = re.compile(r"[ \t]*[=:#][ \t]*[\"']?([A-Za-z0-9_./+-]{6,})|[ \t]+(?:no\.?|number|nr\.?)[ \t]*[:#]?[ \t]*([A-Za-z0-9-]{6,})")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), ("iban", "iban"), *((d, "0") for d in "0123456789"), *((s, "url") for s in SCHEMES), *((w, "account") for w in ACCOUNT_CUES)]:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _iban(text: str) -> bool:
    text = text.replace(" ", "").upper()
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans in code points, ordered by start and kind."""
    spans: list[tuple[int, int, str]] = []
    email = ip = card = phone = url = iban = account = 0  # where the next of the kind can start
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
    for last, (anchor, size) in anchors().iter(lowered):
        at = last - size + 1
        if anchor == "0":
            if at >= card:
                m = CARD.match(text, at)
                card = m.end() if m else at + 1
                if m and 14 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                    spans.append((at, m.end(), "card"))
            if at >= ip:
                m = IP.match(text, at)
                ip = m.end() if m else DIGITS.match(text, at).end()
                if m and all(map(_byte, m[0].split("."))):
                    spans.append((at, m.end(), "ip"))
        elif anchor == "@":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            email = m.end() if m else at + 1
            if m:
                spans.append((start, m.end(), "email"))
        elif anchor == "+":
            m = PHONE.match(text, at) if at >= phone else None
            if m:
                phone = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append((at, m.end(), "phone"))
        elif anchor == "url":
            m = URL.match(text, last + 1) if at >= url else None
            if m:
                url = at + size + len(m[0].rstrip(".,;:!?)]"))
                if url > last + 1:
                    spans.append((at, url, "url"))
        elif anchor == "iban":
            m = re.compile(r"[\s:#.-]{0,3}").match(text, last + 1)
            m = IBAN.match(text, m.end()) if at >= iban else None
            if m and _iban(m[0]):
                iban = m.end()
                spans.append((m.start(), m.end(), "iban"))
        elif at >= account and not (at and text[at - 1].isalnum()):
            m = ACCOUNT.match(text, last + 1)
            if m and any(c.isdigit() for c in m[1] or m[2]):
                g = 1 if m[1] else 2
                account = m.end(g)
                spans.append((m.start(g), account, "account"))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _row(data: bytes | None):
    spans = find(data.decode()) if data else []
    base = [s for s in spans if s[2] in BASE_KINDS]
    return *(sum(s[2] == k for s in base) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, counts of the base kinds, ``base_sha256`` and ``spans`` of every row's whole text.

    Spans are ``kind:start:end`` in code points.  A null or empty text has none;
    repeated rows stay; an empty table gives none.  Other columns are not read.
    """
    return per_text(docs, id_col, text_col, _row, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str | None) -> str | None:
    """``text`` with each span replaced by its kind in brackets; of spans that overlap, the first is named."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in find(text):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])
