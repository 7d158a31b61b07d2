"""Secrets against their definition read position by position, links against all pairs, and weak parts left alone."""

import hashlib
import random
import re
import time

from plumbline.llm import secrets
from plumbline.llm.secrets import Part

CHECKS = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
FORMS = {
    "assign": "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def plain(text):
    """Each kind by trying every place in turn."""
    out = []
    for kind, form in FORMS.items():
        at = 0
        while at < len(text):
            m = re.compile(form).match(text, at)
            if m and CHECKS[kind](m):
                out.append((m.start(), list(FORMS).index(kind), f"{kind}:{m.start()}:{m.end()}"))
            at = m.end() if m else at + 1
    return [x[2] for x in sorted(out)]


def noise(rng):
    words = ["token", "PassWord", "passwd", "secret", "api_key", "apikey", "ſecret", "toKen", " = ", ":", "=", '"', "'", "  ", "\n\n", "\n", "AKIA", "AKIA" + "Q7" * 8, "abcdef0123456789", "deadbeef" * 3, "x", "9", "user=", "bob_1", "host: db.example.org", "https://u:p4ss@h.example.com/x", "é", "Zx81qLm02pRtYw77", "pwd=", "hunter22", "AROA12345678"]
    return "".join(rng.choice(words) for _ in range(rng.randrange(60)))


def test_base_equals_its_definition():
    rng = random.Random(5)
    for _ in range(3000):
        text = noise(rng)
        assert secrets.told(secrets.base_spans(text)) == ",".join(plain(text)), text


def test_links_equal_all_pairs():
    rng = random.Random(6)
    seen = 0
    for _ in range(1500):
        text = noise(rng) + noise(rng)
        base = secrets.base_spans(text)
        parts = base + secrets.weak_spans(text, base)
        reach = rng.choice([0, 5, 40, 200])
        blank = lambda a, b: re.search(r"\n[ \t\r]*\n", text[a.start : b.start + 1])
        want = sorted((a, b) for a in parts for b in parts if secrets.ROLES[b.kind] in secrets.COMPLEMENTS[secrets.ROLES[a.kind]] and a.end <= b.start <= a.end + reach and not blank(a, b))
        assert sorted(secrets.links(text, parts, reach)) == want, text
        seen += len(want)
    assert seen > 1000


def kinds(text):
    base, weak, _ = secrets.find(text)
    return [p.kind for p in sorted(base + weak)]


def test_weak_parts_need_their_complement():
    value = "Zx81qLm02pRtYw77"
    assert kinds(f"build {value} was green") == [] and kinds("log in as user=bob_1 today") == [] and kinds("see https://example.com/a") == []
    assert kinds(f"user=bob_1 and {value}") == ["login", "weak_secret"]
    assert kinds(f"host: db.example.org {value}") == ["endpoint", "weak_secret"]
    assert kinds("https://u_1:p4ss@h.example.com/x") == ["login", "weak_secret"]
    assert kinds(f"user=bob_1\n\n{value}") == [] and kinds("user=bob_1" + " x" * 200 + value) == []
    assert kinds("user=bob_1 token=abcdef") == ["login", "assign"] and kinds("AKIA" + "Q" * 16 + " pwd=hunter22") == ["access", "weak_secret"]
    assert kinds("user=bob_1 host: db.example.org") == []
    assert secrets.redact(f"user=bob_1 {value}!") == "user=[login] [weak_secret]!" and secrets.redact(None) is None


def test_long_texts_take_linear_time():
    for piece in ("token ", "token=", "user=bob_1 pwd=hunter22 ", "a" * 20 + " ", "https://", "AKIA", "passwd  ", "a1" * 12 + "=", "'", "\n\n"):
        began = time.perf_counter()
        secrets.find(piece * (400_000 // len(piece)))
        assert time.perf_counter() - began < 20, piece


def test_tables(spark):
    text = 'é token = "0123456789abcdef01234567"'
    rows = [(1, text, "x"), (1, text, "x"), (2, None, "x"), (None, "", "x"), (3, "user=bob_1 Zx81qLm02pRtYw77", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in secrets.find_secrets(docs).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    strong = "assign:2:35,hex:11:35"
    assert got == sorted([(1, 1, 0, 1, sha(strong), strong)] * 2 + [(2, 0, 0, 0, sha(""), ""), (None, 0, 0, 0, sha(""), ""), (3, 0, 0, 0, sha(""), "login:5:10,weak_secret:11:27")], key=str)
    assert secrets.find_secrets(docs.where("false")).count() == 0
    assert [tuple(r) for r in secrets.credentials(docs).collect()] == [(3, "login:5:10", "weak_secret:11:27")]
    assert Part(1, 2, "hex") < Part(1, 3, "hex")
