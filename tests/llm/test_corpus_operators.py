"""The corpus operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import decontam, hostrules, htmltext, langid, mixing, neardup, pii, queries, tokencount, tokenout, warc

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "one", "One two  three\tfour", "<|endoftext|> x", "é ’s 中文 　x", "́a", "a\n\nb \n c", "x " * 5000, "the same", "the same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(ODD, 10_000)]
    odd = spark.createDataFrame([*rows, (None, "no id at all", None, None, None, "c"), (10_000, None, "en", "s", 0, "clash")], "doc_id long, text string, lang string, source string, n_chars long, key string")
    return spark.read.parquet(f"{SF}/documents.parquet").withColumn("key", F.lit("x")).unionByName(odd)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def empty(docs):
    return docs.limit(0)


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text):
    words = ascii_words(ascii_lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(parent)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    return {k: root(k) for k in keys}


def test_simhash_groups(docs, rows):
    got = neardup.near_duplicates(docs).collect()
    prints = [simhash(r.text) for r in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((r.doc_id, f"{p:016x}") for r, p in zip(rows, prints))
    group = components_of(prints)
    low = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            low[group[p]] = min(low.get(group[p], r.doc_id), r.doc_id)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((r.doc_id, low.get(group[p])) for r, p in zip(rows, prints))
    assert neardup.near_duplicates(empty(docs)).count() == 0
    kept = neardup.first_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group.values()))


@pytest.mark.parametrize("block", [1 << 17, 64])
def test_links_find_all(spark, monkeypatch, block):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    near = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for s in seeds for _ in range(30)}
    hub = {seeds[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    prints = near | hub
    monkeypatch.setattr(neardup, "BLOCK", block)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    roots = neardup.components(neardup.links(spark.createDataFrame(signed, "fp long"))).collect()
    want = components_of(sorted(prints))
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in roots}
    together = {}
    for p in prints:
        together.setdefault(want[p], set()).add(got.get(p, p))
    assert all(len(x) == 1 for x in together.values()) and len({next(iter(x)) for x in together.values()}) == len(together)


def test_token_counts_equal_the_library(docs, rows):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        tok = tokencount.load_tokenizer(path)
        size = (lambda t: len(tok.encode(t))) if name.endswith("model") else (lambda t: len(tok.encode(t, add_special_tokens=False).ids))
        want = Counter((r.doc_id, len((r.text or "").encode()), size(r.text or "")) for r in rows)
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(docs, path).collect()) == want


def test_encoder_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(1)
    texts = ["".join(rng.choices(["a", "B", "é", " ", "  ", "\n", "\t", "'s", ".", "12", "\x85", "’", "<|endoftext|>"], k=rng.randint(0, 30))) for _ in range(3000)]
    flat, ends = tokenout.encoder(path, tokenout.rank_table(path))(texts)
    assert [x.tolist() for x in np.split(flat, ends[:-1])] == [e.ids for e in tokencount.load_tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, docs, rows, tmp_path):
    path, tok = public_tokenizers.path("byte_bpe_50k.json"), None
    tok = tokencount.load_tokenizer(path)
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    tokenout.write_ids(known, str(tmp_path / "ids"), path)
    stored = tokenout.read_ids(spark, str(tmp_path / "ids"))
    at, want = 0, []
    for r in sorted(known.collect(), key=lambda r: r.doc_id):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokenout.digest(stored).collect())) == want
    assert tokenout.lookup(spark, str(tmp_path / "ids"), [10_004]).first().n_tokens == 2
    tokenout.write_ids(docs, str(tmp_path / "all"), path)  # null and repeated ids
    assert tokenout.digest(tokenout.read_ids(spark, str(tmp_path / "all"))).count() == len(rows)
    tokenout.write_ids(empty(docs), str(tmp_path / "none"), path)
    assert tokenout.digest(tokenout.read_ids(spark, str(tmp_path / "none"))).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 2000
    data = [(1, "u1", big), (2, "u2", big), (5, "u5", big + "é"), (3, None, big), (4, "u4", "small"), (6, "u6", "small"), (7, "u7", None), (None, "u8", big), (None, "u9", "lone" * 400), (9, "u\r\nX: y", "")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("first", F.lit(1))
    warc.write_archive(pages, str(tmp_path / "w"))
    read = warc.read_archive(spark, str(tmp_path / "w"))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digest(spark, str(tmp_path / "w")).collect())
    want = Counter()
    for i, _, html in data:
        b = (html or "").encode()
        same = [j for j, _, h in data if (h or "") == (html or "") and j is not None]
        revisit = len(b) >= 1000 and same and i != max(same)
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None)] += 1
    assert got == want
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == len({h or "" for _, _, h in data})
    whole = b"".join(bytes(r.record) for r in warc.record_bytes(read).collect())
    assert len(warc.parse_warc(whole)) == len(data)


def test_quality(docs, rows):
    want = Counter()
    for r in rows:
        w = ascii_words(r.text)
        wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if ascii_words(x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want[(r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(hit), failed)] += 1
    got = hostrules.judge(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert hostrules.keep_good(docs).count() == sum(r.kept for r in got)
    assert hostrules.judge(empty(docs)).count() == 0


def test_bad_hosts_go(spark):
    rows = [(i, "bad", "x") for i in range(400)] + [(i, f"h{i % 30}", " ".join(f"w{i}x{j}" for j in range(20))) for i in range(400, 1000)] + [(1000, "bad", " ".join(f"v{j}" for j in range(20)))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r.doc_id for r in hostrules.judge(docs).where("kept").collect()}
    assert kept == set(range(400, 1000))


def test_leaks(spark, docs, rows, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "the SAME"), (901, None), (902, ""), (903, "x x x x x x x x x x x")], "item_id long, text string"))
    items = [(str(r.item_id), re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(r.text))) for r in bench.collect()]
    windows = {}
    for name, w in items:
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(name)
    sizes = {len(k) for k in windows}
    want = Counter()
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(r.text))
        found = [(i, n) for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows]
        names = sorted({x for i, n in found for x in windows[tuple(w[i : i + n])]})
        want[(r.doc_id, len(w), len({j for i, n in found for j in range(i, i + n)}), len(names), hashlib.sha256(",".join(names).encode()).hexdigest())] += 1
    for block in (decontam.BLOCK_WORDS, 200):  # one automaton, and several
        monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
        got = decontam.leak_digest(decontam.find_leaks(docs, bench)).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want
    clean = decontam.remove_leaks(docs, bench)
    assert clean.columns == docs.columns
    assert decontam.leak_digest(decontam.find_leaks(clean, bench)).where("contaminated").count() == 0


def test_mixing(spark, docs):
    counts = mixing.token_rows(docs, public_tokenizers.path("byte_bpe_50k.json"))
    tok = tokencount.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(r.doc_id, r.source, len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert sorted(map(tuple, counts.collect()), key=str) == sorted(want, key=str)
    got = mixing.mix(counts, max_repetition=1.25)
    per = got.groupBy("doc_id").agg(F.count("*").alias("n"))
    assert per.count() == docs.select("doc_id").distinct().count()
    sources = mixing.plan(counts, max_repetition=1.25).collect()
    totals = {r["__src"]: (r.tokens, r.budget) for r in sources}
    assert all(1 - 1e-6 <= b / t <= 1.25 + 1e-6 for t, b in totals.values() if t)
    used = {r[0]: r[1] for r in got.groupBy("source").agg(F.sum("n_tokens")).collect()}
    biggest = max(n for _, _, n in want)
    assert all(0 <= totals[f"={s}"][1] - n <= biggest for s, n in used.items() if s)
    whole = mixing.mix(docs, counts, max_repetition=1.25)
    assert whole.columns == docs.columns
    for other in (whole, mixing.mix(counts.repartition(7), max_repetition=1.25)):
        assert sorted((r.doc_id for r in got.collect()), key=str) == sorted((r.doc_id for r in other.collect()), key=str)
    half = mixing.mix(counts, entropy=2.0, max_repetition=None, budget_tokens=50_000)
    assert abs(half.agg(F.sum("n_tokens")).first()[0] - 50_000) < 25_000
    none = mixing.token_rows(empty(docs), public_tokenizers.path("byte_bpe_50k.json"))
    assert none.count() == mixing.mix(none).count() == mixing.mix(empty(docs), none).count() == 0


def test_main_text():
    page = "<html><head><title>T</title><script>var a='</p>'</script></head><body><header>Top</header><nav><a>m</a></nav><div class=ad>buy</div><article><h1>Head &amp; tail</h1><p>First <b>bold</b> text" + " word" * 40 + "<p>Short.</p><div class='comments'>me too</div><form>f</form></article><aside>s</aside><footer>f</footer></body></html>"
    assert htmltext.main_text(page.encode()) == "Head & tail First bold text" + " word" * 40 + " Short."
    assert htmltext.main_text(None) == htmltext.main_text(b"") == htmltext.main_text(b"<nav>x</nav>") == ""
    assert htmltext.main_text(b"plain  text < 5") == "plain text < 5"
    assert htmltext.main_text(b"<article><p>a</p><p>b") == "a b"


def test_main_text_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in htmltext.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        from html import unescape

        blocks = re.split(r"</?(?:p|h1|br)[^>]*>", inner)
        assert r.text == " ".join(" ".join(" ".join(unescape(re.sub("<[^>]+>", "", b)).split()) for b in blocks).split())


def test_personal_data():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in s.split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    rng = random.Random(2)
    texts = ["".join(rng.choices("aB@@..+-  00123456789()é%", k=rng.randint(5, 60))) for _ in range(20_000)]
    for t in texts:
        want = sorted(((m.start(), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, t) if valid(k, m[0])), key=lambda s: (s[0], pii.KINDS.index(s[2])))
        assert [s for s in pii.find(t) if s[2] in pii.BASE_KINDS] == want
    assert pii.mask("mail a@b.co or https://x.org/y, IBAN DE89370400440532013000") == "mail [email] or [url], IBAN [iban]"
    assert pii.find("a" * 200_000 + "@") == [] and pii.find("1" * 200_000 + ".") == []


def test_languages(spark, docs):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    model = langid.train(docs)
    odd = {r.doc_id: r for r in langid.predict(docs.where("doc_id >= 10000"), model).collect()}
    assert odd[10_000].lang_pred == odd[10_002].lang_pred == "und" and odd[10_000].score == 0 and odd[10_004].lang_pred in model.langs
    assert langid.train(empty(docs)) is None and {r.lang_pred for r in langid.predict(docs.limit(3), None).collect()} == {"und"}
    grams = np.unique(langid.four_grams(langid.characters(["abc abd abe b"])[0]))
    small = langid.fit(["x"], [(grams, np.ones(len(grams), int))])
    context = langid.four_grams(langid.characters(["abc"])[0])[2] & ~np.uint64(0xFFFF)
    alphabet = np.unique(grams & np.uint64(0xFFFF))
    assert np.exp(small.log_probabilities(context | alphabet)).sum() + np.exp(small.log_probabilities(context | np.array([0x7A], np.uint64))).sum() == pytest.approx(1, abs=1e-4)
