"""Measured runs, places of truncation and objects as text, against plain Python."""

import json
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plumbline.operators import measured, truncation
from plumbline.plans.judging import LengthJudge
from plumbline.sources import jsonl

PATH = public_tokenizers.path("byte_bpe_50k.json")
PAIRS = "pair_id string, document string, claim string"


def test_a_run_in_one_job(spark, tmp_path):
    rows = [(f"p{i:03d}", "d" * i, "c" * (i % 7)) for i in range(100)] + [("p999", None, None)]
    told = measured.judged_pairs(spark.createDataFrame(rows, PAIRS).repartition(3), LengthJudge(), ("score",), batch_size=32)
    told = told.selectExpr("*", "if(score > 0.5, 'supported', if(score > 0.1, 'unsupported', 'odd')) pred_label", "score < 0.3 review_flag")
    account = measured.write_results(told, str(tmp_path / "r"), ("supported", "unsupported"), batch_size=32)
    got = {r.pair_id: r for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert len(got) == 101 and all(r.score == (r.document_len * 31 + r.claim_len * 17) % 1001 / 1000 for r in got.values())
    assert [got[f"p{i:03d}"].batch_id for i in (0, 31, 32, 99)] == ["b00001", "b00001", "b00002", "b00004"] and got["p999"].batch_size == 5
    assert account["pairs"] == 101 and account["batches"] == 4 and account["document_chars"] == sum(range(100)) and account["elapsed_seconds"] > 0
    labels = [r.pred_label for r in got.values()]
    assert account["pred_label_counts"] == {"supported": labels.count("supported"), "unsupported": labels.count("unsupported"), "other": labels.count("odd")}
    assert account["score_max"] == max(r.score for r in got.values()) and account["review_pairs"] == sum(r.review_flag for r in got.values())
    timings = {r.batch_id: r for r in measured.batch_timings(spark.read.parquet(str(tmp_path / "r"))).collect()}
    assert {b: r.pair_count for b, r in timings.items()} == {"b00001": 32, "b00002": 32, "b00003": 32, "b00004": 5} and all(r.batch_latency_ms >= 0 for r in timings.values())
    with pytest.raises(FileExistsError):
        measured.write_results(told, str(tmp_path / "r"), ("supported",))


def test_pairs_that_cannot_be_judged(spark):
    with pytest.raises(ValueError, match="duplicate_key: a"):
        measured.judged_pairs(spark.createDataFrame([("a", "x", "y"), ("a", "x", "y")], PAIRS), LengthJudge(), ("score",))
    with pytest.raises(ValueError, match="no key"):
        measured.judged_pairs(spark.createDataFrame([(None, "x", "y")], PAIRS), LengthJudge(), ("score",))
    lazy = lambda: lambda d, c: [(0.5,)]
    with pytest.raises(Exception, match="1 results for 2 pairs"):
        measured.judged_pairs(spark.createDataFrame([("a", "x", "y"), ("b", "x", "y")], PAIRS), lazy, ("score",)).collect()


def test_places_of_truncation(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["word", "é", "naïve", "字字", "x1", "it's"]) for _ in range(rng.randrange(n)))
    docs, claims = [(i, text(rng.choice([6, 60]))) for i in range(40)] + [(40, None), (41, "")], [(i, text(rng.choice([6, 60]))) for i in range(8)]
    pairs = [(d * 100 + c, d, c) for d, _ in docs for c, _ in claims]
    limits = (9, 20, 51)
    make = spark.createDataFrame
    got = truncation.truncation_places(make(pairs, "pair_id int, document_id int, claim_id int"), make(docs, "document_id int, text string"), make(claims, "claim_id int, text string"), PATH, limits, specials=2).collect()
    assert len(got) == len(pairs)
    tok, cut = Tokenizer.from_file(PATH), 0
    for r in got:
        d, c = dict(docs)[r.pair_id // 100] or "", dict(claims)[r.pair_id % 100]
        for limit in limits:
            tok.enable_truncation(limit - 2, strategy="longest_first")
            e = tok.encode(d, c, add_special_tokens=False)
            ends = [max((b for (_, b), s in zip(e.offsets, e.sequence_ids) if s == side), default=0) for side in (0, 1)]
            assert (r[f"document_end_{limit}"], r[f"claim_end_{limit}"], r[f"input_tokens_{limit}"]) == (*ends, len(e.ids) + 2), (d, c, limit)
            cut += r[f"truncated_{limit}"]
    assert cut > 100


def test_objects_as_text(spark, tmp_path):
    values = ["plain é\n", {"b": 1, "a": [1.0, 1e5, 1e-7, -0.0, 12345678901234567890, True, None], "é": {"x": " \"\\/", "": []}}, [], {}, 7, 1.50, None, "", {"n": {"n": {"n": ["x", {"y": 2}]}}}]
    lines = [json.dumps({"source_id": str(i), "task_type": "Data2txt", "source": "s", "source_info": v, "prompt": "p"}, ensure_ascii=bool(i % 2)) for i, v in enumerate(values)]
    lines.append('{ "source_info" : {"question":"q?", "passages" : "passage 1: a"} ,"source_id":99, "source_id" :"9","task_type":"QA","source":"s","prompt":null}')
    (tmp_path / "s.jsonl").write_text("\n\n".join(lines) + "\n")
    got = {r.source_id: r for r in jsonl.read_sources(spark, str(tmp_path / "s.jsonl")).collect()}
    for i, v in enumerate(values):
        assert got[str(i)].source_info.text == (v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)) and got[str(i)].line == i
    assert tuple(got["9"].source_info)[:2] == ("q?", "passage 1: a") and got["9"].prompt is None and got["9"].task_type == "QA"
    (tmp_path / "bad.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="not an object"):
        jsonl.read_sources(spark, str(tmp_path / "bad.jsonl")).collect()


def test_many_texts_are_encoded_slice_by_slice(monkeypatch):
    sizes = []

    class Encoder:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch(self, texts, **kwargs):
            sizes.append((len(texts), sum(len(t.encode()) for t in texts)))
            return self.inner.encode_batch(texts, **kwargs)

    inner = truncation._encoder(PATH)
    monkeypatch.setattr(truncation, "_encoder", lambda path: Encoder(inner))
    texts = [None, "", *("é word " * n for n in (1, 9000, 90000, 3, 50000)), *(["some words"] * 3000)]
    batch = pa.record_batch({"k": list(range(len(texts))), "t": pa.array(texts, pa.string())})
    got = pa.Table.from_batches(truncation._ends(PATH, 20)([batch])).to_pydict()
    assert all(n == 1 or size <= 1 << 19 for n, size in sizes) and len(sizes) == 3
    assert got["k"] == list(range(len(texts)))
    for t, n, ends in zip(texts, got["tokens"], got["ends"]):
        e = inner.encode(t or "", add_special_tokens=False)
        assert n == len(e.ids) and ends == [b for _, b in e.offsets[:20]]
