"""Token files of documents whose ids are no integers, and of none at all."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import tokenout

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_string_ids_come_back(spark, tmp_path):
    texts = {f"doc-{i:04d}": f"text of {i} " * (i % 7) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(4)
    tokenout.write_ids(docs, str(tmp_path / "t"), PATH)
    got = tokenout.digest(tokenout.read_ids(spark, str(tmp_path / "t"))).collect()
    tok, start = Tokenizer.from_file(PATH), 0
    for r in sorted(got, key=lambda r: r.doc_id):
        ids = [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == 300
    found = tokenout.lookup(spark, str(tmp_path / "t"), ["doc-0007", "doc-0299", "none"])
    assert sorted(r.doc_id for r in found.collect()) == ["doc-0007", "doc-0299"]


def test_no_documents_and_other_types(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    for name, part in (("none", docs.where("false")), ("one", docs)):
        tokenout.write_ids(part, str(tmp_path / name), PATH)
        stored = tokenout.read_ids(spark, str(tmp_path / name))
        assert dict(stored.dtypes)["doc_id"] == "int" and tokenout.digest(stored).count() == part.count()
    assert tokenout.digest(stored).agg(F.max("doc_id")).first()[0] == 1
