"""The language model keeps all it has counted."""

import random

from plumbline.llm import langid


def test_no_four_gram_goes(spark):
    rng = random.Random(5)
    han = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(700_000)) for _ in range(3)]
    few = "zygote quixotic jackdaw"  # each four-gram once
    rows = spark.createDataFrame([(i, "zh", t) for i, t in enumerate(han)] + [(9, "xx", few)], "doc_id long, lang string, text string")
    model = langid.train(rows)
    assert model.langs == ["xx", "zh"] and len(model.grams[-1].hashes) > 2_000_000
    grams = langid.four_grams(langid.characters([few])[0])
    assert (model.grams[-1].find(grams[langid.characters([few])[0][3:] != langid.EDGE]) >= 0).all()
    assert {r.doc_id: r.lang_pred for r in langid.predict(rows, model).collect()} == {0: "zh", 1: "zh", 2: "zh", 9: "xx"}
