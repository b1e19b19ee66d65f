import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import odd_rows
from pyspark.sql import functions as F

from riskloom.llm import language
from riskloom.llm.language import codewords, ngram_shares, predict_language, train_language

SYLLABLES = {
    "en": "the ing tion and er ly sh wh",
    "de": "sch ein und ich pf keit zu ä",
    "fr": "eau que le é è ment oi aux",
    "es": "ción ado ll ñ os que ar ez",
}


def written(name, seed, words=20):
    chooser = random.Random(f"{name}{seed}")
    pool = SYLLABLES[name].split()
    return " ".join("".join(chooser.choice(pool) for _ in range(chooser.randint(1, 4))) for _ in range(words)).capitalize() + "."


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, written(name, i), name) for i in range(200) for name in [list(SYLLABLES)[i % 4]]]
    return spark.createDataFrame(rows, "alert_id bigint, alert_type string, language string").repartition(3)


def test_held_out_texts(texts):
    model = train_language(texts, where=F.col("alert_id") % 5 != 0)
    found = predict_language(texts, model).where("alert_id % 5 = 0").collect()
    assert np.mean([r["lang_pred"] == r["language"] for r in found]) >= 0.95
    assert all(0.25 <= r["score"] <= 1 and r["runner_up"] not in (None, r["lang_pred"]) for r in found)


def test_odd_rows(texts, alerts_of):
    model = train_language(texts)
    rows = odd_rows() + [(70, "12 :: 3", "a"), (71, "日本", "a"), (72, "½ ²", "a")]
    found = predict_language(alerts_of(rows), model).collect()
    assert len(found) == len(rows)
    for r in found:
        lettered = any(map(str.isalpha, r["alert_type"] or ""))
        assert (r["lang_pred"] == "und") == (not lettered) and (r["score"] > 0) == lettered
    assert next(r for r in found if r["alert_id"] == 1)["_key"] == "x"


def test_nothing_learnt(texts, alerts_of):
    model = train_language(texts, where=F.lit(False))
    assert {r["lang_pred"] for r in predict_language(texts, model).collect()} == {"und"}
    assert predict_language(alerts_of([]), model).count() == 0
    one = train_language(texts, where=F.col("language") == "en")
    assert {(r["lang_pred"], r["score"]) for r in predict_language(texts, one).collect()} == {("en", 1.0)}


@pytest.mark.parametrize("classes", [1, 2, 3, 4, 5, 6, 40])
def test_codewords_differ(classes):
    code = codewords(classes, 1)
    apart = [(code[i] != code[j]).sum() for i in range(classes) for j in range(i)]
    assert len(code) == classes and min(apart, default=1) >= (1 if classes < 4 else 4)


def test_pieces_of_long_texts_add_up():
    texts = pa.array([written("fr", k, 5 + 300 * (k % 2)) for k in range(9)] + [None, "", "12"])
    whole = ngram_shares(texts)
    parts = list(language.pieces(np.array([0, 10, 10, 2000, 2010]), 500))
    assert [p[2:] for p in parts] == [(0, 2), (2, 3), (2, 3), (2, 3), (2, 3), (3, 4)]
    assert np.allclose((whole**2).sum(axis=1)[:9], 1) and not whole[-3:-1].any()
