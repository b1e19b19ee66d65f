import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import narrative, odd_rows
from pyspark.sql import functions as F

from riskloom.llm import toxicity
from riskloom.llm.toxicity import AFFIXES, Chains, Field, features, forward_backward, score_toxicity, train_toxicity, word_labels
from riskloom.llm.words import FOLDED, words_of

INSULTS = ["crook", "swindler", "scoundrel", "thief"]


def reports(count):
    """Alert texts; every third one is escalated and has insults in it."""
    rows, labels = [], []
    for i in range(count):
        words, chooser = narrative(i, 30 + i % 50).split(), random.Random(i)
        bad = i % 3 == 0
        for _ in range(3 if bad else 0):
            words.insert(chooser.randrange(len(words)), chooser.choice(INSULTS))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, bad))
    return rows, labels


def test_forward_backward_sums_all_paths():
    random_numbers = np.random.default_rng(7)
    odds, move = random_numbers.uniform(0.2, 4, (5, 1)), random_numbers.uniform(0.2, 4, (2, 2))
    *_, both = forward_backward(odds, np.ones((5, 1), bool), move)
    totals = np.zeros((5, 2))
    for path in itertools.product((0, 1), repeat=5):
        weight = np.prod([odds[t, 0] ** s for t, s in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
        # before the first word, both states are as likely
        weight *= move[0, path[0]] + move[1, path[0]]
        for t, s in enumerate(path):
            totals[t, s] += weight
    assert np.allclose(both[:, 0], totals[:, 1] / totals[:, 0])


def test_chains_hold_every_word_once():
    first = np.r_[0, np.cumsum([3, 0, 1, 7, 2])]
    words = np.concatenate([w[inside] for w, inside in Chains(first).blocks])
    assert sorted(words) == list(range(13))


def test_held_out_texts(spark, alerts_of):
    rows, labels = reports(240)
    alerts = alerts_of(rows)
    marks = spark.createDataFrame([*labels, (5, None), (None, True)], "alert_id bigint, is_sar boolean")
    model = train_toxicity(alerts, marks, where=F.col("alert_id") % 4 != 0)
    scored = {r["alert_id"]: r for r in score_toxicity(alerts, model).collect()}
    held = [i for i, _ in labels if i % 4 == 0]
    assert np.mean([scored[i]["predicted"] == int(bad) for i, bad in labels if i in held]) >= 0.95
    texts = dict((i, t) for i, t, _ in rows)
    found = [texts[i][s["begin"] : s["stop"]] for i in held for s in scored[i]["spans"]]
    assert found and np.mean([all(w in INSULTS for w in f.split()) for f in found]) > 0.9
    assert scored[0]["score"] != 0.5 and scored[0]["size"] == 7 and scored[0]["_key"] == "x"


def test_odd_rows(spark, alerts_of):
    rows, labels = reports(120)
    model = train_toxicity(alerts_of(rows), spark.createDataFrame(labels, "alert_id bigint, is_sar boolean"))
    odd = odd_rows() + [(60, "ÉÉ crook été thief crook", "a")]
    found = score_toxicity(alerts_of(odd), model).collect()
    assert len(found) == len(odd) and all(0 <= r["score"] <= 1 for r in found)
    blank = {r["score"] for r in found if not (r["alert_type"] or "").strip()}
    assert len(blank) == 1 and all(not r["spans"] for r in found if not (r["alert_type"] or "").strip())
    spans = next(r for r in found if r["alert_id"] == 60)["spans"]
    assert ["ÉÉ crook été thief crook"[s["begin"] : s["stop"]] for s in spans] == ["crook", "thief crook"]


@pytest.mark.parametrize("labels", [[], [(1, True), (2, True)], [(9, False)]])
def test_one_label_or_none(spark, alerts_of, labels):
    marks = spark.createDataFrame(labels, "alert_id bigint, is_sar boolean")
    rows = alerts_of([(1, "a b", "x"), (2, None, "x")])
    scores = [r["score"] for r in score_toxicity(rows, train_toxicity(rows, marks)).collect()]
    assert len(scores) == 2 and all((s > 0.5) == (len(labels) == 2) for s in scores)
    assert score_toxicity(alerts_of([]), Field().packed()).count() == 0


def unknown_words(count, seed=9):
    chooser = random.Random(seed)
    return " ".join("".join(chooser.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(chooser.randrange(3, 10))) for _ in range(count))


def test_length_adds_nothing(spark, alerts_of):
    """Unknown words, however many, leave a clean text clean; an insult among them is found; no score without a span."""
    rows, labels = reports(240)
    model = train_toxicity(alerts_of(rows), spark.createDataFrame(labels, "alert_id bigint, is_sar boolean"))
    clean = [t for i, t, _ in rows if i % 3][:5]
    long = [(1000 + k, t + " " + unknown_words(20_000, k), "a") for k, t in enumerate(clean)]
    long += [(2000 + k, unknown_words(9000, k) + " crook " + unknown_words(11_000, k + 50) + " " + t, "a") for k, t in enumerate(clean)]
    long += [(3000, " ".join(clean * 60), "a")]
    found = {r["alert_id"]: r for r in score_toxicity(alerts_of(rows + long), model).collect()}
    assert all(found[1000 + k]["predicted"] == 0 and found[2000 + k]["predicted"] == 1 for k in range(5))
    assert found[3000]["predicted"] == 0
    assert all(r["spans"] for r in found.values() if r["score"] >= 0.5)


def test_repeats_of_a_form_add_nothing():
    field = Field()
    field.evidence = np.array([1.0, 0.5])
    found = words_of(pa.array(["bad", "bad bad bad bad", "bad worse", "", None]), FOLDED, AFFIXES)
    marginals = np.array([0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.8])
    one, many, two, empty, null = field.document_scores(marginals, found)
    assert one == many < two and empty == null == 0


def test_forms_need_more_texts_than_chance_gives():
    texts = [f"plain words here {'crook' if i % 2 else ''} {'once' if i == 1 else ''}" for i in range(60)]
    found = words_of(pa.array(texts), FOLDED, AFFIXES)
    labels = word_labels(found, features(found), np.array([i % 2 for i in range(60)]), 1.0)
    marked = {found.data[s:e].tobytes().decode() for s, e, x in zip(found.start, found.end, labels) if x}
    assert marked == {"crook"}


def test_score_equals_a_plain_version(spark, alerts_of):
    """Marginals by all labelings of each short text, and the document score from them."""
    rows, labels = reports(90)
    data = train_toxicity(alerts_of(rows), spark.createDataFrame(labels, "alert_id bigint, is_sar boolean"))
    field = Field.unpacked(data)
    texts = ["crook", "cash crook wire", "", "thief crook cash thief swindler", "cash wire split"]
    got = {r["alert_id"]: r for r in score_toxicity(alerts_of([(i, t, "a") for i, t in enumerate(texts)]), data).collect()}
    move = np.exp(field.move)
    for i, text in enumerate(texts):
        found = words_of(pa.array([text]), FOLDED, AFFIXES)
        odds, total = field.odds(features(found)), np.zeros((len(found.hashed), 2))
        for path in itertools.product((0, 1), repeat=len(total)):
            weight = np.prod([o**s for o, s in zip(odds, path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
            weight *= (move[0, path[0]] + move[1, path[0]]) if path else 1
            for t, s in enumerate(path):
                total[t, s] += weight
        chance = total[:, 1] / total.sum(axis=1) if len(total) else np.zeros(0)
        forms = {}
        for word, p in zip(text.split(), chance):
            if p >= 0.5:
                forms[word] = max(forms.get(word, 0), min(np.log(p / (1 - p)), 8.0))
        ranked = [*sorted(forms.values(), reverse=True), 0, 0, 0][:3]
        want = 1 / (1 + np.exp(-(np.array([1, *ranked]) @ field.document))) if forms else 0.98 * chance.max(initial=0)
        assert got[i]["score"] == pytest.approx(want, abs=1e-5), text
        assert sum(len(text[s["begin"] : s["stop"]].split()) for s in got[i]["spans"]) == (chance >= 0.5).sum()


def peak_of(work):
    tracemalloc.start()
    try:
        result = work()
        return result, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_fit_holds_few_bytes_a_word(monkeypatch):
    """The working arrays of the fit: 400,000 words of 2.6 MB."""
    monkeypatch.setattr(toxicity, "ROUNDS", 2)
    texts = [narrative(i, 1000) + (" crook" if i % 2 else "") for i in range(400)]
    field, peak = peak_of(lambda: toxicity.fitted(texts, np.arange(400) % 2, 0.5))
    assert field.weight.shape == (1 << toxicity.FEATURE_BITS,) and field.weight.any()
    assert peak < 150


def test_marginals_without_moves():
    """Scoring asks for no moves; the marginals stay the same, and a slice needs less memory."""
    found = words_of(pa.array([narrative(i, 2000) for i in range(200)]), FOLDED, AFFIXES)
    places, chains, field = features(found), Chains(found.first), Field()
    field.weight[places[:9, 0]] = 3.0
    field.move[:] = [[0.0, -1.0], [0.5, 1.0]]
    (with_moves, moves), most = peak_of(lambda: field.marginals(places, chains))
    (without, none), least = peak_of(lambda: field.marginals(places, chains, moved=False))
    assert (with_moves == without).all() and not none.any()
    # every word but the first of a text is moved to
    assert moves.sum() == pytest.approx(len(places) - 200) and least < most
