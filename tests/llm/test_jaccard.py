import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import narrative, odd_rows

from riskloom.llm import jaccard
from riskloom.llm.jaccard import Sketches, close, crossing, jaccard_components, least_overlap, least_size, sketches, spanning


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def expected(rows):
    """By all pairs."""
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for (key, _, _), r in zip(rows, root):
        least[r] = min((k for k in (least.get(r), key) if k is not None), default=None)
    return sorted([(key, len(s), least[r]) for (key, _, _), s, r in zip(rows, sets, root)], key=repr)


def edited(text, seed, edits):
    words, chooser = text.split(), random.Random(seed)
    for e in range(edits):
        words[chooser.randrange(len(words))] = f"edit{seed}x{e}"
    return " ".join(words)


def near_copies():
    """Families around the threshold: copies, one to eleven edits, chains, equal sets with other texts."""
    rows, at = [], 100
    for family in range(5):
        base = narrative(500 + family, 150 + 60 * family)
        for seed in range(14):
            rows.append((at, edited(base, at, seed % 12), "a"))
            at += 1
        rows += [(at, base.upper(), "b"), (at + 1, base.replace(" ", "\n"), "b"), (at + 2, base + " " + base, "c")]
        at += 3
        chain = base
        for seed in range(6):
            chain = edited(chain, 1000 + at, 3)
            rows.append((at, chain, "a"))
            at += 1
    rows += [(at + i, t, "a") for i, t in enumerate(["one", "One", "one two", "ONE  two", "two one", "one two three", "one two three four"])]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("small, block, sent", [(8, 20_000, 1 << 20), (2, 7, 3), (30, 20_000, 0)])
def test_components_of_all_pairs(spark, alerts_of, monkeypatch, small, block, sent):
    for name, value in (("SMALL", small), ("BLOCK", block), ("SENT", sent)):
        monkeypatch.setattr(jaccard, name, value)
    rows = odd_rows() + near_copies()
    found = jaccard_components(alerts_of(rows)).collect()
    assert sorted([tuple(r) for r in found], key=repr) == expected(rows)


def test_pairs_refuted_between_components(spark, alerts_of, monkeypatch):
    """Sketches without information: every pair of like sizes is a candidate, most are refuted."""
    monkeypatch.setattr(jaccard, "sketches", lambda sets: [bytes(jaccard.COUNTERS // 8)] * len(sets))
    rows = near_copies()[:60]
    assert sorted([tuple(r) for r in jaccard_components(alerts_of(rows)).collect()], key=repr) == expected(rows)


def test_bounds_are_those_of_the_threshold():
    for s in range(1, 60):
        partners = [(t, o) for t in range(1, s + 1) for o in range(t + 1) if 100 * o >= 90 * (s + t - o)]
        assert min(t for t, _ in partners) == least_size(s)
        for t in range(1, s + 1):
            overlaps = [o for size, o in partners if size == t]
            assert not overlaps or min(overlaps) == least_overlap(s + t) >= least_size(s)


@pytest.mark.parametrize("size", [300, 1990, 2600, 9000])
def test_sketches_never_rule_out_a_link(size):
    chooser = np.random.default_rng(3)
    sets = []

    def fresh(count):
        return chooser.integers(0, 2**63, count, dtype=np.int64).astype(np.uint64)

    for _ in range(12):
        base = np.unique(fresh(size))
        sets += [base, np.unique(np.r_[base[chooser.integers(0, size // 20) :], fresh(size // 25)])]
    column = pa.array(sketches(sets), pa.binary())
    bits = Sketches.read(column.slice(0, 5)).followed_by(Sketches.read(column.slice(5)))
    n, every = np.array([len(s) for s in sets]), range(len(sets))
    linked = [(i, j) for i in every for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))]
    assert len(linked) == 12 and all(close(n, bits, np.array([i]), np.array([j]))[0] for i, j in linked)
    a, b = spanning(n, bits)
    assert sorted(zip(b, a)) == linked and len(crossing(n, bits, np.arange(len(sets)))[0]) == len(linked)
    a, b = spanning(n[3:9], bits[3:9])
    assert sorted(zip(b, a)) == [(2, 1), (4, 3)]


def test_empty(alerts_of):
    assert jaccard_components(alerts_of([])).count() == 0
    assert [tuple(r) for r in jaccard_components(alerts_of([(4, None, "a"), (3, " ", "a"), (None, "", "a")])).orderBy("alert_id").collect()] == [(None, 0, None), (3, 0, 3), (4, 0, 4)]
