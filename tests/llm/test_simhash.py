import re

import numpy as np
import pytest
import xxhash
from conftest_llm import narrative, odd_rows

from riskloom.llm import simhash
from riskloom.llm.components import components
from riskloom.llm.simhash import Golay, bucket_keys, forest, near_duplicates, near_links


def fingerprint(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    """Smallest index reachable, by all pairs."""
    root = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4 and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def test_golay_lists():
    golay = Golay()
    random = np.random.default_rng(1)
    words = random.integers(0, 1 << 23, 300).astype(np.uint32)
    codewords = np.flatnonzero(golay.remainder == 0).astype(np.uint32)
    assert len(codewords) == 4096
    indices, valid = golay.near(words)
    for word, row, ok in zip(words, indices, valid):
        near = codewords[np.bitwise_count(codewords ^ word) <= 4] >> 11
        assert sorted(row[ok].tolist()) == sorted(near.tolist())


@pytest.mark.parametrize("errors", [(4, 0, 0), (0, 4, 0), (0, 0, 4), (2, 2, 0), (2, 1, 1), (1, 2, 1), (1, 1, 2), (1, 3, 0), (0, 1, 3), (1, 1, 1), (3, 0, 1)])
def test_close_fingerprints_share_a_bucket(errors):
    random, golay = np.random.default_rng(2), Golay()
    values = random.integers(0, 2**64, 500, dtype=np.uint64)
    other = values.copy()
    for (at, width), count in zip(simhash.SEGMENTS, errors):
        for row in range(len(other)):
            for bit in random.choice(width, count, replace=False):
                other[row] ^= np.uint64(1) << np.uint64(at + bit)
    mine = set(zip(*(x.tolist() for x in bucket_keys(values, golay))))
    theirs = set(zip(*(x.tolist() for x in bucket_keys(other, golay))))
    assert {row for _, row in mine & theirs} == set(range(len(values)))


def family(random, size):
    """Fingerprints around a few centres, so that links form chains."""
    centres = random.integers(0, 2**64, 6, dtype=np.uint64)
    out = []
    for k in range(size):
        value = centres[k % 6]
        for bit in random.choice(64, k % 6, replace=False):
            value ^= np.uint64(1) << np.uint64(bit)
        out.append(value)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("block", [50_000, 8])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    values = family(np.random.default_rng(3), 150)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint bigint")
    links = near_links(frame)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    found = [roots.get(int(v), int(v)) for v in values.view(np.int64)]
    want = linked([int(v) for v in values])
    assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


def test_forest_is_small():
    values = family(np.random.default_rng(4), 300)
    assert len(forest(values)) == len(values) - len(set(linked([int(v) for v in values])))


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    links = spark.createDataFrame(path + star + [(7, 7)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert roots == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)}
    assert components(links.where("a < 0")).count() == 0


def test_odd_rows(alerts_of):
    base = narrative(10, 300).split()
    rows = odd_rows() + [(50 + k, " ".join([*base[:k], "changed", *base[k + 1 :]]), "a") for k in range(0, 300, 40)]
    found = near_duplicates(alerts_of(rows)).collect()
    assert len(found) == len(rows)
    prints = [fingerprint(t) for _, t, _ in rows]
    want = linked(prints)
    least = {}
    for (i, _, _), root in zip(rows, want):
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    expected = [(i, p - (p >> 63 << 64), least[root]) for (i, _, _), p, root in zip(rows, prints, want)]
    assert sorted([(r["alert_id"], r["fingerprint"], r["component"]) for r in found], key=repr) == sorted(expected, key=repr)


def test_empty(alerts_of):
    assert near_duplicates(alerts_of([])).count() == 0
