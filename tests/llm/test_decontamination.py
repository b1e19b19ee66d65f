import re

import pytest
from conftest_llm import narrative, odd_rows

from riskloom.llm.decontamination import contaminated


def words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for at in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[at : at + size]), set()).add(item)
    out = []
    for i, text, _ in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for at in range(len(w) - size + 1):
                if (owners := windows.get(tuple(w[at : at + size]))) is not None:
                    hit |= set(range(at, at + size))
                    found |= owners
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), names, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items_of(spark):
    def make(items):
        return spark.createDataFrame([(*x, "c", 1) for x in items], "item_id bigint, text string, window string, n bigint").repartition(2)

    return make


def test_against_brute_force(alerts_of, items_of):
    items = [(i, narrative(200 + i, n)) for i, n in enumerate((40, 13, 14, 12, 5, 4, 1, 60, 60))]
    items += [(20, None), (21, "..."), (None, narrative(300, 30)), (0, items[0][1]), (22, items[0][1]), (23, "cash cash cash cash cash cash")]
    rows = odd_rows()
    for k in range(60):
        item = (items[k % len(items)][1] or "").split()
        cut = item[k % 5 : k % 5 + 10 + k % 30]
        text = narrative(400 + k, k % 25) + ", " + ".".join(w.upper() if k % 2 else w for w in cut) + " " + narrative(600 + k, 13 * (k % 40))
        rows.append((100 + k, text, "a"))
    found = contaminated(alerts_of(rows), items_of(items)).collect()
    got = [(r["alert_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in found]
    want = brute(rows, items)
    assert sorted(got, key=repr) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_empty(alerts_of, items_of):
    assert contaminated(alerts_of([]), items_of([(1, "a b c")])).count() == 0
    clean = contaminated(alerts_of([(1, "a b c", "x"), (2, None, None)]), items_of([])).collect()
    assert sorted((r["alert_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in clean) == [(1, 3, 0, False), (2, 0, 0, False)]
