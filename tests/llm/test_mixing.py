import hashlib
import re
from collections import Counter

import pytest
from conftest_llm import narrative, odd_rows

from riskloom.llm.mixing import mixed, mixing_plan


def brute(rows, seed=42):
    """(alert_id, size, source_size, target, taken) per row, by plain sorting."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sizes = Counter()
    for _, s, n in sized:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, rest, total = {}, set(order), sum(sizes.values())
    while rest:
        level = (total - sum(target.values())) / sum(weight[s] for s in rest)
        full = {s for s in rest if 3 * sizes[s] <= level * weight[s]}
        target |= {s: float(3 * sizes[s]) for s in full} if full else {s: level * weight[s] for s in rest}
        rest = rest - full if full else set()
    def ticket(i):
        return int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:15], 16)

    queue, place = [], Counter()
    for i, s, n in sorted(sized, key=lambda r: (ticket(r[0]), r[0] is not None, r[0] or 0, r[2])):
        place[s] += n
        queue += [((place[s] + r * sizes[s]) / target[s], i, s, n) for r in range(3) if n]
    taken, spent, at = Counter(), 0, 0
    queue.sort(key=lambda q: q[0])
    while at < len(queue):
        group = [q for q in queue[at:] if q[0] == queue[at][0]]
        spent += sum(q[3] for q in group)
        if spent > total:
            break
        for _, i, s, n in group:
            taken[i, s, n] += n
        at += len(group)
    return sized, sizes, target, taken


def test_against_brute_force(alerts_of):
    rows = [(i, narrative(i, 5 + i % 40), "abcde"[i % 7 % 5] if i % 11 else None) for i in range(300)] + [(900, narrative(9, 400), "small")]
    sized, sizes, target, taken = brute(rows)
    plan = mixing_plan(alerts_of(rows)).collect()
    assert len(plan) == len(rows)
    for r in plan:
        source = r["layout_name"]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(target[source])
        assert r["taken"] == taken[r["alert_id"], source, r["size"]] and r["taken"] <= 3 * r["size"]
        assert (r["_size"], r["_key"], r["hash"]) == (8, "x", 9)
    got = Counter()
    for r in plan:
        got[r["layout_name"]] += r["taken"]
    longest = max(r["size"] for r in plan)
    assert all(abs(got[s] - target[s]) <= longest for s in target)
    copies = mixed(alerts_of(rows))
    assert copies.columns == alerts_of(rows).columns
    want = Counter({r["alert_id"]: r["repeats"] for r in plan if r["repeats"]})
    assert Counter(r["alert_id"] for r in copies.collect()) == want
    assert {r["size"] for r in copies.select("size").distinct().collect()} == {7}


def test_odd_rows(alerts_of):
    rows = odd_rows()
    plan = mixing_plan(alerts_of(rows)).collect()
    assert len(plan) == len(rows)
    assert all(r["taken"] == 0 and r["size"] == 0 for r in plan if r["alert_id"] in (3, 4, 5))
    assert sorted(map(tuple, plan), key=repr) == sorted(map(tuple, mixing_plan(alerts_of(rows[::-1])).collect()), key=repr)


def test_empty(alerts_of):
    assert mixing_plan(alerts_of([])).count() == 0 and mixed(alerts_of([])).count() == 0
    assert [r["taken"] for r in mixing_plan(alerts_of([(1, None, None)])).collect()] == [0]
