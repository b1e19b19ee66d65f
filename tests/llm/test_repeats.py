from conftest_llm import narrative, odd_rows, sha256

from riskloom.llm import repeats
from riskloom.llm.repeats import without_repeats


def brute(rows):
    import re

    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    least = {}
    for (i, _, _), words in zip(rows, texts):
        if i is not None:
            for at in range(len(words) - 49):
                window = tuple(words[at : at + 50])
                least[window] = min(i, least.get(window, i))
    out = []
    for (i, _, _), words in zip(rows, texts):
        gone = set()
        for at in range(len(words) - 49) if i is not None else ():
            if least[tuple(words[at : at + 50])] < i:
                gone |= set(range(at, at + 50))
        kept = " ".join(w for n, w in enumerate(words) if n not in gone)
        out.append((i, len(words), len(gone), sha256(kept)))
    return sorted(out, key=repr)


def checked(alerts_of, rows):
    found = without_repeats(alerts_of(rows)).collect()
    assert sorted([(r["alert_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found], key=repr) == brute(rows)
    assert all((r["kept"] is None) == (r["n_removed"] == 0) for r in found)
    return found


def passages():
    """Texts that share passages of 49 to 120 words, at borders, twice in one text, and overlapping ones."""
    shared = [narrative(500 + k, n) for k, n in enumerate((49, 50, 51, 90, 120))]
    rows = []
    for i in range(40):
        parts = [narrative(i, i % 9), shared[i % 5], narrative(100 + i, i % 4), shared[(i * 3) % 5][: 40 * (i % 9)]]
        rows.append((i, "  ".join(parts), "a"))
    return rows + [(77, " ".join(["same"] * 130), "a"), (78, " ".join(["same"] * 60), "b"), (79, shared[3] + " " + shared[3], "b")]


def test_against_brute_force(alerts_of):
    checked(alerts_of, passages() + odd_rows())


def test_large_buckets_are_grouped_by_window(alerts_of, monkeypatch):
    monkeypatch.setattr(repeats, "HELD", 10)
    assert any(r["n_removed"] for r in checked(alerts_of, passages()))


def test_empty(alerts_of):
    assert without_repeats(alerts_of([])).count() == 0
    checked(alerts_of, [(1, None, "a"), (2, "", None)])
