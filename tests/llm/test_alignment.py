import collections
import hashlib
import os
import random

import pytest
from conftest_llm import narrative, odd_rows

from riskloom.llm import alignment
from riskloom.llm.alignment import PartMemory, Tokenizers, align_tokenizers, byte_characters, chosen

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(A), reason="vocabulary files not mounted")
TRICKY = [
    "Hello  wörld 中 😀 \t x\n a", "a\x00b", "𒍅x 𒍅𒍅", "a▁b", " x", "  ", "\n", "<s> <0x41> </s> <unk>", "<|endoftext|> and <|endoftext|>",
    "it's we'll 's '  s", "tab\t end \t", "no break　wide  em", "\x1c sep \x1c\x1d x", "é ́ combining", "a" * 5000,
    "ﬁ ligature ½ ①", "x" * 50 + " " * 40 + "y", "🏳️‍🌈 flags 👨‍👩‍👧", "\r\n line\r\n ends ", "ends with blank ", "...  ---  !!", "١٢٣ ४५",
]


@pytest.fixture(scope="module")
def tokenizers():
    with open(A, encoding="utf-8") as one, open(B, "rb") as two:
        return Tokenizers(one.read(), two.read())


def plain(tokenizers, text):
    """(groups as lists of ids, or None): the whole text at once, ends by adding up decoded bytes."""
    if not text:
        return None
    to_byte = byte_characters()
    found = tokenizers.a.encode(" " + text, add_special_tokens=False)
    sides = []
    for ids, token in (
        (found.ids, lambda i: bytes(to_byte[c] for c in tokenizers.a.id_to_token(i))),
        (tokenizers.b.encode(text), lambda i: bytes([int(tokenizers.b.id_to_piece(i)[3:5], 16)]) if tokenizers.b.is_byte(i) else tokenizers.b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        parts = [token(i) for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return None
        ends, at = [], 0
        for p in parts:
            at += len(p)
            ends.append(at)
        sides.append((ids, ends))
    cuts = sorted(set(sides[0][1]) & set(sides[1][1]))
    return [[[i for i, e in zip(ids, ends) if low < e <= cut] for ids, ends in sides] for low, cut in zip([0, *cuts], cuts)]


def shown(groups):
    return ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)


def expected(tokenizers, texts):
    every = [plain(tokenizers, t) for t in texts]
    links = [[(a, b) for ga, gb in g or [] for a in ga for b in gb] for g in every]
    counts = collections.Counter(p for each in links for p in set(each))
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [
        (sum(len(g[0]) for g in groups or []), sum(len(g[1]) for g in groups or []), len(groups or []), len(each),
         sum(counts[p] == best[p[0]] for p in each), sum(counts[p] for p in each), shown(groups or []))
        for groups, each in zip(every, links)
    ], counts


def result(found):
    sums = {r["_row"]: (r["n_best"], r["count_sum"]) for r in found.links.collect()}
    return [(r["alert_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], *sums.get(r["_row"], (0, 0)), r["groups"]) for r in found.texts.collect()]


@pytest.mark.parametrize("splits", [True, False])
def test_parts_are_aligned_as_whole_texts(tokenizers, monkeypatch, splits):
    assert tokenizers.splits
    monkeypatch.setattr(tokenizers, "splits", splits)
    for text in TRICKY + [narrative(3, 200)]:
        memory = PartMemory(tokenizers, 1 << 17)
        places, _ = memory.parts_of([text])
        found = chosen(memory.all, places)
        groups = plain(tokenizers, text)
        assert (found.good.all()) == (groups is not None), text
        if groups is not None:
            assert ";".join(found.text) == shown(groups), text
            assert found.n_groups.sum() == len(groups) and found.n_links.sum() == sum(len(a) * len(b) for a, b in groups)


def test_random_texts(tokenizers):
    chooser = random.Random(4)
    memory = PartMemory(tokenizers, 60)
    letters = "ab '\n\t  .,éß中😀́ ١0▁Zz"
    for _ in range(2000):
        text = "".join(chooser.choice(letters) for _ in range(chooser.randrange(1, 30)))
        places, _ = memory.parts_of([text])
        found, groups = chosen(memory.all, places), plain(tokenizers, text)
        assert bool(found.good.all()) == (groups is not None), text
        assert groups is None or ";".join(found.text) == shown(groups), text


@pytest.mark.parametrize("head, slice_bytes, remembered", [(1 << 19, 2 << 20, 1 << 18), (40, 3000, 50), (0, 200, 1)])
def test_against_plain_version(spark, alerts_of, tokenizers, monkeypatch, head, slice_bytes, remembered):
    monkeypatch.setattr(alignment, "HEAD", head)
    for name, value in (("SLICE", slice_bytes), ("REMEMBERED", remembered), ("LINKS", 64 if head == 0 else 1 << 21), ("HELD", 30 if head == 0 else 1 << 20)):
        monkeypatch.setattr(alignment, name, value)
    rows = [r if len(r[1] or "") < 50_000 else (r[0], narrative(3, 2000), r[2]) for r in odd_rows()] + [(100 + i, t, "a") for i, t in enumerate(TRICKY)]
    want, counts = expected(tokenizers, [t for _, t, _ in rows])
    found = align_tokenizers(alerts_of(rows), tokenizer_a=A, tokenizer_b=B)
    assert sorted(result(found), key=repr) == sorted([(i, *w) for (i, _, _), w in zip(rows, want)], key=repr)
    assert {(r["pair_a"], r["pair_b"]): r["count"] for r in found.pairs.collect()} == dict(counts)


def test_empty(alerts_of):
    found = align_tokenizers(alerts_of([]), tokenizer_a=A, tokenizer_b=B)
    assert found.texts.count() == found.links.count() == found.pairs.count() == 0


def test_query_on_given_documents(spark, tokenizers):
    from riskloom.llm.queries import QUERIES, table

    directory = "/root/testdata/sf0.001"
    if not os.path.isdir(directory):
        pytest.skip("test data not mounted")
    rows = table(spark, directory, "documents").select("doc_id", "text").collect()
    want, _ = expected(tokenizers, [r["text"] for r in rows])
    digests = sorted((r["doc_id"], *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(rows, want))
    assert sorted(map(tuple, QUERIES["op11_cross_tokenizer_alignment"](spark, directory).collect())) == digests
