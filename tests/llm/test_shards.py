import numpy as np
import pytest
from conftest_llm import narrative, odd_rows

from riskloom.llm.shards import END_OF_TEXT, PATTERN, TOKENIZER, Permutation, load_tokenizer, read_training_order, write_training_order
from riskloom.session import work_path


@pytest.mark.parametrize("size", [1, 2, 3, 5, 1000, 4097, 70_001])
def test_permutation(size):
    order = Permutation(size, key=7)
    slots = order.slot(np.arange(size))
    assert sorted(slots) == list(range(size))
    assert (order.index(slots) == np.arange(size)).all()
    if size >= 1000:
        assert (slots != Permutation(size, key=8).slot(np.arange(size))).mean() > 0.9
        assert abs(np.corrcoef(slots, np.arange(size))[0, 1]) < 0.1


def test_quick_pattern_cuts_alike():
    import base64

    import tiktoken

    with open(TOKENIZER, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = load_tokenizer(TOKENIZER)
    for text in ("", " ", "a b\nc", "a  b", "a \n b ", "ends in blank ", "ends\n", "it's\t12,5 €  \n\n x", narrative(5, 300), "  x", "a b c"):
        assert encode(text).tolist() == plain.encode_ordinary(text), repr(text)


def test_round_trip(spark, alerts_of):
    import tiktoken  # noqa: F401

    rows = odd_rows() + [(i, narrative(i, i), "a") for i in range(100, 140)]
    folder, length = work_path(spark, "shards"), 64
    slots = write_training_order(alerts_of(rows), folder, length=length, shard_bytes=10 * 2 * length)
    table = slots.orderBy("slot").collect()
    assert [r["slot"] for r in table] == list(range(len(table)))
    assert all((r["shard"], r["shard_slot"]) == divmod(r["slot"], 10) for r in table)
    tokens = {r["slot"]: r["tokens"] for r in read_training_order(slots, length=length).collect()}
    assert sorted(tokens) == list(range(len(table))) and all(len(t) == length for t in tokens.values())
    # undo the permutation: every packed stream is its documents, each behind the last one's end token
    index = Permutation(len(table), 42).index(np.arange(len(table)))
    stream = [tokens[s][: table[s]["n_tokens"]] for s in np.argsort(index)]
    flat = [t for part in stream for t in part]
    texts, current = [], []
    for t in flat:
        if t == END_OF_TEXT:
            texts.append(tuple(current))
            current = []
        else:
            current.append(t)
    assert not current
    encode = load_tokenizer(TOKENIZER)
    assert sorted(texts) == sorted(tuple(encode(t).tolist()) if t else () for _, t, _ in rows)
    keys = {k for r in table for k in r["keys"]}
    assert keys == {i for i, _, _ in rows}
    later = read_training_order(slots, length=length, first_slot=13).collect()
    assert {r["slot"]: r["tokens"] for r in later} == {s: t for s, t in tokens.items() if s >= 13}


def test_empty(spark, alerts_of):
    slots = write_training_order(alerts_of([]), work_path(spark, "shards"))
    assert slots.count() == 0 and read_training_order(slots).count() == 0
