"""Alignment of the token sequences of two tokenizers over the same texts, and how often token pairs are aligned."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.words import slices
from riskloom.session import materialise, work_path

# bytes of text that are worked on, and of new parts that are given to the tokenizers, at once
SLICE, ENCODED = 1 << 20, 1 << 16
# texts are cut before single blanks into parts; so many of the distinct parts and groups are remembered by a task
REMEMBERED = 1 << 18
# links that are expanded, and pair counts that are held by a task, at once
LINKS, HELD = 1 << 21, 1 << 20
# groups with more links than this are expanded from distinct ids with multiplicities
LARGE = 64
# the most frequent pairs, at most so many, are looked up while scanning; all others by a join
HEAD = 1 << 19
BREAK = re.compile(r"(?<=\S) (?!\Z)")
IRREGULAR = re.compile(r"(?:\A|\s) | \Z")


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others,
    in order, for the code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenBytes:
    """The bytes of every token of a vocabulary, flat."""

    def __init__(self, tokens: list[bytes]):
        self.width = np.array([len(t) for t in tokens], np.int64)
        self.start = np.r_[0, np.cumsum(self.width)][:-1]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        width = self.width[ids]
        before = np.cumsum(width) - width
        return self.flat[np.repeat(self.start[ids] - before, width) + np.arange(int(width.sum()))]


def spans(width: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Byte ends of tokens. ``begin`` and ``end`` are a tokenizer's own spans in bytes, which are coarse: the tokens of
    one character share its span, or all but the last have an empty one. A cut between two tokens counts if their
    spans meet and one of them is as long as its decoded bytes; between such cuts the decoded bytes decide.
    ``first`` marks the tokens that begin a text."""
    if not len(width):
        return np.zeros(0, np.int64)
    exact = end - begin == width
    certain = np.ones(len(width), bool)
    certain[1:] = first[1:] | ((begin[1:] == end[:-1]) & (exact[1:] | exact[:-1]))
    run = np.cumsum(certain) - 1
    upto = np.cumsum(width)
    heads = np.flatnonzero(certain)
    return begin[heads][run] + upto - (upto[heads] - width[heads])[run]


class Tokenizers:
    """Tokenizer A (byte-level, a tokenizers JSON file) and B (a sentencepiece model), from their files' contents."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a), SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        to_byte = byte_characters()
        entries = {i: token for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = TokenBytes([bytes(to_byte.get(c, 0x3F) for c in entries.get(i, "")) for i in range(max(entries) + 1)])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = TokenBytes(
            [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        )
        self.size_a, self.size_b = len(self.a_bytes.width), len(pieces)
        # no token reaches over a blank that follows another character: parts can be tokenized apart or together
        setting = json.loads(a)
        kind = setting.get("pre_tokenizer") or {}
        split = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not setting.get("normalizer")
        self.splits = bool(split) and not any(re.search("[^▁]▁", p) for p in pieces)

    def parts(self, text: str) -> list[str]:
        """Parts that, each after a blank, make up blank + text; every part begins a token in both tokenizers."""
        if not self.splits:
            return [text]
        return BREAK.split(text) if IRREGULAR.search(text) else text.split(" ")

    def tokens_a(self, parts: list[str], starts: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte ends, tokens per part) of the parts, joined by blanks, by the character offsets of A. ``starts``:
        first byte of each part, which is its blank."""
        found = self.a.encode(" " + " ".join(parts), add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        offsets = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        characters = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
        return placed(ids, characters[offsets[:, 0]], characters[offsets[:, 1]], self.a_bytes, starts)

    def tokens_b(self, parts: list[str], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same by the byte spans of B's protocol message, which do not count the blank that B puts in front."""
        found = self.b.encode(" ".join(parts), return_type="proto").pieces
        ids = np.array([q.id for q in found], np.int64)
        begin, end = np.array([q.begin for q in found], np.int64) + 1, np.array([q.end for q in found], np.int64) + 1
        begin[:1] = 0
        return placed(ids, begin, end, self.b_bytes, starts)


def placed(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, vocabulary: TokenBytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, byte ends, tokens per part): a token belongs to the part in which its own span begins."""
    owner = np.searchsorted(starts[:-1], begin, side="right") - 1
    first = np.r_[True, owner[1:] != owner[:-1]] if len(ids) else np.zeros(0, bool)
    counts = np.bincount(owner, minlength=len(starts) - 1)
    return ids, spans(vocabulary.width[ids], begin, end, first), counts


def faithful(owners: int, starts: np.ndarray, data: np.ndarray, vocabulary: TokenBytes, ids: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which parts have tokens whose joined bytes are the part's bytes, at the places found for them."""
    owner = np.repeat(np.arange(owners), counts)
    width = vocabulary.width[ids]
    sizes = np.bincount(owner, weights=width, minlength=owners).astype(np.int64)
    upto = np.cumsum(width)
    before = (np.r_[0, np.cumsum(sizes)][:-1])[owner]
    good = (sizes == np.diff(starts)) & (counts > 0)
    wrong = ends - starts[:-1][owner] != upto - before
    good[owner[wrong]] = False
    inside = good[owner]
    kept = np.repeat(good, np.diff(starts))
    different = np.flatnonzero(vocabulary.joined(ids[inside]) != data[kept])
    places = np.flatnonzero(kept)[different]
    good[np.searchsorted(starts, places, side="right") - 1] = False
    return good


@dataclass
class Aligned:
    """Alignments of parts. Groups are cut where tokens of both sides end. Part p has the pairs
    pair[at[p]:at[p + 1]] (a * size of B + b), linked ``times`` times, and the groups as text."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    text: list[str] = field(default_factory=list)
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    pair: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[head], np.add.reduceat(weights, head)


def side(ids: np.ndarray, group: np.ndarray, large: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, group, times) by group: tokens as they are, those of large groups once per distinct id."""
    times = np.ones(len(ids), np.int64)
    many = large[group]
    if not many.any():
        return ids, group, times
    keys, counts = summed(group[many] * size + ids[many], times[many])
    ids, group, times = np.r_[ids[~many], keys % size], np.r_[group[~many], keys // size], np.r_[times[~many], counts]
    order = np.argsort(group, kind="stable")
    return ids[order], group[order], times[order]


def group_text(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, owner: np.ndarray, owners: int) -> list[str]:
    """The groups of each part as text, a1,a2|b1;a3|b2,b3."""
    ids = np.empty(len(a) + len(b), np.int64)
    group_a = np.repeat(np.arange(len(end_a)), np.diff(np.r_[0, end_a]))
    group_b = np.repeat(np.arange(len(end_b)), np.diff(np.r_[0, end_b]))
    ids[np.arange(len(a)) + np.r_[0, end_b][:-1][group_a]] = a
    ids[np.arange(len(b)) + end_a[group_b]] = b
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[end_a + np.r_[0, end_b][:-1] - 1] = ord("|")
    mark[end_a + end_b - 1] = ord(";")
    # decimal digits, one row of places per token, the mark behind them
    digits = len(str(int(ids.max(initial=0))))
    cells = np.zeros((len(ids), digits + 1), np.uint8)
    rest = ids.copy()
    for place in range(digits - 1, -1, -1):
        shown = (rest > 0) | (place == digits - 1)
        cells[:, place] = np.where(shown, 48 + rest % 10, 0)
        rest //= 10
    cells[:, digits] = mark
    used = cells != 0
    flat = cells[used].tobytes().decode("ascii")
    # characters up to the end of each part's last group
    last = np.searchsorted(owner, np.arange(owners), side="right")
    upto = np.r_[0, np.cumsum(used.sum(axis=1))]
    tokens = np.r_[0, (end_a + end_b)][last]
    ends = upto[tokens].tolist()
    return [flat[begin : end - 1] if end > begin else "" for begin, end in zip([0, *ends], ends)]


def aligned(parts: list[str], tokenizers: Tokenizers) -> Aligned:
    """Aligns each part, taken after a blank. Parts that can be tokenized together are; those that do not come back
    byte for byte, for their own or a neighbour's sake, are tokenized once more by themselves."""
    if len(parts) > 1 and not tokenizers.splits:
        return joined([aligned([p], tokenizers) for p in parts])
    found = aligned_together(parts, tokenizers)
    doubtful = np.flatnonzero(~found.good)
    if len(parts) == 1 or not len(doubtful):
        return found
    # the others as they are, then the doubtful ones, in the order of the parts
    again = joined([chosen(found, np.flatnonzero(found.good)), *[aligned([parts[i]], tokenizers) for i in doubtful]])
    order = np.r_[np.flatnonzero(found.good), doubtful]
    return chosen(again, np.argsort(order, kind="stable"))


def aligned_together(parts: list[str], tokenizers: Tokenizers) -> Aligned:
    raw = [b" " + p.encode() for p in parts]
    starts = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    owners = len(parts)
    a, end_a, count_a = tokenizers.tokens_a(parts, starts, data)
    b, end_b, count_b = tokenizers.tokens_b(parts, starts)
    good = faithful(owners, starts, data, tokenizers.a_bytes, a, end_a, count_a)
    good &= faithful(owners, starts, data, tokenizers.b_bytes, b, end_b, count_b)
    keep_a, keep_b = np.repeat(good, count_a), np.repeat(good, count_b)
    a, end_a, b, end_b = a[keep_a], end_a[keep_a], b[keep_b], end_b[keep_b]
    ends_here = np.zeros(len(data) + 1, bool)
    ends_here[end_a] = True
    cuts = end_b[ends_here[end_b]]
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    owner = np.searchsorted(starts, cuts, side="left") - 1
    links = in_a * in_b
    out = Aligned(good, np.where(good, count_a, 0), np.where(good, count_b, 0), np.bincount(owner, minlength=owners), np.zeros(owners, np.int64))
    np.add.at(out.n_links, owner, links)
    out.text = group_text(a, b, np.cumsum(in_a), np.cumsum(in_b), owner, owners)
    one, group_one, times_one = side(a, group_a, links > LARGE, tokenizers.size_a)
    two, group_two, times_two = side(b, group_b, links > LARGE, tokenizers.size_b)
    first_two = np.searchsorted(group_two, np.arange(len(cuts)))
    fan = np.bincount(group_two, minlength=len(cuts))[group_one]
    upto = np.cumsum(fan)
    keys, owns, times, at = [], [], [], 0
    while at < len(one):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LINKS, side="right")))
        rows = np.repeat(np.arange(at, stop), fan[at:stop])
        inner = np.arange(len(rows)) - np.repeat(upto[at:stop] - fan[at:stop] - (upto[at - 1] if at else 0), fan[at:stop])
        other = first_two[group_one[rows]] + inner
        keys.append(one[rows] * tokenizers.size_b + two[other])
        owns.append(owner[group_one[rows]])
        times.append(times_one[rows] * times_two[other])
        at = stop
    if keys:
        out.pair, own, out.times = np.concatenate(keys), np.concatenate(owns), np.concatenate(times)
        out.at = np.searchsorted(own, np.arange(owners + 1))
    else:
        out.at = np.zeros(owners + 1, np.int64)
    return out


class Places(dict):
    """Numbers strings in the order in which they are met; ``new`` collects those not met before."""

    def __init__(self, *given):
        super().__init__(*given)
        self.new: list[str] = []

    def __missing__(self, name: str) -> int:
        self.new.append(name)
        self[name] = number = len(self)
        return number

    def numbers(self, names: list[str]) -> tuple[np.ndarray, list[str]]:
        """(number of each name, names not met before)."""
        self.new = []
        return np.fromiter(map(self.__getitem__, names), np.int64, len(names)), self.new


def joined(every: list[Aligned]) -> Aligned:
    columns = {n: np.concatenate([getattr(x, n) for x in every]) for n in ("good", "n_a", "n_b", "n_groups", "n_links", "pair", "times")}
    ends = np.cumsum([0, *[x.at[-1] for x in every]])
    at = np.concatenate([[0], *[x.at[1:] + before for x, before in zip(every, ends)]])
    return Aligned(**columns, text=list(chain.from_iterable(x.text for x in every)), at=at)


class Memory:
    """Alignments of the strings met so far by a task: each is made when it is met first. When there are over
    ``remembered``, those in use least are forgotten; met again, they are made again."""

    def __init__(self, make: Callable[[list[str]], Aligned], remembered: int):
        self.make, self.remembered = make, remembered
        zero = np.zeros(0, np.int64)
        self.place = Places()
        self.all, self.uses = Aligned(np.zeros(0, bool), zero, zero, zero, zero), zero

    def forget(self) -> None:
        least = 1
        while (kept := np.flatnonzero(self.uses > least)).size > self.remembered // 2:
            least *= 2
        self.all = chosen(self.all, kept)
        names = list(self.place)
        self.place, self.uses = Places({names[i]: k for k, i in enumerate(kept.tolist())}), self.uses[kept] // 2

    def find(self, names: list[str]) -> np.ndarray:
        """The place of each string in ``all``."""
        if len(self.place) > self.remembered:
            self.forget()
        places, new = self.place.numbers(names)
        at, more = 0, []
        while at < len(new):  # a bounded number of bytes at once
            held, stop = 0, at
            while stop < len(new) and (held < ENCODED or stop == at):
                held += len(new[stop]) + 8
                stop += 1
            more.append(self.make(new[at:stop]))
            at = stop
        if more:
            self.all = joined([self.all, *more])
        self.uses = np.r_[self.uses, np.zeros(len(new), np.int64)] + np.bincount(places, minlength=len(self.place))
        return places


def chosen(old: Aligned, kept: np.ndarray) -> Aligned:
    _, entry = expanded(old.at, kept)
    sizes = old.at[kept + 1] - old.at[kept]
    columns = {n: getattr(old, n)[kept] for n in ("good", "n_a", "n_b", "n_groups", "n_links")}
    return Aligned(**columns, text=[old.text[i] for i in kept], at=np.r_[0, np.cumsum(sizes)], pair=old.pair[entry], times=old.times[entry])


class PartMemory(Memory):
    """Alignments of the parts of texts."""

    def __init__(self, tokenizers: Tokenizers, remembered: int):
        super().__init__(lambda parts: aligned(parts, tokenizers), remembered)
        self.tokenizers = tokenizers

    def parts_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place of each part, parts per text)."""
        split = [self.tokenizers.parts(t) for t in texts]
        return self.find(list(chain.from_iterable(split))), np.array([len(s) for s in split], np.int64)


_kept: dict[tuple[int, int], PartMemory] = {}


def worker_memory(files: tuple[str, bytes]) -> PartMemory:
    """The memory of this process for these tokenizers: the tasks that it runs one after the other share it. What is
    remembered never changes a result."""
    name = (hash(files[0]), hash(files[1]))
    if name not in _kept:
        _kept.clear()
        _kept[name] = PartMemory(Tokenizers(*files), REMEMBERED)
    return _kept[name]


class Links:
    """The linked pairs of the groups met so far by a task, with their counts if they are known (else 0)."""

    def __init__(self, lookup: "PairTable", highest: np.ndarray, size_b: int):
        self.lookup, self.highest, self.size_b = lookup, highest, size_b
        self.clear()

    def clear(self) -> None:
        zero = np.zeros(0, np.int64)
        self.place = Places()
        self.sums, self.bests, self.pair, self.times, self.at = zero, zero, zero, zero, np.zeros(1, np.int64)

    def find(self, groups: list[str], remembered: int) -> np.ndarray:
        """Place of each group, given as a1,a2|b1. ``sums`` and ``bests`` hold what its pairs of known count add up to,
        ``pair`` and ``times`` the others, from at[place] on."""
        if len(self.place) > remembered:
            self.clear()
        places, new = self.place.numbers(groups)
        pairs, times, sizes = [], [], []
        for group in new:
            a, b = (Counter(map(int, ids.split(","))) for ids in group.split("|"))
            sizes.append(len(a) * len(b))
            pairs.append((np.fromiter(a, np.int64, len(a))[:, None] * self.size_b + np.fromiter(b, np.int64, len(b))).ravel())
            times.append((np.fromiter(a.values(), np.int64, len(a))[:, None] * np.fromiter(b.values(), np.int64, len(b))).ravel())
        if new:
            pair, times = np.concatenate(pairs), np.concatenate(times)
            owner = np.repeat(np.arange(len(new)), sizes)
            counts = self.lookup.find(pair)
            best = (counts > 0) & (counts == self.highest[pair // self.size_b])
            for name, values in (("sums", counts * times), ("bests", np.where(best, times, 0))):
                total = np.zeros(len(new), np.int64)
                np.add.at(total, owner, values)
                setattr(self, name, np.r_[getattr(self, name), total])
            rest = counts == 0
            self.pair, self.times = np.r_[self.pair, pair[rest]], np.r_[self.times, times[rest]]
            self.at = np.r_[self.at, self.at[-1] + np.cumsum(np.bincount(owner[rest], minlength=len(new)))]
        return places


def expanded(at: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the place, index of the entry) of all entries at[p]:at[p + 1] of the places p."""
    sizes = at[places + 1] - at[places]
    owner = np.repeat(np.arange(len(places)), sizes)
    before = np.cumsum(sizes) - sizes
    return owner, np.arange(int(sizes.sum())) - before[owner] + at[places][owner]


def slice_pairs(memory: PartMemory, places: np.ndarray, text: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The pairs of each text once, one after another."""
    total = memory.tokenizers.size_a * memory.tokenizers.size_b
    used = good[text]
    places, text = places[used], text[used]
    found = np.zeros(0, np.int64)
    step = max(1, LINKS // 2)
    for at in range(0, len(places), step):
        owner, entry = expanded(memory.all.at, places[at : at + step])
        keys = np.unique(text[at : at + step][owner] * total + memory.all.pair[entry])
        # a text that began in the part before may repeat its pairs
        found = keys if not len(found) else np.unique(np.concatenate([found, keys]))
    return found % total


def good_texts(memory: PartMemory, places: np.ndarray, counts: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each part, texts that have tokens)."""
    text = np.repeat(np.arange(len(counts)), counts)
    bad = np.bincount(text, weights=~memory.all.good[places], minlength=len(counts)) > 0
    return text, filled & ~bad


class PairTable:
    """Counts by pair in an open hash table, looked up for many pairs at once."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        bits = max(4, int(4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.counts = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        slot = self.slot(pairs)
        while len(pairs):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = pairs[free]
            mine = self.keys[slot] == pairs
            self.counts[slot[mine]] = counts[mine]
            pairs, counts, slot = pairs[~mine], counts[~mine], (slot[~mine] + 1) & self.mask

    def slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The counts; 0 for pairs that are not in the table."""
        out = np.zeros(len(pairs), np.int64)
        rows, slot = np.arange(len(pairs)), self.slot(pairs)
        while len(rows):
            key = self.keys[slot]
            hit = key == pairs[rows]
            out[rows[hit]] = self.counts[slot[hit]]
            on = ~hit & (key != -1)
            rows, slot = rows[on], (slot[on] + 1) & self.mask
        return out


@dataclass(frozen=True)
class Alignment:
    """``texts``: one row per input row, with a row number ``_row``. ``links``: per ``_row``, the sums over its links;
    rows without links are absent. ``pairs``: (pair_a, pair_b, count) of the corpus."""

    texts: DataFrame
    links: DataFrame
    pairs: DataFrame


def align_tokenizers(
    alerts: DataFrame, *, tokenizer_a: str, tokenizer_b: str, key: str = "alert_id", text: str = "alert_type"
) -> Alignment:
    """Aligns the tokens of two tokenizers over each text (with a blank in front) and weighs every link by how many
    texts of the table have its pair of ids linked.

    ``tokenizer_a`` is the path of a byte-level tokenizers JSON file, ``tokenizer_b`` that of a sentencepiece model
    that puts a blank in front; the driver reads them. Token spans come from A's character offsets and B's protocol
    message, refined inside multibyte characters and byte-fallback tokens by the tokens' own bytes. Byte offsets where
    tokens of both sides end cut the tokens into groups; every A token of a group is linked with every B token of it.

    ``texts`` has ``_row``, ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups``, the token ids as
    text, a1,a2|b1;a3|b2,b3; ``links`` has ``_row``, ``n_best`` (links whose pair has the highest count of its A id,
    ties included) and ``count_sum``; ``pairs`` the counts. A NULL or empty text, and one that either tokenizer does
    not give back byte for byte, has no tokens: zeros and an empty ``groups``. NULL keys and repeated rows are rows
    like others, very long texts are aligned whole, other columns are ignored, an empty table gives empty results.

    Texts are cut into parts where no token of either side can reach across (if both vocabularies allow it), and a
    task aligns a part that it remembers only once. Texts are tokenized once; the second pass reads the stored groups. Pair counts are added up per task before they are shuffled. The
    most frequent pairs, at most 2**19, are looked up while scanning; links of all others are joined with their counts,
    none of which is frequent enough to be a hot key. Best counts are broadcast: one number per id of A.
    """
    spark = alerts.sparkSession
    with open(tokenizer_a, encoding="utf-8") as one, open(tokenizer_b, "rb") as two:
        files = spark.sparkContext.broadcast((one.read(), two.read()))
    whole = Tokenizers(*files.value)
    size_a, size_b = whole.size_a, whole.size_b
    del whole
    rows = alerts.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = alerts.schema[key].dataType.simpleString()
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    names = ["_key", *numbers, "groups", "pair", "count"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_memory(files.value)
        pairs, counts, key_type = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def added_up() -> pa.RecordBatch:
            none = [pa.nulls(len(pairs), t) for t in (key_type, *[pa.int64()] * len(numbers), pa.string())]
            return pa.RecordBatch.from_arrays([*none, pa.array(pairs), pa.array(counts)], names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for begin, stop in slices(batch.column(1), SLICE):
                given = [t or "" for t in batch.column(1).slice(begin, stop - begin).to_pylist()]
                places, parts = memory.parts_of(given)
                text_of, good = good_texts(memory, places, parts, np.array([bool(t) for t in given]))
                shown, stops, every = places.tolist(), np.cumsum(parts).tolist(), memory.all
                groups = [";".join([every.text[p] for p in shown[x:y]]) if ok else "" for x, y, ok in zip([0, *stops], stops, good)]
                columns = [batch.column(0).slice(begin, stop - begin)]
                for name in numbers:
                    total = np.zeros(len(given), np.int64)
                    np.add.at(total, text_of, getattr(every, name)[places])
                    columns.append(pa.array(np.where(good, total, 0)))
                none = [pa.nulls(len(given), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([*columns, pa.array(groups, pa.string()), *none], names)
                found, times = np.unique(slice_pairs(memory, places, text_of, good), return_counts=True)
                pairs, counts = summed(np.concatenate([pairs, found]), np.concatenate([counts, times]))
                if len(pairs) > HELD:
                    yield added_up()
                    pairs, counts = pairs[:0], counts[:0]
        if len(pairs):
            yield added_up()

    schema = f"_key {kind}, {', '.join(f'{n} bigint' for n in numbers)}, groups string, pair bigint, count bigint"
    texts_at = work_path(spark, "alignments")
    # row numbers are stored with the rows, so that they are drawn once
    numbered = rows.mapInArrow(align, schema).withColumn("_row", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(texts_at)
    stored = spark.read.schema(f"{schema}, _row bigint").parquet(texts_at)
    texts = stored.where("pair IS NULL")
    counted = materialise(stored.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("count").alias("count")), "pairs")
    size = F.floor(F.log2("count") * 8)
    best = np.zeros(size_a, np.int64)
    for a, most in counted.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("count")).collect():
        best[a] = most
    # at most 8 * 63 classes of sizes; the head is whole classes
    classes = {r["size"]: r["count"] for r in counted.groupBy(size.alias("size")).count().collect()}
    least, held = None, 0
    for level in sorted(classes, reverse=True):
        held += classes[level]
        if held > HEAD:
            break
        least = level
    frequent = (counted.where(size >= least) if least is not None else counted.limit(0)).toPandas()
    head = spark.sparkContext.broadcast((frequent["pair"].to_numpy(np.int64), frequent["count"].to_numpy(np.int64), best))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *known, highest = head.value
        links = Links(PairTable(*known), highest, size_b)
        for batch in batches:
            for begin, stop in slices(batch.column(1), SLICE):
                split = [g.split(";") for g in batch.column(1).slice(begin, stop - begin).to_pylist()]
                text_of = np.repeat(np.arange(len(split)), [len(s) for s in split])
                places = links.find(list(chain.from_iterable(split)), REMEMBERED)
                sums = []
                for values in (links.bests, links.sums):
                    total = np.zeros(len(split), np.int64)
                    np.add.at(total, text_of, values[places])
                    sums.append(pa.array(total))
                open_ = links.at[places + 1] > links.at[places]
                owner, entry = expanded(links.at, places[open_])
                total = size_a * size_b
                keys, times = summed(text_of[open_][owner] * total + links.pair[entry], links.times[entry])
                ends = np.searchsorted(keys, np.arange(len(split) + 1) * total).astype(np.int32)
                tail = pa.StructArray.from_arrays([pa.array(keys % total), pa.array(times)], ["pair", "times"])
                columns = [batch.column(0).slice(begin, stop - begin), *sums, pa.ListArray.from_arrays(pa.array(ends), tail)]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "n_best", "count_sum", "tail"])

    scored = "_row bigint, n_best bigint, count_sum bigint, tail array<struct<pair: bigint, times: bigint>>"
    # the stored groups are several times as long as the texts: few rows at once, by a session of its own
    few = spark.newSession()
    few.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    few.conf.set("spark.sql.parquet.columnarReaderBatchSize", "500")
    scores_at = work_path(spark, "scores")
    stored_groups = few.read.schema(f"{schema}, _row bigint").parquet(texts_at).where("pair IS NULL AND n_links > 0").select("_row", "groups")
    stored_groups.mapInArrow(score, scored).write.parquet(scores_at)
    scores = spark.read.schema(scored).parquet(scores_at)
    tails = scores.select("_row", F.explode("tail").alias("_t")).select("_row", "_t.pair", "_t.times")
    marks = counted.where(size < least) if least is not None else counted
    marks = marks.join(F.broadcast(best_table(spark, best)), F.expr(f"pair div {size_b}") == F.col("_a"), "left")
    joined = tails.join(marks, "pair").select(
        "_row",
        F.when(F.col("count") == F.col("_most"), F.col("times")).otherwise(F.lit(0)).alias("n_best"),
        (F.col("count") * F.col("times")).alias("count_sum"),
    )
    every = scores.select("_row", "n_best", "count_sum").union(joined)
    links = every.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    shown = counted.select(F.expr(f"pair div {size_b}").alias("pair_a"), F.expr(f"pair % {size_b}").alias("pair_b"), "count")
    return Alignment(texts.select("_row", F.col("_key").alias(key), *numbers, "groups"), links, shown)


def best_table(spark, best: np.ndarray) -> DataFrame:
    """The highest count of each id of A: as many rows as its vocabulary has ids."""
    return spark.createDataFrame(pd.DataFrame({"_a": np.arange(len(best)), "_most": best}), "_a bigint, _most bigint")
