"""Jaccard self-join of texts by their word shingles: a prefix join of groups, expanded and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.filters import bit_filter, passes
from riskloom.llm.prints import content_print
from riskloom.llm.words import WHITE_FOLDED, finished, slices, words_of
from riskloom.operators.iterative import linked_roots
from riskloom.session import materialise

SHINGLE = 3
# two sets link if LEVEL[1] * |intersection| >= LEVEL[0] * |union|
LEVEL = (90, 100)
# shingles are ordered by how often those of the same bucket of hashes occur in the table
BUCKETS = 1 << 16
# counters of a set's sketch; of sets with over LARGE elements they count modulo 16, of others modulo 2
COUNTERS, LARGE = 1024, 2000
# bytes of text that are worked on at once
SLICE = 4 << 20
# classes that a task compares at once; a larger bucket is compared block by block, each pair of blocks by itself
BLOCK = 20_000
# buckets up to this size are compared by diagonals, when candidates are chosen and when prefixes are
SMALL, SMALL_TOKENS = 8, 64
# groups whose prefix tokens a task remembers to have sent
SENT = 1 << 20
# hashes of texts whose sets are needed; more texts than bits only let more sets pass
FILTER_BITS = 25


def least_overlap(total):
    """The smallest intersection that links two sets of ``total`` elements together."""
    top, bottom = LEVEL
    return -(-top * total // (top + bottom))


def least_size(size):
    """The smallest set that can link with one of this size; also the smallest overlap of a link."""
    return -(-LEVEL[0] * size // LEVEL[1])


def shingles_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first hash of each text and the total): all shingles, repeats included; of a text with fewer words
    than SHINGLE, the whole sequence."""
    found = words_of(texts, WHITE_FOLDED)
    left, counts = found.left(), np.diff(found.first)
    hashes = found.shingles(SHINGLE)
    valid = left >= SHINGLE
    for words in range(1, SHINGLE):
        whole = found.first[:-1][counts == words]
        hashes[whole] = found.shingles(words)[whole]
        valid[whole] = True
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    return hashes[valid], np.r_[0, np.cumsum(sizes)]


def bucket_ranks(texts: DataFrame) -> np.ndarray:
    """The rank of each bucket of hashes by its shingles in the whole table, rarest first. Tasks send at most BUCKETS
    sums, and so many reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for begin, stop in slices(batch.column(0), SLICE):
                total += np.bincount((shingles_of(batch.column(0).slice(begin, stop - begin))[0] >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    totals = np.zeros(BUCKETS, np.int64)
    for bucket, n in texts.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        totals[bucket] = n
    ranks = np.empty(BUCKETS, np.uint64)
    ranks[np.argsort(totals, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    return ranks


def ordered_sets(texts: pa.Array, ranks: np.ndarray) -> list[np.ndarray]:
    """The set of each text as ascending numbers: rarity in the upper bits, the hash's own bits below."""
    hashes, first = shingles_of(texts)
    keys = (ranks[(hashes >> np.uint64(48)).astype(np.int64)] << np.uint64(48)) | (hashes & np.uint64((1 << 48) - 1))
    return [np.unique(keys[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    data = np.ascontiguousarray(rows)
    kind = pa.binary(data.shape[1])
    return pa.FixedSizeBinaryArray.from_buffers(kind, len(data), [None, pa.py_buffer(data)]).cast(pa.binary())


def bytes_of(column: pa.Array, width: int) -> np.ndarray:
    """The inverse: a binary column of equal widths, without NULLs."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return raw.reshape(-1, width)


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """16 bytes per set, that equal sets share: two independent sums over its elements."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        mixed = finished(s + np.uint64(0x9E3779B97F4A7C15))
        size = np.uint64(len(s))
        out[i] = (mixed.sum(dtype=np.uint64) + size, (mixed * finished(s ^ np.uint64(0xD6E8FEB86659FD93))).sum(dtype=np.uint64) ^ size)
    # most significant byte first, so that bytes order as the numbers do
    return out.astype(">u8").view(np.uint8).reshape(len(sets), 16)


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """Elements counted by their last bits. However two sets differ, the counts differ by no more in all than the sets
    have elements that are not common; modulo 2 or 16, they can only differ by less."""
    out = []
    for s in sets:
        counts = np.bincount((s & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        if len(s) > LARGE:
            half = (counts & 15).astype(np.uint8)
            out.append((half[0::2] | half[1::2] << 4).tobytes())
        else:
            out.append(np.packbits((counts & 1).astype(np.uint8)).tobytes())
    return out


class Sketches:
    """Sketches of many sets: parities of all, counts of the large ones."""

    def __init__(self, parity: np.ndarray, large: np.ndarray, counts: np.ndarray):
        self.parity, self.large, self.counts = parity, large, counts
        self.place = np.cumsum(large) - 1

    @classmethod
    def read(cls, column: pa.Array) -> "Sketches":
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
        large = np.diff(offsets) > COUNTERS // 8
        inside = np.repeat(large, np.diff(offsets))
        packed = raw[inside].reshape(-1, COUNTERS // 2)
        counts = np.empty((len(packed), COUNTERS), np.uint8)
        counts[:, 0::2], counts[:, 1::2] = packed & 15, packed >> 4
        parity = np.empty((len(large), COUNTERS // 8), np.uint8)
        parity[~large], parity[large] = raw[~inside].reshape(-1, COUNTERS // 8), np.packbits(counts & 1, axis=1)
        return cls(parity.view(np.uint64), large, counts)

    def __getitem__(self, rows: slice) -> "Sketches":
        before, upto = (int(self.large[:at].sum()) for at in (rows.start or 0, len(self.large) if rows.stop is None else rows.stop))
        return Sketches(self.parity[rows], self.large[rows], self.counts[before:upto])

    def followed_by(self, more: "Sketches") -> "Sketches":
        return Sketches(*(np.concatenate([getattr(self, n), getattr(more, n)]) for n in ("parity", "large", "counts")))

    def apart(self, a: np.ndarray, b: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Whether the rows a and b differ by ``allowed`` elements at most, as far as the sketches tell."""
        out = np.bitwise_count(self.parity[a] ^ self.parity[b]).sum(axis=1, dtype=np.int64) <= allowed
        deeper = np.flatnonzero(out & self.large[a] & self.large[b])
        for at in range(0, len(deeper), 4096):
            rows = deeper[at : at + 4096]
            turn = (self.counts[self.place[a[rows]]] - self.counts[self.place[b[rows]]]) & 15
            out[rows] = np.minimum(turn, 16 - turn).sum(axis=1, dtype=np.int64) <= allowed[rows]
        return out


def described(rows: DataFrame, ranks, key_type: str) -> DataFrame:
    """(_key, _print, n, class, group, bits, prefix) of every row. The prefix holds the rarest elements, as many as a
    link must touch; rows with equal prefix and size are one group, those with equal sets one class. A row without
    words has none of these."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices(batch.column(2), SLICE):
                sets = ordered_sets(batch.column(2).slice(begin, stop - begin), ranks.value)
                n = np.array([len(s) for s in sets], np.int32)
                filled = n > 0
                prefixes = [s[: len(s) - least_size(len(s)) + 1] for s in sets]
                groups = np.array([(finished(p) * np.uint64(3)).sum(dtype=np.uint64) for p in prefixes], np.uint64)
                groups = finished(groups + finished(n.astype(np.uint64)))
                empty = pa.array(~filled)
                found = (fixed_binary(class_ids(sets)), pa.array(groups.view(np.int64)), pa.array(sketches(sets), pa.binary()))
                flat = np.concatenate([*prefixes, np.zeros(0, np.uint64)])
                ends = pa.array(np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32))
                columns = [
                    batch.column(0).slice(begin, stop - begin),
                    batch.column(1).slice(begin, stop - begin),
                    pa.array(n),
                    *[pc.if_else(empty, pa.scalar(None, c.type), c) for c in found],
                    pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "_print", "n", "class", "group", "bits", "prefix"])

    schema = f"_key {key_type}, _print bigint, n int, class binary, `group` bigint, bits binary, prefix array<bigint>"
    return rows.mapInArrow(describe, schema)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def diagonals(sizes: np.ndarray, small: int) -> Iterator[tuple[np.ndarray, int]]:
    """(positions, step): every pair (p, p + step) inside the runs of at most ``small`` rows."""
    inside = np.repeat(sizes, sizes)
    where = np.arange(len(inside)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for step in range(1, small):
        at = np.flatnonzero((inside <= small) & (where + step < inside))
        if not len(at):
            return
        yield at, step


def surviving(token: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, group) of the groups that have a partner by size and position under some token. Rows come
    ordered by token, size and group. Tokens with the same groups get the same bucket."""
    first = np.r_[True, (token[1:] != token[:-1]) | (group[1:] != group[:-1])] if len(token) else np.zeros(0, bool)
    token, group, size, place = token[first], group[first], size[first], place[first]
    head = starts_of(token) if len(token) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[head, len(token)])
    keep = np.zeros(len(token), bool)
    for at, step in diagonals(runs, small):
        one, two = size[at].astype(np.int64), size[at + step].astype(np.int64)
        rest = np.minimum(one - place[at], two - place[at + step])
        near = at[(one >= least_size(two)) & (rest >= least_overlap(one + two))]
        keep[near] = keep[near + step] = True
    # larger runs: the neighbour by size decides
    many = np.repeat(runs > small, runs)
    near = np.zeros(len(token), bool)
    near[1:] = (token[1:] == token[:-1]) & (size[:-1] >= least_size(size[1:].astype(np.int64)))
    keep |= many & (near | np.r_[near[1:], False][: len(near)])
    token, group = token[keep], group[keep]
    if not len(token):
        return token, group
    head = starts_of(token)
    sums = np.add.reduceat(finished(group.view(np.uint64)), head)
    return np.repeat(finished(sums), np.diff(np.r_[head, len(token)])).view(np.int64), group


def group_buckets(rows: DataFrame) -> DataFrame:
    """Stored (bucket, group): groups that may link, by the prefix tokens they share."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            groups = batch.column(0).to_pylist()
            new = []
            for i, g in enumerate(groups):
                if g not in sent:
                    sent.add(g)
                    new.append(i)
            if len(sent) > SENT:
                sent.clear()
            part = batch.take(pa.array(new, pa.int64()))
            counts = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            columns = [
                part.column(2).flatten(),
                pa.array(np.repeat(part.column(0).to_numpy(), counts)),
                pa.array(np.repeat(part.column(1).to_numpy(), counts)),
                pa.array(place.astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["token", "group", "size", "place"])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
        huge = None

        def out(bucket: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(group)], ["bucket", "group"])

        for batch in batches:
            rest = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest)]
            if not len(rest[0]):
                continue
            if huge is not None:
                # more rows of a token whose first ones have left
                cut = int(np.searchsorted(rest[0], huge, side="right"))
                if cut:
                    yield out(np.full(cut, huge, np.int64), rest[1][:cut])
                    rest = [r[cut:] for r in rest]
                if not len(rest[0]):
                    continue
                huge = None
            last = int(np.searchsorted(rest[0], rest[0][-1]))
            if last:
                yield out(*surviving(*[r[:last] for r in rest], SMALL_TOKENS))
                rest = [r[last:] for r in rest]
            if len(rest[0]) > BLOCK:
                huge = rest[0][0]
                yield out(np.full(len(rest[0]), huge, np.int64), rest[1])
                rest = [r[:0] for r in rest]
        yield out(*surviving(*rest, SMALL_TOKENS))

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.where("n > 0").select("group", "n", "prefix").mapInArrow(tokens, "token bigint, `group` bigint, size int, place int")
    dealt = sent.repartition(partitions, "token").sortWithinPartitions("token", "size", "group")
    return materialise(dealt.mapInArrow(share, "bucket bigint, `group` bigint").distinct(), "buckets")


def close(n: np.ndarray, bits: Sketches, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sizes and sketches of the rows a and b allow a link."""
    one, two = n[a], n[b]
    low, high = np.minimum(one, two), np.maximum(one, two)
    out = low >= least_size(high)
    at = np.flatnonzero(out)
    total = (one + two)[at]
    out[at] = bits.apart(a[at], b[at], total - 2 * least_overlap(total))
    return out


def spanning(n: np.ndarray, bits: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect whatever close pairs connect: fewer than there are rows."""
    label = np.arange(len(n))
    left, right = [], []
    for i in range(len(n)):
        others = np.flatnonzero(label != label[i])
        if not len(others):
            break
        others = others[others > i]
        others = others[close(n, bits, others, np.full(len(others), i))]
        if len(others):
            others = others[np.unique(label[others], return_index=True)[1]]
            left.append(np.full(len(others), i))
            right.append(others)
            label[np.isin(label, label[others])] = label[i]
    return np.concatenate(left or [label[:0]]), np.concatenate(right or [label[:0]])


def crossing(n: np.ndarray, bits: Sketches, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All close pairs of different labels."""
    left, right = [], []
    for i in range(len(n)):
        others = np.flatnonzero(label != label[i])
        others = others[others > i]
        others = others[close(n, bits, others, np.full(len(others), i))]
        left.append(np.full(len(others), i))
        right.append(others)
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def candidates(cells: DataFrame, labelled: bool) -> DataFrame:
    """(a, b) of classes that may link, from cells of classes that share a bucket: enough pairs to connect them, or,
    of labelled classes, all pairs with different labels."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(bucket, i, j, ids, n, bits, label) -> pa.RecordBatch:
            head = starts_of(bucket, i, j) if len(n) else np.zeros(0, np.int64)
            runs = np.diff(np.r_[head, len(n)])
            left, right = [], []
            for at, step in diagonals(runs, SMALL):
                at = at[label[at] != label[at + step]] if labelled else at
                at = at[close(n, bits, at, at + step)]
                left.append(at)
                right.append(at + step)
            for begin, size in zip(head[runs > SMALL], runs[runs > SMALL]):
                cell = slice(begin, begin + size)
                a, b = crossing(n[cell], bits[cell], label[cell]) if labelled else spanning(n[cell], bits[cell])
                left.append(a + begin)
                right.append(b + begin)
            a, b = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (left, right))
            return pa.RecordBatch.from_arrays([fixed_binary(ids[a]), fixed_binary(ids[b])], ["a", "b"])

        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            now += [bytes_of(batch.column(3), 16), batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)]
            now += [Sketches.read(batch.column(5)), batch.column(6).to_numpy(zero_copy_only=False)]
            joined = zip(held or [], now)
            held = now if held is None else [h.followed_by(x) if isinstance(x, Sketches) else np.concatenate([h, x]) for h, x in joined]
            if len(held[0]):
                last = int(starts_of(*held[:3])[-1])
                if last:
                    yield found(*[h[:last] for h in held])
                    held = [h[last:] for h in held]
        if held is not None:
            yield found(*held)

    partitions = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(partitions, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "class")
    return dealt.mapInArrow(compare, "a binary, b binary").distinct()


def sets_of(rows: DataFrame, wanted: np.ndarray, ranks) -> DataFrame:
    """Stored (class, set) of the texts whose hash may be wanted, each class once."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            chosen = batch.column(1).filter(pa.array(passes(shared.value, prints)))
            for begin, stop in slices(chosen, SLICE):
                sets = [s for s in ordered_sets(chosen.slice(begin, stop - begin), ranks.value) if len(s)]
                ids = class_ids(sets)
                new = []
                for i, name in enumerate(ids):
                    if name.tobytes() not in sent:
                        sent.add(name.tobytes())
                        new.append(i)
                if len(sent) > SENT:
                    sent.clear()
                kept = [sets[i] for i in new]
                ends = pa.array(np.r_[0, np.cumsum([len(s) for s in kept])].astype(np.int32))
                flat = np.concatenate([*kept, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([fixed_binary(ids[new]), pa.ListArray.from_arrays(ends, pa.array(flat))], ["class", "set"])

    return rows.mapInArrow(emit, "class binary, set array<bigint>")


def linking(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored (a, b, linked): the exact test of the pairs."""
    one = sets.select(F.col("class").alias("a"), F.col("set").alias("_a"))
    two = sets.select(F.col("class").alias("b"), F.col("set").alias("_b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("_o", F.size(F.array_intersect("_a", "_b")))
    union = F.size("_a") + F.size("_b") - F.col("_o")
    return materialise(both.select("a", "b", (LEVEL[1] * F.col("_o").cast("bigint") >= LEVEL[0] * union.cast("bigint")).alias("linked")), "verified")


def split_cells(buckets: DataFrame, classes: DataFrame, label: Column) -> DataFrame:
    """The classes of each bucket; a bucket of over BLOCK classes as cells, one for each pair of its blocks."""
    per_group = materialise(classes.groupBy("group").agg(F.count("*").alias("m")), "groups")
    # groups of several classes are buckets of their own: their members may link with each other
    own = per_group.where("m > 1").select(F.xxhash64("group").alias("bucket"), "group")
    every = buckets.union(own)
    large = every.join(per_group, "group").groupBy("bucket").agg(F.sum("m").alias("m")).where(F.col("m") > BLOCK)
    large = materialise(large.select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("pieces")), "large")
    rows = every.join(classes.withColumn("label", label), "group").join(large, "bucket", "left")
    pieces = F.coalesce("pieces", F.lit(1))
    rows = rows.withColumn("_p", F.pmod(F.xxhash64("class"), pieces).cast("int"))
    rows = rows.withColumn("_q", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return rows.select("bucket", F.least("_p", "_q").alias("i"), F.greatest("_p", "_q").alias("j"), "class", "n", "bits", "label")


def jaccard_components(alerts: DataFrame, *, key: str = "alert_id", text: str = "alert_type") -> DataFrame:
    """(key, n_shingles, component): one row per input row.

    A text's set holds its distinct three-word shingles (A-Z in lower case; the whole sequence if it has fewer
    words). Two texts link if 100 * |intersection| >= 90 * |union|; ``component`` is the smallest key that links reach,
    the row's own included. NULL, empty and wordless texts have no shingles and link with nothing: their component is
    their own key. A NULL key is never the smallest (NULL only if no other is reached); repeated rows are repeated;
    very long texts take part whole; other columns are ignored; an empty table gives an empty result.

    Elements are ordered by how often shingles like them occur, rarest first. Texts with the same prefix and size
    form a group, and equal sets a class, so that copies count once. Groups that share a prefix token and agree in
    size and position meet in buckets; there their classes are expanded and compared by parity sketches, which never
    rule out a link. Candidate pairs are verified on the sets themselves: first as many as connect each bucket, then
    all that remain between components. No bucket is emitted as all its pairs unless it fails to connect.
    """
    spark = alerts.sparkSession
    rows = alerts.select(F.col(key).alias("_key"), content_print(F.col(text)).alias("_print"), F.col(text).cast("string").alias("_text"))
    ranks = spark.sparkContext.broadcast(bucket_ranks(rows.select("_text")))
    stored = materialise(described(rows, ranks, alerts.schema[key].dataType.simpleString()), "described")
    grouped = stored.where("n > 0").groupBy("class", "group", "n", "bits")
    classes = materialise(grouped.agg(F.min("_key").alias("least"), F.min("_print").alias("_print")), "classes")
    buckets = group_buckets(stored)
    cells = split_cells(buckets, classes, F.lit(0).cast("bigint"))
    pairs = materialise(candidates(cells, labelled=False), "pairs")
    named = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    paired = materialise(classes.join(named, "class"), "paired")
    wanted = bit_filter(paired.select(F.col("_print").alias("hash")), FILTER_BITS)
    sets = sets_of(rows.select("_print", "_text"), wanted, ranks)
    sets = materialise(sets.dropDuplicates(["class"]).join(paired.select("class"), "class", "left_semi"), "sets")
    verified = linking(pairs, sets)
    links = verified.where("linked").select("a", "b")
    roots = linked_roots(links).withColumnRenamed("node", "class")
    # what is left: close pairs between different components
    labels = paired.join(roots, "class", "left").select("class", "group", "n", "bits", F.coalesce("root", "class").alias("root"))
    labels = materialise(labels, "labels")
    open_buckets = buckets.join(labels.select("group", "root"), "group").groupBy("bucket")
    open_buckets = open_buckets.agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("bucket")
    rest = split_cells(buckets.join(materialise(open_buckets, "open"), "bucket", "left_semi"), labels, F.xxhash64("root"))
    more = candidates(rest, labelled=True).join(verified.select("a", "b"), ["a", "b"], "left_anti")
    again = linking(materialise(more, "rest"), sets)
    extra = again.where("linked").select("a", "b")
    if not extra.isEmpty():
        roots = linked_roots(links.union(extra)).withColumnRenamed("node", "class")
    rooted = materialise(classes.select("class", "least").join(roots, "class", "left").select("class", "least", F.coalesce("root", "class").alias("root")), "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component")), "least")
    named = materialise(rooted.join(least, "root").select("class", "component"), "named")
    joined = stored.select("_key", "n", "class").join(named, "class", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_key"))
    return joined.select(F.col("_key").alias(key), F.col("n").cast("bigint").alias("n_shingles"), component.alias("component"))
