"""Near-duplicates by SimHash, found through Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.components import components
from riskloom.llm.prints import content_print
from riskloom.session import materialise

SHINGLE = 4
HASH_SEED = 42
MAX_BITS = 4
# the generator polynomial of the perfect binary Golay code (23, 12, 7); a fixed value
GENERATOR = 0xAE3
LENGTH, CHECK_BITS = 23, 11
# segments of a fingerprint: bits 0-22, 23-45, 46-63
SEGMENTS = ((0, 23), (23, 23), (46, 18))
# rows of one key that a task compares at once; larger buckets are compared block by block
BLOCK = 50_000
# buckets up to this size are compared by diagonals, larger ones member by member
SMALL = 12
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str) -> list[int]:
    """XXH64 of every word shingle, repeats included; of the whole sequence if it is shorter."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(LOWER).split()
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(joined, HASH_SEED)] if words else []
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], HASH_SEED) for s, e in zip(starts[: 1 - SHINGLE].tolist(), (ends[SHINGLE - 1 :] - 1).tolist())]


def majority(hashes: list[int]) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    voted = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(voted.view("<i8")[0])


def fingerprints(alerts: DataFrame, *, key: str = "alert_id", text: str = "alert_type") -> DataFrame:
    """(_key, _print, fingerprint bigint), one row per input row; ``_print`` tells texts of one key apart. NULL text
    and text without words: 0."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, int] = {}
            out = []
            for value in batch.column(2).to_pylist():
                found = seen.get(value)
                if found is None:
                    found = seen[value] = majority(shingle_hashes(value or ""))
                out.append(found)
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_print", "fingerprint"])

    rows = alerts.select(
        F.col(key).alias("_key"), content_print(F.col(text)).alias("_print"), F.col(text).cast("string").alias("_text")
    )
    kind = dict(rows.dtypes)["_key"]
    return rows.mapInArrow(compute, f"_key {kind}, _print bigint, fingerprint bigint")


class Golay:
    """Decoder: for a 23-bit word, the indices (upper 12 bits) of all codewords at distance 4 or less.

    Every word is within 3 of exactly one codeword, and words at 3 have five more at 4: one or six in all. Two
    words at distance 2 or less have a word within 1 of both, whose codeword within 3 is within 4 of both: they
    share an index.
    """

    def __init__(self):
        remainder = np.zeros(1 << LENGTH, np.uint16)
        for bit in range(LENGTH):
            value = 1 << bit
            for high in range(bit, CHECK_BITS - 1, -1):
                if value >> high & 1:
                    value ^= GENERATOR << (high - CHECK_BITS)
            remainder[1 << bit : 2 << bit] = remainder[: 1 << bit] ^ np.uint16(value)
        self.remainder = remainder
        by_syndrome: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
        for weight in range(5):
            for bits in combinations(range(LENGTH), weight):
                error = sum(1 << b for b in bits)
                by_syndrome[remainder[error]].append(error)
        # a word within 2 of its codeword has no other within 4; errors come by rising weight
        self.count = np.array([len(e) for e in by_syndrome])
        self.errors = np.array([e + [e[0]] * (6 - len(e)) for e in by_syndrome], np.uint32)

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices, valid), both of shape (words, 6)."""
        syndrome = self.remainder[words]
        codewords = words.astype(np.uint32)[:, None] ^ self.errors[syndrome]
        return (codewords >> np.uint32(CHECK_BITS)).astype(np.uint64), np.arange(6) < self.count[syndrome][:, None]


def bucket_keys(values: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) pairs so that any two fingerprints at distance 4 or less share a bucket.

    With a + b + c <= 4 errors in the segments: if a segment is free of errors, one of the other two has at most
    2, and (that segment as it is, index of the other) agrees; these are families 0 to 5. If none is free, no
    segment has more than 2, and the indices of the first two agree: family 6.
    """
    a, b, c = ((values >> np.uint64(at)) & np.uint64((1 << width) - 1) for at, width in SEGMENTS)
    near = {name: golay.near(word) for name, word in (("a", a), ("b", b), ("c", c))}
    rows = np.arange(len(values))
    keys, owners = [], []

    def add(family: int, exact: np.ndarray, name: str) -> None:
        indices, valid = near[name]
        packed = (np.uint64(family) << np.uint64(36)) | (exact[:, None] << np.uint64(12)) | indices
        keys.append(packed[valid])
        owners.append(np.broadcast_to(rows[:, None], valid.shape)[valid])

    for family, (exact, name) in enumerate(((a, "b"), (b, "a"), (c, "a"), (c, "b"), (a, "c"), (b, "c"))):
        add(family, exact, name)
    (first, ok), (second, fine) = near["a"], near["b"]
    valid = ok[:, :, None] & fine[:, None, :]
    pairs = ((first[:, :, None] << np.uint64(12)) | second[:, None, :])[valid]
    owner = np.broadcast_to(rows[:, None, None], valid.shape)[valid]
    for third in range(3):
        part = (c >> np.uint64(6 * third)) & np.uint64(63)
        keys.append((np.uint64(6 + third) << np.uint64(36)) | (pairs << np.uint64(6)) | part[owner])
        owners.append(owner)
    return np.concatenate(keys), np.concatenate(owners)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_BITS


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever ``values`` within MAX_BITS connect: at most one fewer than values."""
    label = np.arange(len(values))
    found = []
    for i in range(len(values)):
        others = np.flatnonzero(label != label[i])
        if not len(others):
            break
        others = others[others > i]
        for j in others[close(values[others], values[i])]:
            if label[j] != label[i]:
                found.append((i, int(j)))
                label[label == label[j]] = label[i]
    return found


def bucket_links(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole buckets; ``keys`` ascending."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    inside = np.repeat(sizes, sizes)
    where = np.arange(len(keys)) - np.repeat(starts, sizes)
    for step in range(1, SMALL):
        at = np.flatnonzero((inside <= SMALL) & (where + step < inside))
        if not len(at):
            break
        at = at[close(values[at], values[at + step])]
        left.append(values[at])
        right.append(values[at + step])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        group = values[start : start + size]
        pairs = np.array(forest(group), np.int64).reshape(-1, 2)
        left.append(group[pairs[:, 0]])
        right.append(group[pairs[:, 1]])
    return np.concatenate(left or [values[:0]]), np.concatenate(right or [values[:0]])


def near_links(distinct: DataFrame) -> DataFrame:
    """Stored links (a, b) over distinct fingerprints that have the connected components of all pairs within
    MAX_BITS. Buckets are compared in tasks; buckets of over BLOCK rows leave as blocks, and every pair of their
    blocks is compared in a task of its own."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                keys, owners = bucket_keys(part, golay)
                columns = [pa.array(keys.view(np.int64)), pa.array(part[owners].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "value"])

    def links(kind: int, bucket, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(a), kind, np.int8), np.broadcast_to(np.int64(bucket), len(a)), a.view(np.int64), b.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "bucket", "a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_keys, rest = np.empty(0, np.int64), np.empty(0, np.uint64)
        blocks = (None, 0)
        for batch in batches:
            keys = np.concatenate([rest_keys, batch.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([rest, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last:
                whole = slice(0, last)
                if blocks[0] is not None and keys[0] == blocks[0]:
                    # the end of a bucket whose first blocks have left
                    cut = int(np.searchsorted(keys, keys[0], side="right"))
                    yield links(1, keys[0], values[:cut], np.full(cut, blocks[1], np.uint64))
                    whole = slice(cut, last)
                yield links(0, 0, *bucket_links(keys[whole], values[whole]))
                keys, values = keys[last:], values[last:]
            while len(values) > BLOCK:
                number = blocks[1] if blocks[0] == keys[0] else 0
                yield links(1, keys[0], values[:BLOCK], np.full(BLOCK, number, np.uint64))
                blocks = (keys[0], number + 1)
                keys, values = keys[BLOCK:], values[BLOCK:]
            rest_keys, rest = keys, values
        if len(rest):
            if blocks[0] == rest_keys[0]:
                yield links(1, rest_keys[0], rest, np.full(len(rest), blocks[1], np.uint64))
            else:
                yield links(0, 0, *bucket_links(rest_keys, rest))

    def block_pair(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows["a"].drop_duplicates().to_numpy().view(np.uint64)
        pairs = np.array(forest(values), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": values[pairs[:, 0]].view(np.int64), "b": values[pairs[:, 1]].view(np.int64)})

    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select("fingerprint").mapInArrow(emit, "bucket bigint, value bigint")
    # as many tasks as configured: their rows take far more memory in Python than their bytes suggest
    rows = rows.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    found = materialise(rows.mapInArrow(compare, "kind tinyint, bucket bigint, a bigint, b bigint"), "compared")
    direct = found.where("kind = 0").select("a", "b")
    large = found.where("kind = 1").select("bucket", "a", F.col("b").alias("block"))
    blocks = large.groupBy("bucket").agg(F.max("block").alias("_last"))
    # block p meets every block q: both land in the group (min, max)
    paired = large.join(blocks, "bucket").withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    paired = paired.withColumns({"_i": F.least("block", "_q"), "_j": F.greatest("block", "_q")})
    crossed = paired.groupBy("bucket", "_i", "_j").applyInPandas(block_pair, "a bigint, b bigint")
    return materialise(direct.union(crossed).distinct(), "near")


def near_duplicates(alerts: DataFrame, *, key: str = "alert_id", text: str = "alert_type") -> DataFrame:
    """(key, fingerprint, component, group, _print): one row per input row.

    Texts link if their 64-bit fingerprints over four-word shingles differ in at most four bits; ``component`` is
    the smallest key that links reach, the row's own included. Equal fingerprints are one node, so copies cost
    one row each and are never paired. ``group`` identifies the component (its smallest fingerprint) even where
    rows share keys; ``_print`` is a hash of the text. NULL and wordless texts have fingerprint 0 and link like others; a NULL key
    is never the smallest (NULL only if its component has no other); repeated rows are repeated; an empty table
    gives an empty result. Extra columns are ignored: join on the key to carry them.
    """
    rows = materialise(fingerprints(alerts, key=key, text=text), "fingerprints")
    distinct = materialise(rows.groupBy("fingerprint").agg(F.min("_key").alias("_least")), "distinct")
    roots = components(near_links(distinct)).select(F.col("node").alias("fingerprint"), "root")
    rooted = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    rooted = materialise(rooted, "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("_least").alias("component")), "least")
    named = materialise(rooted.join(least, "root").select("fingerprint", "root", "component"), "named")
    joined = rows.join(named, "fingerprint")
    return joined.select(F.col("_key").alias(key), "fingerprint", "component", F.col("root").alias("group"), "_print")
