"""Passages that repeat across texts, found exactly through super-k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm.filters import bit_filter, passes
from riskloom.llm.prints import content_print
from riskloom.llm.words import UNCHANGED, Words, words_of
from riskloom.session import materialise

WINDOW = 50
# words of a minimiser
MINIMISER = 10
# size of the filter of shared minimisers that the second scan tests
FILTER_BITS = 26
# size of the filter of texts with repeats
TEXT_BITS = 24
# distinct windows of a bucket that a task holds; the rest of a larger bucket is grouped by window
HELD = 200_000
SPAN = "array<struct<begin: int, stop: int>>"


def super_kmers(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, minimiser) of the longest runs of windows of one text with one minimiser, the smallest
    shingle hash in the window."""
    smallest = found.shingles(MINIMISER) if len(found.hashed) else found.hashed
    span, width = WINDOW - MINIMISER + 1, 1
    while width < span:
        step = min(width, span - width)
        reached = smallest.copy()
        np.minimum(smallest[:-step], smallest[step:], out=reached[: max(0, len(smallest) - step)])
        smallest, width = reached, width + step
    whole = found.left() >= WINDOW
    fresh = whole.copy()
    fresh[1:] &= ~whole[:-1] | (smallest[1:] != smallest[:-1])
    first = np.flatnonzero(fresh)
    # a run ends before the next run or the next place without a window
    edge = np.flatnonzero(fresh | ~whole)
    stop = np.append(edge, len(whole))[np.searchsorted(edge, first, side="right")]
    return first, stop - first, smallest[first]


def shared_minimisers(rows: DataFrame) -> DataFrame:
    """(hash) of the minimisers that at least two keys have."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words_of(batch.column("text"), UNCHANGED)
            first, _, smallest = super_kmers(found)
            owner = np.searchsorted(found.first, first, side="right") - 1
            columns = [pa.array(smallest.view(np.int64)), batch.column("_key").take(pa.array(owner))]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "_key"])

    kind = dict(rows.dtypes)["_key"]
    found = rows.mapInArrow(scan, f"hash bigint, _key {kind}")
    ends = found.groupBy("hash").agg(F.min("_key").alias("low"), F.max("_key").alias("high"))
    return ends.where("low < high").select("hash")


def packed_runs(rows: DataFrame, table) -> DataFrame:
    """(hash, _key, _print, begin, packed): the super-k-mers whose minimiser passes, as one string of words each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words_of(batch.column("text"), UNCHANGED)
            first, windows, smallest = super_kmers(found)
            kept = passes(table.value, smallest)
            first, windows, smallest = first[kept], windows[kept], smallest[kept]
            owner = np.searchsorted(found.first, first, side="right") - 1
            begin = (first - found.first[owner]).astype(np.int32)
            for at in range(0, len(first), 20_000):
                part = slice(at, at + 20_000)
                packed = [found.joined(a, a + n + WINDOW - 1) for a, n in zip(first[part].tolist(), windows[part].tolist())]
                columns = [
                    pa.array(smallest[part].view(np.int64)),
                    batch.column("_key").take(pa.array(owner[part])),
                    batch.column("_print").take(pa.array(owner[part])),
                    pa.array(begin[part]),
                    pa.array(packed, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "_key", "_print", "begin", "packed"])

    kind = dict(rows.dtypes)["_key"]
    return rows.mapInArrow(scan, f"hash bigint, _key {kind}, _print bigint, begin int, packed binary")


def windows_of(packed: bytes) -> list[bytes]:
    gaps = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist()
    starts = [0, *(g + 1 for g in gaps)]
    ends = [*gaps, len(packed)]
    return [packed[s:e] for s, e in zip(starts, ends[WINDOW - 1 :])]


class Bucket:
    """The windows of one minimiser, offered by ascending key: a window that a smaller key had is a repeat."""

    def __init__(self):
        self.runs: dict[bytes, object] = {}
        self.windows: dict[bytes, object] = {}
        self.open = True

    def spans(self, key, begin: int, packed: bytes) -> list[tuple[int, int]]:
        """Word ranges of ``packed`` under repeated windows."""
        count = packed.count(b" ") - WINDOW + 2
        if self.runs.setdefault(packed, key) < key:
            return [(begin, begin + count + WINDOW - 1)]
        out: list[tuple[int, int]] = []
        for number, window in enumerate(windows_of(packed)):
            if self.windows.setdefault(window, key) < key:
                at = begin + number
                if out and at <= out[-1][1]:
                    out[-1] = (out[-1][0], at + WINDOW)
                else:
                    out.append((at, at + WINDOW))
        return out


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Stored (_key, _print, begin, stop): word ranges covered by windows that also stand under a smaller key.

    Sorted buckets pass through the tasks key by key. A bucket of over HELD distinct windows sends what it has seen
    and the windows still to come to a grouping by window, which knows no buckets."""
    kind = dict(rows.dtypes)["_key"]
    names = ["_key", "_print", "begin", "stop", "window"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bucket = None, Bucket()
        for batch in batches:
            out: list[tuple] = []
            for hashed, key, text, begin, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if hashed != current:
                    current, bucket = hashed, Bucket()
                if bucket.open:
                    out += [(key, text, low, high, None) for low, high in bucket.spans(key, begin, packed)]
                    if len(bucket.windows) > HELD:
                        bucket.open = False
                        for at, (window, first) in enumerate(bucket.windows.items()):
                            out.append((first, None, None, None, window))
                            if len(out) >= 20_000:
                                yield table(out)
                                out = []
                        bucket.windows, bucket.runs = {}, {}
                else:
                    out += [(key, text, begin + n, begin + n + WINDOW, w) for n, w in enumerate(windows_of(packed))]
                if len(out) >= 20_000:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        kinds = [None, pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        columns = [pa.array(c, k) if k else pa.array(c) for c, k in zip(zip(*out), kinds)]
        return pa.RecordBatch.from_arrays(columns, names)

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(partitions, "hash").sortWithinPartitions("hash", "_key")
    found = materialise(
        sorted_rows.mapInArrow(compare, f"_key {kind}, _print bigint, begin int, stop int, window binary"), "spans"
    )
    direct = found.where("window IS NULL").select("_key", "_print", "begin", "stop")
    large = found.where("window IS NOT NULL")
    least = materialise(large.groupBy("window").agg(F.min("_key").alias("_least")), "least")
    later = large.where("begin IS NOT NULL").join(least, "window").where("_least < _key")
    return materialise(direct.union(later.select("_key", "_print", "begin", "stop")), "repeats")


def without_repeats(alerts: DataFrame, *, key: str = "alert_id", text: str = "alert_type") -> DataFrame:
    """One row per input row: key, ``n_words``, ``n_removed``, ``kept`` (the text without its repeats, words joined
    by one blank; NULL where nothing was removed) and ``kept_sha256`` (of the kept words in any case).

    Words are runs other than ASCII white space, unchanged. A window is 50 consecutive words of one text. Every
    word covered by a window that also stands in a text with a smaller key is removed; all windows are judged on
    the input. Consecutive windows that share a minimiser travel as one string to its bucket. Minimisers that
    only one key has cannot repeat and stay where they are.

    NULL texts have no words. A NULL key is neither smaller nor larger than another: its windows neither remove
    nor go. Rows of one key do not remove each other, so repeated rows keep the same words. Texts of fewer than 50
    words stay whole. An empty table gives an empty result. Extra columns are ignored.
    """
    spark: SparkSession = alerts.sparkSession
    rows = alerts.select(
        F.col(key).alias("_key"), content_print(F.col(text)).alias("_print"), F.col(text).cast("string").alias("text")
    )
    keyed = rows.where("_key IS NOT NULL")
    table = spark.sparkContext.broadcast(bit_filter(shared_minimisers(keyed.select("_key", "text")), FILTER_BITS))
    spans = repeated_spans(packed_runs(keyed, table))
    marked = spark.sparkContext.broadcast(bit_filter(spans.select(F.xxhash64("_key", "_print").alias("hash")), TEXT_BITS))

    def sha(words: list[bytes]) -> str:
        return hashlib.sha256(b" ".join(words)).hexdigest()

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = passes(marked.value, batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64))
            texts = batch.column("text").to_pylist()
            words = [(t or "").encode().split() for t in texts]
            columns = [
                batch.column("_key"),
                batch.column("_print"),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([None if m else sha(w) for w, m in zip(words, maybe)], pa.string()),
                pa.array([t if m else None for t, m in zip(texts, maybe)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_print", "n_words", "kept_sha256", "text"])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, digests = [], [], []
            for digest, value, spans in zip(*(batch.column(c).to_pylist() for c in ("kept_sha256", "text", "spans"))):
                if digest is None:
                    words = (value or "").encode().split()
                    gone = np.zeros(len(words), bool)
                    for span in spans or []:
                        gone[span["begin"] : span["stop"]] = True
                    left = [words[w] for w in np.flatnonzero(~gone)]
                    removed.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode() if removed[-1] else None)
                    digests.append(sha(left))
                else:
                    removed.append(0)
                    kept.append(None)
                    digests.append(digest)
            columns = [
                batch.column("_key"),
                batch.column("n_words"),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.string()),
                pa.array(digests, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_words", "n_removed", "kept", "kept_sha256"])

    kind = dict(rows.dtypes)["_key"]
    first = rows.withColumn("hash", F.xxhash64("_key", "_print")).mapInArrow(
        untouched, f"_key {kind}, _print bigint, n_words bigint, kept_sha256 string, text string"
    )
    grouped = spans.groupBy("_key", "_print").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    joined = first.join(grouped, ["_key", "_print"], "left").select("_key", "n_words", "kept_sha256", "text", "spans")
    return joined.mapInArrow(
        cleaned, f"`{key}` {kind}, n_words bigint, n_removed bigint, kept string, kept_sha256 string"
    )
