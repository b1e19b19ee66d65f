"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from riskloom.llm.filters import bit_filter, passes
from riskloom.llm.prints import content_print
from riskloom.llm.words import FOLDED, Words, words_of
from riskloom.session import materialise

WINDOW = 13
# words of a shingle; a window of fewer words is one shingle
SHINGLE = 5
# size of the filter that the scan of the texts tests
FILTER_BITS = 24
EMPTY = "array<struct<first: int, words: string>>"


def benchmark_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Stored (item, window, n_window, hashes): every window of every item with its shingles in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words_of(batch.column(1), FOLDED)
            hashes = {n: found.shingles(n).view(np.int64) for n in range(1, SHINGLE + 1)}
            for number, name in enumerate(batch.column(0).to_pylist()):
                begin, stop = int(found.first[number]), int(found.first[number + 1])
                size = min(WINDOW, stop - begin)
                if not size:
                    continue
                width = min(SHINGLE, size)
                rows = range(begin, stop - size + 1)
                columns = [
                    pa.array([name] * len(rows), batch.schema.field(0).type),
                    pa.array([found.joined(w, w + size).decode() for w in rows], pa.string()),
                    pa.array([size] * len(rows), pa.int32()),
                    pa.array([hashes[width][w : w + size - width + 1] for w in rows], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["item", "window", "n_window", "hashes"])

    kind = dict(benchmark.dtypes)[item]
    schema = f"item {kind}, window string, n_window int, hashes array<bigint>"
    rows = benchmark.select(F.col(item), F.col(text).cast("string")).mapInArrow(cut, schema)
    return materialise(rows, "windows")


def filtered_places(found: Words, widths: list[int], table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, words, hashes) of the shingles that pass the filter and fit into their text."""
    left = found.left()
    for width in widths:
        hashes = found.shingles(width)
        at = np.flatnonzero(passes(table, hashes) & (left >= width))
        yield width, at, hashes[at]


def text_runs(rows: DataFrame, widths: list[int], table) -> DataFrame:
    """Stored (_key, _print, n_words, runs): the stretches of every text around shingles of the benchmark, each
    with WINDOW - 1 words of margin; texts without any have no runs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            found = words_of(batch.column(2), FOLDED)
            spans = [np.stack([at, at + width]) for width, at, _ in filtered_places(found, widths, bits)]
            spans = np.concatenate([np.zeros((2, 0), np.int64), *spans], axis=1)
            spans = spans[:, np.argsort(spans[0], kind="stable")]
            text = np.searchsorted(found.first, spans[0], side="right") - 1
            low = np.maximum(spans[0] - (WINDOW - 1), found.first[text])
            high = np.minimum(spans[1] + WINDOW - 1, found.first[text + 1])
            reach = np.maximum.accumulate(high) if len(high) else high
            # windows across a gap of more than a window cannot hold both shingles
            fresh = np.r_[True, (text[1:] != text[:-1]) | (low[1:] > reach[:-1])] if len(text) else np.zeros(0, bool)
            runs: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            heads = np.flatnonzero(fresh)
            for head, tail in zip(heads, np.r_[heads[1:], len(fresh)]):
                owner, begin, stop = int(text[head]), int(low[head]), int(reach[tail - 1])
                runs[owner].append({"first": begin - int(found.first[owner]), "words": found.joined(begin, stop).decode()})
            kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.string())]))
            columns = [batch.column(0), batch.column(1), pa.array(np.diff(found.first)), pa.array(runs, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_print", "n_words", "runs"])

    kind = dict(rows.dtypes)["_key"]
    return materialise(rows.mapInArrow(scan, f"_key {kind}, _print bigint, n_words bigint, runs {EMPTY}"), "runs")


def run_shingles(runs: DataFrame, widths: list[int], table=None) -> DataFrame:
    """Every shingle of the runs as (hash); with a filter, those that pass, as (hash, _key, _print, at, first,
    around): the text's word number of the shingle, and its surroundings from word ``first`` on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words_of(batch.column("words"), FOLDED)
            left = found.left()
            for width in widths:
                hashes = found.shingles(width)[left >= width]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words_of(batch.column("words"), FOLDED)
            text, firsts = found.text_of(), batch.column("first").to_numpy()
            for _, places, hashes in filtered_places(found, widths, table.value):
                owner = text[places]
                low = np.maximum(places - (WINDOW - 1), found.first[owner])
                high = np.minimum(places + WINDOW, found.first[owner + 1])
                shift = firsts[owner] - found.first[owner]
                columns = [
                    pa.array(hashes.view(np.int64)),
                    batch.column("_key").take(pa.array(owner)),
                    batch.column("_print").take(pa.array(owner)),
                    pa.array((places + shift).astype(np.int32)),
                    pa.array((low + shift).astype(np.int32)),
                    pa.array([found.joined(a, b).decode() for a, b in zip(low.tolist(), high.tolist())], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "_key", "_print", "at", "first", "around"])

    flat = runs.select("_key", "_print", F.explode("runs").alias("run")).select("_key", "_print", "run.first", "run.words")
    if table is None:
        return flat.mapInArrow(count, "hash bigint")
    kind = dict(runs.dtypes)["_key"]
    return flat.mapInArrow(pick, f"hash bigint, _key {kind}, _print bigint, at int, first int, around string")


def contaminated(
    alerts: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "alert_id",
    text: str = "alert_type",
    item: str = "item_id",
    item_text: str = "text",
    share: int = 20,
) -> DataFrame:
    """One row per input row: key, ``n_words``, ``n_hit`` (words inside any occurrence of a benchmark window),
    ``n_items``, ``items`` (their ids as sorted strings), ``contaminated`` (hit words are at least 1 / ``share`` of
    all), and ``_print``, a hash of the text.

    Words are runs of digits, letters and characters beyond ASCII, with A-Z in lower case. A window is 13
    consecutive words of an item, or all words of a shorter one. Windows are sets of five-word shingles ordered by
    rarity in the texts. Containment must be whole, so the necessary prefix of a window is its rarest shingle
    alone; texts and windows join on it, the window must fit into the text around it, and then its words are
    compared one by one.

    NULL and wordless texts have no words and are clean; items without words have no windows; an item with a NULL
    id marks words but is not listed; repeated items count once; repeated rows are repeated; a NULL key is kept;
    an empty benchmark leaves everything clean. Extra columns are ignored.
    """
    spark: SparkSession = alerts.sparkSession
    windows = benchmark_windows(benchmark, item, item_text)
    parts = windows.select("window", "n_window", F.posexplode("hashes").alias("offset", "hash"))
    # at most SHINGLE values
    narrow = F.least(F.col("n_window"), F.lit(SHINGLE))
    widths = sorted(r[0] for r in windows.select(narrow.alias("w")).distinct().collect())
    rows = alerts.select(F.col(key).alias("_key"), content_print(F.col(text)).alias("_print"), F.col(text).cast("string"))
    everything = spark.sparkContext.broadcast(bit_filter(parts, FILTER_BITS))
    runs = text_runs(rows, widths, everything)

    # rarity over all texts; shingles that no text has are the rarest
    counts = run_shingles(runs, widths).groupBy("hash").agg(F.count("*").alias("n"))
    ranked = parts.distinct().join(counts, "hash", "left")
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "hash", "n_window")
    prefix = ranked.groupBy("window").agg(F.min(order).alias("_r")).where("_r.n > 0")
    prefix = materialise(prefix.select("window", "_r.offset", "_r.hash", "_r.n_window"), "prefix")

    needed = spark.sparkContext.broadcast(bit_filter(prefix, FILTER_BITS))
    candidates = materialise(run_shingles(runs, widths, needed).distinct(), "candidates")
    begin = F.col("at") - F.col("offset")
    around = F.split("around", " ")
    fits = (begin >= F.col("first")) & (begin - F.col("first") + F.col("n_window") <= F.size(around))
    same = F.array_join(F.slice(around, begin - F.col("first") + 1, F.col("n_window")), " ") == F.col("window")
    pairs = candidates.join(prefix, "hash").where(fits)
    matches = pairs.where(same).select("_key", "_print", begin.alias("begin"), "n_window", "window").distinct()
    matches = materialise(matches, "matches")

    # covered words: each window adds what reaches beyond the windows that begin earlier
    text_key = ["_key", "_print"]
    earlier = W.partitionBy(*text_key).orderBy("begin", "n_window", "window").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("begin") + F.col("n_window")
    reach = F.coalesce(F.max(end).over(earlier), F.lit(0))
    added = matches.withColumn("_new", F.greatest(F.lit(0), end - F.greatest(reach, F.col("begin"))))
    hit = added.groupBy(*text_key).agg(F.sum("_new").alias("n_hit"))

    owners = materialise(windows.where("item IS NOT NULL").select("window", "item").distinct(), "owners")
    listed = materialise(matches.select(*text_key, "window").distinct(), "listed").join(owners, "window")
    listed = listed.groupBy(*text_key, "item").agg(F.lit(1).alias("_one")).groupBy(*text_key)
    listed = listed.agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"_key": "_k", "_print": "_p"})
        on = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_print") == F.col("_p"))
        return left.join(right, on, "left").drop("_k", "_p")

    found = beside(hit, listed)
    result = beside(runs.select("_key", "_print", "n_words"), materialise(found, "found"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return result.select(
        F.col("_key").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        "_print",
    )
