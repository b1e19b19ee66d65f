"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.llm.ordering import prefix_sums, range_sorted
from riskloom.session import materialise

WHITE = "\t\n\x0b\f\r "
# a word and the white space behind it
WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
# the weight cycle of the sources in code-point order
WEIGHTS = 3
# how often one record may be repeated
MAX_REPEATS = 3
# a source's shuffled records are cut into 2**SLICE_BITS hash ranges, so that no task orders a whole source
TICKET_BITS, SLICE_BITS = 60, 12


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; NULL has none."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.coalesce(F.length(F.regexp_replace(bare, WORD, ".")), F.lit(0)).cast("bigint")


def shuffle_ticket(key: Column, seed: int) -> Column:
    """A record's place in the shuffled order of its source: the first 60 bits of a keyed digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, TICKET_BITS // 4), 16, 10).cast("bigint")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_targets(sized: DataFrame) -> DataFrame:
    """(_source, source_size, target) from (_source, _size): sources in code-point order, NULL last, weigh 1, 2,
    3, 1, ... and share the total; a target stops at MAX_REPEATS times its source's size and the excess goes to
    the others by weight.

    With the sources ordered by size / weight, the common level once the first k are full is
    (total - their caps) / (weight of the rest); it rises while sources fill up and falls afterwards, so the
    final level is its maximum.
    """
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("source_size")).withColumn("_one", F.lit(1))
    last = F.col("_source") == "n"
    ranked = prefix_sums(totals, [last, F.col("_source")], ["_one"], "sources")
    capped = ranked.select(
        "_source",
        "source_size",
        (F.col("_one_before") % WEIGHTS + 1).alias("_weight"),
        (F.col("source_size") * MAX_REPEATS).alias("_cap"),
    )
    filled = prefix_sums(capped, [F.col("_cap") / F.col("_weight"), F.col("_source")], ["_cap", "_weight"], "levels")
    filled = materialise(filled, "filled")
    total, weights = filled.agg(F.sum("source_size")).scalar(), filled.agg(F.sum("_weight")).scalar()
    level = filled.agg(
        F.max((total - F.col("_cap_before")).cast("double") / (weights - F.col("_weight_before")).cast("double"))
    )
    target = F.least(F.col("_cap").cast("double"), level.scalar() * F.col("_weight").cast("double"))
    return materialise(filled.select("_source", "source_size", target.alias("target")), "targets")


def finish_time(repeat: Column) -> Column:
    """Virtual finish of one repeat: the source's words up to and with it, divided by the source's target."""
    words = F.col("_upto") + repeat * F.col("source_size")
    return words.cast("double") / F.col("target")


def sized_records(records: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    return records.select(
        "*",
        source_key(F.col(source)).alias("_source"),
        word_count(F.col(text)).alias("_size"),
        shuffle_ticket(F.col(key), seed).alias("_ticket"),
    ).withColumn("_slice", F.shiftright("_ticket", TICKET_BITS - SLICE_BITS))


def queued(sized: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Adds the source's words up to and with each record in shuffled order. The join and the window share one
    exchange, on (source, slice)."""
    inside = W.partitionBy("_source", "_slice").orderBy("_ticket", key, "_size")
    upto = F.sum("_size").over(inside.rowsBetween(W.unboundedPreceding, 0)) + F.col("_before")
    return sized.join(starts, ["_source", "_slice"]).withColumn("_upto", upto)


def truncation(queue: DataFrame, budget: int) -> float:
    """The last virtual finish time within the budget, over the globally range-sorted repeats. Repeats with equal
    finish times go together."""
    repeats = queue.where("_size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))).alias("_r"))
    ordered = range_sorted(repeats.select(finish_time(F.col("_r")).alias("finish"), "_size"), [F.col("finish")], "mix")
    # one row per partition
    parts = ordered.groupBy("_part").agg(F.sum("_size"), F.max("finish")).orderBy("_part").collect()
    spent, cut = 0, 0.0
    for part, words, last in parts:
        if spent + words > budget:
            upto = F.sum("_size").over(W.orderBy("finish").rangeBetween(W.unboundedPreceding, 0))
            inside = ordered.where(F.col("_part") == part).withColumn("_sum", upto).where(F.col("_sum") <= budget - spent)
            return max(cut, inside.agg(F.max("finish")).first()[0] or 0.0)
        spent, cut = spent + words, last
    return cut


def mixing_plan(
    alerts: DataFrame,
    *,
    key: str = "alert_id",
    text: str = "alert_type",
    source: str = "layout_name",
    seed: int = 42,
) -> DataFrame:
    """All input rows and columns with ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted),
    ``repeats`` (whole copies taken) and ``first_finish``, the virtual finish time of the first copy.

    Records are taken whole. Every source's records are shuffled by a keyed digest of the key and queued up to
    three times; the queues merge by virtual finish time, and the merged list is cut at the words of the corpus.
    A source misses its target by less than its largest record at the cut.

    NULL text or text without words has size 0 and takes 0 words. NULL is a source of its own and comes last; a
    NULL key is shuffled like any other. Rows with equal key and size are interchangeable, and each repeated row
    counts. An empty table gives an empty plan. Existing columns named like the added ones are replaced.
    """
    added = {"size", "source_size", "target", "taken", "repeats", "first_finish"}
    if clash := {key, text, source} & added:
        raise ValueError(f"rename the input columns {sorted(clash)}: the plan adds columns of these names")
    kept = [c for c in alerts.columns if c not in added]
    # numbered names inside: no column of the input can clash with a working column
    safe = alerts.select(*kept).toDF(*[f"c{i}" for i in range(len(kept))])
    key, text, source = (f"c{kept.index(c)}" for c in (key, text, source))
    sized = sized_records(safe, key, text, source, seed)
    slim = materialise(sized.select(key, "_source", "_size", "_ticket", "_slice"), "sizes")
    targets = source_targets(slim)
    slices = slim.groupBy("_source", "_slice").agg(F.sum("_size").alias("_words"))
    earlier = W.partitionBy("_source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = slices.select("_source", "_slice", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    starts = materialise(starts.join(targets, "_source"), "starts")
    budget = slim.agg(F.sum("_size")).first()[0] or 0
    cut = truncation(queued(slim, starts, key), budget)
    repeats = sum(
        (F.when(finish_time(F.lit(r)) <= F.lit(cut), 1).otherwise(0) for r in range(MAX_REPEATS)), F.lit(0)
    )
    taken = F.when(F.col("_size") > 0, repeats).otherwise(0)
    # only the columns that the caller keeps travel through the exchange
    return queued(sized, starts, key).select(
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(kept)],
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (taken * F.col("_size")).alias("taken"),
        taken.cast("int").alias("repeats"),
        F.when(F.col("_size") > 0, finish_time(F.lit(0))).alias("first_finish"),
    )


def mixed(alerts: DataFrame, *, key: str = "alert_id", text: str = "alert_type", source: str = "layout_name", seed: int = 42) -> DataFrame:
    """The mix itself: the input's columns, each record as often as mixing_plan takes it."""
    names = list(alerts.columns)
    safe = alerts.toDF(*[f"c{i}" for i in range(len(names))])
    key, text, source = (f"c{names.index(c)}" for c in (key, text, source))
    plan = mixing_plan(safe, key=key, text=text, source=source, seed=seed)
    copies = plan.where("repeats > 0").select(*safe.columns, F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return copies.select(*safe.columns).toDF(*names)
