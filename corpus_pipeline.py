"""Documents to training shards: toxicity, near-duplicates, benchmark passages, source mix, token shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from riskloom.llm.decontamination import contaminated
from riskloom.llm.mixing import mixed
from riskloom.llm.prints import content_print
from riskloom.llm.queries import fold, table
from riskloom.llm.shards import write_training_order
from riskloom.llm.simhash import near_duplicates
from riskloom.llm.toxicity import score_toxicity, train_toxicity
from riskloom.session import materialise, work_path


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with numbered columns, so that no name of theirs clashes with a working column."""
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the field does not predict toxic. It learns from the labels outside the held-out
    fold, as op2 does. Documents without words score 0 and stay; NULLs in any column, repeated rows and columns of any
    name are kept as they are; an empty table stays empty, and without labels nothing is toxic."""
    labels = table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels, key="doc_id", text="text", label="toxic", where=fold(5) != 0)
    safe, name = numbered(docs)
    scored = score_toxicity(safe, model, key=name["doc_id"], text=name["text"])
    return scored.where("predicted = 0").select(*safe.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component: the one with the smallest id (a NULL id comes last),
    and of rows with one id and text the first by the other columns."""
    safe, name = numbered(docs)
    rows = near_duplicates(docs, key="doc_id", text="text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_unnamed"), F.col("doc_id").alias("_kept"), "_print"))
    kept = materialise(rows.groupBy("group").agg(first.alias("_f")).select("_f._kept", "_f._print"), "kept")
    marked = safe.withColumn("_text_print", content_print(F.col(name["text"])))
    same = F.col(name["doc_id"]).eqNullSafe(F.col("_kept")) & (F.col("_text_print") == F.col("_print"))
    alike = W.partitionBy(name["doc_id"], "_text_print").orderBy(name["lang"], name["source"], name["n_chars"])
    ranked = marked.join(kept, same, "left_semi").withColumn("_rank", F.row_number().over(alike))
    return ranked.where("_rank = 1").select(*safe.columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not contaminated by the benchmark. Documents without words are not; rows are told
    apart by id and text, so rows without an id are judged by their own text, and repeated rows share the verdict; an
    empty table, or benchmark, loses nothing."""
    safe, name = numbered(docs)
    found = contaminated(docs, table(spark, sf_dir, "benchmark"), key="doc_id", text="text")
    bad = materialise(found.where("contaminated").select("doc_id", "_print").distinct(), "contaminated")
    bad = bad.withColumnRenamed("doc_id", "_bad")
    same = F.col(name["doc_id"]).eqNullSafe(F.col("_bad")) & (content_print(F.col(name["text"])) == F.col("_print"))
    return safe.join(bad, same, "left_anti").toDF(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: documents that it takes more than once are repeated. Documents without words are not
    taken; a NULL source is a source, the last; ties go by the seeded digest of the id, then id; repeated rows queue
    one by one; an empty table stays empty."""
    return mixed(docs, key="doc_id", text="text", source="source")


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards in permuted training order; returns the slot table. Texts that are NULL or empty add no
    tokens; NULL ids are listed as NULL, repeated rows are written again; an empty table gives no slots."""
    slots = write_training_order(docs, work_path(spark, "shards"), key="doc_id", text="text")
    return slots.withColumnRenamed("keys", "doc_ids")


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("token_shards", token_shards),
]

# SQL can express neither the field nor XXH64; tests/llm/test_stages.py compares every stage with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read back as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
