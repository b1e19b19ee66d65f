"""The opN queries: thin steps between the given tables and the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm.alignment import align_tokenizers
from riskloom.llm.decontamination import contaminated
from riskloom.llm.extraction import extract_main_text, train_extractor
from riskloom.llm.jaccard import jaccard_components
from riskloom.llm.language import predict_language, train_language
from riskloom.llm.metric_tree import top_k
from riskloom.llm.mixing import mixing_plan
from riskloom.llm.repeats import without_repeats
from riskloom.llm.shards import write_training_order
from riskloom.llm.simhash import near_duplicates
from riskloom.llm.toxicity import score_toxicity, train_toxicity
from riskloom.llm.warc import read_warc, write_warc
from riskloom.llm.whitening import whitened_embeddings
from riskloom.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(body: Callable[[SparkSession, str], DataFrame]):
    QUERIES[body.__name__] = body
    return body


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


@register
def op1_token_shards(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    slots = write_training_order(documents, work_path(spark, "shards"), key="doc_id", text="text")
    return slots.select("slot", "shard", "shard_slot", "n_tokens", F.col("keys").alias("doc_ids"))


def fold(folds: int):
    """The fold that a document's id falls into."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


@register
def op2_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    documents, labels = table(spark, directory, "documents"), table(spark, directory, "labels")
    model = train_toxicity(documents, labels, key="doc_id", text="text", label="toxic", where=fold(5) != 0)
    scored = score_toxicity(documents.select("doc_id", "text"), model, key="doc_id", text="text")
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted", "spans")


@register
def op3_warc_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    pages = table(spark, directory, "pages")
    records = read_warc(write_warc(pages, work_path(spark, "archives")))
    return records.select(
        F.col("key").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
        "verified",
    )


ORACLES["op3_warc_roundtrip"] = """
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
roles AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS latest FROM digests)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda c:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hex, 5 * g + 1, 5))::BIGINT >> (15 - 5 * c)) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to, true AS verified
FROM roles
"""


@register
def op4_language_id(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    model = train_language(documents, key="doc_id", text="text", language="lang", where=fold(4) != 2)
    found = predict_language(documents.select("doc_id", "text"), model, key="doc_id", text="text")
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


@register
def op5_html_extraction(spark: SparkSession, directory: str) -> DataFrame:
    pages = table(spark, directory, "pages")
    return extract_main_text(pages, train_extractor(pages)).select("page_id", "url", "text", "n_chars")


@register
def op6_simhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    rows = near_duplicates(table(spark, directory, "documents"), key="doc_id", text="text")
    return rows.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@register
def op7_source_mixing(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").select("doc_id", "text", "source")
    plan = mixing_plan(documents, key="doc_id", text="text", source="source")
    return plan.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op7_source_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS ticket
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, coalesce(sum(3 * source_size) OVER earlier, 0) AS caps, coalesce(sum(weight) OVER earlier, 0) AS weights
  FROM sources
  WINDOW earlier AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (
  SELECT max(((SELECT sum(source_size) FROM sources) - caps)::DOUBLE / ((SELECT sum(weight) FROM sources) - weights)::DOUBLE)
         AS level FROM filled),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT level FROM leveled) * weight::DOUBLE) AS target
  FROM sources),
queue AS (
  SELECT s.*, t.source_size, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY ticket, doc_id, size
         ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
merged AS (
  SELECT (upto + r * source_size)::DOUBLE / target AS finish, size
  FROM queue, (SELECT unnest([0, 1, 2]) AS r) WHERE size > 0),
spent AS (SELECT finish, sum(size) OVER (ORDER BY finish) AS words FROM merged),
cut AS (SELECT coalesce(max(finish), 0) AS last FROM spent WHERE words <= (SELECT sum(size) FROM sized))
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE size * (
         (upto::DOUBLE / target <= (SELECT last FROM cut))::INT
         + ((upto + source_size)::DOUBLE / target <= (SELECT last FROM cut))::INT
         + ((upto + 2 * source_size)::DOUBLE / target <= (SELECT last FROM cut))::INT) END::BIGINT AS taken
FROM queue
"""


@register
def op8_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    rows = without_repeats(table(spark, directory, "documents"), key="doc_id", text="text")
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op8_substring_dedup"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
              FROM documents),
windows AS (SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS words
            FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
firsts AS (SELECT words, min(doc_id) AS least FROM windows GROUP BY words),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM windows JOIN firsts USING (words) WHERE least < doc_id),
kept AS (
  SELECT p.r, string_agg(p.word, ' ' ORDER BY p.j) AS words, count(*) AS n
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM docs) p
  LEFT JOIN gone g ON g.r = p.r AND g.j = p.j WHERE g.r IS NULL GROUP BY p.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(words, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


@register
def op9_exact_top_k(spark: SparkSession, directory: str) -> DataFrame:
    embeddings = table(spark, directory, "embeddings")
    return top_k(embeddings, embeddings.where("vec_id % 100 = 0"), key="vec_id", vector="embedding")


ORACLES["op9_exact_top_k"] = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@register
def op10_benchmark_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    documents, benchmark = table(spark, directory, "documents"), table(spark, directory, "benchmark")
    rows = contaminated(documents, benchmark, key="doc_id", text="text")
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", "n_items", listed, "contaminated")


WORDS_SQL = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

ORACLES["op10_benchmark_decontamination"] = f"""
WITH items AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
matches AS (
  SELECT r, i, x.size, x.item_id
  FROM (SELECT r, i, z.size, array_to_string(w[i:i + z.size - 1], ' ') AS words
        FROM places, (SELECT DISTINCT size FROM windows) z WHERE i + z.size - 1 <= len(w)) p
  JOIN windows x ON x.size = p.size AND x.words = p.words),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS j FROM matches) GROUP BY r),
listed AS (SELECT r, count(DISTINCT item_id) AS n_items,
                  array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM matches GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN listed USING (r)
"""


TOKENIZERS = "/opt/tokenizers"


@register
def op11_cross_tokenizer_alignment(spark: SparkSession, directory: str) -> DataFrame:
    found = align_tokenizers(
        table(spark, directory, "documents"),
        tokenizer_a=f"{TOKENIZERS}/byte_bpe_50k.json",
        tokenizer_b=f"{TOKENIZERS}/piece_bpe_32k.model",
        key="doc_id",
        text="text",
    )
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    texts = found.texts.select("_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest)
    sums = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    return texts.join(found.links, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")


@register
def op12_ngram_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    rows = jaccard_components(table(spark, directory, "documents"), key="doc_id", text="text")
    return rows.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


@register
def op13_embedding_whitening(spark: SparkSession, directory: str) -> DataFrame:
    embeddings = table(spark, directory, "embeddings")
    rows = whitened_embeddings(embeddings, key="vec_id", vector="embedding", components=32, scale=64, offset=1_000_000)
    listed = rows.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("_at", "whitened"))
    return listed.select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        "n",
        F.col("deviation").cast("bigint").alias("deviation"),
        "whitened",
        F.get("explained", F.col("_at")).alias("explained"),
        "identity_error",
    )
