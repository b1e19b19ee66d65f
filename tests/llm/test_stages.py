"""Every stage of the pipeline against a plain version on the small table."""

import collections
import os
import re

import duckdb
import pytest
from test_simhash import fingerprint, linked

import corpus_pipeline
from riskloom.llm.queries import ORACLES, fold
from riskloom.llm.toxicity import score_toxicity, train_toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not mounted")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_toxicity_keeps_what_is_not_predicted(spark, docs):
    """The marginals and scores themselves are compared with all labelings in test_toxicity."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = train_toxicity(docs, labels, key="doc_id", text="text", label="toxic", where=fold(5) != 0)
    toxic = {r["doc_id"] for r in score_toxicity(docs, model, key="doc_id", text="text").collect() if r["score"] >= 0.5}
    kept = STAGES["toxicity"](spark, docs, DATA)
    assert rows_of(kept) == sorted((tuple(r) for r in docs.collect() if r["doc_id"] not in toxic), key=repr)
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(clean & toxic) <= 0.05 * len(clean)


def test_near_dedup_keeps_one_of_each_component(spark, docs):
    every = docs.collect()
    roots = linked([fingerprint(r["text"]) for r in every])
    least = {}
    for r, root in zip(every, roots):
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    want = sorted((tuple(r) for r, root in zip(every, roots) if r["doc_id"] == least[root]), key=repr)
    assert rows_of(STAGES["simhash_near_dedup"](spark, docs, DATA)) == want and len(want) < len(every)


def words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def test_decontamination_keeps_what_is_not_contaminated(spark, docs):
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r["text"])
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[size].add(tuple(w[i : i + size]))
    kept = []
    for r in docs.collect():
        w, hit = words(r["text"]), set()
        for size, known in windows.items():
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in known:
                    hit.update(range(i, i + size))
        if not hit or 20 * len(hit) < len(w):
            kept.append(tuple(r))
    assert rows_of(STAGES["benchmark_decontamination"](spark, docs, DATA)) == sorted(kept, key=repr)
    assert len(kept) < docs.count()


def test_mixing_repeats_as_the_plan_says(spark, docs):
    """The plan itself is the SQL of op7."""
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    result = connection.execute(ORACLES["op7_source_mixing"])
    names = [d[0] for d in result.description]
    copies = {}
    for row in result.fetchall():
        row = dict(zip(names, row))
        copies[row["doc_id"]] = row["taken"] // row["size"] if row["size"] else 0
    want = [tuple(r) for r in docs.collect() for _ in range(copies[r["doc_id"]])]
    assert rows_of(STAGES["source_mixing"](spark, docs, DATA)) == sorted(want, key=repr)


def test_shards_hold_every_document(spark, docs):
    slots = STAGES["token_shards"](spark, docs, DATA).collect()
    assert sorted(r["slot"] for r in slots) == list(range(len(slots)))
    held = {i for r in slots for i in r["doc_ids"]}
    assert held == {r["doc_id"] for r in docs.collect() if r["text"]}


def test_run_is_the_stages_one_after_the_other(spark, docs):
    """``run`` gives each document that the first three stages keep and the mix takes, and no other."""
    rows = docs
    for name in ("toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"):
        rows = STAGES[name](spark, rows, DATA)
        assert rows.columns == docs.columns
    want = {r["doc_id"] for r in rows.collect() if r["text"]}
    slots = corpus_pipeline.run(spark, DATA)
    assert {i for r in slots.collect() for i in r["doc_ids"]} == want
