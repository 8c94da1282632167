import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomrank.llm import bpe, decontam, quality, secrets
from tests.llm.test_decontam import hit_documents
from tests.llm.test_near_dedup_stage import kept_ids
from tests.llm.test_secrets import added, base


def test_run_against_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r["doc_id"] for r in quality.quality_weights(docs, labels).where("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept]
    single = set(kept_ids(rows, corpus_pipeline.NEAR_PERCENT))
    rows = [(i, t) for i, t in rows if i in single]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = hit_documents(rows, items)
    rows = [(i, t) for i, t in rows if i not in dirty]
    table = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))
    library = Tokenizer.from_file(bpe.default_tokenizer())
    want = {}
    for i, t in rows:
        b = base(t)
        hit = {k for start, _, end, _ in b + added(t, table, b) for k in range(start, end)}
        clean = "".join(c if k not in hit else "" if k - 1 in hit else "[SECRET]" for k, c in enumerate(t))
        ids = library.encode(clean, add_special_tokens=False).ids
        want[i] = (ids, hashlib.sha256(clean.encode()).hexdigest())
    assert set(got) == set(want)
    assert all((list(got[i]["ids"]), got[i]["decoded_sha256"]) == w and got[i]["n_tokens"] == len(w[0]) for i, w in want.items())


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.simpleString() == docs.schema.simpleString() and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Names that operators use for themselves are only passed through."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["_hash", "_secret_all", "_secret_text", "hash", "node", "top", "kept", "label", "hits", "contaminated", "rep", "chunk"]
    named = docs.withColumns({n: F.lit(f"own {n}") for n in names})
    plain = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        named, plain = stage(spark, named, sf_dir), stage(spark, plain, sf_dir)
        assert named.columns == [*docs.columns, *names]
    rows = named.collect()
    assert {tuple(r[c] for c in docs.columns) for r in rows} == {tuple(r) for r in plain.collect()} and rows
    assert all(r[n] == f"own {n}" for r in rows for n in names)


def test_stage_names_and_oracle():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None and decontam.WINDOW == 10
