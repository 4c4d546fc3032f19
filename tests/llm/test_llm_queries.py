"""The registered queries against their SQL, and the pipeline against its stages done by hand."""

import hashlib
import math

import duckdb
import pytest

import corpus_pipeline
from pulsegrid.llm import pii
from pulsegrid.llm import queries as Q

TABLES = "documents pages benchmark labels conversations embeddings".split()


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = Q.QUERIES[name](spark, sf_dir)
    found = c.sql(Q.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(found.columns) == names
    at = [list(found.columns).index(x) for x in names]
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    assert sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


@pytest.fixture
def short_training(monkeypatch):
    """Fewer made sentences: the pipeline's tests need a model, not a good one."""
    monkeypatch.setattr(pii, "MADE", 100)


def test_pipeline_equals_its_stages_by_hand(spark, sf_dir, short_training):
    from test_operators import classes_by_hand, hits_by_hand

    from pulsegrid.llm import bpe, quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ok = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    left = [(d.doc_id, d.text) for d in docs.collect() if d.doc_id in ok]
    classes = classes_by_hand(left)
    left = [(i, t) for i, t in left if classes[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in left if not hits_by_hand(t, items)[4]]
    frame = spark.createDataFrame(left, "doc_id bigint, text string")
    tagger = pii.train(frame)
    clean = [pii.redacted(t, a + b) for (i, t), (a, b) in zip(left, pii.spans_of([t for _, t in left], tagger))]
    want = {i: hashlib.sha256(t.encode()).hexdigest() for (i, _), t in zip(left, clean)}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and len(got) > 50
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and bpe.digests(frame.limit(0)).count() == 0


def test_pipeline_on_odd_rows(spark, sf_dir, tmp_path, short_training):
    from pyspark.sql import functions as F
    from test_operators import ODD

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"n_words": F.lit("clash"), "kept": F.lit(1), "ids": F.lit(2), "class_id": F.lit("x"), "spans": F.lit(None).cast("int"), "sha": F.lit(0), "gone": F.lit(3), "hit": F.lit(3)})
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string").withColumn("doc_id", 10**6 + F.col("doc_id"))
    some = docs.where("doc_id < 40").unionByName(docs.where("doc_id < 10"))  # repeated rows
    lone = docs.where("doc_id = 50").withColumn("doc_id", F.lit(None).cast("bigint"))
    for name, frame in (("odd", some.unionByName(odd, allowMissingColumns=True).unionByName(lone)), ("empty", docs.limit(0))):
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids)) > 5 and max(ids) < 40
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_near_copies_of_some_against_all(spark, sf_dir):
    """Recall of pairs at a similarity of 0.8: every row whose id is divisible by 50 against all rows, by brute force."""
    from pulsegrid.llm import neardup

    docs = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    texts = {r.doc_id: neardup.word_hashes(neardup.normal(r.text)) for r in docs.collect()}
    sets = {i: set(neardup.kmer_hashes(w).tolist()) for i, w in texts.items()}
    pairs = [(q, d) for q in sets if q % 50 == 0 for d in sets if d != q and len(sets[q] & sets[d]) >= 0.8 * len(sets[q] | sets[d]) > 0]
    found = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert pairs and sum(found[a] == found[b] for a, b in pairs) >= 0.9 * len(pairs)
