"""Prompt jobs over several folds, and embedding in lists of bounded size."""

from pyspark.sql import functions as F

from tabfold.operators.sampling import test_rows as held_out, train_rows
from tabfold.plans import prompting as P
from tabfold.registry import base, prompted
from tabfold.registry.prompted import hash_embedder, stub_complete


def test_an_embedder_gets_short_lists(spark):
    def embed(texts):
        if len(texts) > P.EMBED_ROWS or (len(texts) > 1 and sum(map(len, texts)) > P.EMBED_CHARS):
            raise ValueError("too much at a time")
        return [[float(len(t)), 1.0] for t in texts]

    long = F.expr("repeat('x', 400000)")
    rows = spark.range(0, 1500, 1, 1).withColumn("text", F.when(F.col("id") % 300 < 4, long).otherwise(F.col("id").cast("string")))
    found = P.embed_text(rows, "text", embed)
    assert found.where("embedding[0] = length(text) AND size(embedding) = 2").count() == 1500


def test_retrieval_of_all_folds_at_once(spark):
    rows = [(i, i % 3, [float(i % 7), float(i % 5)], i % 4) for i in range(120)]
    data = spark.createDataFrame(rows, "row_id int, label int, features array<double>, fold int")
    once = P.classify_rag(data, data, stub_complete, hash_embedder, group="fold")
    split = lambda f: (train_rows(data, f).drop("fold"), held_out(data, f).drop("fold"))
    each = [r for f in range(4) for r in P.classify_rag(*split(f), stub_complete, hash_embedder).collect()]
    assert sorted(once.collect()) == sorted(each) and len(each) == 120


def test_folds_are_asked_in_one_job(spark, monkeypatch):
    jobs = []
    once = P.ask_once
    monkeypatch.setattr(P, "ask_once", lambda *a, **k: (jobs.append(1), once(*a, **k))[1])
    for query in (prompted.classify_zero_shot, prompted.classify_few_shot):
        jobs.clear()
        assert query(spark, "/root/testdata/sf0.001").count() > 0 and len(jobs) == 1


def test_typed_rows_need_no_join(spark):
    for typed in (base.typed_orders, base.typed_customers):
        plan = typed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "row" in plan
