import math

import pytest
from pyspark.sql import functions as F

from graphloom.llm.mixing import mix, mixed, smoothed_targets, tokens_of
from tests.llm.tables import SF, docs, nothing, odd


def tilt(tokens, target):
    """The rates' exponent by bisection."""
    low, high = -50.0, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        if sum(math.exp(min(mid * t, 500)) * t for t in tokens) < target:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def test_rates_against_bisection(spark):
    texts = ["w " * n for n in (3, 10, 1, 7, 5, 5, 2, 30)]
    d = docs(spark, texts)
    targets = {"s0": 40.0, "s1": 20.0}
    got = {r["doc_id"]: r["rate"] for r in mix(d, targets).collect()}
    for s in (0, 1):
        own = {i: len(t.split()) for i, t in enumerate(texts) if i % 2 == s}
        x = tilt(list(own.values()), targets[f"s{s}"])
        assert {i: got[i] for i in own} == pytest.approx({i: math.exp(x * n) for i, n in own.items()}, rel=1e-4)


def test_a_table_meets_its_targets(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    full = mix(d, exponent=0.7, keep_all=False).withColumn("t", tokens_of(F.col("text")))
    totals = {r["source"]: r["n"] for r in full.groupBy("source").agg(F.sum("t").alias("n")).collect()}
    want = smoothed_targets(totals, 0.7, False)
    got = {r["source"]: r["n"] for r in full.groupBy("source").agg(F.sum(F.col("rate") * F.col("t")).alias("n")).collect()}
    assert got == pytest.approx(want, rel=1e-5)
    assert all(r["copies"] in (math.floor(r["rate"]), math.ceil(r["rate"])) for r in full.collect())
    assert [tuple(r) for r in mix(d, exponent=0.7, keep_all=False).select("doc_id", "copies").orderBy("doc_id").collect()] == [tuple(r) for r in full.select("doc_id", "copies").orderBy("doc_id").collect()]


def test_keeping_all(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixed(d, exponent=0.9, keep_all=True)
    assert out.columns == d.columns and out.select("doc_id").distinct().count() == d.select("doc_id").distinct().count()


def test_odd_tables(spark):
    d = odd(spark)
    out = mix(d)
    assert out.columns[: len(d.columns)] == d.columns and out.count() == 9
    rate = out.columns[-2]
    assert {r[rate] for r in out.where("doc_id in (1, 2, 3)").collect()} == {1.0}
    assert mix(nothing(spark)).count() == 0 and mixed(nothing(spark)).count() == 0
    assert mix(docs(spark, ["a b", "c d"]), {"s0": 2.0}).where("doc_id = 1").first()["rate"] == 0.0
    assert mixed(d).columns == d.columns
