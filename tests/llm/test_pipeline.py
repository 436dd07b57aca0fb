from collections import Counter

import corpus_pipeline
from graphloom.llm.near_dedup import similarity, tokens
from tests.llm.tables import SF, nothing, odd


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[: len(names)] == names and (i == len(corpus_pipeline.STAGES) - 1 or docs.columns == names)
        seen[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mixture", "tokens"]
    first = {}
    for i, t in sorted(seen["language"]):
        first.setdefault(t, i)
    assert sorted(i for i, _ in seen["exact"]) == sorted(first.values())
    kept = {i: tokens(t) for i, t in seen["near"]}
    gone = [(i, tokens(t)) for i, t in seen["exact"] if i not in kept]
    everything = {i: tokens(t) for i, t in seen["exact"]}
    assert all(any(j < i and similarity(t, everything[j], 0.75) is not None for j in everything) or any(similarity(t, everything[j], 0.75) is not None for j in everything if j != i) for i, t in gone)
    assert set(Counter(i for i, _ in seen["mixture"])) == set(kept) == {i for i, _ in seen["tokens"]}


def test_whole_run_and_nothing(spark):
    out = corpus_pipeline.run(spark, SF)
    assert "tokens" in out.columns and out.count() > 100
    docs = nothing(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_tables(spark):
    """Nulls, blanks, repeated rows, a long text and clashing names through all stages, each on what the one before kept,
    and each on the whole odd table."""
    d = odd(spark)
    kept = {"language": None, "exact": 7, "near": 8, "mixture": None, "tokens": 9}
    docs = d
    for name, stage in corpus_pipeline.STAGES:
        alone = stage(spark, d, SF)
        assert alone.columns[: len(d.columns)] == d.columns and kept[name] in (None, alone.count())
        docs = stage(spark, docs, SF)
        assert set(d.columns) <= set(docs.columns)
        docs.count()
