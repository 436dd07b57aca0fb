from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm.language import accepted, fitted, forward_backward, identify, label_texts
from tests.llm.tables import docs, nothing, odd


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(0)
    lengths, k = [3, 1, 4, 0, 2], 3
    at = np.concatenate([[0], np.cumsum(lengths)])
    emit, move = r.normal(size=(at[-1], k)).astype(np.float32), r.normal(size=(k, k))
    p, pairs = forward_backward(at, emit, move, pairs=True)
    want, joint = np.zeros((at[-1], k)), np.zeros((k, k))
    for a, b in zip(at, at[1:]):
        total, sums, moves = 0.0, np.zeros((b - a, k)), np.zeros((k, k))
        for way in product(range(k), repeat=b - a):
            w = np.exp(sum(emit[a + i, s] for i, s in enumerate(way)) + sum(move[s, t] for s, t in zip(way, way[1:])))
            total += w
            for i, s in enumerate(way):
                sums[i, s] += w
            for s, t in zip(way, way[1:]):
                moves[s, t] += w
        want[a:b] = sums / total
        joint += moves / total
    assert np.allclose(p, want, atol=1e-4) and np.allclose(pairs, joint, atol=1e-3)


@pytest.fixture(scope="module")
def model(spark):
    """Fitted on the smallest table; held out is the larger one."""
    return fitted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_held_out_accuracy(spark, model):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 100")
    rows = identify(d, model).withColumnRenamed("lang", "found").join(d.select("doc_id", "lang"), "doc_id").collect()
    good = [r for r in rows if r["accepted"]]
    assert len(good) >= 0.95 * len(rows) and sum(r["found"] == r["lang"] for r in good) >= 0.97 * len(good)


def test_code_switching(spark, model):
    rows = {r["lang"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars between 400 and 900").collect()}
    mixed = " ".join(rows["de"].split()[:25] + rows["fr"].split()[:25])
    spans = label_texts(pa.array([mixed]), model)[3].to_pylist()[0]
    big = [s for s in spans if s["words"] >= 10]
    assert [s["lang"] for s in big] == ["de", "fr"] and abs(big[1]["start"] - 25) <= 3 and sum(s["words"] for s in spans) == 50


def test_junk_is_rejected(spark, model):
    texts = ["0x8f3a 99123 ###### 12.5 ==== 77261", "xkqzt bvcxw qqwrt zzkpl mnbvc 8812", "1 2 3 4 5 6 7 8 9"]
    assert identify(docs(spark, texts), model).where("accepted").count() == 0


def test_odd_tables(spark, model):
    d = odd(spark)
    rows = {r["doc_id"]: r for r in identify(d, model).collect()}
    assert identify(d, model).count() == 9 and all(not rows[i]["accepted"] and rows[i]["lang"] is None and rows[i]["spans"] == [] for i in (1, 2, 3))
    assert sum(s["words"] for s in rows[5]["spans"]) == 14 * 3000
    kept = accepted(d, model)
    assert kept.columns == d.columns and kept.schema == d.schema and kept.count() == identify(d, model).where("accepted").count()
    assert identify(nothing(spark), model).count() == 0 and accepted(nothing(spark), model).count() == 0
    none = fitted(nothing(spark))
    assert none.labels == ["und"] and identify(docs(spark, ["a b"]), none).where("accepted").count() == 0
