import random
from itertools import combinations

import numpy as np
import pytest

from graphloom.llm.fingerprints import fingerprints, links_by_fingerprint
from graphloom.llm.links import LONGEST, aligned_together, candidates, distances, links_by_keys, tokens_of
from graphloom.llm.near_dedup import similarity, tokens
from tests.llm.tables import docs, nothing, odd
from tests.llm.test_duplicates import full_distance, grouped


def test_alignment_of_many_pairs():
    r = random.Random(3)
    texts = [np.array([r.randrange(9) for _ in range(r.choice((1, 2, 40, 64, 65, 130)) + r.randrange(3))], np.int64) for _ in range(40)]
    a, b = (np.array([r.randrange(40) for _ in range(300)]) for _ in range(2))
    assert aligned_together(texts, a, b, 9).tolist() == [full_distance(texts[i], texts[j]) for i, j in zip(a, b)]
    base = [f"w{r.randrange(200)}" for _ in range(LONGEST + 40)]
    hashed = [np.array([hash(w) & (2**63 - 1) for w in (base if i else base[: LONGEST - 9]) if r.random() < 0.93], np.uint64) for i in (0, 1) * 20]
    a, b = (np.array(x) for x in zip(*combinations(range(40), 2)))
    want = [similarity(hashed[i].tolist(), hashed[j].tolist(), 0.8) for i, j in zip(a, b)]
    most = [int(0.2 * max(len(hashed[i]), len(hashed[j])) + 1e-9) for i, j in zip(a, b)]
    got = distances(hashed, a, b, 0.8)
    assert [d <= m for d, m in zip(got, most)] == [s is not None for s in want]
    assert all(d > m or s == 1 - d / max(len(hashed[i]), len(hashed[j])) for d, m, s, i, j in zip(got, most, want, a, b))


def near_copies():
    """A group of near copies at all distances, exact copies of some, pairs, longer texts, and texts alone."""
    r = random.Random(5)
    texts = []
    for g, (copies, size, edits) in enumerate([(40, 120, 12), (2, 60, 2), (12, 90, 14), (6, 900, 60)]):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(size)]
        for c in range(copies):
            words = list(base)
            at = r.randrange(size)
            for j in range(at, at + r.randrange(edits)):
                words[j % size] = f"e{c}x{j}"
            texts.append(" ".join(words))
    texts += texts[3:9] + [texts[3]] + [" ".join(f"u{i}w{j}" for j in range(50)) for i in range(5)]
    return texts


@pytest.mark.parametrize("most", [2048, 7])
def test_every_link_of_a_group_is_counted(spark, most):
    """similar_by_fingerprint() lists about n links of a group of n and leaves out the others."""
    texts = near_copies()
    t = {i: tokens(x) for i, x in enumerate(texts)}
    want = [(a, b) for a, b in combinations(t, 2) if similarity(t[a], t[b], 0.8) is not None]
    d = docs(spark, texts)
    rows = {x["doc_id"]: x for x in links_by_keys(d, fingerprints(d), 0.8, "doc_id", "text", most).collect()}
    groups = grouped([(i, x["class_id"]) for i, x in rows.items()], t)
    assert groups == grouped(want, t)
    degree = {i: 0 for i in t}
    for a, b in want:
        degree[a] += 1
        degree[b] += 1
    assert {i: x["links"] for i, x in rows.items()} == degree
    assert all(x["text_id"] == texts.index(texts[i]) for i, x in rows.items())


def test_links_in_odd_tables(spark):
    rows = links_by_fingerprint(odd(spark)).collect()
    assert sorted((x["doc_id"], x["text_id"], x["class_id"], x["links"]) for x in rows) == [(1, 1, 1, 0), (2, 2, 2, 0), (3, 3, 3, 0), (4, 4, 4, 1), (5, 5, 5, 0), (6, 4, 4, 1), (7, 7, 7, 0)]
    assert links_by_fingerprint(nothing(spark)).count() == 0


def test_pairs_of_a_bucket_grow_with_its_members(spark):
    """All share a bucket: unrelated texts give no pairs to align, near copies one each."""
    texts = [" ".join(f"d{i}w{j}" for j in range(60)) for i in range(150)] + [" ".join(["x"] * 60 + [f"e{i}"]) for i in range(150)]
    d = spark.createDataFrame([(i, bytes([i % 256]), x) for i, x in enumerate(texts)], "id long, digest binary, text string")
    members = spark.createDataFrame([(7, i) for i in range(300)], "key long, id long")
    pairs = [(x["doc_a"], x["doc_b"]) for x in candidates(members, tokens_of(d), None, 0.8, False).collect()]
    assert sorted(pairs) == [(150, i) for i in range(151, 300)]
