import random
from itertools import combinations

import pyarrow as pa
import pytest

from graphloom.llm.common import banded_distance, components
from graphloom.llm.exact_dedup import DigestIndex, exact_dedup, unseen
from graphloom.llm.fingerprints import similar_by_fingerprint
from graphloom.llm.near_dedup import bags_of, linked_by_keys, near_duplicates, similarity, tokens, without_near_duplicates
from graphloom.llm.repeats import Windows, exact_prefixes, occurrences, prime_windows, repeated_passages, suffix_array
from tests.llm.tables import SF, docs, nothing, odd


def full_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    r = random.Random(1)
    for _ in range(600):
        a = [r.randrange(3) for _ in range(r.randrange(12))]
        b = [r.randrange(3) for _ in range(r.randrange(12))]
        most = r.randrange(10)
        assert banded_distance(a, b, most) == min(full_distance(a, b), most + 1)


def grouped(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def table(spark):
    """The smallest documents, with edited copies of some."""
    r = random.Random(2)
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for i in range(0, 120, 2):
        words = rows[i][1].split(" ")
        for _ in range(max(1, len(words) // 25)):
            j = r.randrange(len(words))
            words[j : j + r.choice((0, 1))] = [r.choice(("new", "words", "here"))]
        rows.append((10_000 + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("search, threshold", [(near_duplicates, 0.75), (similar_by_fingerprint, 0.8)])
def test_near_copies_against_all_pairs(spark, table, search, threshold):
    t = {i: tokens(x) for i, x in table}
    want = {(a, b) for a, b in combinations(sorted(t), 2) if similarity(t[a], t[b], threshold) is not None}
    got = search(spark.createDataFrame(table, "doc_id long, text string")).collect()
    pairs = {(r["doc_a"], r["doc_b"]) for r in got}
    assert pairs <= want and all(r["similarity"] >= threshold - 1e-9 for r in got)
    a, b = grouped(want, t), grouped(pairs, t)
    linked = [p for p in want if b[p[0]] == b[p[1]]]
    assert len(want) > 50 and len(linked) >= 0.9 * len(want) and all(a[x] == a[y] for x, y in pairs)


def test_groups_of_many_copies_stay_linear(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six"
    texts = [base] * 60 + [base + f" tail{i}" for i in range(60)] + ["something else altogether, nothing to see"]
    got = near_duplicates(docs(spark, texts)).collect()
    assert len(got) < 3 * len(texts) and len(set(grouped([(r["doc_a"], r["doc_b"]) for r in got], range(121)).values())) == 2
    assert [r["doc_id"] for r in without_near_duplicates(docs(spark, texts)).select("doc_id").orderBy("doc_id").collect()] == [0, 120]


def test_buckets_are_connected_through_any_of_their_members(spark):
    """All share a bucket. Of each four only neighbours in the order 1, 2, 4, 3 are similar, so that no pair of parts'
    least members joins {1, 2} and {3, 4}; then random walks of edits."""
    r = random.Random(6)
    texts = {}
    for chain in range(8):
        words = [f"c{chain}w{i}" for i in range(40)]
        for i, n in enumerate((1, 2, 4, 3) if chain < 2 else r.sample(range(1, 5), 4)):
            words[8 * i : 8 * i + 8] = [f"{x}e" for x in words[8 * i : 8 * i + 8]]
            texts[10 * chain + n] = " ".join(words[: 40 - r.randrange(3) * (chain > 2)])
    t = {i: tokens(x) for i, x in texts.items()}
    want = {(a, b) for a, b in combinations(sorted(t), 2) if similarity(t[a], t[b], 0.75) is not None}
    assert {p for p in want if p[1] < 10} == {(1, 2), (2, 4), (3, 4)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sketched = spark.createDataFrame([(i, bytes([i]), len(t[i]), [7, 8]) for i in texts], "id long, digest binary, words long, keys array<long>")
    pairs = {(x["doc_a"], x["doc_b"]) for x in linked_by_keys(d, sketched, 0.75, "doc_id", "text").collect()}
    assert pairs <= want and grouped(pairs, t) == grouped(want, t)


def test_bags_never_rule_out_what_alignment_accepts(spark):
    r = random.Random(7)
    for _ in range(200):
        a = [r.choice("abcdefgh") for _ in range(r.randrange(1, 30))]
        b = [r.choice("abcdefgh") if r.random() < 0.2 else x for x in a for _ in range(r.choice((0, 1, 1, 1, 2)))]
        x, y = bags_of(pa.array([" ".join(a), " ".join(b)])).astype(int)
        assert max((x - y).clip(0).sum(), (y - x).clip(0).sum()) <= full_distance(a, b)


@pytest.mark.parametrize("search", [near_duplicates, similar_by_fingerprint])
def test_odd_tables(spark, search):
    pairs = {(r["doc_a"], r["doc_b"]) for r in search(odd(spark)).collect()}
    assert pairs == {(4, 6)}
    assert search(nothing(spark)).count() == 0


def test_near_dedup_keeps_the_other_rows_and_columns(spark):
    d = odd(spark)
    kept = without_near_duplicates(d)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "4", "None", "5", "7"])
    assert without_near_duplicates(nothing(spark)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 9), (9, 8), (8, 8)], "doc_a long, doc_b long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (9, 5), (8, 5)}


# --- exact -----------------------------------------------------------------------------------------------------------


def index(spark, tmp_path, name="i"):
    return DigestIndex(spark, str(tmp_path / name), 4)


def test_exact(spark, tmp_path):
    d = odd(spark)
    kept = exact_dedup(d, index(spark, tmp_path))
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "None"]
    assert exact_dedup(nothing(spark), index(spark, tmp_path, "e")).count() == 0


def test_the_index_persists(spark, tmp_path):
    first = docs(spark, ["a", "b", "a"])
    assert exact_dedup(first, index(spark, tmp_path)).count() == 2
    assert exact_dedup(first, index(spark, tmp_path)).count() == 2  # a repeated run
    later = spark.createDataFrame([(10, "b"), (11, "c"), (12, "c")], "doc_id long, text string")
    assert [r["doc_id"] for r in exact_dedup(later, index(spark, tmp_path)).collect()] == [11]
    again = DigestIndex(spark, str(tmp_path / "i"), 4)
    assert again.read().count() == 3
    found = later.selectExpr("cast(text as binary) as digest", "doc_id as owner")
    again.compact()
    stored_side = unseen(found, again)._jdf.queryExecution().executedPlan().toString().split("digest_index_")[0]
    assert stored_side.count("Sort [") == stored_side.count("Exchange hash") == 1  # the new rows' alone
    plan = exact_dedup(later, again)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_the_index_refuses_other_buckets(spark, tmp_path):
    texts = docs(spark, [f"text {i}" for i in range(50)])
    first = index(spark, tmp_path)
    assert exact_dedup(texts, first).count() == 50
    first.close()
    with pytest.raises(ValueError):
        DigestIndex(spark, str(tmp_path / "i"), 8)
    later = texts.selectExpr("doc_id + 1000 as doc_id", "text")
    reopened = DigestIndex(spark, str(tmp_path / "i"))
    assert reopened.buckets == 4 and exact_dedup(later, reopened).count() == 0


def test_null_ids_in_later_runs(spark, tmp_path):
    d = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c")], "doc_id long, text string")
    assert exact_dedup(d, index(spark, tmp_path)).count() == 3
    assert [r["text"] for r in exact_dedup(d, index(spark, tmp_path)).collect()] == ["c"]


def test_the_index_is_compacted(spark, tmp_path):
    i = DigestIndex(spark, str(tmp_path / "c"), 2, most_files=2)
    for n in range(4):
        exact_dedup(spark.createDataFrame([(10 * n + k, f"{n} {k}") for k in range(9)], "doc_id long, text string"), i).count()
    assert i.generation >= 1 and len(i.read().inputFiles()) <= 4
    again = DigestIndex(spark, str(tmp_path / "c"))
    assert (again.generation, again.buckets, again.read().count()) == (i.generation, 2, 36)
    assert exact_dedup(spark.createDataFrame([(99, "0 0"), (98, "new")], "doc_id long, text string"), again).count() == 1


# --- repeats ---------------------------------------------------------------------------------------------------------


def test_suffix_arrays():
    import numpy as np

    r = random.Random(4)
    for _ in range(100):
        x = np.array([r.randrange(3) for _ in range(r.randrange(1, 40))], np.uint64)
        want = sorted(range(len(x)), key=lambda i: x[i:].tolist())
        assert suffix_array(x).tolist() == want


def brute_repeats(texts, least):
    """{words: {(document, place)}} of the maximal repeats that two documents have."""
    places: dict = {}
    for d, t in texts.items():
        w = t.split()
        for i in range(len(w)):
            for j in range(i + least, len(w) + 1):
                places.setdefault(tuple(w[i:j]), []).append((d, i))
    out = {}
    for run, at in places.items():
        if len({d for d, _ in at}) < 2:
            continue
        before = {texts[d].split()[i - 1] if i else ("start", d) for d, i in at}
        after = {texts[d].split()[i + len(run)] if i + len(run) < len(texts[d].split()) else ("end", d) for d, i in at}
        if len(before) > 1 and len(after) > 1:
            out[run] = set(at)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_maximal_repeats_against_enumeration(spark, seed):
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") + str(r.randrange(6)) for _ in range(r.randrange(4, 14))] for _ in range(4)]
    texts = {}
    for d in range(14):
        words = []
        for _ in range(r.randrange(1, 5)):
            words += r.choice(passages)[r.randrange(3) :]
            words += [f"u{d}{r.randrange(99)}" for _ in range(r.randrange(3))]
        texts[d] = " ".join(words)
    texts[14], texts[15], texts[16] = texts[0], texts[0], ""
    want = brute_repeats(texts, 4)
    tree = repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), least=4)
    listed = [(x["doc_id"], x["start_word"]) for x in tree.collect()]
    assert len(listed) < 2 * len(set(listed)) + len(want)
    got: dict = {}
    for x in occurrences(tree).collect():
        got.setdefault(x["repeat_id"], []).append((x["n_words"], x["doc_id"], x["start_word"]))
    found = {}
    for places in got.values():
        n, d, i = places[0]
        run = tuple(texts[d].split()[i : i + n])
        assert all(tuple(texts[d].split()[i : i + n]) == run for n, d, i in places) and run not in found
        found[run] = {(d, i) for _, d, i in places}
    assert found == want


def test_repeats_grow_with_the_words_and_not_with_groups_squares(spark):
    """Of n near copies with scattered edits each place is listed once, whatever n."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    copies = []
    for d in range(80):
        words = list(base)
        for j in r.sample(range(60), 2):
            words[j] = f"e{d}"
        copies.append(" ".join(words))
    rows = repeated_passages(docs(spark, copies), least=10).collect()
    places = {(x["doc_id"], x["start_word"]) for x in rows}
    nodes = {x["repeat_id"] for x in rows}
    assert len(places) <= 80 * 60 and len(rows) <= len(places) + len(nodes)


def test_equal_hashes_of_different_words():
    """Thue-Morse words of two letters collide in polynomials modulo 2 ** 64."""
    import numpy as np

    t = np.array([bin(i).count("1") & 1 for i in range(2048)])
    two = np.array([0x1234567, 0x89ABCDEF], np.uint64)
    a, b = two[t], two[1 - t]
    h = np.concatenate([a, b])
    w = Windows(h)
    ends = np.array([0, 2048])
    assert w.at(ends[:1], 2048)[0] == w.at(ends[1:], 2048)[0]
    assert prime_windows(h, ends[:1], np.array([2048]))[0] != prime_windows(h, ends[1:], np.array([2048]))[0]
    order, lcp = np.array([0, 2048]), np.array([0, 2048])
    assert exact_prefixes(h, order, lcp).tolist() == [0, 0]


def test_repeats_in_odd_tables(spark):
    assert repeated_passages(nothing(spark)).count() == 0
    assert repeated_passages(odd(spark)).count() == 0
    passage = " ".join(f"w{i}" for i in range(51))
    tree = repeated_passages(docs(spark, ["left " + passage, passage + " right", passage + " right", None, "no"]))
    assert {r["n_words"] for r in tree.where("parent_id is null").collect()} == {51}
    rows = occurrences(tree).collect()
    assert {(r["doc_id"], r["start_word"]) for r in rows if r["n_words"] == 51} == {(0, 1), (1, 0), (2, 0)}
    assert {r["doc_id"] for r in rows if r["n_words"] == 52} == {1, 2}
