import base64

import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.bpe import Prefixes, TextEncoding, decode, decoded, encode, encoded
from graphloom.llm.token_counts import symbol_counts, token_counts
from graphloom.llm.vocabulary import PATTERN, VOCABULARY, vocabulary
from tests.llm.tables import SF, nothing, odd


@pytest.fixture(scope="module")
def v():
    return vocabulary(VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_table_against_a_tokenizer(spark, reference):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = encode(d).collect()
    assert all(r["tokens"] == reference.encode_ordinary(r["text"]) for r in rows)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(d).collect()}
    assert counts == {r["doc_id"]: len(r["tokens"]) for r in rows}
    assert all(r["decoded"] == r["text"] for r in decode(encode(d)).collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("ab \n'", max_size=40), st.sampled_from(["aaaaaaaaaaa", "don't stop", "漢字かな", "🙂🙂🙂", "<|endoftext|>"])), max_size=6))
def test_random_texts(texts):
    v = vocabulary(VOCABULARY)
    with open(VOCABULARY, "rb") as f:
        ranks = _ranks(f)
    at, tokens = encoded(pa.array(texts, pa.string()), v)
    for i, t in enumerate(texts):
        mine = tokens[at[i] : at[i + 1]].tolist()
        assert mine == ranks.encode_ordinary(t) and decoded(mine, v) == t


_kept = {}


def _ranks(f):
    if not _kept:
        _kept["x"] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    return _kept["x"]


def test_counts_of_words(v, reference):
    words = ["", "a", "aaaaaaaaaaaaaaaaaaaaaaa", " the", "xqzvw" * 40, "äöü", "\n\n\n\n"]
    assert symbol_counts(words, v).tolist() == [len(reference._core_bpe.encode_single_piece(w.encode())) if w else 0 for w in words]


def test_prefixes_and_edits(v):
    text = b"unbelievable internationalisation aaaa bbbb cccc"
    p = Prefixes(v, text[:10])
    p.append(text[10:])
    assert p.tokens() == Prefixes(v, text).tokens()
    assert all(p.tokens(n) == Prefixes(v, text[:n]).tokens() for n in range(0, len(text), 7))
    long = text * 40
    q = Prefixes(v, long)
    done = q.replace(5, 9, b"XY")
    assert q.tokens() == Prefixes(v, long[:5] + b"XY" + long[9:]).tokens() and done < len(long) / 2


def test_edits_of_texts(v):
    t = TextEncoding(v, "Hello brave new world, don't panic. " * 5)
    t.replace(6, 11, "old")
    t.append(" The end")
    at, tokens = encoded(pa.array([t.text]), v)
    assert t.tokens() == tokens.tolist()


def test_odd_tables(spark):
    d = odd(spark)
    e = encode(d)
    assert e.columns[:-1] == d.columns and e.columns[-1].startswith("tokens_") and len(set(c.lower() for c in e.columns)) == len(e.columns)
    rows = {r["doc_id"]: r[e.columns[-1]] for r in e.collect()}
    assert rows[1] is None and rows[2] == [] and len(rows[5]) > 30_000 and e.count() == 9
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(d).collect()}
    assert counts[1] == counts[2] == 0 and counts[5] == len(rows[5])
    assert encode(nothing(spark)).count() == 0 and token_counts(nothing(spark)).count() == 0


def test_long_texts_are_decoded_a_slice_at_a_time(spark, monkeypatch):
    """Neither a batch's tokens nor two workers' vocabularies are held at once."""
    import graphloom.llm.bpe as bpe

    held = []
    one = bpe.decoded_texts
    v = bpe.vocabulary()
    texts = ["lorem ipsum dolor " * 30_000, None, "", "ünïcödé 🙂"] * 8
    lists = bpe.token_lists(pa.array(texts), v)
    batch = pa.RecordBatch.from_arrays([lists], names=["c0"])
    for part in bpe.slices(iter([batch]), "c0", bpe.SLICE):
        held.append(len(part.column(0).flatten()))
        assert one(part.column(0), v).to_pylist() == texts[: part.num_rows]
        texts = texts[part.num_rows :]
    assert len(held) > 1 and not texts
    d = odd(spark)
    rows = bpe.round_trip(d)
    assert rows.columns[:-1] == d.columns and [r[-1] for r in rows.collect()] == [r["text"] for r in d.collect()]
    assert "MapInArrow" not in rows._jdf.queryExecution().optimizedPlan().toString().replace("MapInArrow", "", 1)


def test_queries_with_sql(spark):
    """What SQL can say of the text operators' queries."""
    import duckdb

    from graphloom.llm import queries
    from tests.llm.tables import SF

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
        assert sorted(names) == sorted(df.columns) and got == sorted(cur.fetchall(), key=repr), name
