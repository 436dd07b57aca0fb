"""Stored indexes: sorted values for points and ranges, postings for full text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph, named
from graphloom.operators.retrieval import terms
from graphloom.storage import written

#: Files of postings by their term's hash, so that a search opens those of its terms.
BUCKETS = 64
#: Words that a task groups at a time.
WORDS = 1_000_000


@dataclass(frozen=True)
class FullText:
    """postings: (bucket, term, id, tf, length, places); stats: one row (n, mean)."""

    postings: DataFrame
    stats: DataFrame


def bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(batches):
    """(term, id, tf, length, places) of batches (id, words): a document's words are all here, so its terms are grouped
    without moving a word. Ids name one document each."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for whole in batches:
        sizes = pc.list_value_length(whole.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // WORDS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            batch, size = whole.slice(a, b - a), sizes[a:b]
            words = batch.column(1).flatten().dictionary_encode()
            if not len(words):
                continue
            code = words.indices.to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
            key = owner * len(words.dictionary) + code
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            at = order[first]
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
            tf = np.diff(np.append(first, len(code)))
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[at])), batch.column(0).take(pa.array(owner[at])), pa.array(tf), pa.array(size[owner[at]].astype(np.int32)), places], names=["term", "id", "tf", "length", "places"])


def build(g: Graph, label: str, prop: str, kind: str):
    """What CREATE INDEX stores in the shared folder. Values: (value, id) sorted by range, so that the scan's statistics
    leave out files and row groups. Full text: postings by the hash of their term."""
    df = g.node_table(label)
    if kind == "taxonomy":  # the ontology's own edges are the index
        return None
    if prop not in df.columns:
        return None
    if kind != "fulltext":
        return written(df.where(named(prop).isNotNull()).select(named(prop).alias("value"), "id").orderBy("value"))
    words = df.where(named(prop).isNotNull()).select("id", terms(named(prop).cast("string")).alias("w"))
    lists = words.mapInArrow(postings, f"term string, id {df.schema['id'].dataType.simpleString()}, tf long, length int, places array<int>")
    stats = written(words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("mean")))
    # A bucket's terms are in several tasks, so that a task's share stays small; the number is given, as others would merge.
    found = lists.withColumn("bucket", bucket("term")).repartition(4 * BUCKETS, F.xxhash64("term")).sortWithinPartitions("bucket", "term")
    return FullText(written(found, "bucket"), stats)


def lookup(g: Graph, name: str, value) -> DataFrame:
    """(id) of the nodes with a value, from an index."""
    return stored(g, name).where(F.col("value") == F.lit(value)).select("id")


def between(g: Graph, name: str, low=None, high=None) -> DataFrame:
    """(value, id) with low <= value <= high; a missing bound is open."""
    df = stored(g, name)
    if low is not None:
        df = df.where(F.col("value") >= F.lit(low))
    return df if high is None else df.where(F.col("value") <= F.lit(high))


def stored(g: Graph, name: str):
    if name not in g.indexes:
        raise LookupError(f"no index {name}")
    if name not in g.built:  # a write since then: made anew from the graph as it is
        g.built[name] = build(g, *g.indexes[name])
    return g.built[name]


def parsed(query: str) -> tuple[list[list[str]], list[str], bool]:
    """(groups of terms, excluded terms, whether all groups are needed): a phrase in quotes is a group of several terms;
    AND makes all groups necessary, OR and nothing any; a minus or NOT excludes a term."""
    groups, without, every, negated = [], [], False, False
    for m in re.finditer(r'(?P<minus>-)?(?:"(?P<phrase>[^"]*)"|(?P<word>\S+))', query):
        if m["word"] in ("AND", "OR", "NOT") and not m["minus"]:
            every, negated = every or m["word"] == "AND", m["word"] == "NOT"
            continue
        words = [t for t in re.split(r"[^\w]+|_", (m["phrase"] if m["phrase"] is not None else m["word"]).lower()) if t]
        if m["minus"] or negated:
            without += words
        elif words:
            groups.append(words)
        negated = False
    return groups, without, every


def search(g: Graph, name: str, query: str, k: int | None = 1000, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) by BM25 from a full-text index; ties to the lesser id; without k all. Only the postings of the query's
    terms are read, in the files that their hashes name."""
    index = stored(g, name)
    groups, without, every = parsed(query)
    terms_ = sorted({t for x in groups for t in x} | set(without))
    if not groups:
        return index.postings.select("id", F.lit(0.0).alias("score")).limit(0)
    spark = g.spark
    codes = [r["b"] for r in spark.createDataFrame([(t,) for t in terms_], "t string").select(bucket("t").alias("b")).distinct().collect()]
    hits = index.postings.where(F.col("bucket").isin(codes) & F.col("term").isin(terms_)).select("term", "id", "tf", "length", "places")
    counts = hits.groupBy("term").agg(F.count(F.lit(1)).alias("d"))  # a row a term of the query
    scored = hits.join(F.broadcast(counts), "term").crossJoin(F.broadcast(index.stats))
    idf = F.log(1.0 + (F.col("n") - F.col("d") + 0.5) / (F.col("d") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    wanted = sorted({t for x in groups for t in x})
    places = [F.first(F.when(F.col("term") == t, F.col("places")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(terms_)]
    by_doc = scored.groupBy("id").agg(F.sum(F.when(F.col("term").isin(wanted), weight).otherwise(0.0)).alias("score"), *places)
    at = {t: F.col(f"p{i}") for i, t in enumerate(terms_)}

    def holds(words: list[str]):
        """The first word's places from which the others follow."""
        test = at[words[0]].isNotNull()
        if len(words) > 1:
            for w in words[1:]:
                test = test & at[w].isNotNull()

            def follows(p):
                ok = F.lit(True)
                for i, w in enumerate(words[1:], 1):
                    ok = ok & F.array_contains(at[w], p + i)
                return ok

            test = test & F.coalesce(F.exists(at[words[0]], follows), F.lit(False))
        return test

    test = None
    for x in groups:
        test = holds(x) if test is None else (test & holds(x) if every else test | holds(x))
    for w in without:
        test = test & at[w].isNull()
    out = by_doc.where(test).select("id", "score")
    return out if k is None else out.orderBy(F.col("score").desc(), "id").limit(k)
