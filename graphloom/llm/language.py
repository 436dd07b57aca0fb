"""Word-level language identification by a linear-chain conditional random field."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import col, mix, new_name, slices, words_of
from graphloom.llm.toxicity import AROUND

#: The label of words in none of the languages.
NONE = "und"
SIZES = (2, 3, 4)
#: Bytes of text that are labelled at once.
SLICE = 3 << 19


def features(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, buckets of features) of lower-case words without outer punctuation; an empty word has none.

    With "^" and "$" at its ends, a word has its n-grams of 2 to 4 characters, of which those with an end mark are its
    affixes, and itself as the lexicon's key.
    """
    n = len(words)
    text = "".join(f"^{w}$" if w else "" for w in words.to_pylist())
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.where(lengths > 0, lengths + 2, 0)
    owner = np.repeat(np.arange(n), lengths)
    owners, keys = [], []
    rolled = codes.copy()
    for size in range(2, max(SIZES) + 1):
        rolled = rolled[: max(0, len(codes) - size + 1)] * np.uint64(0x100000001B3) + codes[size - 1 :]
        if size in SIZES:
            inside = owner[: len(rolled)] == owner[size - 1 :] if len(rolled) else np.zeros(0, bool)
            owners.append(owner[: len(rolled)][inside])
            keys.append(mix(rolled[inside] + np.uint64(size)))
    position = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    full = np.flatnonzero(lengths)
    if len(full):  # the whole word: a sum over its characters, each scrambled with its position
        terms = mix(codes * np.uint64(0x9E3779B97F4A7C15) + position.astype(np.uint64))
        owners.append(full)
        keys.append(mix(np.add.reduceat(terms, (np.cumsum(lengths) - lengths)[full])))
    owners, keys = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, keys))
    order = np.argsort(owners, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=n))])
    return starts, (keys[order] % np.uint64(buckets)).astype(np.int64)


def emissions(words: pa.Array, weights: np.ndarray, scale: bool = True) -> np.ndarray:
    """Each word's score for each label: its features' weights, divided by the square root of their number."""
    starts, keys = features(words, len(weights))
    out = np.zeros((len(words), weights.shape[1]), np.float32)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        out[some] = np.add.reduceat(weights[keys], starts[some], axis=0) / np.sqrt(np.diff(starts)[some])[:, None]
    return out


def normal(words: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.utf8_trim(words, AROUND))


def forward_backward(at: np.ndarray, emit: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Label probabilities of every word, for sequences emit[at[i]:at[i + 1]] at once; with pairs, also the expected
    transitions. Sequences are taken by falling length, so that step t handles those longer than t as one block."""
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    begin, length = at[:-1][order], lengths[order]
    k = emit.shape[1]
    longest = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(longest), "left")  # sequences with more than t words
    e = np.exp(emit - emit.max(axis=1, keepdims=True)) if len(emit) else emit
    m = np.exp(move).astype(np.float32)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    now = None
    for t in range(longest):
        where = begin[: alive[t]] + t
        now = e[where] if now is None else (now[: alive[t]] @ m) * e[where]
        now = now / now.sum(axis=1, keepdims=True)
        alpha[where] = now
    total = np.zeros((k, k))
    now = None
    for t in range(longest - 2, -1, -1):
        n = alive[t + 1]
        where = begin[:n] + t
        after = np.ones((n, k), np.float32)
        if now is not None:
            after[: len(now)] = now
        after *= e[where + 1]
        if pairs:
            joint = alpha[where][:, :, None] * m[None] * after[:, None, :]
            total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        now = after @ m.T
        now = now / now.sum(axis=1, keepdims=True)
        beta[where] = now
    p = alpha * beta
    p = p / p.sum(axis=1, keepdims=True) if len(p) else p
    return (p, total) if pairs else p


def switched(samples: dict, count: int, seed: int) -> list[list[tuple[str, str]]]:
    """Training sequences of (word, label): runs of words of the samples' texts, one or several languages in each,
    and runs of words in no language, made of digits, marks and random letters."""
    r = random.Random(seed)
    langs = sorted(samples)
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = []
    for _ in range(count):
        sequence = []
        for _ in range(r.choice((1, 1, 2, 3))):
            n = r.randint(4, 30)
            if r.random() < 0.15:
                for _ in range(n):
                    kind = r.random()
                    size = r.randint(1, 12)
                    w = "".join(r.choices("0123456789", k=size)) if kind < 0.3 else "".join(r.choices("0123456789" + letters + "=_-/+", k=size + 4)) if kind < 0.6 else "".join(r.choices("bcdfghjklmnpqrstvwxz", k=size + 2))
                    sequence.append((w, NONE))
            else:
                lang = r.choice(langs)
                words = r.choice(samples[lang])
                start = r.randrange(max(1, len(words) - n))
                sequence += [(w, lang) for w in words[start : start + n]]
        out.append(sequence)
    return out


class Model:
    """labels; weights (bucket, label) of features; move (label, label)."""

    def __init__(self, labels: list[str], weights: np.ndarray, move: np.ndarray):
        self.labels, self.weights, self.move = labels, weights, move


def train(samples: dict, buckets: int = 1 << 16, sequences: int = 1500, epochs: int = 12, seed: int = 1, rate: float = 0.15, decay: float = 1e-4) -> Model:
    """Fit by the gradient of the sequences' log-likelihood, expected minus seen counts, with Adagrad's step sizes.

    samples: for each language, lists of words. With no language there is only the label for none."""
    labels = [*sorted(samples), NONE]
    k = len(labels)
    weights, move = np.zeros((buckets, k), np.float32), np.eye(k) * 2.0
    if not samples:
        return Model(labels, weights, move)
    data = switched(samples, sequences, seed)
    g_w, g_m = np.full_like(weights, 1e-3), np.full((k, k), 1e-3)
    number = {label: i for i, label in enumerate(labels)}
    parts = [data[i : i + 100] for i in range(0, len(data), 100)]
    held = []
    for part in parts:
        at = np.concatenate([[0], np.cumsum([len(s) for s in part])])
        coded = normal(pa.array([w for s in part for w, _ in s], pa.large_string())).dictionary_encode()
        truth = np.array([number[label] for s in part for _, label in s])
        follows = np.ones(at[-1] - 1, bool)
        follows[at[1:-1] - 1] = False
        seen = np.zeros((k, k))
        np.add.at(seen, (truth[:-1][follows], truth[1:][follows]), 1)
        held.append((at, coded.indices.to_numpy(), features(coded.dictionary, buckets), truth, seen))
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in r.permutation(len(held)):
            at, ids, (starts, keys), truth, seen = held[i]
            size = np.diff(starts)
            some = np.flatnonzero(size)
            emit = np.zeros((len(size), k), np.float32)
            emit[some] = np.add.reduceat(weights[keys], starts[some], axis=0) / np.sqrt(size[some])[:, None]
            p, pairs = forward_backward(at, emit[ids], move, pairs=True)
            p = p.astype(np.float64)
            p[np.arange(len(p)), truth] -= 1
            each = np.zeros((len(size), k))
            np.add.at(each, ids, p)
            each[some] /= np.sqrt(size[some])[:, None]
            owner = np.repeat(np.arange(len(size)), size)
            used, place = np.unique(keys, return_inverse=True)
            grad = np.zeros((len(used), k))
            np.add.at(grad, place, each[owner])
            grad = grad / len(at) + decay * weights[used]
            g_w[used] += grad**2
            weights[used] -= rate * grad / np.sqrt(g_w[used])
            gm = (pairs - seen) / len(at)
            g_m += gm**2
            move -= rate * gm / np.sqrt(g_m)
    return Model(labels, weights, move)


def labelled(docs: DataFrame, most: int, most_words: int, text_col: str, lang_col: str) -> dict:
    """At most ``most`` documents a language, those with the least hashes, of each at most ``most_words`` neighbouring
    words from a place that the hash chooses in the whole text: the bounded sample that the model is fitted on. Labelling
    itself reads whole texts. Repeated rows and copies of a text in one language count once; rows with a null language
    or a null or blank text are left out; an empty table gives nothing."""
    h, lang = F.xxhash64(col(text_col)).alias("h"), col(lang_col).cast("string").alias("lang")
    some = docs.where(col(lang_col).isNotNull() & (F.trim(col(text_col)) != ""))
    ranked = some.select(lang, h).distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    bounds = ranked.where(F.col("r") <= most).groupBy("lang").agg(F.max("h").alias("bound")).collect()
    if not bounds:
        return {}
    inside = F.lit(False)
    for b in bounds:  # a term a language
        inside = inside | ((F.col("lang") == b["lang"]) & (F.col("h") <= b["bound"]))
    rows = some.select(lang, h, F.split(F.trim(col(text_col)), r"\s+").alias("all")).where(inside)
    start = F.pmod("h", F.greatest(F.lit(1), F.size("all") - most_words + 1).cast("long")).cast("int") + 1
    rows = rows.select("lang", "h", F.slice("all", start, F.lit(most_words)).alias("words")).dropDuplicates(["lang", "h"]).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        out.setdefault(r["lang"], []).append(r["words"])
    return out


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())]))


def label_texts(texts: pa.Array, model: Model, least: float = 0.2) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(language, share of words in a language, accepted, spans) of each text."""
    at, ids, words = words_of(texts)
    p = forward_backward(at, emissions(normal(words), model.weights)[ids], model.move)
    n, k = len(at) - 1, len(model.labels)
    lengths = np.diff(at)
    mass = np.zeros((n, k))
    some = np.flatnonzero(lengths)
    if len(some):
        mass[some] = np.add.reduceat(p, at[:-1][some], axis=0) / lengths[some][:, None]
    share = mass[:, :-1].sum(axis=1) if k > 1 else np.zeros(n)
    best = mass[:, :-1].argmax(axis=1) if k > 1 else np.zeros(n, int)
    names = pa.array([*model.labels, None])
    lang = names.take(pa.array(np.where(lengths == 0, k, np.where(share >= least, best, k - 1))))
    label = p.argmax(axis=1) if len(p) else np.zeros(0, int)
    owner = np.repeat(np.arange(n), lengths)
    first = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])])) if len(label) else np.zeros(0, int)
    runs = np.diff(np.concatenate([first, [len(label)]]))
    spans = pa.StructArray.from_arrays([names.take(pa.array(label[first])), pa.array((first - at[owner[first]]).astype(np.int32)), pa.array(runs.astype(np.int32))], names=["lang", "start", "words"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=n))]).astype(np.int32)
    return lang, pa.array(share.round(6)), pa.array((share >= least) & (lengths > 0)), pa.ListArray.from_arrays(pa.array(offsets), spans)


def fitted(docs: DataFrame, most: int = 300, most_words: int = 400, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model fitted on a bounded sample: ``most`` documents a language, ``most_words`` neighbouring words of each
    (labelled()). Without any labelled text there is only the label for none, and nothing is accepted."""
    return train(labelled(docs, most, most_words, text_col, lang_col))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, share, accepted, spans), a row a document.

    Every word of the whole text gets the label that is likeliest given all of the text; spans are the runs of
    words with one label, so that code-switched text shows its parts. share is the mean probability of words being
    in any language of the model, lang the language with most of it, or "und" if share is under a fifth; such
    documents are not accepted. A null, empty or blank text has lang null, share 0, no spans, and is not accepted.
    A tie goes to the label that comes first by name. Rows are independent: repeated rows repeat, an empty table
    gives none, nothing is shuffled; other columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the buckets and languages alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), *label_texts(batch.column(1), shared.value)], names=["id", "lang", "share", "accepted", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, lang string, share double, accepted boolean, spans array<struct<lang: string, start: int, words: int>>").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that identify() accepts, with all their columns and as they are, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    flag = new_name(docs, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, flag, SLICE):
            keep = label_texts(batch.column(place), shared.value)[2]
            yield batch.filter(keep)

    named = docs.toDF(*[flag if i == place else f"__{i}" for i in range(len(docs.columns))])  # names may clash
    kept = named.mapInArrow(run, named.schema)
    return kept.toDF(*docs.columns)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fitted(docs))
