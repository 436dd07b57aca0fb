"""Token counts by rank-synchronous merging of arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import col, slices
from graphloom.llm.vocabulary import PATTERN, SLICE, VOCABULARY, Batches, Vocabulary, flat_bytes, pair_key, pretokens, vocabulary

NEVER = np.int32(2**31 - 1)


def symbol_counts(words: list[str], v: Vocabulary) -> np.ndarray:
    """How many tokens each word has.

    All words are one array of symbols, at first bytes. In every round each word's pairs of neighbours get their
    ranks; the pairs that have their word's lowest rank are merged in all words at once, of overlapping ones every
    other from the left; words without a pair are done and leave the array.
    """
    offsets, data = flat_bytes(words)
    counts = np.diff(offsets)
    symbols, owner = v.byte_token[data], np.repeat(np.arange(len(words)), counts)
    rank = _ranks(symbols, owner, v)
    while len(symbols):
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        lowest = np.minimum.reduceat(rank, begin)
        size = np.diff(np.concatenate([begin, [len(symbols)]]))
        counts[owner[begin]] = size
        if (lowest == NEVER).any():
            stay = np.repeat(lowest != NEVER, size)
            symbols, owner, rank, lowest, size = symbols[stay], owner[stay], rank[stay], lowest[lowest != NEVER], size[lowest != NEVER]
            if not len(symbols):
                break
        hit = rank == np.repeat(lowest, size)
        at = np.flatnonzero(hit)
        follows = np.concatenate([[False], (at[1:] == at[:-1] + 1)])
        if follows.any():  # overlapping pairs, as in a run of one symbol: every other one
            first = np.maximum.accumulate(np.where(~follows, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        symbols[at] = rank[at]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        place = np.cumsum(stay) - 1
        symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
        new = place[at]
        again = np.unique(np.concatenate([new, new[new > 0] - 1]))
        rank[again] = NEVER
        again = again[again < len(symbols) - 1]
        again = again[owner[again] == owner[again + 1]]
        found = v.join.get(pair_key(symbols[again], symbols[again + 1]))
        rank[again] = np.where(found < 0, NEVER, found)
    return counts


def _ranks(symbols: np.ndarray, owner: np.ndarray, v: Vocabulary) -> np.ndarray:
    rank = np.full(len(symbols), NEVER, np.int32)
    if len(symbols) > 1:
        found = v.join.get(pair_key(symbols[:-1], symbols[1:]))
        rank[:-1] = np.where((owner[:-1] == owner[1:]) & (found >= 0), found, NEVER)
    return rank


def token_counts(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_pretokens, n_bytes), a row a document, of whole texts.

    A null, empty text has zeros. Rows are independent: repeated rows repeat, an empty table gives none, nothing is
    shuffled; other columns are dropped. path is a vocabulary file that every executor can read.
    """

    def run(batches: Batches) -> Batches:
        v = vocabulary(path)
        for batch in slices(batches, "text", SLICE):
            texts = batch.column(1)
            at, ids, words = pretokens(texts, pattern)
            each = symbol_counts(words, v)[ids] if len(ids) else np.zeros(0, np.int64)
            total = np.concatenate([[0], np.cumsum(each)])
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total[at[1:]] - total[at[:-1]]), pa.array(np.diff(at)), size], names=["id", "n_tokens", "n_pretokens", "n_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, n_tokens long, n_pretokens long, n_bytes long").withColumnRenamed("id", id_col)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes as the counts have them, and whether its tokens lie between its pre-tokens and its bytes."""
    n = op5_token_counts(spark, sf_dir)
    return n.select("doc_id", "n_bytes", F.col("n_tokens").between(F.col("n_pretokens"), F.col("n_bytes")).alias("inside"))


EXTRA = {"token_bytes": (token_bytes, "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, true AS inside FROM documents")}
