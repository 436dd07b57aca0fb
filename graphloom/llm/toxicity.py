"""Toxicity by a weighted finite-state pattern grammar."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import col, slices, words_of

#: Word classes. "." ends a clause, "o" is any other word.
LEXICON = {
    "i": "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns imbecile dumbass bastard bastards "
    "asshole assholes dumb vermin filth garbage retard cretin wretch swine "
    "dummkopf trottel arschloch abschaum widerlich wertlos erbärmlich idioten "
    "imbécile imbéciles abruti abrutie ordure ordures connard crétin stupide minable "
    "idiota idiotas imbécil imbéciles estúpido estúpida escoria basura inútil patético asqueroso",
    "v": "kill hurt destroy murder stab shoot strangle burn crush beat töten umbringen verprügeln tuer frapper détruire matar golpear destruir",
    "w": "will gonna going shall must should i'll we'll werde werden vais allons voy vamos",
    "t": "you your yours you're youre u ur he she they them him her these those people everyone du ihr dich euch sie tu toi vous ils elles tú te ustedes ellos ellas yourself yourselves themselves",
    "c": "are is am be is're being was were bist seid ist sind es est êtes sont eres son",
    "n": "not never no isn't aren't wasn't don't won't can't cannot n't nor nicht kein keine nie jamais pas nunca",
    "r": "said says say wrote writes reported reports claimed claims called calls tweeted quoted quote according told alleged sagte schrieb laut dit écrit selon dijo escribió según",
}
CLASS = {w: c for c, ws in LEXICON.items() for w in ws.split()}
ENDS = ".;:!?…"
AROUND = "\"'`.,;:!?…()[]{}<>*#$%&|~^_/\\-–—“”‘’«»¡¿"


class Transducer:
    """Deterministic letter-to-letter transducer with weights that add up: arcs[state, read] = (written, weight, next)."""

    def __init__(self, arcs: dict, start: object = 0):
        self.arcs, self.start = arcs, start

    def compose(self, after: Transducer) -> Transducer:
        """The transducer that reads as this one and hands what it writes to ``after``; only states that are reached."""
        start = (self.start, after.start)
        arcs, todo = {}, [start]
        mine: dict = {}
        for (s, a), arc in self.arcs.items():
            mine.setdefault(s, []).append((a, arc))
        seen = {start}
        while todo:
            p, q = state = todo.pop()
            for a, (b, w, p2) in mine[p]:
                b2, w2, q2 = after.arcs[q, b]
                arcs[state, a] = (b2, w + w2, (p2, q2))
                if (p2, q2) not in seen:
                    seen.add((p2, q2))
                    todo.append((p2, q2))
        return Transducer(arcs, start)

    def numbered(self) -> Transducer:
        number = {s: i for i, s in enumerate(dict.fromkeys([self.start, *(s for s, _ in self.arcs)]))}
        return Transducer({(number[s], a): (b, w, number[n]) for (s, a), (b, w, n) in self.arcs.items()}, number[self.start])

    def run(self, read: str) -> tuple[str, float]:
        written, weight, state = [], 0.0, self.start
        for a in read:
            b, w, state = self.arcs[state, a]
            written.append(b)
            weight += w
        return "".join(written), weight


def negation(scope: int = 3) -> Transducer:
    """An insult or a threat's verb within ``scope`` words of a negating word becomes an ordinary word."""
    arcs = {}
    for s in range(scope + 1):
        for a in "ivwtcrno":
            written = "o" if a == "n" or (s and a in "iv") else a
            arcs[s, a] = (written, 0.0, scope if a == "n" else max(0, s - 1))
    return Transducer(arcs)


def reported() -> Transducer:
    """After a verb of saying insults and threats are written as reported ones: I and V."""
    arcs = {}
    for s in (0, 1):
        for a in "ivwtcro":
            written = "o" if a == "r" else {"i": "I", "v": "V"}.get(a, a) if s else a
            arcs[s, a] = (written, 0.0, 1 if a == "r" else s)
    return Transducer(arcs)


def targeted(weights: dict) -> Transducer:
    """Writes "x" for the address of a threat and "m" for a matched insult, weighing it by what stood before it.

    States: 0 nothing, 1 a target stands before, 2 a target and a form of "be", 3 right after an insult with no
    target. An insult after a target weighs more; a target right after an insult makes up the difference.
    """
    arcs = {}
    for s in range(4):
        for a in "ivwtcoIV":
            if a in "iI":
                share = weights["reported"] if a == "I" else 1.0
                arcs[s, a] = ("m", share * weights["predicated" if s == 2 else "addressed" if s == 1 else "bare"], s if s in (1, 2) else 3)
            elif a == "t":
                arcs[s, a] = ("t", weights["addressed"] - weights["bare"] if s == 3 else 0.0, max(s % 3, 1))
            elif a == "c":
                arcs[s, a] = ("o", 0.0, 2 if s in (1, 2) else 0)
            else:
                arcs[s, a] = (a, 0.0, s % 3)
    return Transducer(arcs)


def threatening(weights: dict) -> Transducer:
    """A verb of harm before a target weighs as a threat, more so after a word of intent.

    States: 0 nothing, 1 intent, 2 verb, 3 intent and verb, 4 and 5 the same with a reported verb; a verb waits for
    its target over two other words.
    """
    arcs = {}
    for wait in range(3):
        for s in range(6):
            for a in "ivwtomV":
                state = (s, wait)
                if a == "w":
                    arcs[state, a] = ("o", 0.0, (1, 0))
                elif a in "vV":
                    arcs[state, a] = ("o", 0.0, ((2 if a == "v" else 4) + (s == 1 or s in (3, 5)), 2))
                elif a == "t" and s >= 2:
                    w = weights["intended" if s in (3, 5) else "threat"] * (weights["reported"] if s >= 4 else 1.0)
                    arcs[state, a] = ("x", w, (0, 0))
                elif s >= 2:
                    arcs[state, a] = (a if a == "m" else "o", 0.0, (s, wait - 1) if wait else (0, 0))
                else:
                    arcs[state, a] = (a if a == "m" else "o", 0.0, (s, wait))
    return Transducer(arcs, (0, 0))


WEIGHTS = {"bare": 0.6, "addressed": 1.0, "predicated": 1.2, "threat": 1.0, "intended": 2.0, "reported": 0.4}


def grammar(weights: dict = WEIGHTS) -> Transducer:
    return negation().compose(reported()).compose(targeted(weights)).compose(threatening(weights)).numbered()


def clauses(text: str) -> list[str]:
    """The text's clauses as strings of word classes. What the operator does for many texts at once, for one."""
    out, now = [], []
    for word in text.split():
        now.append(CLASS.get(word.strip(AROUND).lower(), "o"))
        if word.rstrip("\"'`)]}»”’").endswith(tuple(ENDS)) or word == "|":
            out.append("".join(now))
            now = []
    return [*out, "".join(now)] if now else out


def scored(read: str, machine: Transducer) -> tuple[float, int, int]:
    """(weight, insults, threats) of a clause."""
    written, weight = machine.run(read)
    return max(weight, 0.0), written.count("m"), written.count("x")


STEM = range(4, 9)


def stem_counts(text: str) -> set[str]:
    """Beginnings of 4 to 8 letters that two words or more of a text have, without those of known insults."""
    seen: dict[str, int] = {}
    for word in text.split():
        word = word.strip(AROUND).lower()
        if word not in CLASS:
            for n in STEM:
                if len(word) >= n:
                    seen[word[:n]] = seen.get(word[:n], 0) + 1
    return {p for p, n in seen.items() if n > 1}


def learned_stems(docs: DataFrame, labels: DataFrame, most: int = 4000, ratio: float = 20.0, chance: float = 1e-8, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[str]:
    """Beginnings of words that mark abuse in languages for which the lexicon has no words, learnt from labels.

    The bounded sample: of toxic and of clean labelled documents those ``most`` each with the least hashes of their id.
    A beginning counts in a document that has it twice. It is taken if it is ``ratio`` times as frequent in toxic
    documents as in clean ones, and if that many toxic ones among its documents would come about by chance with a
    probability under ``chance``, so that few labels teach nothing rather than something wrong. Of beginnings of one
    another only the one with the most documents is kept, of equal ones the longest. Rows with a null id, text or
    label are left out; no labels, no beginnings.
    """
    marked = labels.where(col(id_col).isNotNull() & col(label_col).isNotNull()).select(col(id_col).alias("id"), (col(label_col).cast("int") > 0).alias("toxic")).distinct()
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id")
    sample = marked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
    texts = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(sample), "id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [(p, t) for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in ["", *stem_counts(text)]]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([t for _, t in found], pa.bool_())], names=["stem", "toxic"])

    each = texts.mapInArrow(run, "stem string, toxic boolean").groupBy("stem").agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.sum((~F.col("toxic")).cast("long")).alias("good"))
    rows = each.where("stem = '' or (bad >= 5 and bad > good)").collect()
    total = next((r for r in rows if r["stem"] == ""), None)
    if total is None or not total["bad"]:
        return []
    share = total["bad"] / (total["bad"] + total["good"])
    kept = []
    for r in rows:
        n, k = r["bad"] + r["good"], r["bad"]
        if r["stem"] and k / total["bad"] >= ratio * (r["good"] + 0.5) / max(1, total["good"]):
            tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(share) + (n - j) * math.log(max(1e-12, 1 - share))) for j in range(k, n + 1))
            if tail < chance:
                kept.append((k, len(r["stem"]), r["stem"]))
    out: list[str] = []
    for _, _, stem in sorted(kept, reverse=True):
        if not any(stem.startswith(x) or x.startswith(stem) for x in out):
            out.append(stem)
    return sorted(out)


def toxicity(docs: DataFrame, threshold: float = 1.0, density: float = 0.004, stems: list[str] | tuple = (), weights: dict = WEIGHTS, all_documents: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, insults, threats, toxic) of the documents whose matched clauses' weights sum to the threshold.

    Words that begin with one of ``stems`` are insults too. Where clauses with words of the lexicon don't suffice, the
    weights must also sum to ``density`` a word, so that a long text isn't toxic for what chance puts into it.

    A clause ends at a word with an end mark. An insult alone weighs little, with a target or a form of "be" more;
    negated it weighs nothing, in reported speech little; a verb of harm weighs only before a target. With
    all_documents the other documents come too, with toxic false; a null, empty or blank text then has score 0.
    Rows are independent: repeated rows give repeated results, an empty table none, and nothing is shuffled.
    Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = grammar(weights), {}
        names = pa.array(list(CLASS), pa.large_string())
        codes = np.array([ord(c) for c in CLASS.values()] + [ord("o")], np.uint8)
        begins = f"^(?:{'|'.join(map(re.escape, stems))})" if stems else None
        for batch in slices(batches, "text", 8 << 20):
            at, ids, words = words_of(batch.column(1))
            lower = pc.utf8_lower(pc.utf8_trim(words, AROUND))
            place = pc.fill_null(pc.index_in(lower, names), len(names)).to_numpy(zero_copy_only=False)
            class_of, guessed = codes[place], np.zeros(len(words), bool)
            if begins:
                guessed = pc.match_substring_regex(lower, begins).to_numpy(zero_copy_only=False) & (place == len(names))
                class_of = np.where(guessed, ord("i"), class_of).astype(np.uint8)
            bare = pc.utf8_rtrim(words, "\"'`)]}»”’")
            ends = np.zeros(len(words), bool)
            for e in ENDS:
                ends |= pc.ends_with(bare, e).to_numpy(zero_copy_only=False)
            ends |= pc.equal(words, "|").to_numpy(zero_copy_only=False)
            kinds, stops = class_of[ids], ends[ids]
            n = len(at) - 1
            score, insults, threats = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            hits = np.flatnonzero((kinds == ord("i")) | (kinds == ord("v")))
            sure = np.zeros(n)
            edge = np.unique(np.concatenate([at, np.flatnonzero(stops) + 1]))
            known_words = set(np.searchsorted(edge, hits[~guessed[ids[hits]]], "right").tolist())
            for k in np.unique(np.searchsorted(edge, hits, "right")).tolist() if len(hits) else ():
                a, b = edge[k - 1], edge[k]
                read = kinds[a:b].tobytes()
                if len(read) > 200 or (found := known.get(read)) is None:
                    found = scored(read.decode(), machine)
                    if len(read) <= 200 and len(known) < 100_000:  # remembered, not left out
                        known[read] = found
                doc = np.searchsorted(at, a, "right") - 1
                score[doc] += found[0]
                sure[doc] += found[0] * (k in known_words)
                insults[doc] += found[1]
                threats[doc] += found[2]
            toxic = (score >= threshold - 1e-9) & ((sure >= threshold - 1e-9) | (score >= density * np.diff(at)))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(score.round(6)), pa.array(insults), pa.array(threats), pa.array(toxic)], names=["id", "score", "insults", "threats", "toxic"])
            yield out if all_documents else out.filter(pa.array(toxic))

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, score double, insults long, threats long, toxic boolean").withColumnRenamed("id", id_col)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, stems=learned_stems(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
