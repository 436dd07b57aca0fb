"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import col, drop_stored, new_name, stored


def tokens_of(text) -> F.Column:
    """Number of words between white space; 0 for a null or blank text."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("double")


MOST_BROADCAST = 100_000


def by_source(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of a row a source, marked for broadcast while it is small; else the join is left to the optimiser."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= MOST_BROADCAST else table


def smoothed_targets(totals: dict, exponent: float, keep_all: bool) -> dict:
    """Tokens that each source shall have: shares in proportion to its tokens to the power ``exponent``.

    keep_all: the least overall size at which no source has to give tokens up; else the size stays as it is.
    """
    weights = {s: t**exponent for s, t in totals.items() if t > 0}
    whole = sum(weights.values())
    size = max((totals[s] * whole / w for s, w in weights.items()), default=0.0) if keep_all else sum(totals.values())
    return {s: size * w / whole for s, w in weights.items()}


def balanced(units: DataFrame, targets: dict, tolerance: float = 1e-6, most_steps: int = 100) -> dict:
    """The dual solution: for each source the tilt x of the rates exp(x * tokens / scale), as (x, scale).

    units has (source, tokens). Minimising the divergence of the rates from 1 under "the source's tokens, weighted
    by the rates, sum to its target" has the convex dual sum(exp(x * c)) - x * target / scale with c = tokens / scale.
    Every Newton step is one aggregation over all documents that returns a row a source: the gradient and the
    Hessian, which is diagonal as a document is of one source. Steps are damped where the dual doesn't fall.
    """
    held = units.where("tokens > 0").groupBy("source").agg(F.avg("tokens").alias("scale"), F.sum("tokens").alias("total"), F.max("tokens").alias("most")).collect()
    scale = {r["source"]: r["scale"] for r in held}
    reach = {r["source"]: r["most"] / r["scale"] for r in held}
    want = {s: targets[s] / scale[s] for s in scale if targets.get(s, 0) > 0}
    if not want:
        return {}
    x, step, value = dict.fromkeys(want, 0.0), dict.fromkeys(want, 0.0), dict.fromkeys(want, math.inf)
    done: set = set()
    spark = units.sparkSession
    for _ in range(most_steps):
        trial = {s: x[s] + step[s] for s in want}
        table = by_source(spark, [(s, trial[s], scale[s]) for s in want], "source string, x double, scale double")
        tilted = units.where("tokens > 0").join(table, units.source.eqNullSafe(table.source)).select(table.source, (F.col("tokens") / F.col("scale")).alias("c"), (F.col("x") * F.col("tokens") / F.col("scale")).alias("e"))
        rate = F.exp("e")
        rows = tilted.groupBy("source").agg(F.sum(rate).alias("f"), F.sum(rate * F.col("c")).alias("g"), F.sum(rate * F.col("c") * F.col("c")).alias("h")).collect()
        for r in rows:
            s = r["source"]
            if s in done:
                continue
            now = r["f"] - trial[s] * want[s]
            if not math.isfinite(now) or now > value[s] + 1e-9 * abs(value[s]):
                step[s] /= 4
                continue
            x[s], value[s] = trial[s], now
            gradient = r["g"] - want[s]
            if abs(gradient) <= tolerance * want[s]:
                done.add(s)
                step[s] = 0.0
                continue
            newton = -gradient / r["h"]
            step[s] = float(np.clip(newton, -8 / 1.0, 20 / reach[s]))
        if len(done) == len(want):
            break
    else:
        raise ArithmeticError(f"no balance after {most_steps} Newton steps for {sorted(map(str, set(want) - done))[:5]}")
    return {s: (x[s], scale[s]) for s in want}


def mix(docs: DataFrame, targets: dict | None = None, exponent: float = 0.9, keep_all: bool = True, seed: int = 7, tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with the columns rate and copies (with underscores where docs has such): copies sum to the targets.

    targets: tokens for each source; without them they follow from ``exponent`` (smoothed_targets). A source that
    targets lack gets rate 0. rate is exp(tilt * tokens); copies is the rate rounded up or down by a hash of id and
    seed, so that its mean is the rate and a second run gives the same. A null source is a source like another.
    A null, empty or blank text has no tokens and weighs in no constraint: its rate is 1, its copies 1. Repeated
    rows each get the same result. An empty table returns no rows.
    """
    rate, copies, t, s = (new_name(docs, n) for n in ("rate", "copies", "__tokens", "__source"))
    source = F.coalesce(F.concat(F.lit("="), col(source_col).cast("string")), F.lit("null"))
    units = stored(docs.select(source.alias("source"), tokens_of(col(text_col)).alias("tokens")), "units")
    if targets is None:
        totals = {r["source"]: r["n"] for r in units.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
        goal = smoothed_targets(totals, exponent, keep_all)
    else:
        goal = {"null" if k is None else f"={k}": v for k, v in targets.items()}
    tilt = balanced(units, goal, tolerance)
    drop_stored(units)
    full = docs.withColumns({t: tokens_of(col(text_col)), s: source})
    spark = docs.sparkSession
    k, x = new_name(docs, "__k"), new_name(docs, "__x")
    table = by_source(spark, [(name, a / c) for name, (a, c) in tilt.items()], f"{k} string, {x} double")
    full = full.join(table, F.col(s) == F.col(k), "left")
    full = full.withColumn(rate, F.when(F.col(t) == 0, 1.0).otherwise(F.coalesce(F.exp(F.col(x) * F.col(t)), F.lit(0.0))))
    u = (F.xxhash64(col(id_col).cast("string"), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    full = full.withColumn(copies, F.floor(F.col(rate) + u).cast("long"))
    return full.select(*[col(c) for c in docs.columns], col(rate), col(copies))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as mix() says, and the columns that docs has. What mix() says of nulls, blank texts,
    repeated rows and empty tables holds: rows without tokens stay once."""
    found = mix(docs, **options)
    return found.withColumn(found.columns[-1], F.explode(F.array_repeat(F.lit(1), col(found.columns[-1]).cast("int")))).select(*[col(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rate and copies under the smoothed targets at the corpus's present size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, exponent=0.7, keep_all=False).select("doc_id", "source", "rate", "copies")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents and tokens, and what part of its target the rates reach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    full = mix(docs, exponent=0.7, keep_all=False).withColumn("t", tokens_of(F.col("text")))
    sums = full.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("t").alias("tokens"), F.sum(F.col("rate") * F.col("t")).alias("got"))
    whole = sums.agg(F.sum("tokens").alias("all"), F.sum(F.pow("tokens", F.lit(0.7))).alias("weights"))  # one row
    target = F.col("all") * F.pow("tokens", F.lit(0.7)) / F.col("weights")
    return sums.crossJoin(F.broadcast(whole)).select("source", "documents", F.col("tokens").cast("long").alias("tokens"), F.round(F.col("got") / target, 4).alias("reached"))


EXTRA = {"mixing_targets": (mixing_targets, r"SELECT source, count(*) AS documents, CAST(sum(len([w FOR w IN string_split_regex(text, '\s+') IF w <> ''])) AS BIGINT) AS tokens, 1.0 :: DOUBLE AS reached FROM documents GROUP BY 1")}
