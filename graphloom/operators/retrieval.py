"""Vectors, full text, and both fused by rank."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.expressions import failing
from graphloom.model import Graph, named
from graphloom.plans.syntax import PatternError
from graphloom.storage import written

# --- vectors as columns ----------------------------------------------------------------------------------------------


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length or the sizes differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / F.when(size != 0, size))


def euclidean(a: Column, b: Column) -> Column:
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)))


def strict_cosine(a: Column, b: Column) -> Column:
    wrong = failing("vectors differ in size", _double())
    none = failing("a vector has no length", _double())
    return F.when(F.size(a) != F.size(b), wrong).when((norm(a) == 0) | (norm(b) == 0), none).otherwise(cosine(a, b))


def _double():
    from pyspark.sql.types import DoubleType

    return DoubleType()


def _array():
    from pyspark.sql.types import ArrayType, DoubleType

    return ArrayType(DoubleType())


def present(v: Column) -> Column:
    return F.when(v.isNull(), failing("a node of the path has no vector", _array())).otherwise(v)


def mean(vectors: Column, what: str) -> Column:
    """The mean of an array of vectors; missing ones or different sizes fail."""
    n = F.size(vectors)
    bad = F.exists(vectors, lambda v: v.isNull()) | F.exists(vectors, lambda v: F.size(v) != F.size(F.get(vectors, F.lit(0))))
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.when(bad, failing(f"a {what} of the path has no vector, or one of another size", _array())).otherwise(F.transform(total, lambda x: x / n))


# --- nearest neighbours ----------------------------------------------------------------------------------------------


def vectors_of(g: Graph, model: str) -> DataFrame:
    if g.node_vectors is None:
        raise PatternError("the graph has no vectors")
    return g.node_vectors.where(F.col("model") == model).select("id", "vector")


def vector_of(g: Graph, node, model: str) -> list:
    row = vectors_of(g, model).where(F.col("id") == F.lit(node)).first()
    if row is None:
        raise PatternError(f"{node} has no vector of {model}")
    return row["vector"]


def references_of(g: Graph, node_model: str, edge_model: str) -> DataFrame:
    if g.references is None:
        return g.spark.createDataFrame([], "name string, vector array<double>")
    return g.references.where((F.col("node_model") == node_model) & (F.col("edge_model") == edge_model)).select("name", F.col("vector").cast("array<double>").alias("vector"))


def reference(g: Graph, name: str) -> list:
    """A stored reference vector by its name; else the vector of the node with that id."""
    if g.references is not None:
        row = g.references.where(F.col("name") == name).first()
        if row is not None:
            return row["vector"]
    if g.node_vectors is not None:
        row = g.node_vectors.where(F.col("id").cast("string") == name).first()
        if row is not None:
            return row["vector"]
    raise PatternError(f"no vector is named {name}")


def with_reference(g: Graph, name: str, vector: list, node_model: str = "default", edge_model: str = "default") -> Graph:
    if not vector or not any(vector):
        raise ValueError("a reference needs a vector with a length")
    row = g.spark.createDataFrame([(name, node_model, edge_model, [float(x) for x in vector])], "name string, node_model string, edge_model string, vector array<double>")
    old = g.references
    return g.but(references=row if old is None else old.where(F.col("name") != name).unionByName(row))


def knn(vectors: DataFrame, query: list, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(id, distance): the k least cosine distances, ties to the lesser id: exact, over the allowed ids only.

    Every task keeps its own k best, the driver's side merges k a task.
    """
    if allowed is not None:
        vectors = vectors.join(allowed.select(F.col(allowed.columns[0]).alias("id")).distinct(), "id", "left_semi")
    return vectors.select("id", (1.0 - cosine(F.col("vector"), vector_literal(query))).alias("distance")).orderBy("distance", "id").limit(k)


def knn_reference(g: Graph, name: str, model: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
    return knn(vectors_of(g, model), reference(g, name), k, allowed)


def similarity_to(g: Graph, node, model: str) -> DataFrame:
    """(id, cosine similarity) to a node's vector."""
    kind = g.node_vectors.schema["id"].dataType.simpleString()
    node = int(node) if kind in ("bigint", "int") else node
    return vectors_of(g, model).select("id", cosine(F.col("vector"), vector_literal(vector_of(g, node, model))).alias("similarity"))


#: Vectors in a block of knn_join().
BLOCK = 4096


def by_size(vectors) -> dict:
    """{size: (places, vectors of length one as a matrix)} of an Arrow array of vectors; one without a length stays 0."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        w = vectors.take(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), int(size))
        length = np.linalg.norm(w, axis=1, keepdims=True)
        out[size] = (at, w / np.where(length > 0, length, 1.0))
    return out


def blocks_of(names: list[str]):
    """(ids in their order, by_size() of their vectors) of the Parquet files' rows, BLOCK at a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow import fs

    for name in names:
        place, inside = fs.FileSystem.from_uri(name)
        with place.open_input_file(inside) as f:
            for batch in pq.ParquetFile(f).iter_batches(BLOCK, columns=["id", "vector"]):
                batch = batch.take(pc.sort_indices(pa.table({"id": batch.column(0)}), sort_keys=[("id", "ascending")]))
                ids = batch.column(0)
                yield np.array(ids.to_pylist(), dtype=object if pa.types.is_string(ids.type) else np.int64), by_size(batch.column(1))


def knn_join(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(id, other, distance): the k nearest others of each left row, by cosine distance, ties to the lesser id. Exact:
    every two blocks of vectors are multiplied as matrices. A vector without a length, or of another size, has distance 1.

    All pairs are compared, but only the left side is moved, once: the right side is written to the shared folder, and
    each task reads it a block at a time and keeps the best k of each of its own rows.
    """
    import numpy as np
    import pyarrow as pa

    kind, other_kind = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    stored = written(right.select("id", "vector"))
    names = stored.inputFiles()

    def nearest(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                own, mine = batch.column(0).to_pylist(), by_size(batch.column(1))
                best: list[list] = [[] for _ in own]
                worst = np.full(len(own), np.inf)
                for ids, columns in blocks_of(names):
                    same = np.searchsorted(ids, np.array(own, ids.dtype), "left"), np.searchsorted(ids, np.array(own, ids.dtype), "right")
                    for size, (rows, u) in mine.items():
                        for x in range(0, len(rows), 512):
                            some = rows[x : x + 512]
                            distance = np.ones((len(some), len(ids)))
                            if size in columns:
                                at, w = columns[size]
                                distance[:, at] = 1.0 - u[x : x + 512] @ w.T
                            for i in np.flatnonzero(same[0][some] < same[1][some]):
                                distance[i, same[0][some[i]] : same[1][some[i]]] = np.inf
                            low = distance.min(axis=1)
                            for i in np.flatnonzero((low <= worst[some]) & np.isfinite(low)):  # few, once k are near
                                row, d = some[i], distance[i]
                                edge = min(worst[row], np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf)
                                near = np.flatnonzero((d <= edge) & np.isfinite(d))
                                near = near[np.argsort(d[near], kind="stable")][:k]  # by id where distances are equal
                                best[row] = sorted([*best[row], *zip(d[near].tolist(), ids[near].tolist())])[:k]
                                worst[row] = best[row][-1][0] if len(best[row]) == k else np.inf
                flat = [(a, b, d) for a, found in zip(own, best) for d, b in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], batch.schema.field(0).type), pa.array([r[1] for r in flat], pa.string() if other_kind == "string" else pa.int64()), pa.array([r[2] for r in flat], pa.float64())], names=["id", "other", "distance"])

    n = max(1, -(-left.count() // BLOCK))
    met = left.select("id", "vector").repartition(n, "id").mapInArrow(nearest, f"id {kind}, other {'string' if other_kind == 'string' else 'bigint'}, distance double")
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return met.withColumn("place", place).where(F.col("place") <= k).select("id", F.col("other").cast(other_kind).alias("other"), "distance")


def knn_lists(g: Graph, wanted: DataFrame, k: int, model: str) -> DataFrame:
    """(id, list): a JSON array of the k nearest nodes' ids."""
    v = vectors_of(g, model)
    near = knn_join(v.join(wanted, "id", "left_semi"), v, k)
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("x"))
    return lists.select("id", F.to_json(F.transform("x", lambda x: x["other"].cast("string"))).alias("near"))


# --- full text -------------------------------------------------------------------------------------------------------


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search(g: Graph, name: str, query: str, k: int | None = 1000) -> DataFrame:
    """(id, score) from a stored full-text index (operators.indexes)."""
    from graphloom.operators.indexes import search as found

    return found(g, name, query, k)


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda t: t == F.lit(term)))


def bm25(docs: DataFrame, query: str, k: int = 1000, text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the k best documents that have one of the query's terms; ties to the lesser id.

    Only the query's terms are counted; one scan yields each document's length and term frequencies.
    """
    wanted = sorted({t for t in re.split(r"[^\w]+|_", query.lower()) if t})
    if not wanted:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    words = docs.where(named(text).isNotNull()).select("id", terms(named(text)).alias("w"))
    tf = words.select("id", F.size("w").alias("length"), *[_times("w", q).alias(f"t{i}") for i, q in enumerate(wanted)])
    stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(wanted))])
    joined = tf.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        f, d = F.col(f"t{i}"), F.coalesce(F.col(f"d{i}"), F.lit(0))
        idf = F.log(1.0 + (F.col("n") - d + 0.5) / (d + 0.5))
        score = score + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("length") / F.col("mean")))).otherwise(0.0)
    some = F.greatest(*[F.col(f"t{i}") for i in range(len(wanted))]) if len(wanted) > 1 else F.col("t0")
    return joined.where(some > 0).select("id", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def text_table(g: Graph, label: str | None = None, prop: str | None = None) -> DataFrame:
    """(id, text) of the full-text indexes, or of a label's property."""
    if label and prop:
        return g.node_table(label).select("id", named(prop).cast("string").alias("text"))
    kinds = [(a, p) for a, p, kind in g.indexes.values() if kind == "fulltext" and label in (None, a)]
    if not kinds:
        raise PatternError("no full-text index")
    out = None
    for a, p in kinds:
        t = g.node_table(a).select("id", named(p).cast("string").alias("text"))
        out = t if out is None else out.union(t)
    return out.groupBy("id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")) if len(kinds) > 1 else out


def fused(text_hits: DataFrame, vector_hits: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """(id, score, text_rank, vector_rank): reciprocal ranks from 0 summed over (id, rank) tables; ties to the lesser id."""
    a = text_hits.select("id", F.col("rank").alias("text_rank"))
    v = vector_hits.select("id", F.col("rank").alias("vector_rank"))
    both = a.join(v, "id", "full")
    score = F.coalesce(1.0 / (rrf_k + F.col("text_rank")), F.lit(0.0)) + F.coalesce(1.0 / (rrf_k + F.col("vector_rank")), F.lit(0.0))
    return both.select("id", score.alias("score"), "text_rank", "vector_rank").orderBy(F.col("score").desc(), "id").limit(k)


def ranked(df: DataFrame, order: list) -> DataFrame:
    """Places from 0 in a table that a limit has already made small."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).select("id", "rank")


def hybrid(g: Graph, text: str, vector: list, model: str = "default", k: int = 10, label: str | None = None, props: dict | None = None, text_prop: str | None = None, rrf_k: int = 60, overfetch: int = 4) -> DataFrame:
    """Full-text and vector hits fused. Candidates are k * overfetch of each among the nodes allowed by label and
    property values."""
    want = max(k, k * overfetch)
    allowed = None
    if label or props:
        allowed = g.node_table(label)
        for p, x in (props or {}).items():
            allowed = allowed.where(named(p) == F.lit(x))
        allowed = allowed.select("id")
    texts = text_table(g, label, text_prop)
    if allowed is not None:
        texts = texts.join(allowed, "id", "left_semi")
    a = ranked(bm25(texts, text, want), [F.col("score").desc(), "id"])
    b = ranked(knn(vectors_of(g, model), vector, want, allowed), ["distance", "id"])
    return fused(a, b, k, rrf_k)
