"""What the text operators share: the cluster's shared folder, batching, word arrays, alignment, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAST = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``; where that is unset, a new one, on a local master only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("graphloom.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("graphloom.shared.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: this cuts the lineage, and the loss of an executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def drop_stored(*frames: DataFrame) -> None:
    """Delete what stored() wrote. Only for frames that no later plan reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about ``most`` bytes of ``column``, texts or lists of numbers; one row is
    never cut.

    When they are used up, the memory they took goes back to the system: workers are kept for later tasks, beside
    others of the same executor.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        lists = pa.types.is_list(values.type)
        sizes = pc.fill_null(pc.list_value_length(values) if lists else pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes *= values.type.value_type.bit_width // 8 if lists else 1
        part = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, ids, distinct words): text i has the words ids[offsets[i]:offsets[i + 1]]; null has none.

    Words are what is left between white space; empty ones are dropped.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        owner = np.repeat(np.arange(len(lengths)), lengths)
        kept = ids != empty
        lengths = np.bincount(owner[kept], minlength=len(lengths)).astype(np.int64)
        ids = ids[kept]
    return np.concatenate([[0], np.cumsum(lengths)]), ids, coded.dictionary


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.asarray(words.to_pylist(), dtype=object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finish)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def plain(x: int) -> int:
    """mix() of one Python integer."""
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance (insert, delete, replace) of two sequences if it is at most ``most``, else ``most + 1``.

    Bands grow by a factor of four until the distance fits, so that long texts cost what they differ by.
    """
    band = 64
    while band * 2 < most:
        d = within_band(a, b, band)
        if d <= band:
            return d
        band *= 4
    return within_band(a, b, most)


def within_band(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most + 1``.

    Only the diagonals from -most to most are computed. The band is one integer, a bit for a cell's step to the
    next row, so that a column costs a few operations on 2 * most + 1 bits.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    start, end, shorter = 0, 0, len(b)
    while start < shorter and a[start] == b[start]:
        start += 1
    while end < shorter - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : shorter - end]
    rows, columns = len(a), len(b)
    if not columns:
        return rows
    limit, most = most, min(most, rows)
    if not most:
        return 1
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    # Bit k of column j stands for row j - most + k; vp and vn say where the value grows or falls to the next row.
    full = (1 << 2 * most + 1) - 1
    lowest = 1 << 2 * most
    vp, vn, value = full >> most << most, 0, most
    for j in range(columns):
        hit = where.get(b[j], 0)
        hit = (hit >> j - most if j > most else hit << most - j) & full
        d0 = (((hit & vp) + vp ^ vp) | hit | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j < rows - most:  # along the band's edge, until it meets the last row
            value += not d0 & lowest
            if value > limit + columns - (rows - most):
                return limit + 1
        else:  # then along the last row
            lowest >>= 1
            value += bool(hp & lowest) - bool(hn & lowest)
        vp = (hn | ~(d0 >> 1 | hp)) & full
        vn = d0 >> 1 & hp
    return min(value, limit + 1)


def components(edges: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(node, root): each node that has an edge and the least node it is connected with, directly or not.

    Large-star and small-star steps in turn until no edge changes; each step is written to the shared folder.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    was = now.agg(F.count(F.lit(1)), mark).first()
    while was[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", "m")).where("u <> v").distinct()
        after = stored(small, "edges")
        drop_stored(now)
        is_now = after.agg(F.count(F.lit(1)), mark).first()
        now = after
        if is_now == was:
            break
        was = is_now
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def new_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until df has no such column, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
