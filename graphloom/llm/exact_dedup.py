"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import LAST, col, drop_stored, fresh_path, new_name, stored


class DigestIndex:
    """(digest, owner) of all documents seen, in a folder, bucketed and sorted by digest. One writer at a time.

    New data is joined to it bucket by bucket with a sort-merge anti-join: the index is neither shuffled nor, where a
    bucket is one file, sorted. New digests are appended as one more sorted file in each bucket; beyond ``most_files``
    files a bucket they are merged into one. The folder outlives the session; another session attaches to it by opening
    an index with the same path. The bucket count is stored with the data: without ``buckets`` it is taken from there,
    and another one is refused, as it would look for digests in the wrong buckets.

    Data is in ``path/g<n>-<buckets>``; a generation counts once its file ``_complete`` is there, and the latest one is
    read, so that a merge that is broken off leaves the former one in force.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, most_files: int = 8):
        self.spark, self.path, self.most_files = spark, path.rstrip("/"), most_files
        # A scan of buckets of one file each then counts as sorted. Only bucketed tables heed it.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        have = self._generations()
        if have:
            self.generation, self.buckets = max(have)
            if buckets and buckets != self.buckets:
                raise ValueError(f"the index in {path} has {self.buckets} buckets, not {buckets}")
        else:
            self.generation, self.buckets = 0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._open()
        if not have:
            self._complete()

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _generations(self) -> list[tuple[int, int]]:
        if not self._fs.exists(self._hadoop(self.path)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._hadoop(self.path))]
        found = [m for m in (re.fullmatch(r"g(\d+)-(\d+)", n) for n in names) if m]
        return [(int(m[1]), int(m[2])) for m in found if self._fs.exists(self._hadoop(f"{self.path}/{m[0]}/_complete"))]

    def _open(self) -> None:
        self.folder = f"{self.path}/g{self.generation}-{self.buckets}"
        self.table = "digest_index_" + hashlib.md5(self.folder.encode()).hexdigest()
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, owner BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'"
        )

    def _complete(self) -> None:
        self._fs.mkdirs(self._hadoop(self.folder))
        self._fs.create(self._hadoop(f"{self.folder}/_complete"), True).close()

    def _write(self, digests: DataFrame) -> None:
        writer = digests.repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet")
        writer.option("path", self.folder).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, digests: DataFrame) -> None:
        """Add (digest, owner) rows that the index lacks. Partitions are the buckets, so each gets one sorted file."""
        have = self.read().select("digest")
        self._write(digests.select("digest", "owner").join(have.hint("merge"), "digest", "left_anti"))
        if len(self.read().inputFiles()) > self.most_files * self.buckets:
            self.compact()

    def compact(self) -> None:
        """One sorted file a bucket again. What a reader that has the former files open still reads is gone after."""
        # Read as plain files: of a bucketed table Spark takes the partitions as given, but reads it unbucketed here.
        rows, former, table = self.spark.read.schema(self.read().schema).parquet(self.folder), self.folder, self.table
        self.generation += 1
        self._open()
        self._write(rows)
        self._complete()
        self.spark.sql(f"DROP TABLE {table}")
        self._fs.delete(self._hadoop(former), True)

    def close(self) -> None:
        """Forget the table in the session's catalogue; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digest_of(text) -> F.Column:
    """SHA-256 of the text's bytes; a null text has a digest of its own that no text has."""
    return F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"\0"))


def unseen(found: DataFrame, index: DigestIndex) -> DataFrame:
    """The (digest, owner) rows that the index has not, or has from the same owner. A null id, LAST, is no owner."""
    seen = index.read().select("digest", F.col("owner").alias("first_owner"))
    taken = (found.digest == seen.digest) & ((seen.first_owner != found.owner) | (found.owner == LAST))
    return found.join(seen.hint("merge"), taken, "left_anti")


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is new, with all their columns; their digests are appended to the index.

    Of rows with equal texts the one with the least id stays; of repeated rows, one. All null texts count as
    equal to each other, empty texts likewise; a null id comes after every other. A text that the index has from
    another owner is dropped; one that it has from the same owner stays, so that a run that is repeated after a
    failure returns the same rows. Rows without an id have no owner to tell: a text that was indexed from one, or comes
    with one, is dropped wherever the index has it. Ids are integers. An empty table returns no rows. Extra columns pass through, whatever their names.
    """
    digest, key = new_name(docs, "__digest"), new_name(docs, "__key")
    owner = F.coalesce(col(id_col).cast("long"), F.lit(LAST))
    # Only digests and ids are aggregated; this combines within map tasks, so copies in any number make no hot key.
    found = stored(docs.select(digest_of(col(text_col)).alias("digest"), owner.alias("owner")).groupBy("digest").agg(F.min("owner").alias("owner")), "digests")
    fresh = stored(unseen(found, index), "fresh")
    index.append(fresh)
    drop_stored(found)
    # Within a digest fresh.owner is the least id, so "<=" holds for that row alone; as it is no equality, rows stay
    # partitioned and sorted by digest alone, and dropping repeated rows needs neither another shuffle nor a sort.
    rows = docs.withColumns({digest: digest_of(col(text_col)), key: owner})
    kept = rows.join(fresh.hint("merge"), (rows[digest] == fresh.digest) & (rows[key] <= fresh.owner), "left_semi")
    return kept.dropDuplicates([digest]).select(*[col(c) for c in docs.columns])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in two batches, the lesser half of the ids' range first; the second one meets the stored
    digests of the first. What both keep is returned: of each text the row with the least id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    middle = docs.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("middle")).first()["middle"]
    index = DigestIndex(spark, fresh_path(spark, "index"))
    early = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    kept = [exact_dedup(docs.where(batch), index) for batch in (early, ~early)]
    index.close()
    return kept[0].union(kept[1])


SQL = {
    "op7_exact_dedup": "SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1"
}
