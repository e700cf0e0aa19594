"""Exact deduplication through a persistent digest index.

The index is a table bucketed and sorted by digest with one row for each distinct
text. New data comes in batches: a batch is aggregated by digest first (so a text
with a third of all rows is one row before any shuffle), a sort-merge anti-join finds
the digests the index lacks, and those are appended. What a batch holds of digests
the index knows goes to a log beside it, bucketed alike, so counts and the largest
doc_id stay right. Digests are 32 bytes of SHA-256 of the UTF-8 text as it is; null
text counts as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stored


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class DigestIndex:
    """Tables ``name`` (digest, keep_id, rows, batch) and ``name``_seen (the same, of
    known digests), both of ``buckets`` buckets by digest. Give the ``name`` and ``path``
    of an earlier index to go on with it."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = (path or scratch_path(spark, self.name)).rstrip("/")
        for table, where in ((self.name, self.path), (f"{self.name}_seen", f"{self.path}-seen")):
            fresh = not spark.catalog.tableExists(table)
            spark.sql(
                f"create table if not exists {table} (digest binary, keep_id {id_type}, rows bigint, batch string) using parquet "
                f"partitioned by (batch) clustered by (digest) sorted by (digest) into {buckets} buckets location '{where}'"
            )
            if fresh and path:  # an index of another session's catalogue
                spark.sql(f"msck repair table {table}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def groups(self) -> DataFrame:
        """(digest, keep_id, rows) over all batches; tables are bucketed alike, so
        nothing is dealt anew."""
        log = self.spark.table(f"{self.name}_seen").groupBy("digest").agg(F.max("keep_id").alias("later_id"), F.sum("rows").alias("later"))
        rows = self.table().join(log.hint("merge"), "digest", "left")
        return rows.select("digest", F.greatest("keep_id", "later_id").alias("keep_id"), (F.col("rows") + F.coalesce("later", F.lit(0))).alias("rows"))

    def _write(self, table: str, groups: DataFrame, batch: str) -> None:
        """Put ``groups`` in the place of this batch's rows: a batch that is added again
        after a failure replaces what it had written."""
        view = f"digests_{uuid.uuid4().hex}"
        groups.repartition(self.buckets, "digest").sortWithinPartitions("digest").createOrReplaceTempView(view)
        self.spark.sql(f"insert overwrite table {table} partition (batch = '{batch}') select digest, keep_id, rows from {view}")
        self.spark.catalog.dropTempView(view)

    def add(self, batch: DataFrame, batch_id: str | None = None) -> DataFrame:
        """Deduplicate ``batch`` (digest, doc_id) within itself and against the other
        batches of the index, and append what is new. Returns the new groups (digest,
        keep_id, rows). With the same ``batch_id`` it can be run again."""
        batch_id = batch_id or uuid.uuid4().hex
        groups = stored(batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("rows")), "digest-batch")
        known = self.table().filter(F.col("batch") != batch_id).select("digest")
        new = stored(groups.hint("merge").join(known, "digest", "left_anti"), "digest-new")
        again = stored(groups.hint("merge").join(known, "digest", "left_semi"), "digest-known")
        self._write(self.name, new, batch_id)
        self._write(f"{self.name}_seen", again, batch_id)
        return new

    def drop(self) -> None:
        """Take the tables out of the catalogue; their files stay until ``purge``."""
        for table in (self.name, f"{self.name}_seen"):
            self.spark.sql(f"drop table if exists {table}")


def exact_groups(docs: DataFrame, buckets: int = 64, hot_share: int = 1000, batches: int = 2, index: DigestIndex | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; other columns are ignored) with its group.

    The rows meet the index in ``batches`` batches by a hash of doc_id, each against
    what the index holds by then. Give a lasting ``index`` to deduplicate against
    earlier data too: its rows count in group_size and may hold the keep_id.

    Returns (doc_id, digest, keep_id, group_size, kept). Of equal texts the row with
    the largest doc_id stays; a null doc_id is below any other. Of repeated rows with
    that same doc_id exactly one stays. Null text equals empty text; texts of any
    length are hashed whole. An empty table gives no rows. Texts with more than
    1 / ``hot_share`` of all rows number fewer than ``hot_share``, so these groups alone
    are broadcast; all others meet their rows in a sort-merge join, where no digest has
    more than that share.
    """
    batch_of = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    rows = stored(docs.select("doc_id", text_digest(F.col("text")).alias("digest")).withColumn("part", batch_of), "digests")
    own = index or DigestIndex(docs.sparkSession, buckets=buckets, id_type=dict(docs.dtypes)["doc_id"])
    run = uuid.uuid4().hex
    for part in range(batches):
        own.add(rows.filter(F.col("part") == part), f"{run}-{part}")
    here = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("here"))  # a lasting index holds more than these rows
    groups = stored(own.groups().hint("merge").join(here, "digest"), "digest-groups")
    hot = F.col("here") * hot_share > F.lit(rows.count())
    ids = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    near = ids.join(F.broadcast(groups.filter(hot)), "digest", "left")
    done = near.filter(F.col("rows").isNotNull())
    rest = near.filter(F.col("rows").isNull()).select("digest", "doc_id", "copies")
    rest = rest.join(groups.filter(~hot).hint("merge"), "digest")
    both = done.unionByName(rest).withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    if index is None:
        own.drop()
    return both.select(
        "doc_id",
        "digest",
        "keep_id",
        F.col("rows").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
    )


def distinct_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``docs`` that stay, with ``columns``: one for each distinct text.
    Null and empty texts are one text; of rows without any doc_id one stays; an empty
    table gives no rows."""
    stay = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    rows = docs.withColumn("_own", text_digest(F.col("text")))
    rows = rows.join(stay, rows["doc_id"].eqNullSafe(stay["_id"]) & (rows["_own"] == stay["_digest"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "_own"]).select(*columns)
