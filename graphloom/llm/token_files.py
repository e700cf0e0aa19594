"""Token counts of the documents in flat, unindexed token files.

Files hold nothing but little-endian ids; a separator id ends each document. Blocks
of a file are searched for separators with vector compares, independently of each
other; a prefix scan over the blocks (running separator counts, and the tokens left
open by the blocks before) stitches documents that cross block boundaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder_of, parse_ranks, rank_file
from .common import stored


def write_token_files(docs: DataFrame, path: str, vocabulary: str, pattern: str, separator: int, dtype: str = "<u2") -> DataFrame:
    """Encode ``docs`` (doc_id, text) into one flat file a task under ``path``, a URI
    in storage that all executors share. Returns which document is where (file,
    ordinal, doc_id); the files are written as that frame is evaluated, so store it
    once. A task that runs again replaces its own file by the same bytes. Null text
    counts as empty; repeated rows are documents of their own; a long text is written as
    it is encoded; an empty table writes no file. A vocabulary with ids beyond ``dtype``,
    or with the ``separator`` among them, is an error."""
    ranks = rank_file(docs.sparkSession, vocabulary)
    ids = parse_ranks(ranks.value).values()
    if max(ids) > np.iinfo(dtype).max or not 0 <= separator <= np.iinfo(dtype).max:
        raise ValueError(f"ids up to {max(ids)} and the separator {separator} must fit {dtype}")
    if separator in set(ids):
        raise ValueError(f"the separator {separator} is an id of the vocabulary")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        own = encoder_of(ranks.value, pattern)
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.tokens"
        draft = f"{root}/_{name}.{context.taskAttemptId()}"
        end = np.array([separator], dtype).tobytes()
        at = 0
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                for ids in own.encode_all(text.as_py() or "" for text in batch.column(1)):
                    out.write(ids.astype(dtype).tobytes())
                    out.write(end)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(range(at, at + n), pa.int64()), batch.column(0)], names=["file", "ordinal", "doc_id"]
                )
                at += n
        if at:
            final = f"{root}/{name}"
            if fs.get_file_info(final).type != pafs.FileType.NotFound:  # of an earlier attempt: not all stores replace
                fs.delete_file(final)
            fs.move(draft, final)
        else:
            fs.delete_file(draft)

    return docs.select("doc_id", "text").mapInArrow(run, f"file string, ordinal long, doc_id {kind}")


def count_tokens(spark: SparkSession, path: str, separator: int, dtype: str = "<u2", block_tokens: int = 1 << 20) -> DataFrame:
    """Documents and token counts of every ``.tokens`` file under ``path``.

    Returns (file, ordinal, n_tokens), ordinals from 0 in file order. A document
    may cross any number of blocks. Tokens after the last separator form a last
    document; an empty file, or one ending in a separator, has none there; a folder
    without files gives no rows. The prefix scan of a file sees three numbers a block;
    the lengths within blocks stay in the stored scan and meet its result by block.
    """
    fs, root = pafs.FileSystem.from_uri(path)
    width = np.dtype(dtype).itemsize
    files = [f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".tokens") and not f.base_name.startswith("_")]
    listing = pa.table({"file": pa.array([f.base_name for f in files], pa.string()), "tokens": pa.array([f.size // width for f in files], pa.int64())})
    blocks = spark.createDataFrame(listing).filter("tokens > 0")
    blocks = blocks.select("file", "tokens", F.explode(F.expr(f"sequence(0, (tokens - 1) div {block_tokens})")).alias("block"))
    blocks = blocks.repartition("file", "block")

    def scan(batches):
        own, top = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                with own.open_input_file(f"{top}/{file}") as f:
                    f.seek(block * block_tokens * width)
                    ids = np.frombuffer(f.read(block_tokens * width), dtype)
                found = np.flatnonzero(ids == separator)
                inner = np.diff(found) - 1
                head = int(found[0]) if len(found) else 0
                tail = len(ids) - (int(found[-1]) + 1 if len(found) else 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([len(found)], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([inner.tolist()], pa.list_(pa.int64()))],
                    names=["file", "block", "ends", "head", "tail", "inner"],
                )

    scanned = stored(blocks.mapInArrow(scan, "file string, block long, ends long, head long, tail long, inner array<long>"), "token-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    seen = scanned.select("file", "block", "ends", "head", "tail")
    seen = seen.withColumn("base", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    seen = seen.withColumn("opened", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    closed = F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("opened"))).over(before), F.lit(0))
    seen = seen.withColumn("carry", F.col("opened") - closed)
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.col("block").desc())) == 1
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    seen = seen.select("file", "block", "base", "ends", (F.col("carry") + F.col("head")).alias("first"), F.when(last & (rest > 0), rest).alias("rest"))
    joined = seen.join(scanned.select("file", "block", "inner").hint("merge"), ["file", "block"])
    whole = F.when(F.col("ends") > 0, F.concat(F.array("first"), "inner")).otherwise(F.array().cast("array<bigint>"))
    lengths = F.when(F.col("rest").isNotNull(), F.concat(whole, F.array("rest"))).otherwise(whole)
    return joined.select("file", "base", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens")
