"""Shared plumbing of the training-data operators: scratch tables, byte views of
Arrow columns, and vectorised hashing of the words of a text."""

from __future__ import annotations

import hashlib
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space that separates words: code points 9 to 13 and 32.
WORD = r"[^\x20\x09-\x0D]+"

_RUN = uuid.uuid4().hex[:12]
_NEXT = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). Only where
    the session names none and runs on this machine alone (tests), a folder of it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "graphloom-checkpoints")
    return f"{root.rstrip('/')}/graphloom-{_RUN}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{next(_NEXT):04d}-{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: the lineage
    ends there, and a lost executor costs no more than the reader's own task."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete every scratch table this process has written. Call it once the
    results have been consumed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_table(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A driver-made table as a local relation (no Python runs on executors)."""
    return spark.createDataFrame(table)


# ---- bytes of Arrow columns -------------------------------------------------


def byte_views(column) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each value of a string column, without copies; None for null."""
    col = column.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = np.asarray(col.is_valid())
    for i in range(len(col)):
        yield data[offsets[i] : offsets[i + 1]] if valid[i] else None


# ---- hashes of words --------------------------------------------------------

_SEGMENT = 1 << 20  # bytes hashed at a time; a longer word goes through blake2b
_M = np.uint64(0x9DDFEA08EB382D69)
_POWERS: list[np.ndarray] = []

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 white space, 1 letters, digits and bytes of other scripts, 2 punctuation
_KIND = np.full(256, 2, np.uint8)
_KIND[np.flatnonzero(_SPACE)] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        inverse = np.uint64(pow(int(_M), -1, 1 << 64))
        for m in (_M, inverse):
            p = np.full(_SEGMENT + 1, m, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment_hashes(buf: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """One hash for each run of equal non-zero kind in a segment."""
    edges = np.flatnonzero(np.diff(kind)) + 1
    starts = np.concatenate(([0], edges))
    ends = np.concatenate((edges, [len(buf)]))
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers()
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, lower: bool = True, split_punctuation: bool = False) -> np.ndarray:
    """64-bit hashes of the words of a text in order; the same word has the same
    hash in every process. ``split_punctuation`` parts runs of letters from runs
    of punctuation. Texts of any length: they are hashed a segment at a time."""
    if lower:
        buf = _LOWER[buf]
    kinds = _KIND if split_punctuation else (~_SPACE).astype(np.uint8)
    parts, at, size = [], 0, len(buf)
    while at < size:
        piece = buf[at : at + _SEGMENT]
        kind = kinds[piece]
        if len(piece) < _SEGMENT:
            parts.append(_segment_hashes(piece, kind))
            break
        cuts = np.flatnonzero(kind == 0)
        if len(cuts) and cuts[-1]:
            parts.append(_segment_hashes(piece[: cuts[-1]], kind[: cuts[-1]]))
            at += int(cuts[-1])
        elif len(cuts):
            at += 1
        else:  # a word of a segment or more
            end = at + _SEGMENT
            while end < size and not _SPACE[buf[end]]:
                step = np.flatnonzero(_SPACE[buf[end : end + _SEGMENT]])
                end = end + int(step[0]) if len(step) else min(size, end + _SEGMENT)
            digest = hashlib.blake2b(buf[at:end].tobytes(), digest_size=8).digest()
            parts.append(np.frombuffer(digest, np.uint64))
            at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words; of fewer words, the whole
    sequence as one; of none, nothing."""
    if not len(words):
        return words
    width = min(k, len(words))
    n = len(words) - width + 1
    acc = np.full(n, np.uint64(width), np.uint64)
    for j in range(width):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return np.unique(acc)
