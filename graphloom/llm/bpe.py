"""Byte-level byte-pair encoding with a hierarchical-bitmap rank queue.

Each merge rank has a bucket of linked-list positions. A two-level bitmap over
the ranks gives the lowest rank that has entries by find-first-set, so a merge
costs a few word operations however long the pre-token is. Entries whose pair has
changed meanwhile are skipped when they come up. In a bucket the leftmost position
goes first. Many pre-tokens go through one run of the queue, side by side, so that
a short one costs no set-up of its own.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

_CACHED_PIECES = 1 << 19  # about 100 MB a worker; the older half goes when it is full, and with each task
_BIT = [1 << i for i in range(256)]
_CACHED_CHARS = 64
_MERGED_AT_ONCE = 1000  # pre-tokens a run: the links of more do not fit the processor's cache
_AT_ONCE = 1 << 20  # longer texts are matched piece by piece


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class RankQueue:
    """Buckets of positions by rank, each a heap, under a two-level bitmap of 256-bit words."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 8) + 1)


class Encoder:
    """Ids of texts by ``ranks``, each match of ``pattern`` on its own; no special
    tokens. Text of any length, and pre-tokens of any length."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_rank = np.array([ranks[bytes([x])] for x in range(256)], np.int32)
        self.pair_rank = np.array([ranks.get(bytes([x, y]), -1) for x in range(256) for y in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}  # packed ids
        self.old: dict[str, bytes] = {}
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of pre-tokens, none of them empty. All are merged in one run of
        the queue, over positions in their concatenation; no pair crosses an end. The
        queue is empty between runs; its steps stand here in line, as calls would cost
        more than they do."""
        data, n = b"".join(pieces), sum(map(len, pieces))
        listed = (lambda x: x.tolist()) if n < _AT_ONCE else (lambda x: array("q", x.astype(np.int64).tobytes()))
        codes = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(piece) for piece in pieces])
        starts = ends - [len(piece) for piece in pieces]
        pairs = np.full(n, -1, np.int32)  # the rank of the pair that starts here, or -1
        pairs[:-1] = self.pair_rank[(codes[:-1].astype(np.int32) << 8) + codes[1:]]
        pairs[ends - 1] = -1
        edge = bytearray(n + 1)
        np.frombuffer(edge, np.uint8)[np.append(starts, n)] = 1
        gone = bytearray(n)
        after, before = listed(np.arange(1, n + 1)), listed(np.arange(-1, n - 1))
        pair, node = listed(pairs), listed(self.byte_rank[codes])
        rank_of, buckets, low, top, bit = self.ranks.get, self.queue.buckets, self.queue.low, 0, _BIT
        at = np.flatnonzero(pairs >= 0)
        at = at[np.argsort(pairs[at], kind="stable")]
        present, first = np.unique(pairs[at], return_index=True)
        for rank, bucket in zip(present.tolist(), np.split(at, first[1:])):
            buckets[rank] = bucket.tolist()
            low[rank >> 8] |= bit[rank & 255]
            top |= 1 << (rank >> 8)
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = (word << 8) + (bits & -bits).bit_length() - 1
            bucket = buckets.pop(rank)
            low[word] = bits & (bits - 1)
            if not low[word]:
                top &= top - 1
            while bucket:
                left = heappop(bucket)
                if pair[left] != rank:  # stale
                    continue
                right = after[left]
                end = after[right]
                pair[right] = -1
                gone[right] = 1
                after[left] = end
                node[left] = rank
                lower = False
                if edge[end]:
                    pair[left] = -1
                else:
                    before[end] = left
                    found = pair[left] = rank_of(data[left : after[end]], -1)
                    if found >= 0:
                        if found in buckets:
                            heappush(buckets[found], left)
                        else:
                            buckets[found] = [left]
                            low[found >> 8] |= bit[found & 255]
                            top |= 1 << (found >> 8)
                        lower = found < rank
                if not edge[left]:
                    prior = before[left]
                    found = pair[prior] = rank_of(data[prior:end], -1)
                    if found >= 0:
                        if found in buckets:
                            heappush(buckets[found], prior)
                        else:
                            buckets[found] = [prior]
                            low[found >> 8] |= bit[found & 255]
                            top |= 1 << (found >> 8)
                        lower = lower or found < rank
                if lower and bucket:  # that pair goes before the rest of this bucket
                    buckets[rank] = bucket
                    low[word] |= bit[rank & 255]
                    top |= 1 << word
                    break
        kept = np.frombuffer(gone, np.uint8) == 0
        packed = np.asarray(node, "<u4")[kept].tobytes()
        cuts = (4 * np.append(0, np.cumsum(kept)[ends - 1])).tolist()
        return [packed[cuts[i] : cuts[i + 1]] for i in range(len(pieces))]

    def _packed(self, texts: list[list[str]]) -> list[bytes]:
        """The packed ids of texts given as pre-tokens. What the cache lacks is merged first."""
        if len(self.cache) >= _CACHED_PIECES // 2:
            self.cache, self.old = {}, self.cache
        cache, old = self.cache, self.old
        lacking = set()
        for pieces in texts:
            lacking |= set(pieces).difference(cache)
        new, raw = [], []
        for piece in lacking:
            ids = old.get(piece)
            if ids is None:
                data = piece.encode("utf-8")
                whole = self.ranks.get(data)
                if whole is None:
                    new.append(piece)
                    raw.append(data)
                    continue
                ids = whole.to_bytes(4, "little")
            cache[piece] = ids
        for i in range(0, len(new), _MERGED_AT_ONCE):
            cache.update(zip(new[i : i + _MERGED_AT_ONCE], self.merge(raw[i : i + _MERGED_AT_ONCE])))
        out = [b"".join(map(cache.__getitem__, pieces)) for pieces in texts]
        for piece in new:
            if len(piece) > _CACHED_CHARS:
                del cache[piece]
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; about ``_AT_ONCE`` characters are held at a time."""
        held, chars = [], 0
        for text in texts:
            if len(text) < _AT_ONCE:
                held.append(self.pattern.findall(text))
                chars += len(text)
            if chars >= _AT_ONCE or len(text) >= _AT_ONCE:
                for packed in self._packed(held):
                    yield np.frombuffer(packed, "<u4")
                held, chars = [], 0
            if len(text) >= _AT_ONCE:
                pieces = (match.group() for match in self.pattern.finditer(text))
                parts = iter(lambda: list(islice(pieces, _AT_ONCE // 4)), [])
                yield np.frombuffer(b"".join(self._packed([part])[0] for part in parts), "<u4")
        for packed in self._packed(held):
            yield np.frombuffer(packed, "<u4")

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_of(rank_data: bytes, pattern: str) -> Encoder:
    """The worker process's own encoder of a vocabulary, made once."""
    key = (hashlib.sha256(rank_data).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(parse_ranks(rank_data), pattern)
    return _ENCODERS[key]


def rank_file(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast: its size is that of the file (under 1 MB)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text of ``docs`` (doc_id, text; others ignored).

    Returns (doc_id, n_tokens, ids_sha256, decoded_sha256), and with ``with_ids``
    also ids (array of int). Null text counts as empty: 0 tokens. Repeated rows give
    repeated rows; an empty table gives none. Ids are hashed as little-endian
    unsigned 32-bit integers; the decoded bytes come from the ids alone.
    """
    ranks = rank_file(docs.sparkSession, vocabulary)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        own = encoder_of(ranks.value, pattern)
        for batch in batches:
            counts, shas, backs, lists = [], [], [], []
            for ids in own.encode_all(text.as_py() or "" for text in batch.column(1)):
                counts.append(len(ids))
                shas.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                backs.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        own.old = {}

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
