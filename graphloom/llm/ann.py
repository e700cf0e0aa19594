"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Equal vectors are indexed once and carry their least ids, so a vector with any
number of copies is one node. Each shard's graph is built by greedy searches that
propose neighbours and by relaxed-distance pruning that keeps diverse edges; beam
searches then run every query against every shard, in batches. Queries are not dealt
to the shards as rows: they are written once as files of bounded size, which each
shard's task reads in turn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, stored


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors scaled to length 1, safe against overflow and underflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of paired rows of original vectors, in double precision."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    q, x = q / np.abs(q).max(-1, keepdims=True), x / np.abs(x).max(-1, keepdims=True)
    return (q * x).sum(-1) / np.sqrt((q * q).sum(-1) * (x * x).sum(-1))


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int, keep_path: int = 0):
    """Greedy best-first search of all ``queries`` at once. Returns ids and squared
    distances of the final beams, nearest first (-1 pads), and the first
    ``keep_path`` nodes each search opened."""
    n = len(queries)
    ids = np.full((n, beam), -1, np.int32)
    dist = np.full((n, beam), np.inf, np.float32)
    opened = np.zeros((n, beam), bool)
    ids[:, 0] = entry
    dist[:, 0] = 2 - 2 * (queries @ x[entry])
    path = np.full((n, keep_path), -1, np.int32)
    for step in range(8 * beam):
        wait = ~opened & (ids >= 0)
        rows = np.flatnonzero(wait.any(1))
        if not len(rows):
            break
        slot = wait[rows].argmax(1)
        opened[rows, slot] = True
        at = ids[rows, slot]
        if step < keep_path:
            path[rows, step] = at
        near = graph[at]
        mine = ids[rows]
        known = (near[:, :, None] == mine[:, None, :]).any(2) | (near < 0)
        d = 2 - 2 * np.einsum("qd,qrd->qr", queries[rows], x[near])
        d[known] = np.inf
        all_ids = np.concatenate([mine, np.where(known, -1, near)], 1)
        all_dist = np.concatenate([dist[rows], d], 1)
        all_open = np.concatenate([opened[rows], np.zeros(near.shape, bool)], 1)
        best = np.argsort(all_dist, 1, kind="stable")[:, :beam]
        ids[rows] = np.take_along_axis(all_ids, best, 1)
        dist[rows] = np.take_along_axis(all_dist, best, 1)
        opened[rows] = np.take_along_axis(all_open, best, 1)
    return ids, dist, path


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node up to ``degree`` of its candidates (-1 pads): nearest first,
    leaving out those that a kept one is nearer to by the factor ``alpha``."""
    candidates = np.sort(candidates, 1)
    bad = (candidates < 0) | (candidates == nodes[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    near = x[candidates]
    d = 2 - 2 * np.einsum("nd,ncd->nc", x[nodes], near)
    d[bad] = np.inf
    order = np.argsort(d, 1, kind="stable")[:, : 4 * degree]
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    near = x[candidates]
    between = 2 - 2 * np.einsum("ncd,nkd->nck", near, near)
    out = np.full((len(nodes), degree), -1, np.int32)
    alive, rows = np.isfinite(d), np.arange(len(nodes))
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        pick = alive.argmax(1)  # they are sorted by distance
        out[some, k] = candidates[rows, pick][some]
        alive &= ~((alpha * between[rows, pick] <= d) & some[:, None])
        alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, batch: int = 256, seed: int = 7) -> tuple[np.ndarray, int]:
    """A directed graph over unit vectors ``x`` and its entry, the node nearest to
    the mean. Starts from random edges; each batch of nodes is searched for, pruned,
    and linked back."""
    n = len(x)
    rng = np.random.default_rng(seed)
    entry = int((x @ x.mean(0)).argmax())
    graph = np.full((n, degree), -1, np.int32)
    if n > 1:
        start = min(degree // 2, n - 1)
        graph[:, :start] = (np.arange(n)[:, None] + rng.integers(1, n, (n, start))) % n
    order = rng.permutation(n)
    for lo in range(0, n, batch):
        nodes = order[lo : lo + batch]
        ids, _, path = beam_search(x, graph, entry, x[nodes], beam, keep_path=16)
        graph[nodes] = robust_prune(x, nodes, np.concatenate([ids, path, graph[nodes]], 1), degree, alpha)
        src = np.repeat(nodes, degree).astype(np.int32)
        dst = graph[nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        heads, first, count = np.unique(dst, return_index=True, return_counts=True)
        extra = np.full((len(heads), int(count.max(initial=1))), -1, np.int32)
        extra[np.repeat(np.arange(len(heads)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        for s in range(0, len(heads), batch):
            h = heads[s : s + batch]
            graph[h] = robust_prune(x, h, np.concatenate([graph[h], extra[s : s + batch]], 1), degree, alpha)
    return graph, entry


def usable(vector: Column) -> Column:
    """Vectors that take part: not null or empty, all components finite, one not 0."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, k: int = 5, query_step: int = 50, shard_size: int = 12_000, beam: int = 96, file_rows: int = 65_536) -> DataFrame:
    """The ``k`` nearest of each query (vec_id divisible by ``query_step``) among all
    other rows of ``vectors`` (vec_id, embedding; other columns are ignored).

    Returns (query_id, rank, vec_id, score): largest cosine first, ties to the smaller
    vec_id; scores are exact cosines of the original vectors. Rows that ``usable``
    leaves out, and null vec_ids, take no part; vectors of another length are never
    compared. Where a vec_id repeats with other vectors, the query is the least of them
    (component by component) and each of them is a candidate under that id, which
    counts once, by its best score. With fewer candidates all are returned; an empty
    table gives no rows. A shard has about ``shard_size`` distinct vectors, which bounds
    its task's memory; queries lie in files of ``file_rows`` rows at most.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", "embedding")
    rows = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    rows = stored(rows, "ann-rows")
    nodes = rows.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"))
    # the k + 1 least ids of each vector (a query may be one of them), by salts first
    by_salt = Window.partitionBy("h1", "h2", "salt").orderBy("vec_id")
    by_node = Window.partitionBy("h1", "h2").orderBy("vec_id")
    ids = rows.select("h1", "h2", "vec_id").distinct().withColumn("salt", F.pmod("vec_id", F.lit(64)))
    ids = ids.withColumn("r", F.row_number().over(by_salt)).filter(F.col("r") <= k + 1)
    ids = ids.withColumn("r", F.row_number().over(by_node)).filter(F.col("r") <= k + 1).select("h1", "h2", "vec_id")

    queries = rows.filter(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = scratch_path(vectors.sparkSession, "ann-queries")
    queries.select("vec_id", F.size("embedding").alias("dim"), "embedding").write.option("maxRecordsPerFile", file_rows).parquet(asked)
    files = sorted(vectors.sparkSession.read.schema("vec_id long").parquet(asked).inputFiles())

    nodes = stored(nodes, "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_size))
    placed = nodes.select(F.expr(f"cast(pmod(h1, {shards}) as int)").alias("shard"), F.size("embedding").alias("dim"), "h1", "h2", "embedding")
    # one task a shard: its number is the partition's
    stream = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "h1", "h2")

    def batches_of(dim: int):
        for file in files:
            fs, path = pafs.FileSystem.from_uri(file)
            with fs.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(512):
                    at = np.flatnonzero(np.asarray(batch.column("dim")) == dim)
                    if len(at):
                        batch = batch.take(pa.array(at))
                        yield np.asarray(batch.column("vec_id")), np.asarray(batch.column("embedding").flatten(), np.float64).reshape(-1, dim)

    def search(dim: int, held: list):
        """All queries of this length against the nodes of one shard; the k + 1 best by
        exact cosine, and what ties with the last of them."""
        h1, h2, own = (np.concatenate(z) for z in zip(*held))
        x = unit(own).astype(np.float32)
        graph, entry = build_graph(x)
        for names, q in batches_of(dim):
            found, _, _ = beam_search(x, graph, entry, unit(q).astype(np.float32), beam)
            found = found[:, : 4 * (k + 1)]
            row, col = np.nonzero(found >= 0)
            score = np.full(found.shape, -np.inf)
            score[row, col] = cosine(q[row], own[found[row, col]])
            last = -np.sort(-score, 1)[:, min(k, score.shape[1] - 1)]
            row, col = np.nonzero((score >= last[:, None]) & (found >= 0))
            node = found[row, col]
            yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(h1[node]), pa.array(h2[node]), pa.array(score[row, col])], names=["query_id", "h1", "h2", "score"])

    def run(batches):
        dim, held = None, []
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            cuts = np.flatnonzero(np.concatenate(([True], dims[1:] != dims[:-1]))) if len(dims) else []
            for s, e in zip(cuts, [*cuts[1:], len(dims)]):
                if held and dims[s] != dim:
                    yield from search(dim, held)
                    held = []
                dim = int(dims[s])
                part = batch.slice(int(s), int(e - s))
                held.append((np.asarray(part.column("h1")), np.asarray(part.column("h2")), np.asarray(part.column("embedding").flatten(), np.float64).reshape(-1, dim)))
        if held:
            yield from search(dim, held)

    found = stream.mapInArrow(run, "query_id long, h1 long, h2 long, score double")
    # k + 1 vectors of each query hold its k nearest rows; more where vectors tie
    top = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    found = found.withColumn("r", F.rank().over(top)).filter(F.col("r") <= k + 1)
    pairs = found.join(ids, ["h1", "h2"]).filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    pairs = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return pairs.select("query_id", "rank", "vec_id", "score")
