"""Embedding near-duplicates by navigable small-world graphs per shard (operator 5).

1. Equal vectors become one, with their number. Vectors are dealt over shards by a hash of their id; each shard
   builds a hierarchical navigable small-world graph (layers of nested random samples, neighbours chosen for
   closeness and spread), searched and extended for many vectors at once in numpy.
2. Every vector is a query to every shard, in blocks. A beam is widened for a query while all it holds is within the
   threshold, and for all queries of a block while an audit against brute force, of queries that have links, finds
   less than ``recall`` of the linked vectors; a beam as wide as the shard is brute force itself.
3. What a beam found is verified by cosine in double precision. A block returns each query's number of links and a
   spanning forest of its links, at most a row for each vector, and the forests are united.

Results may miss links, as the method is approximate; audits hold the recall. Vectors that are null, zero or hold
null or non-finite components, and vectors of different lengths, link with nothing.

Ties and odd rows: rows that repeat a vector are linked with each other; an id that names several vectors gives a
row for each; null ids are carried; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, public_id

SHARDS, SHARD_ROWS, BLOCKS, BLOCK_ROWS = 8, 50_000, 2, 50_000
M, M0, BUILD_BEAM, BEAM = 12, 24, 48, 48
#: an audit goes on until it has so many queries with links besides themselves, and so many links, or no query is left
AUDIT, AUDIT_LINKS = 32, 200


def spread(sims: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """Which candidates (rows: best first, similarities ``sims``; ``among`` theirs to each other) become neighbours:
    one that is nearer to its query than to any neighbour taken before. Places that stay free go to the best others."""
    b, c = sims.shape
    take, n = np.zeros((b, c), bool), np.zeros(b, np.int64)
    for i in range(c):
        near = np.where(take[:, :i], among[:, i, :i], -2.0).max(axis=1) if i else np.full(b, -2.0)
        ok = (sims[:, i] > near) & (n < most) & (sims[:, i] > -2)
        take[:, i] = ok
        n += ok
    for i in range(c):
        ok = ~take[:, i] & (n < most) & (sims[:, i] > -2)
        take[:, i] |= ok
        n += ok
    return take


class Graph:
    """Layers 0 .. top over the vectors ``x`` (unit rows); layer l holds the first ``sizes[l]``, which are in random order."""

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        self.sizes = [n]
        while self.sizes[-1] > 4 * M:
            self.sizes.append(max(1, self.sizes[-1] // M))
        self.links = [np.full((s, M0 if i == 0 else M), -1, np.int32) for i, s in enumerate(self.sizes)]
        for layer in range(len(self.sizes) - 1, -1, -1):
            self._build(layer)

    def _build(self, layer: int) -> None:
        n, done = self.sizes[layer], 0
        while done < n:
            step = min(n - done, 256 if done == 0 else min(1024, done))
            new = np.arange(done, done + step)
            q = self.x[new]
            inner = q @ q.T
            np.fill_diagonal(inner, -2)
            k = min(BUILD_BEAM, step)
            part = np.argpartition(-inner, k - 1, axis=1)[:, :k] if step > 1 else np.zeros((step, 1), int)
            ids, sims = new[part], np.take_along_axis(inner, part, 1)
            if done:
                far, fs = self.search(q, BUILD_BEAM, layer, done)
                ids, sims = np.concatenate([ids, far], 1), np.concatenate([sims, fs], 1)
            self._connect(layer, new, ids, sims)
            done += step

    def _connect(self, layer: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        ids, sims = self._choose(layer, ids, sims)
        self.links[layer][nodes] = ids
        to, src = ids.ravel(), np.repeat(nodes, ids.shape[1])
        ok = to >= 0
        to, src, s = to[ok], src[ok], sims.ravel()[ok]
        order = np.lexsort((-s, to))
        to, src = to[order], src[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        wide = self.links[layer].shape[1]
        keep = place < 2 * wide
        to, src, place = to[keep], src[keep], place[keep]
        hit, row = np.unique(to, return_inverse=True)
        more = np.full((len(hit), 2 * wide), -1, np.int64)
        more[row, place] = src
        both = np.concatenate([self.links[layer][hit].astype(np.int64), more], 1)
        for a in range(0, len(hit), 512):
            h, c = hit[a : a + 512], both[a : a + 512]
            c.sort(axis=1)
            sim = np.einsum("bcd,bd->bc", self.x[np.maximum(c, 0)], self.x[h])
            same = np.zeros(c.shape, bool)
            same[:, 1:] = c[:, 1:] == c[:, :-1]
            sim[(c < 0) | same | (c == h[:, None])] = -2
            self.links[layer][h] = self._choose(layer, c, sim)[0]

    def _choose(self, layer: int, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = self.links[layer].shape[1]
        out, kept = np.full((len(ids), wide), -1, np.int64), np.full((len(ids), wide), -2.0)
        for a in range(0, len(ids), 256):
            i, s = ids[a : a + 256], sims[a : a + 256]
            order = np.argsort(-s, axis=1, kind="stable")[:, : 2 * wide]
            i, s = np.take_along_axis(i, order, 1), np.take_along_axis(s, order, 1)
            v = self.x[np.maximum(i, 0)]
            take = spread(s, v @ v.transpose(0, 2, 1), wide)
            rank = np.cumsum(take, 1) - 1
            r, c = np.nonzero(take)
            out[a + r, rank[r, c]], kept[a + r, rank[r, c]] = i[r, c], s[r, c]
        return out, kept

    def search(self, q: np.ndarray, beam: int, layer: int = 0, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and similarities of the ``beam`` best found in the layer's first ``size`` vectors, unordered."""
        size = self.sizes[layer] if size is None else size
        rows = max(8, min(512, (1 << 25) // max(size, 1)))
        parts = [self._search(q[a : a + rows], beam, layer, size) for a in range(0, len(q), rows)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, beam: int, layer: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        b = len(q)
        top = layer
        while top + 1 < len(self.sizes) and self.sizes[top + 1] <= size and top + 1 - layer < len(self.sizes):
            top += 1
        first = min(size, self.sizes[top], 4 * M)
        sims = q @ self.x[:first].T
        k = min(8, first)
        entry = np.argpartition(-sims, k - 1, axis=1)[:, :k] if first > k else np.tile(np.arange(first), (b, 1))
        for at in range(top, layer - 1, -1):
            ids, sims = self._walk(q, entry, 12 if at > layer else beam, at, min(size, self.sizes[at]))
            if at > layer:
                best = np.argsort(-sims, axis=1)[:, :8]
                entry = np.take_along_axis(ids, best, 1)
        return ids, sims

    def _walk(self, q: np.ndarray, entry: np.ndarray, beam: int, layer: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        b, links = len(q), self.links[layer]
        seen = np.zeros((b, size + 1), bool)  # the last place stands for "none"
        ids, sims, open_ = np.full((b, beam), -1, np.int64), np.full((b, beam), -2.0, np.float32), np.zeros((b, beam), bool)
        who, new = np.arange(b), entry
        while len(who):
            # distinct, not yet seen, in the part that exists
            new = np.where((new < 0) | (new >= size), size, new)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = size
            new[seen[who[:, None], new]] = size
            seen[who[:, None], new] = True
            seen[:, size] = True
            s = np.einsum("bcd,bd->bc", self.x[np.minimum(new, size - 1)], q[who])
            s[new == size] = -2
            all_ids = np.concatenate([ids[who], np.where(new == size, -1, new)], 1)
            all_sims = np.concatenate([sims[who], s], 1)
            all_open = np.concatenate([open_[who], new < size], 1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam] if all_sims.shape[1] > beam else np.arange(all_sims.shape[1])[None, :].repeat(len(who), 0)
            ids[who, : keep.shape[1]] = np.take_along_axis(all_ids, keep, 1)
            sims[who, : keep.shape[1]] = np.take_along_axis(all_sims, keep, 1)
            open_[who, : keep.shape[1]] = np.take_along_axis(all_open, keep, 1)
            who = who[open_[who].any(1)]
            if not len(who):
                break
            rank = np.where(open_[who], sims[who], -3.0)
            n = min(4, beam)
            pick = np.argpartition(-rank, n - 1, axis=1)[:, :n] if beam > n else np.tile(np.arange(beam), (len(who), 1))
            good = np.take_along_axis(rank, pick, 1) > -3
            node = np.where(good, np.take_along_axis(ids[who], pick, 1), -1)
            open_[who[:, None], pick] = False
            new = np.where((node >= 0)[:, :, None], links[np.maximum(node, 0)], -1).reshape(len(who), -1).astype(np.int64)
        return ids, sims


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components leave the doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's graph as bytes."""
    pdf = pdf.sort_values("_id").sample(frac=1.0, random_state=7)
    x = _unit(pdf["vec"])
    g = Graph(x)
    blob = _pack(x=x, id=pdf["_id"].to_numpy(), n=pdf["n"].to_numpy(), sizes=np.array(g.sizes), **{f"links{i}": a for i, a in enumerate(g.links)})
    return pd.DataFrame({"dim": [x.shape[1]], "shard": [pdf["shard"].iloc[0]], "blob": [blob]})


def _load(blob: bytes) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        g = Graph.__new__(Graph)
        x = z["x"]
        g.x, g.sizes = x.astype(np.float32), z["sizes"].tolist()
        g.links = [z[f"links{i}"] for i in range(len(g.sizes))]
        return g, x, z["id"], z["n"]


class _Forest:
    """Union of ids, keeping the edges that joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, a: int) -> int:
        up = self.up
        while (b := up.setdefault(a, a)) != a:
            up[a] = up[b]
            a = up[a]
        return a

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[x] = y
            self.edges.append((a, b))


def query_shard(threshold: float, recall: float):
    def run(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(index):
            return pd.DataFrame({"_id": [], "links": [], "other": []}, dtype="int64")
        g, x, ids, weight = _load(index["blob"].iloc[0])
        q, me = _unit(queries["vec"]), queries["_id"].to_numpy()
        q32, size = q.astype(np.float32), len(x)
        low, beam = threshold - 1e-4, min(BEAM, size)

        def exact(rows: np.ndarray) -> list[np.ndarray]:
            return [np.flatnonzero(t) for a in range(0, len(rows), 64) for t in (q32[rows[a : a + 64]] @ g.x.T) >= low]

        def close(rows: np.ndarray, beam: int) -> Iterator[tuple[int, np.ndarray]]:
            """The vectors found within the threshold of each query."""
            while len(rows) and beam < size:
                found, sims = g.search(q32[rows], beam)
                full = (sims >= low).all(1)
                yield from ((i, f[s >= low]) for i, f, s in zip(rows[~full], found[~full], sims[~full], strict=True))
                rows, beam = rows[full], min(size, 2 * beam)
            yield from zip(rows, exact(rows), strict=True)

        def others(i: int, f: np.ndarray) -> np.ndarray:
            return f[(x[f] @ q[i] >= threshold) & (ids[f] != me[i])] if len(f) else f

        # audit: the block's beam is widened until brute force on queries with links agrees
        some, true = [], 0
        order = np.random.default_rng(11).permutation(len(q))
        for a in range(0, len(order), 64):
            if len(some) >= AUDIT and true >= AUDIT_LINKS:
                break
            for i, f in zip(order[a : a + 64], exact(order[a : a + 64]), strict=True):
                if n := len(others(i, f)):
                    some.append(i)
                    true += n
        while beam < size and sum(len(others(i, f)) for i, f in close(np.array(some, np.int64), beam)) < recall * true:
            beam = min(size, 2 * beam)
        links, forest = np.zeros(len(q), np.int64), _Forest()
        for a in range(0, len(q), 1024):
            for i, f in close(np.arange(a, min(a + 1024, len(q))), beam):
                f = others(i, f)
                links[i] = weight[f].sum()
                for other in ids[f].tolist():
                    forest.link(int(me[i]), other)
        some_links = links > 0
        e = np.array(forest.edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"_id": np.concatenate([me[some_links], e[:, 0]]), "links": np.concatenate([links[some_links], np.zeros(len(e), np.int64)]), "other": pd.array([*[None] * int(some_links.sum()), *e[:, 1].tolist()], dtype="Int64")})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.99, shards: int = SHARDS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: id_col, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    v = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = F.coalesce(F.forall("vec", finite) & F.exists("vec", lambda c: c != 0), F.lit(False))
    v = scratch.write(v.withColumn("good", good), "vectors")
    kinds = scratch.write(v.where("good").groupBy("vec").agg(F.min("_id").alias("_id"), F.count("*").alias("n")), "kinds")
    many = kinds.count()
    shards, blocks = max(shards, math.ceil(many / SHARD_ROWS)), max(BLOCKS, math.ceil(many / BLOCK_ROWS))
    dim = F.size("vec").alias("dim")
    index = kinds.select("_id", "vec", "n", dim, F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int").alias("shard"))
    index = scratch.write(index.groupBy("dim", "shard").applyInPandas(build_shard, "dim int, shard int, blob binary"), "graphs")
    block = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    asked = kinds.select("_id", "vec", dim, block, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = index.select("dim", "shard", "blob", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ["dim", "shard", "block"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(query_shard(threshold, recall), "_id long, links long, other long")
    found = scratch.write(found, "found")
    links = found.groupBy("_id").agg(F.sum("links").alias("links"))
    parts = components(found.where("other IS NOT NULL").select(F.col("_id").alias("a"), F.col("other").alias("b")), scratch)
    kinds = kinds.join(links, "_id", "left").join(parts.withColumnRenamed("node", "_id"), "_id", "left")
    kinds = scratch.write(kinds.select(F.col("vec").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "_id").alias("component")), "linked")
    linked = v.where("good").join(kinds, F.col("vec") == F.col("_v")).select("_id", "links", "component")
    out = linked.unionByName(v.where("NOT good").select("_id", F.lit(0).cast("long").alias("links"), F.col("_id").alias("component")))
    return out.select(public_id(id_col), F.col("links").cast("long").alias("n_links"), public_id("component_id", "component"), (F.col("_id") == F.col("component")).alias("kept"))


def op5_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
