"""Near duplicates among embeddings: hierarchical navigable small-world graphs per shard.

Equal vectors are one node with a weight. Nodes are dealt into shards by hash; each shard's graph is built by one task
and stored. An audit finds the beam of each shard: queries are drawn from all nodes until AUDIT_LINKS true links of the
shard are among them, or no query is left, and the links found must be at least RECALL of those that a comparison with
the whole shard finds. A shard for which no beam passes is compared as a whole. Then every block of nodes queries every
shard. A query follows all neighbours above the similarity, so that a dense cluster is not cut off by the beam.
Similarities are verified in double precision. A task hands on its links as compressed bits; what two shards found in
each other is put together, so that a link found from one end counts for both, and goes on as link counts and a spanning
forest, never as rows of pairs.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, stored

SIMILARITY = 0.9
SHARD_NODES = 8192
BLOCK_NODES = 2048
DEGREE = 12  # links of a node in upper layers; twice as many in the lowest
BEAM = 32
AUDIT_QUERIES = 2048  # queries of the first round of the audit; eight times as many in each further one
AUDIT_LINKS = 500  # true links of a shard that end its audit
EXACT = 0  # in place of a beam: the shard is compared as a whole
RECALL = 0.98


class Graph:
    """Layers of neighbour lists over unit vectors; -1 pads short lists."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        self.v = vectors
        self.levels = levels
        self.top = int(levels.max(initial=0))
        self.links = [np.full((len(vectors), DEGREE * (2 if layer == 0 else 1)), -1, np.int32) for layer in range(self.top + 1)]

    def search(self, q: np.ndarray, layer: int, entry: np.ndarray, beam: int, known: int, floor: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest nodes found for each query: indices (-1 pads) and similarities, best first.

        All queries walk at once. Each step opens the best unopened node of every beam. With a floor, the walk also
        opens every node at least that similar, and all such nodes are in self.hits.
        """
        n = len(q)
        rows = np.arange(n)
        seen = np.zeros((n, known), bool)
        width = max(beam, entry.shape[1])
        idx = np.full((n, width), -1, np.int32)
        sim = np.full((n, width), -np.inf, np.float32)
        opened = np.ones((n, width), bool)
        k = entry.shape[1]
        idx[:, :k] = entry
        ok = entry >= 0
        s = np.einsum("nkd,nd->nk", self.v[np.maximum(entry, 0)], q)
        sim[:, :k] = np.where(ok, s, -np.inf)
        opened[:, :k] = ~ok
        for c in range(k):
            seen[rows[ok[:, c]], entry[ok[:, c], c]] = True
        order = np.argsort(-sim, axis=1, kind="stable")
        idx, sim, opened = (np.take_along_axis(x, order, 1) for x in (idx, sim, opened))
        links = self.links[layer]
        live = rows
        while len(live):
            todo = ~opened[live]
            has = todo.any(axis=1)
            live = live[has]
            if not len(live):
                break
            at = np.argmax(todo[has], axis=1)
            node = idx[live, at]
            opened[live, at] = True
            near = links[node]
            valid = (near >= 0) & (near < known)
            safe = np.where(valid, near, 0)
            valid &= ~seen[live[:, None], safe]
            # the same neighbour never stands twice in one list
            r, c = np.nonzero(valid)
            seen[live[r], safe[r, c]] = True
            s = np.where(valid, np.einsum("nkd,nd->nk", self.v[safe], q[live]), -np.inf).astype(np.float32)
            all_i = np.concatenate([idx[live], safe.astype(np.int32)], axis=1)
            all_s = np.concatenate([sim[live], s], axis=1)
            all_o = np.concatenate([opened[live], ~valid], axis=1)
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            idx[live], sim[live], opened[live] = (np.take_along_axis(x, order, 1) for x in (all_i, all_s, all_o))
        return np.where(np.isfinite(sim), idx, -1), sim

    def descend(self, q: np.ndarray, down_to: int, entry: int, known: int) -> np.ndarray:
        at = np.full((len(q), 1), entry, np.int32)
        for layer in range(self.top, down_to, -1):
            idx, _ = self.search(q, layer, at, 1, known)
            at = idx[:, :1]
        return at


def nearest_apart(sim: np.ndarray, vectors: np.ndarray, idx: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in order of similarity those that are nearer to the node than to one already chosen, then the rest in order."""
    chosen: list[int] = []
    spare: list[int] = []
    for k, i in enumerate(idx):
        if len(chosen) >= most:
            break
        if chosen and (vectors[idx[chosen]] @ vectors[i]).max() > sim[k]:
            spare.append(k)
        else:
            chosen.append(k)
    return idx[(chosen + spare)[:most]]


def build(vectors: np.ndarray, levels: np.ndarray, beam: int = BEAM, batch: int = 256) -> Graph:
    """Insert nodes highest layer first, in batches that are searched in the graph so far and in the batch itself."""
    order = np.argsort(-levels, kind="stable")
    vectors, levels = vectors[order], levels[order]
    g = Graph(vectors, levels)
    g.order = order
    done = min(len(vectors), 1)
    while done < len(vectors):
        end = min(len(vectors), done + max(1, min(batch, done)))
        end = min(end, done + int(np.count_nonzero(levels[done:end] == levels[done])))  # one layer at a time
        q = vectors[done:end]
        within = q @ q.T
        new = np.arange(done, end)
        at = g.descend(q, int(levels[done]), 0, done)
        for layer in range(int(levels[done]), -1, -1):
            idx, sim = g.search(q, layer, at, beam, done)
            at = idx[:, : max(1, min(4, idx.shape[1]))]
            most = g.links[layer].shape[1]
            earlier = np.tril(np.ones_like(within, bool), -1)
            for r in range(len(q)):
                mates = np.flatnonzero(earlier[r])
                mates = mates[np.argsort(-within[r, mates], kind="stable")[:most]]
                ok = idx[r] >= 0
                cand = np.concatenate([idx[r][ok], new[mates]])
                s = np.concatenate([sim[r][ok], within[r, mates]])
                by = np.argsort(-s, kind="stable")
                near = nearest_apart(s[by], vectors, cand[by], max(1, most // 2))
                g.links[layer][new[r], :len(near)] = near
                for other in near:
                    row = g.links[layer][other]
                    free = np.flatnonzero(row < 0)
                    if len(free):
                        row[free[0]] = new[r]
                    else:
                        both = np.append(row, new[r])
                        s2 = vectors[both] @ vectors[other]
                        by2 = np.argsort(-s2, kind="stable")
                        kept = nearest_apart(s2[by2], vectors, both[by2], most)
                        row[:] = -1
                        row[:len(kept)] = kept
        done = end
    return g


def range_search(g: Graph, q: np.ndarray, beam: int, floor: float) -> list[np.ndarray]:
    """Positions of the nodes at least floor similar to each query: the beam's, and all reached from them through such nodes."""
    known = len(g.v)
    if not known:
        return [np.empty(0, np.int64)] * len(q)
    at = g.descend(q, 0, 0, known)
    idx, sim = g.search(q, 0, at, beam, known)
    out = []
    for r in range(len(q)):
        hits = idx[r][(sim[r] >= floor) & (idx[r] >= 0)]
        if not len(hits):
            out.append(hits.astype(np.int64))
            continue
        seen = np.zeros(known, bool)
        seen[idx[r][idx[r] >= 0]] = True
        every, front = [hits], hits
        while len(front):
            near = np.unique(g.links[0][front])
            near = near[(near >= 0)]
            near = near[~seen[near]]
            seen[near] = True
            front = near[g.v[near] @ q[r] >= floor]
            every.append(front)
        out.append(np.concatenate(every).astype(np.int64))
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    scale = np.abs(v).max(axis=1, keepdims=True)  # very long or short vectors neither overflow nor vanish
    v = v / np.where(scale > 0, scale, 1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def forest(pairs: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges that connect what the links connect."""
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, others in pairs:
        ra = find(a)
        for b in others.tolist():
            rb = find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                ra = min(ra, rb)
                out.append((a, b))
    return out


def beams(nodes: int) -> list[int]:
    """Beams worth trying: a wider one would compare a query with as many nodes as the whole shard has."""
    out = [BEAM]
    while out[-1] * 2 * 2 * DEGREE < nodes:
        out.append(out[-1] * 2)
    return out


def links_between(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, g: Graph, exact: np.ndarray, similarity: float, beam: int) -> list[np.ndarray]:
    """For each query the verified positions of its links in the shard, itself left out."""
    out = []
    for start in range(0, len(q), 256):
        some, names = q[start:start + 256], q_ids[start:start + 256]
        if beam == EXACT:
            found = [np.flatnonzero(x) for x in some @ exact.T >= similarity]
        else:  # the walk is in single precision
            found = range_search(g, some.astype(np.float32), beam, similarity - 1e-4)
            found = [f[exact[f] @ v >= similarity] for v, f in zip(some, found)]
        out += [f[ids[f] != i] for i, f in zip(names, found)]
    return out


def audit(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, g: Graph, exact: np.ndarray, similarity: float, recall: float) -> list[tuple[int, int, int]]:
    """(beam, links found, true links) of the queries for each beam; those wider than one that passes count what it found."""
    truth = links_between(q_ids, q, ids, g, exact, similarity, EXACT)
    asked = np.flatnonzero([len(t) > 0 for t in truth])
    total, got, out = sum(map(len, truth)), 0, []
    for beam in beams(len(ids)):
        if got < recall * total:
            found = links_between(q_ids[asked], q[asked], ids, g, exact, similarity, beam)
            got = sum(len(np.intersect1d(f, truth[k])) for k, f in zip(asked, found))
        out.append((beam, got, total))
    return out


def cells(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the bits that are set in a matrix of packed bits."""
    r, c = np.nonzero(packed)
    at, bit = np.nonzero(np.unpackbits(packed[r, c][:, None], axis=1))
    return r[at], c[at] * 8 + bit


def meeting(queries: DataFrame, graphs: DataFrame) -> DataFrame:
    """Each block of queries with each graph. Both are read from the shared folder by the tasks that need them, none is shuffled:
    bytes of queries and graphs times the number of their partners would be the largest thing on disk."""
    return graphs.hint("shuffle_replicate_nl").crossJoin(queries)


def both_ends(rows: list[tuple[int, int, np.ndarray, np.ndarray, bytes]]) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Weighted links by key, and forest edges, of what two shards found in each other or one in itself.

    rows: shard of the queries, block, keys and weights of the queries, bits of the links; all blocks of both shards.
    """
    sides = []
    for own in sorted({r[0] for r in rows}):
        blocks = sorted((r for r in rows if r[0] == own), key=lambda r: r[1])
        sides.append((np.concatenate([r[2] for r in blocks]), np.concatenate([r[3] for r in blocks]), [r[4] for r in blocks], [len(r[2]) for r in blocks]))
    (keys, weights, *_), (keys2, weights2, *_) = sides[0], sides[-1]

    def matrix(side: int) -> np.ndarray:
        _, _, bits, sizes = sides[side]
        return np.concatenate([np.frombuffer(zlib.decompress(b), np.uint8).reshape(n, -1) for b, n in zip(bits, sizes)])

    mine, theirs = matrix(0), matrix(-1)
    count, count2, pairs = np.zeros(len(keys)), np.zeros(len(keys2)), []
    for start in range(0, len(keys), 256):  # of the links found from the other end, the columns of these rows
        links = np.zeros((min(256, len(keys) - start), len(keys2)), bool)
        links[cells(mine[start:start + 256])] = True
        c, r = cells(theirs[:, start // 8:start // 8 + 32])
        links[r, c] = True
        r, c = np.nonzero(links)
        if not len(r):
            continue
        count[start:start + 256] = np.bincount(r, weights2[c], len(links))
        count2 += np.bincount(c, weights[start + r], len(keys2))
        if len(sides) == 1:  # either end of a link has it
            r, c = r[c > start + r], c[c > start + r]
        at, first = np.unique(r, return_index=True)
        pairs += [(int(keys[start + k]), keys2[f]) for k, f in zip(at, np.split(c, first[1:]))]
    out = dict(zip(keys.tolist(), count.astype(np.int64).tolist()))
    if len(sides) == 2:
        out |= dict(zip(keys2.tolist(), count2.astype(np.int64).tolist()))
    return {k: n for k, n in out.items() if n}, forest(pairs)


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column]).reshape(len(column), dim)


def usable(vector: Column) -> Column:
    """Neither null nor zero nor holding null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY,
                    shard_nodes: int = SHARD_NODES, block_nodes: int = BLOCK_NODES, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Linked: cosine of at least `similarity` in double precision. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, vectors of different lengths not with each other; equal vectors always
    do. n_links counts other rows, repeated rows too; component_id is the smallest id reachable, the row's own
    included, kept tells whether it is its own. Null ids never name a component unless nothing else is in it. Other
    columns are not read; no rows give no rows.
    """
    small_batches(rows.sparkSession)
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    base = base.select("id", F.when(usable(F.col("vector")), F.col("vector")).alias("vector"))
    # equal up to the sign of zero
    clean = F.transform("vector", lambda x: x + F.lit(0.0))
    base = base.withColumn("vector", clean).withColumn("node", F.when(F.col("vector").isNotNull(), F.sha2(F.to_json(F.struct("vector")), 256)))
    light = stored(base.select("id", "node"))
    nodes = base.filter("node IS NOT NULL").groupBy("node").agg(F.any_value("vector").alias("vector"), F.min("id").alias("first"), F.count("*").alias("weight"))
    nodes = stored(nodes.withColumn("key", F.xxhash64("node")))
    dims = [(r["d"], r["n"]) for r in nodes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()]
    found = None
    for dim, n in dims:
        one = _links(nodes.filter(F.size("vector") == dim), dim, n, similarity, shard_nodes, block_nodes, recall)
        found = one if found is None else found.union(one)
    if found is None:
        return light.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found)
    labels = components(found.filter("b IS NOT NULL").select("a", "b"))
    counts = stored(found.filter("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links")))
    named = nodes.select("node", "key", "first", "weight").join(labels.withColumnRenamed("node", "key"), "key", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "key")).join(counts, "key", "left"))
    lowest = stored(named.groupBy("component").agg(F.min("first").alias("component_id")))
    named = stored(named.join(lowest, "component").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    out = light.join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _links(nodes: DataFrame, dim: int, n: int, similarity: float, shard_nodes: int, block_nodes: int, recall: float) -> DataFrame:
    """(a, b, links): a row (a, null, weight of its links in one shard) per node and shard with links, and forest edges (a, b, null)."""
    shards = math.ceil(n / shard_nodes)
    shard = F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards))

    def level(keys: np.ndarray) -> np.ndarray:
        u = ((keys.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
        return np.floor(-np.log(u) / math.log(DEGREE)).astype(int)

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        exact = unit(_matrix(pdf["vector"], dim))
        keys = pdf["key"].to_numpy(np.int64)
        g = build(exact.astype(np.float32), level(keys))
        return pd.DataFrame({
            "shard": [int(pdf["shard"].iloc[0])], "keys": [keys[g.order].tobytes()], "weights": [pdf["weight"].to_numpy(np.int64)[g.order].tobytes()],
            "vectors": [exact[g.order].tobytes()], "levels": [g.levels.astype(np.int32).tobytes()], "links": [[x.tobytes() for x in g.links]]})

    graphs = nodes.select(shard.alias("shard"), "key", "weight", "vector").groupBy("shard").applyInPandas(
        graph, "shard long, keys binary, weights binary, vectors binary, levels binary, links array<binary>")

    def slices(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                keys, weights, exact = np.frombuffer(row.keys, np.int64), np.frombuffer(row.weights, np.int64), np.frombuffer(row.vectors).reshape(-1, dim)
                for k, at in enumerate(np.array_split(np.arange(len(keys)), math.ceil(len(keys) / block_nodes))):
                    yield pd.DataFrame({"own": [row.shard], "block": [k], "q_keys": [keys[at].tobytes()], "q_weights": [weights[at].tobytes()], "queries": [exact[at].tobytes()]})

    graphs = stored(graphs)
    queries = stored(graphs.mapInPandas(slices, "own long, block long, q_keys binary, q_weights binary, queries binary"))

    def read(row) -> tuple:
        ids, exact = np.frombuffer(row.keys, np.int64), np.frombuffer(row.vectors).reshape(-1, dim)
        g = Graph(exact.astype(np.float32), np.frombuffer(row.levels, np.int32))
        g.links = [np.frombuffer(x, np.int32).reshape(len(ids), -1) for x in row.links]
        return np.frombuffer(row.q_keys, np.int64), np.frombuffer(row.queries).reshape(-1, dim), ids, g, exact

    # the beam of each shard
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "q_keys": [pdf["key"].to_numpy(np.int64).tobytes()], "queries": [unit(_matrix(pdf["vector"], dim)).tobytes()]})

    def audited(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                found = audit(*read(row), similarity, recall)
                yield pd.DataFrame(found, columns=["beam", "found", "total"]).assign(shard=row.shard)

    place = F.pmod(F.xxhash64("key", F.lit("audit")), F.lit(1 << 30))
    left, seen, done, size = set(range(shards)), {}, 0, AUDIT_QUERIES
    while left and done < 1 << 30:
        end = min(1 << 30, math.ceil((1 << 30) * size / n))
        parts = math.ceil(n * (end - done) / (1 << 30) / block_nodes)
        sample = nodes.filter((place >= done) & (place < end)).select(F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts)).alias("block"), "key", "vector")
        sample = stored(sample.groupBy("block").applyInPandas(pack, "block long, q_keys binary, queries binary"))
        asked = meeting(sample, graphs.drop("weights").filter(F.col("shard").isin(sorted(left))))
        rows = asked.mapInPandas(audited, "beam long, found long, total long, shard long").groupBy("shard", "beam").agg(F.sum("found").alias("found"), F.sum("total").alias("total"))
        for r in rows.collect():  # a few rows a shard
            old = seen.setdefault(r["shard"], {}).get(r["beam"], (0, 0))
            seen[r["shard"]][r["beam"]] = old[0] + r["found"], old[1] + r["total"]
        left = {x for x in left if all(total < AUDIT_LINKS for _, total in seen.get(x, {}).values())}
        done, size = end, 8 * size
    fit = {x: min((b for b, (found, total) in at.items() if found >= recall * total), default=EXACT) for x, at in seen.items()}
    widths = nodes.sparkSession.createDataFrame([(x, fit.get(x, EXACT)) for x in range(shards)], "shard long, beam long")

    # each block of queries meets each shard
    tasks = meeting(queries, graphs.drop("weights").join(F.broadcast(widths), "shard"))

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q_ids, q, ids, g, exact = read(row)
                bits = np.zeros((len(q), len(ids)), bool)
                for k, f in enumerate(links_between(q_ids, q, ids, g, exact, similarity, row.beam)):
                    bits[k, f] = True
                bits = zlib.compress(np.packbits(bits, axis=1).tobytes(), 1)
                yield pd.DataFrame({"low": [min(row.own, row.shard)], "high": [max(row.own, row.shard)], "own": [row.own], "block": [row.block],
                                    "q_keys": [row.q_keys], "q_weights": [row.q_weights], "bits": [bits]})

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, edges = both_ends([(r.own, r.block, np.frombuffer(r.q_keys, np.int64), np.frombuffer(r.q_weights, np.int64), r.bits) for r in pdf.itertuples(index=False)])
        counts = pd.DataFrame({"a": list(counts), "b": None, "links": list(counts.values())}, dtype="object")
        return pd.concat([counts, pd.DataFrame(edges, columns=["a", "b"], dtype="object").assign(links=None)])

    found = tasks.mapInPandas(run, "low long, high long, own long, block long, q_keys binary, q_weights binary, bits binary")
    return found.groupBy("low", "high").applyInPandas(together, "a long, b long, links long")
