"""Near duplicates by Jaccard similarity of word shingles: universe-partition pigeonhole join.

A document is the set of its distinct shingles, 64-bit hashes; documents with equal sets are one node. Two sets of a
and b shingles are linked when their Jaccard similarity is at least PERCENT / 100, which means that they differ in at
most H = (a + b) (100 - PERCENT) / (100 + PERCENT) shingles.

* Size bands double. A pair meets in the class of its larger member's band; a node takes part in its own class and, if
  a partner may be that large, in the next.
* In a class the universe of hashes is cut into m segments. Some are indexed with their one-deletion neighbourhood,
  the others only as they are. If two sets differ by at most H and none of p deletion segments agrees up to one
  shingle, those use up 2p of H, so at least m - p - (H - 2p) of the plain segments are equal. Hence it is enough that
  each side indexes the first H - 2p + 1 of its plain segments in one order common to all sets.
* That order is by cost: the rarest segments first, as told by a sketch of shingle counts over all documents, segments
  without shingles last. p is chosen per class by the expected number of entries and of collisions.
* Entries are grouped by signature, and groups of equal members are one. Each member is first compared with one other
  that heads many of its groups, a few times; the links found make components. Then the members of a group that are in
  different components are compared pair by pair inside the task, by sizes and parity bitmaps that never reject a
  true pair, and only pairs that pass leave it. Every link is verified by counting whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, components, small_batches, stored

SHINGLE = 5
PERCENT = 75
SKETCH_BITS = 20
CHUNKS = 64
BITMAP_BITS = 1024  # of the parity bitmap of a small set; those of larger sets have at least a bit a shingle
GROUP_ENTRIES = 1 << 19  # index entries grouped by one task call, about
COMPARED_ROWS = 32_000  # group members compared by one task call, about
SMALL = 64  # members of a group whose pairs are listed together with those of others
BLOCK = 16_384  # members of a group compared by one task; of larger groups, any two blocks meet in some task
STAR_ROUNDS = 3
MOST_OF_COMPONENTS = 4  # pairs of two components that a task with too many hands on at first; 16 times as many each time after
HANDED_ON = 8192  # pairs that a task hands on without leaving any for later
FINE_SEGMENTS = 256  # classes of small sets have more segments than shingles, up to so many
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def shingles(text: str | None, k: int = SHINGLE, seed: int = 0) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words)) ^ U(seed)
    k = min(k, len(words))
    n = len(words) - k + 1
    acc = w[:n] + U(k)
    for i in range(1, k):
        acc = (acc ^ (acc >> U(29))) * M1 + w[i:i + n]
    return np.unique(mixed(acc))


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two independent digests of a set."""
    a = int(mixed(s).sum(dtype=U)) ^ len(s)
    b = int(mixed(s ^ M2).sum(dtype=U))
    return [int(x) for x in np.array([a, b], U).view(np.int64)]


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each cell; two bitmaps differ in at most as many bits as the sets in shingles."""
    n = max(BITMAP_BITS, 1 << len(s).bit_length())
    cells = np.bincount((mixed(s ^ M1) & U(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(cells.astype(np.uint8)).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    return differing(np.frombuffer(a, U), np.frombuffer(b, U))


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that a set has with so many 64-bit words."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2:]
    return x


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the length of the shorter."""
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())


def allowance(a: int, b: int, percent: int = PERCENT) -> int:
    """Most shingles in which linked sets of these sizes differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def largest_partner(n: int, percent: int = PERCENT) -> int:
    return n * 100 // percent


def band(n: int) -> int:
    return n.bit_length() - 1


def segments(c: int, percent: int = PERCENT) -> int:
    """Number of segments of a class: above its largest allowance, so that costly ones can be left out.

    Small sets are cut finer, so that hardly any has fewer segments with shingles than it must index.
    """
    top = (2 << c) - 1
    return max(allowance(top, top, percent) + 2, -(-top // 2), min(4 * top, FINE_SEGMENTS))


def memberships(n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(class, largest allowance there) of a set of n; none where only equal sets are linked."""
    if not n:
        return []
    own, most = band(n), largest_partner(n, percent)
    out = [(own, allowance(n, min((2 << own) - 1, most), percent))]
    if band(most) > own:
        out.append((own + 1, allowance(n, most, percent)))
    return [(c, h) for c, h in out if h > 0]


def allocate(stats: dict[int, tuple[int, float]], cold: float, percent: int = PERCENT) -> dict[int, int]:
    """Deletion segments per class, by cost.

    stats: class to (number of sets, mean size); cold: share of shingles that are rare. The cost of a set is its
    index entries, plus the sets it would meet in a costly segment times the chance that it needs one, plus the sets that
    it meets in deletion segments without having anything in common: those where both have one shingle or none.
    """
    out = {}
    for c, (n_sets, mean) in stats.items():
        m, h = segments(c, percent), allowance(int(mean), min(2 << c, largest_partner(int(mean), percent)), percent)
        costs = []
        for p in range(0, min(m, h // 2 + 1, 8) + 1):
            need, left = max(0, h - 2 * p + 1), m - p
            filled = 1 - math.exp(-mean * cold / m)
            sd = math.sqrt(max(left * filled * (1 - filled), 1e-9))
            short = 0.5 * math.erfc((left * filled - need + 0.5) / sd / math.sqrt(2)) if need else 0.0
            few = math.exp(-mean / m) * (1 + mean / m)
            costs.append((p * (1 + mean / m) + need + short * n_sets + p * few * few * n_sets, p))
        out[c] = min(costs)[1]
    return out


def signatures(s: np.ndarray, sketch: np.ndarray, plan: dict[int, int], percent: int = PERCENT) -> np.ndarray:
    """Index entries of one set."""
    out = []
    for c, h in memberships(len(s), percent):
        m, p = segments(c, percent), plan.get(c, 0)
        seg = ((s >> U(32)) * U(m)) >> U(32)
        starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        mix = mixed(s)
        sums, ids = np.add.reduceat(mix, starts), seg[starts]
        freq = np.minimum.reduceat(sketch[(s >> U(64 - SKETCH_BITS)).astype(np.int64)], starts)
        tag = (ids + U(1)) * U(0x9E3779B97F4A7C15) + U(c << 1)
        sig = mixed(sums ^ mixed(tag))
        if p:
            near = ids < U(p)
            out.append(sig[near])
            at = seg < U(p)
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(s))))[at]
            out.append(mixed((sums[of] - mix[at]) ^ mixed(tag[of])))
            empty = np.setdiff1d(np.arange(p, dtype=U), ids[near])
            out.append(mixed(mixed((empty + U(1)) * U(0x9E3779B97F4A7C15) + U(c << 1))))
            sig, freq, ids = sig[~near], freq[~near], ids[~near]
        need = h - 2 * p + 1
        if need > 0:
            first = np.lexsort((sig, freq))[:need]
            out.append(sig[first])
            if len(first) < need:
                empty = np.setdiff1d(np.arange(p, m, dtype=U), ids)[:need - len(first)]
                out.append(mixed(mixed((empty + U(1)) * U(0x9E3779B97F4A7C15) + U(c << 1))))
    return np.concatenate(out) if out else np.empty(0, U)


def _scan(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """A row (id, n, node, check) per document, and the sketch in rows (part, chunk, counts)."""
    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for pdf in batches:
            rows, cells, held = [], [], 0
            for text in pdf["text"]:
                s = shingles(text, k, seed)
                rows.append((len(s), *digests(s)))
                cells.append((s >> U(64 - SKETCH_BITS)).astype(np.int64))
                held += len(s)
                if held > 1 << 19:
                    total += np.bincount(np.concatenate(cells), minlength=len(total))
                    cells, held = [], 0
            if cells:
                total += np.bincount(np.concatenate(cells), minlength=len(total))
            n, node, check = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"id": pdf["id"], "n": n, "node": node, "check": check, "part": None, "chunk": None, "counts": None})
        counts = np.minimum(total, 0xFFFFFFFF).astype("<u4").reshape(CHUNKS, -1)
        used = [i for i in range(CHUNKS) if counts[i].any()]
        part = TaskContext.get().partitionId()
        yield pd.DataFrame({"id": None, "n": None, "node": None, "check": None, "part": [part] * len(used), "chunk": used, "counts": [counts[i].tobytes() for i in used]})

    return stored(docs.mapInPandas(run, "id long, n long, node long, check long, part int, chunk int, counts binary"))


def _sketch(rows: DataFrame, fan_in: int = 64) -> np.ndarray:
    """The sum of the tasks' sketches, in rounds of fan_in each; its fixed size is what reaches the driver."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in pdf["counts"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1] // fan_in, "chunk": pdf["chunk"].iloc[:1], "counts": [np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()]})

    most = rows.agg(F.max("part")).first()[0]
    while most is not None:
        rows = stored(rows.groupBy("chunk", F.floor(F.col("part") / fan_in).alias("up")).applyInPandas(lambda pdf: add(pdf), "part int, chunk int, counts binary"))
        if most < fan_in:
            break
        most //= fan_in
    out = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), np.uint32)
    for r in rows.select("chunk", "counts").toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["counts"], "<u4")
    return out.reshape(-1)


def _groups(docs: DataFrame, k: int, percent: int, seed: int, sketch: np.ndarray, plan: dict[int, int], n_buckets: int) -> DataFrame:
    """(grp, node, head0, head1, ..., n): the members of each group of at least two nodes with a common signature.

    Groups of equal members are one within a bucket of signatures, n being how many there were. The heads are the
    first members in STAR_ROUNDS orders by hash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    bits = max(1, n_buckets.bit_length() - 1)

    def index(batches):
        seen: set[int] = set()  # equal sets of one task are indexed once
        for pdf in batches:
            sigs, nodes = [], []

            def flush():
                if not sigs:
                    return None
                sig = np.concatenate(sigs)
                node = np.repeat(np.array(nodes, np.int64), [len(x) for x in sigs])
                bucket = (sig >> U(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                sig, node, bucket = sig[order], node[order], bucket[order]
                cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                ends = np.append(cuts[1:], len(bucket))
                sigs.clear(), nodes.clear()
                return pd.DataFrame({"bucket": bucket[cuts], "sigs": [sig[a:b].tobytes() for a, b in zip(cuts, ends)], "nodes": [node[a:b].tobytes() for a, b in zip(cuts, ends)]})

            held = 0
            for text in pdf["text"]:
                s = shingles(text, k, seed)
                if not len(s) or (node := digests(s)[0]) in seen:
                    continue
                seen.add(node)
                if len(out := signatures(s, shared.value, plan, percent)):
                    sigs.append(out)
                    nodes.append(node)
                    held += len(out)
                if held > 1_000_000:
                    yield flush()
                    held = 0
            if (last := flush()) is not None:
                yield last

    columns = ["grp", "node", *[f"head{i}" for i in range(STAR_ROUNDS)], "n"]

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.concatenate([np.frombuffer(x, U) for x in pdf["sigs"]])
        node = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["nodes"]])
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
        sig, node = sig[new], node[new]
        same = sig[1:] == sig[:-1]
        more = np.concatenate((same, [False])) | np.concatenate(([False], same))
        sig, node = sig[more], node[more]
        if not len(sig):
            return pd.DataFrame({x: [] for x in columns})
        starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        sizes = np.diff(np.append(starts, len(sig)))
        keys = node.view(U)
        grp = mixed(np.add.reduceat(mixed(keys ^ M1), starts) ^ sizes.astype(U))
        _, first, times = np.unique(grp, return_index=True, return_counts=True)
        heads = []
        for turn in range(STAR_ROUNDS):
            rank = mixed(keys + U(turn + 1))
            low = np.minimum.reduceat(rank, starts)
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            heads.append(node[at[np.searchsorted(at, starts)]])
        kept = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in first])
        many = sizes[first]
        table = [np.repeat(grp[first].view(np.int64), many), node[kept], *[np.repeat(h[first], many) for h in heads], np.repeat(times, many)]
        return pd.DataFrame(dict(zip(columns, table)))

    packed = docs.select("text").mapInPandas(index, "bucket long, sigs binary, nodes binary")
    return stored(packed.groupBy("bucket").applyInPandas(group, ", ".join(f"{x} long" for x in columns)))


def _sets(docs: DataFrame, wanted: DataFrame, k: int, seed: int) -> DataFrame:
    """(node, n, bits, items) of the documents whose ids are wanted, and of those without id."""
    def run(batches):
        for pdf in batches:
            found = [shingles(x, k, seed) for x in pdf["text"]]
            yield pd.DataFrame({"node": [digests(s)[0] for s in found], "n": [len(s) for s in found],
                                "bits": [bitmap(s) for s in found], "items": [s.tobytes() for s in found]})

    rows = docs.join(checked_broadcast(wanted), "id", "left_semi").union(docs.filter("id IS NULL")).select("text")
    return stored(rows.mapInPandas(run, "node long, n long, bits binary, items binary"))


def _near(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) without those whose sizes or bitmaps tell that they are not linked."""
    side = lambda x: light.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches):
        for pdf in batches:
            apart = np.array([differing_bits(x, y) for x, y in zip(pdf["bits_a"], pdf["bits_b"])], np.int64)
            yield pdf.loc[(100 + percent) * apart <= (100 - percent) * (pdf["n_a"] + pdf["n_b"]).to_numpy(np.int64), ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, n_pairs: int, sets: DataFrame, percent: int) -> DataFrame:
    """Of the stored pairs (a, b) those that are linked, by their whole sets."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}"))
    one = side("a").join(checked_broadcast(pairs, rows=n_pairs), "a")
    other = side("b").join(checked_broadcast(stored(pairs.select("b").distinct(), n_pairs)), "b", "left_semi")

    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["items_a"], pdf["items_b"]):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return one.join(other, "b").mapInPandas(run, "a long, b long")


def _split(groups: DataFrame, n_rows: int) -> DataFrame:
    """Groups (grp, node, comp) of more than BLOCK nodes as groups of two blocks each, so that any two nodes still meet."""
    large = stored(groups.groupBy("grp").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK), n_rows // BLOCK)
    if large.isEmpty():
        return groups
    blocks = F.ceil(F.col("size") / (BLOCK // 2)).cast("int")
    sized = groups.join(F.broadcast(large) if n_rows // BLOCK < 1_000_000 else large, "grp", "left")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = F.explode(F.when(F.col("size").isNotNull(), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(-1))))
    both = sized.withColumn("mine", mine).withColumn("other", other)
    pair = F.xxhash64("grp", F.least("mine", "other"), F.greatest("mine", "other"))
    return both.select(F.when(F.col("other") < 0, F.col("grp")).otherwise(pair).alias("grp"), "node", "comp")


def _compared(groups: DataFrame, light: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (a, b) of nodes of one group (grp, node, comp) and different components that sizes and bitmaps do not rule out.

    A task gets whole groups, and the bitmap of each of their nodes once. It hands on all its pairs, or if they are more than
    HANDED_ON, the `most` likeliest between two components; more tells that there were others.
    """
    groups = stored(groups)
    apart = stored(groups.groupBy("grp").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("grp"))
    groups = stored(groups.join(checked_broadcast(apart), "grp"))
    n_rows = groups.count()
    groups = _split(groups, n_rows)
    n_buckets = 1 + n_rows // COMPARED_ROWS
    rows = groups.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(n_buckets)))
    needed = rows.select(F.col("bucket").alias("task"), F.col("node").alias("key")).distinct()
    needed = needed.join(light.select(F.col("node").alias("key"), "n", "bits"), "key")

    def compare(members: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        facts = facts.drop_duplicates("key").sort_values("key", ignore_index=True)
        nodes, n = facts["key"].to_numpy(np.int64), facts["n"].to_numpy(np.int64)
        members = members.sort_values(["grp", "node"])
        at = np.searchsorted(nodes, members["node"].to_numpy(np.int64))
        comp = np.zeros(len(nodes), np.int64)
        comp[at] = members["comp"].to_numpy(np.int64)
        grp = members["grp"].to_numpy(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1])))
        sizes = np.diff(np.append(starts, len(grp)))
        bits = [np.frombuffer(x, U) for x in facts["bits"]]
        longest = np.array([len(x) for x in bits])
        short = np.array([folded(x, BITMAP_BITS // 64) for x in bits])
        codes = []

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            x, y = np.minimum(x, y), np.maximum(x, y)
            fits = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            x, y = x[fits], y[fits]
            apart = np.bitwise_count(short[x] ^ short[y]).sum(axis=1, dtype=np.int64)
            near = (100 + percent) * apart <= (100 - percent) * (n[x] + n[y])
            codes.append(np.unique(x[near] * len(nodes) + y[near]))

        for start, k in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            mine = at[start:start + k]
            ids, of, counts = np.unique(comp[mine], return_inverse=True, return_counts=True)
            rest = mine[of != np.argmax(counts)]  # pairs inside the largest component need no comparison
            step = max(1, 100_000 // k)
            for i in range(0, len(rest), step):
                part = rest[i:i + step]
                keep(np.repeat(part, k), np.tile(mine, len(part)))
        for k in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
            which = starts[sizes == k]
            left, right = np.triu_indices(k, 1)
            step = max(1, 100_000 // len(left))
            for i in range(0, len(which), step):
                table = at[which[i:i + step, None] + np.arange(k)]
                keep(table[:, left].ravel(), table[:, right].ravel())
        every = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int64)
        found, apart = [], []
        for i in range(0, len(every), 100_000):
            x, y = np.divmod(every[i:i + 100_000], len(nodes))
            allowed = (100 - percent) * (n[x] + n[y])
            d = np.bitwise_count(short[x] ^ short[y]).sum(axis=1, dtype=np.int64)
            for j in np.flatnonzero(np.minimum(longest[x], longest[y]) > short.shape[1]):
                d[j] = differing(bits[x[j]], bits[y[j]])
            near = (100 + percent) * d <= allowed
            found.append(np.stack([x[near], y[near]]))
            apart.append(d[near] / (n[x[near]] + n[y[near]]))
        if not found:
            return pd.DataFrame({"a": [], "b": [], "more": []})
        (x, y), share = np.concatenate(found, axis=1), np.concatenate(apart)
        one, two = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
        order = np.lexsort((y, x, share, two, one))
        one, two = one[order], two[order]
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(one) else np.empty(0, bool)
        start = np.flatnonzero(new)
        nth = np.arange(len(one)) - np.repeat(start, np.diff(np.append(start, len(one))))
        kept = order if len(order) <= HANDED_ON else order[nth < most]
        return pd.DataFrame({"a": nodes[x[kept]], "b": nodes[y[kept]], "more": np.full(len(kept), len(kept) < len(order))})

    # partitions of a fixed number: small tables of costly rows are not put together again
    rows, needed = rows.repartition(n_buckets, "bucket"), needed.repartition(n_buckets, "task")
    return rows.groupBy("bucket").cogroup(needed.groupBy("task")).applyInPandas(compare, "a long, b long, more boolean")


def links(groups: DataFrame, sets: DataFrame, percent: int = PERCENT, rounds: int = STAR_ROUNDS) -> DataFrame | None:
    """Component labels (node, component) of the linked nodes; None without links.

    groups: (grp, node, head0, head1, ..., n). In each round every node is compared with the head of another component
    that it meets in most groups. What is left is compared pair by pair, the likeliest pairs of two components first,
    until all have been that are still apart.
    """
    light = sets.select("node", "n", "bits")
    found, turn, more, most = None, 0, True, MOST_OF_COMPONENTS
    while turn < rounds or more:
        labels = stored(components(found), n_found) if found is not None else None
        comp = lambda x: F.coalesce(f"comp_{x}", x)
        named = groups
        for x in ["node", f"head{turn}"][: 1 + (turn < rounds)] if labels is not None else []:
            named = named.join(checked_broadcast(labels.select(F.col("node").alias(x), F.col("component").alias(f"comp_{x}")), rows=n_found), x, "left")
        mine = comp("node") if labels is not None else F.col("node")
        if turn < rounds:
            head = f"head{turn}"
            met = named.filter(mine != (comp(head) if labels is not None else F.col(head)))
            votes = met.groupBy("node", F.col(head).alias("b")).agg(F.sum("n").alias("n"))
            pairs = votes.groupBy("node").agg(F.max(F.struct("n", "b"))["b"].alias("b")).select(F.col("node").alias("a"), "b")
            pairs = _near(pairs, light, percent)
        else:
            every = stored(_compared(named.select("grp", "node", mine.alias("comp")).distinct(), light, percent, most))
            more, most = not every.filter("more").isEmpty(), 16 * most
            pairs = every.select("a", "b").distinct()
        pairs = stored(pairs)
        n_pairs = pairs.count()
        turn += 1
        if n_pairs:
            new = stored(_verified(pairs, n_pairs, sets, percent), n_pairs)
            found = new if found is None else stored(found.union(new), n_pairs)
            n_found = 2 * found.count()
    return stored(components(found), n_found) if found is not None and n_found else None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs.

    component_id is the smallest id reachable by links, the row's own included. Rows without words (null, empty or
    blank text) have no shingles and are linked with nothing; equal sets are linked; repeated rows and ids are kept.
    Null ids never name a component unless nothing else is in it. Other columns are not read. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seed = 0
    while True:
        scan = _scan(docs, k, seed)
        n_rows = scan.count()
        rows = scan.filter("part IS NULL").select("id", "n", "node", "check")
        nodes = rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("first"), F.min("n").alias("n"), F.min("check").alias("c1"), F.max("check").alias("c2"))
        nodes = stored(nodes, n_rows)
        if nodes.filter("c1 <> c2").isEmpty():
            break
        seed += 1  # two different sets had one digest: start again with other hashes
    size_class = F.floor(F.log2(F.col("n") + 0.5)).cast("int")
    stats = {r["c"]: (r["sets"], r["mean"]) for r in nodes.groupBy(size_class.alias("c")).agg(F.count("*").alias("sets"), F.avg("n").alias("mean")).collect()}
    labels = None
    if stats:
        sketch = _sketch(scan.filter("part IS NOT NULL").select("part", "chunk", "counts"))
        total = float(sketch.sum(dtype=np.int64))
        common = sketch > max(16.0, 4 * total / len(sketch))
        plan = allocate(stats, 1 - float(sketch[common].sum(dtype=np.int64)) / max(total, 1.0), percent)
        n_buckets = max(32, int(0.5 * sum(n * mean for n, mean in stats.values())) // GROUP_ENTRIES)
        groups = _groups(docs, k, percent, seed, sketch, plan, n_buckets)
        met = groups.select("node").distinct().join(nodes, "node").select(F.col("first").alias("id")).filter("id IS NOT NULL").distinct()
        labels = links(groups, _sets(docs, stored(met, n_rows), k, seed), percent)
    if labels is not None:
        named = nodes.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
        lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
        names = stored(stored(named, n_rows).join(stored(lowest, n_rows), "component").select("node", "component_id"), n_rows)
    else:
        names = nodes.select("node", F.col("first").alias("component_id"))
    out = rows.join(names, (rows["node"] == names["node"]) & (rows["n"] > 0), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"))
