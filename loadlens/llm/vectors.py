"""Near-duplicate embeddings over a robust-pruned flat graph.

Vectors are scaled to length one; equal vectors become one node.  Nodes are split into overlapping shards by rounds of
k-means, each round fitted on at most ``SAMPLE`` members of a shard, until no shard is larger than ``shard_size``; a node
whose second centroid is nearly as close goes to both.  In each shard every node gets its nearest members, thinned by
robust pruning; adjacency lists of a node are united over its shards.  Every node then searches its shards greedily from
the medoid, and expands from all nodes within a slack of the range until nothing new is found.  What is found is verified
in double precision.

Recall is audited against brute force in one job: ``AUDITED`` nodes, the first in the order of a hash, are compared with
all vectors.  The links returned are the graphs'.  Below ``goal``, or where fewer than ``enough`` of the audited nodes have
a neighbour and the audit so proves little, another graph on shards of another seed adds its links.  A recall measured on
too few nodes after that is returned as unproven.  Where ``tries`` graphs are shown to fall short of the goal, as in a group
of near vectors larger than a shard, the nodes are compared with all others in blocks, and the result is exact; this costs
time with the square of the nodes, but lists no pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing.  Vectors of different lengths
do not link.  Rows with equal ids are separate vectors.  A null id counts as larger than every id.  An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import components, cut, table

LAST = (1 << 63) - 1
SAMPLE = 4096
#: Nodes of the audit, of the largest block of the exact comparison, and bytes of vectors that a block may have.
AUDITED, LARGEST, ASKED_BYTES = 1024, 16_384, 32 << 20
#: Up to this many centroid rows are broadcast; beyond it they are joined by shard.
BROADCAST_SHARDS = 2048


def nodes_of(vectors: DataFrame, id_: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """(rows (id, node), nodes (node, unit, n)).  The node of an unusable vector is null."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(id_).alias("id"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scale = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("usable", F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("scale", F.when(F.col("usable"), scale))
    rows = rows.withColumn("node", F.when(F.col("scale") > 0, F.xxhash64("v")))
    small = F.transform("v", lambda x: x / F.col("scale"))
    rows = rows.withColumn("small", F.when(F.col("scale") > 0, small))
    norm = F.sqrt(F.aggregate("small", F.lit(0.0), lambda a, x: a + x * x))
    nodes = (
        rows.where(F.col("node").isNotNull()).withColumn("norm", norm)
        .groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("small", "norm")).alias("s"))
        .select("node", "n", F.transform("s.small", lambda x: x / F.col("s.norm")).alias("unit"))
    )
    return cut(rows.select("id", "node"), "vector-rows"), cut(nodes, "vector-nodes")


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    centers = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        for c in range(len(centers)):
            if (mine := x[near == c]).size:
                mean = mine.sum(axis=0)
                centers[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centers


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def shards_of(nodes: DataFrame, shard_size: int, seed: int, overlap: float = 0.08, fan_out: int = 64) -> DataFrame:
    """(shard, node, unit): overlapping shards of at most ``shard_size`` nodes, as far as vectors differ."""
    rows = nodes.select(F.size("unit").cast("long").alias("shard"), "node", "unit")
    done = None
    for level in range(8):
        sizes = cut(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size")), "vector-sizes")
        large = sizes.where(F.col("size") > shard_size)
        count = large.count()
        small = rows.join(large.select("shard"), "shard", "left_anti") if count else rows
        done = small if done is None else done.unionByName(small)
        if not count:
            return done
        few = F.broadcast(large) if count <= BROADCAST_SHARDS else large
        over = rows.join(few, "shard")
        # A bounded share of each shard, by hash.
        share = F.pmod(F.xxhash64("node", F.lit(seed), F.lit(level)), F.lit(1 << 30)) / float(1 << 30)

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("node")
            x = np.stack(frame["unit"].to_list())
            k = int(min(fan_out, max(2, np.ceil(2 * frame["size"].iloc[0] / shard_size))))
            return pd.DataFrame({"shard": frame["shard"].iloc[:1], "centers": [k_means(x, k, seed).ravel()]})

        centers = cut(
            over.where(share * F.col("size") < SAMPLE).groupBy("shard").applyInPandas(fit, "shard long, centers array<double>"),
            "vector-centers")

        def assign(batches):
            for batch in batches:
                shard, node, unit = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
                out_shard, out_at = [], []
                for s in np.unique(shard):
                    at = np.flatnonzero(shard == s)
                    x = matrix(unit.take(pa.array(at)))
                    c = np.asarray(batch.column(3)[int(at[0])].as_py()).reshape(-1, x.shape[1])
                    near = x @ c.T
                    two = np.argpartition(-near, min(1, near.shape[1] - 1), axis=1)[:, :2]
                    sims = np.take_along_axis(near, two, axis=1)
                    for j in range(two.shape[1]):
                        close = sims[:, j] >= sims.max(axis=1) - overlap
                        name = (np.int64(s) * np.int64(1000003) + two[:, j] + 1) * np.int64(31) + level
                        out_shard.append(name[close])
                        out_at.append(at[close])
                take = pa.array(np.concatenate(out_at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_shard)), node.take(take), unit.take(take)], names=["shard", "node", "unit"])

        few = F.broadcast(centers) if count <= BROADCAST_SHARDS else centers
        rows = over.select("shard", "node", "unit").join(few, "shard").select("shard", "node", "unit", "centers").mapInArrow(
            assign, "shard long, node long, unit array<double>")
        rows = cut(rows, "vector-split")
    return done.unionByName(rows)


def robust_prune(x: np.ndarray, degree: int, candidates: int, alpha: float) -> np.ndarray:
    """Adjacency, -1 where a list is shorter: candidates thinned as in a flat navigable graph.

    Candidates are the nearest nodes and as many drawn ones, which give the long links.  A candidate goes if an accepted
    one is closer to it by the factor ``alpha`` than the node is.  Links are then made mutual, the nearest first.
    """
    n, wide = len(x), min(candidates, len(x) - 1)
    out = np.full((n, degree), -1, np.int64)
    draw = np.random.default_rng(len(x))
    for low in range(0, n, 512):
        part = np.arange(low, min(n, low + 512))
        sims = x[part] @ x.T
        sims[np.arange(len(part)), part] = -9
        near = np.argpartition(-sims, wide - 1, axis=1)[:, :wide]
        near = np.concatenate([near, np.tile(draw.choice(n, wide, replace=False), (len(part), 1))], axis=1)
        order = np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        away = 1 - np.take_along_axis(sims, near, axis=1)
        alive, taken = away < 9, np.zeros(len(part), np.int64)
        for j in range(near.shape[1]):
            use = np.flatnonzero(alive[:, j] & (taken < degree))
            if not len(use):
                continue
            out[part[use], taken[use]] = near[use, j]
            taken[use] += 1
            between = 1 - np.einsum("nd,nkd->nk", x[near[use, j]], x[near[use]])
            alive[use] &= alpha * between > away[use]
            # What is equal up to rounding, the accepted candidate included, needs no second link.
            alive[use] &= near[use] != near[use, j][:, None]
    source, slot = np.nonzero(out >= 0)
    target = out[source, slot]
    pair = np.unique(np.r_[source * n + target, target * n + source])
    source, target = pair // n, pair % n
    sims = np.empty(len(pair))
    for low in range(0, len(pair), 1 << 16):
        s = slice(low, low + (1 << 16))
        sims[s] = np.einsum("nd,nd->n", x[source[s]], x[target[s]])
    order = np.lexsort((-sims, source))
    source, target = source[order], target[order]
    good = np.arange(len(source)) - np.searchsorted(source, source) < 2 * degree
    # What a full list has no room for hangs in a chain behind its last link, so that every node stays reachable.
    behind = np.flatnonzero(~good)
    return padded(n, np.r_[source[good], target[behind - 1]], np.r_[target[good], target[behind]])


def padded(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Links as adjacency (n, widest), -1 where there are fewer."""
    pair = np.unique(source * n + target)
    source, target = pair // n, pair % n
    rank = np.arange(len(source)) - np.searchsorted(source, source)
    out = np.full((n, int(rank.max(initial=0)) + 1), -1, np.int64)
    out[source, rank] = target
    return out


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, limit: float, beam: int = 24, slack: float = 0.08):
    """(query, found, cosine >= limit) by greedy search from the medoid, then expansion over the range."""
    n = len(x)
    mean = x.mean(axis=0)
    medoid = int((x @ mean).argmax())
    q = len(queries)
    rows = np.arange(q)
    seen = np.zeros((q, n), bool)
    seen[:, medoid] = True
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -9.0)
    ids[:, 0], sims[:, 0] = medoid, x[queries] @ x[medoid]
    # A query is a node of the graph itself, and so is a second way in.
    ids[:, 1], sims[:, 1] = queries, 1.0
    seen[rows, queries] = True
    open_ = np.zeros((q, beam), bool)
    open_[:, :2] = True
    for _ in range(4 * beam):
        best = np.where(open_, sims, -9).argmax(axis=1)
        active = np.flatnonzero(open_[rows, best])
        if not len(active):
            break
        open_[active, best[active]] = False
        near = graph[ids[active, best[active]]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], np.where(fresh, near, medoid)] = True
        got = np.where(fresh, np.einsum("nd,nkd->nk", x[queries[active]], x[near]), -9)
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_sims = np.concatenate([sims[active], got], axis=1)
        all_open = np.concatenate([open_[active], fresh], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, top, axis=1)
        sims[active] = np.take_along_axis(all_sims, top, axis=1)
        open_[active] = np.take_along_axis(all_open, top, axis=1) & (sims[active] > -9)
    at, slot = np.nonzero(sims >= limit - slack)
    found = ids[at, slot]
    reached = np.zeros((q, n), bool)
    reached[at, found] = True
    results = [(at, found)]
    while len(at):
        near = graph[found]
        who, what = np.repeat(at, near.shape[1]), near.ravel()
        fresh = (what >= 0) & ~reached[who, what]
        pair = np.unique(who[fresh] * n + what[fresh])
        who, what = pair // n, pair % n
        good = np.empty(len(pair), bool)
        for low in range(0, len(pair), 1 << 16):
            s = slice(low, low + (1 << 16))
            good[s] = np.einsum("nd,nd->n", x[queries[who[s]]], x[what[s]]) >= limit - slack
        reached[who, what] = True
        at, found = who[good], what[good]
        results.append((at, found))
    at, found = (np.concatenate(r) for r in zip(*results))
    exact = np.einsum("nd,nd->n", x[queries[at]], x[found])
    good = (exact >= limit) & (queries[at] != found)
    return queries[at[good]], found[good], exact[good]


def graph_links(shards: DataFrame, limit: float, degree: int = 16, candidates: int = 48, alpha: float = 1.2) -> DataFrame:
    """(a, b, cosine), a < b, of the pairs that the search finds."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        ids = frame["node"].to_numpy()
        graph = robust_prune(np.stack(frame["unit"].to_list()), degree, candidates, alpha) if len(ids) > 1 else np.full((1, 1), -1)
        return pd.DataFrame({"node": ids, "near": [ids[g[g >= 0]] for g in graph]})

    lists = cut(shards.groupBy("shard").applyInPandas(build, "node long, near array<long>"), "vector-lists")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    ready = shards.join(united, "node").select("shard", "node", "unit", "near")

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node").drop_duplicates("node")
        ids, x = frame["node"].to_numpy(), np.stack(frame["unit"].to_list())
        inside = [np.searchsorted(ids, np.asarray(g, np.int64)) for g in frame["near"]]
        inside = [p[(p < len(ids)) & (ids[np.minimum(p, len(ids) - 1)] == g)] for p, g in zip(inside, frame["near"])]
        graph = padded(len(ids), np.repeat(np.arange(len(ids)), [len(p) for p in inside]), np.concatenate(inside))
        found = [search(x, graph, np.arange(low, min(len(ids), low + 256)), limit) for low in range(0, len(ids), 256)]
        a, b, cosine = (np.concatenate(f) for f in zip(*found))
        low = np.minimum(ids[a], ids[b])
        return pd.DataFrame({"a": low, "b": np.maximum(ids[a], ids[b]), "cosine": cosine}).drop_duplicates(["a", "b"])

    return ready.groupBy("shard").applyInPandas(find, "a long, b long, cosine double")


class Recall(float):
    """Audited recall, with the number of nodes compared with all others, those of them that have a neighbour, and their pairs.

    ``proven`` is false where too few audited nodes have a neighbour to tell; 1.0 of no pair says nothing then.
    """

    asked: int
    linked: int
    pairs: int
    proven: bool


def stars(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what ``near`` (a x b) joins, at most one for each node."""
    i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near = near[np.ix_(i, j)]
    label = np.arange(len(i))
    while True:
        over = np.where(near, label[:, None], len(i)).min(axis=0)
        new = np.where(near, over[None, :], len(i)).min(axis=1)
        if np.array_equal(new, label):
            return np.r_[a[i], b[j]], a[i][np.r_[label, over]]
        label = new


def compared(nodes: DataFrame, asked: DataFrame, limit: float) -> DataFrame:
    """``asked`` nodes against all, exactly: per task rows (node, pairs, rows) and rows (node, other).

    The first count the neighbours of an asked node and their rows, the second join what is near.  Neither lists the
    pairs themselves, which grow with the square of a group.
    """
    mine = asked.select("node", "unit").toArrow()
    ids, units = (mine.column(c).combine_chunks() for c in (0, 1))
    size = np.diff(units.offsets.to_numpy())
    by_size = {int(s): (ids.take(pa.array(at)).to_numpy(), matrix(units.take(pa.array(at))))
               for s in np.unique(size) for at in [np.flatnonzero(size == s)]}
    sent = nodes.sparkSession.sparkContext.broadcast(by_size)

    def compare(batches):
        counts = {s: np.zeros((2, len(ids)), np.int64) for s, (ids, _) in sent.value.items()}
        short = {s: x.astype(np.float32) for s, (_, x) in sent.value.items()}
        joined: dict[int, int] = {}
        links: list[tuple[int, int]] = []

        def top(c):
            while (up := joined.get(c, c)) != c:
                joined[c] = c = joined.get(up, up)
            return c

        for batch in batches:
            node, unit, n = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            sizes = np.diff(unit.offsets.to_numpy())
            for s, (ids, x) in sent.value.items():
                at = np.flatnonzero(sizes == s)
                # What single precision leaves open is computed again.
                open_ = max(1e-4, s * 2.4e-7)
                for low in range(0, len(at), 1024):
                    part = at[low:low + 1024]
                    y = matrix(unit.take(pa.array(part)))
                    y_short, other = y.astype(np.float32), node[part]
                    for q in range(0, len(ids), 2048):
                        sims = short[s][q:q + 2048] @ y_short.T
                        near = sims >= limit + open_
                        i, j = np.nonzero(np.abs(sims - limit) <= open_)
                        for k in range(0, len(i), 1 << 16):
                            i_, j_ = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
                            near[i_, j_] = np.einsum("nd,nd->n", x[q + i_], y[j_]) >= limit
                        near &= ids[q:q + 2048, None] != other[None, :]
                        if not near.any():
                            continue
                        counts[s][0, q:q + 2048] += near.sum(axis=1)
                        counts[s][1, q:q + 2048] += (near @ n[part].astype(np.float64)).astype(np.int64)
                        for one, two in zip(*(e.tolist() for e in stars(near, ids[q:q + 2048], other))):
                            if (c := top(one)) != (d := top(two)):
                                joined[max(c, d)] = min(c, d)
                                links.append((one, two))
        found = [(i, None, p, r) for s, (ids, _) in sent.value.items() for i, p, r in zip(ids.tolist(), *counts[s].tolist()) if p]
        for low in range(0, len(rows := found + [(a, b, None, None) for a, b in links]), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows[low:low + (1 << 16)])], names=["node", "other", "pairs", "rows"])

    return nodes.select("node", "unit", "n").mapInArrow(compare, "node long, other long, pairs long, rows long")


class Audit:
    """Brute force for a share of the nodes, in the order of a hash: each block is compared with all nodes."""

    def __init__(self, nodes: DataFrame, limit: float):
        self.nodes, self.limit = nodes, limit
        self.total, wide = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("unit")), F.lit(1))).first()
        self.block = max(256, min(LARGEST, ASKED_BYTES // (8 * wide)))
        self.next, self.done, self.asked, self.seen = min(AUDITED, self.block), 0.0, 0, None

    def all_asked(self) -> bool:
        return self.done >= 1 or not self.total

    def ask(self) -> None:
        """One more block."""
        upto = min(1.0, self.done + self.next / max(self.total, 1))
        place = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)) / float(1 << 30)
        block = self.nodes.where((place >= self.done) & (place < upto))
        more = cut(compared(self.nodes, block, self.limit), "vector-truth")
        self.asked += block.count()
        self.seen = more if self.seen is None else self.seen.unionByName(more)
        self.done, self.next = upto, min(self.block, 4 * self.next)

    def counts(self) -> DataFrame:
        return self.seen.where("other is null").groupBy("node").agg(F.sum("pairs").alias("pairs"), F.sum("rows").alias("rows"))

    def recall(self, links: DataFrame, enough: int) -> Recall:
        """Recall of ``links`` over the first block of nodes, proven if ``enough`` of them have neighbours or they are all.

        The smaller of two: the share of all pairs, and the mean share of a node's pairs, which a large group of near
        vectors does not settle alone.
        """
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
        known = cut(ends.groupBy("node").agg(F.count(F.lit(1)).alias("found")), "vector-degrees")
        linked, pairs, value = 0, 0, 1.0
        if self.seen is None and self.total:
            self.ask()
        if self.seen is not None:
            both = cut(self.counts(), "vector-asked").join(known, "node", "left").select(
                "pairs", F.coalesce("found", F.lit(0)).alias("found"))
            linked, pairs, found, mean = both.agg(
                F.count(F.lit(1)), F.sum("pairs"), F.sum("found"), F.avg(F.col("found") / F.col("pairs"))).first()
            value = min(found / pairs, mean) if linked else 1.0
        out = Recall(value)
        out.asked, out.linked, out.pairs, out.proven = self.asked, linked, pairs or 0, linked >= enough or self.all_asked()
        return out


def near_vectors(
    vectors: DataFrame, id_: str = "vec_id", embedding: str = "embedding", limit: float = 0.9, shard_size: int = 2000,
    goal: float = 0.97, tries: int = 3, enough: int = 100,
) -> tuple[DataFrame, Recall]:
    """(one row per vector: id, n_links, component_id, kept; audited recall).

    The recall is that of what is returned.  Rows are the graphs' unless those are shown to stay below ``goal``.
    """
    rows, nodes = nodes_of(vectors, id_, embedding)
    audit, links, recall = Audit(nodes, limit), None, Recall(0.0)
    for seed in range(tries):
        shards = cut(shards_of(nodes, shard_size, seed), "vector-shards")
        more = cut(graph_links(shards, limit).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "vector-links")
        links = more if links is None else cut(
            links.unionByName(more).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "vector-links")
        recall = audit.recall(links, enough)
        # What too few nodes show is not relied on: a second, independent graph adds what the first may have lost.
        if recall >= goal and (recall.proven or seed > 0):
            break
    exact = recall < goal
    if exact:
        while not audit.all_asked():
            audit.ask()
    if exact:
        # Every node has met every other: counts and joins are exact.
        counts = cut(audit.counts(), "vector-asked")
        linked = counts.select("node", F.col("rows").alias("others"))
        groups = components(
            audit.seen.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "vector")
        n_linked, n_pairs = counts.agg(F.count(F.lit(1)), F.sum("pairs")).first()
        recall = Recall(1.0)
        recall.asked, recall.linked, recall.pairs, recall.proven = audit.asked, n_linked, n_pairs or 0, True
    else:
        groups = components(links.select("a", "b"), "vector")
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        sizes = nodes.select(F.col("node").alias("b"), "n")
        linked = both.join(sizes, "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    known = nodes.select("node", "n").join(linked, "node", "left").join(groups, "node", "left").select(
        "node", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component"))
    known = cut(known, "vector-known")
    placed = rows.join(known, "node").withColumn("place", F.coalesce(F.col("id").cast("long"), F.lit(LAST)))
    smallest = cut(
        placed.groupBy("component").agg(F.min("place").alias("smallest")), "vector-smallest")
    usable = placed.join(smallest, "component").select(
        "id", "n_links", F.when(F.col("smallest") < LAST, F.col("smallest")).alias("component_id"))
    rest = rows.where(F.col("node").isNull()).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    out = usable.unionByName(rest)
    return out.select(
        F.col("id").alias(id_), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), recall


def op10_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))[0]
