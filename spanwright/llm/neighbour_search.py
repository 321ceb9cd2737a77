"""Approximate nearest neighbours by learned partitions (smallest Euclidean distance).

1. Rows with equal vectors are one node, with the ids of its smallest rows: a vector that
   half the table repeats costs as much as any other.
2. A bounded sample of nodes gives a neighbour graph; bisections with swaps along the graph
   part it into balanced pieces (``balanced_partition``).
3. A small classifier learns from each sampled vector which partitions hold its neighbours.
   Its most probable partition holds a node; a query visits the most probable ones until
   their probability reaches a share that is calibrated on sampled vectors it has not
   learned from, so that they find ``TARGET`` of their neighbours.
4. Nodes and queries meet in cells (partition, block of nodes, block of queries) of bounded
   size, where distances are computed in double precision; the best of all cells are merged.

Only fitting uses the sample; every node is indexed and every visited partition is compared in full.

Defined results: null ids, and vectors that are null, zero, or hold null or non-finite components,
take no part, nor do vectors of another length than the most frequent one; rows that repeat id and
vector count once; a query never finds its own id; ties go to the smaller id; fewer candidates give
fewer rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialise

#: Nodes that the partitions are fitted on, at most, and partitions, at most.
SAMPLE, PARTITIONS = 8192, 64
#: Share of neighbours that visited partitions should hold.
TARGET = 0.97
#: Nodes and queries of one cell, about.
BLOCK, QUERIES = 4096, 1024
HIDDEN, EPOCHS, NEIGHBOURS = 128, 30, 10


# --- fitting, on the sample -----------------------------------------------------------------------


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of each row."""
    out = np.empty((len(x), k), np.int64)
    norms = (x * x).sum(1)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        d = norms[None, :] - 2 * part @ x.T
        d[np.arange(len(part)), np.arange(at, at + len(part))] = np.inf
        out[at : at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _bisect(x: np.ndarray, graph: np.ndarray, own: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Which of the rows ``own`` go right: half of them, with few graph edges across."""
    inside = np.full(len(x), -1)
    inside[own] = np.arange(len(own))
    edges = inside[graph[own]]
    known = edges >= 0
    centred = x[own] - x[own].mean(0)
    axis = np.linalg.svd(centred[:2000], full_matrices=False)[2][0]
    order = np.argsort(centred @ axis, kind="stable")
    side = np.zeros(len(own), np.int8)
    side[order[len(own) // 2 :]] = 1
    for _ in range(rounds):
        # edges count in both directions
        to_right = np.where(known, side[edges], 0).sum(1).astype(float)
        degree = known.sum(1).astype(float)
        row, col = np.nonzero(known)
        np.add.at(to_right, edges[row, col], side[row])
        np.add.at(degree, edges[row, col], 1)
        gain = np.where(side == 1, degree - 2 * to_right, 2 * to_right - degree)  # of changing sides
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        swap = np.flatnonzero(gain[left[:n]] + gain[right[:n]] > 0)[: max(1, n // 4)]
        if not len(swap):
            break
        side[left[swap]], side[right[swap]] = 1, 0
    return side.astype(bool)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A part number below ``parts`` (a power of two) for each row; parts differ by a row or two in size."""
    label = np.zeros(len(x), np.int64)
    for _ in range(parts.bit_length() - 1):
        split = np.zeros(len(x), bool)
        for p in np.unique(label):
            own = np.flatnonzero(label == p)
            split[own] = _bisect(x, graph, own)
        label = 2 * label + split
    return label


@dataclass(frozen=True)
class Router:
    """Standardisation and the two layers of the classifier; ``cover``: the probability that visits must reach."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    cover: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def visits(self, x: np.ndarray) -> list[np.ndarray]:
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        reached = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
        number = np.minimum((reached < self.cover).sum(1) + 1, p.shape[1])
        return [o[:n] for o, n in zip(order, number, strict=True)]


def _train(x: np.ndarray, want: np.ndarray, seed: int = 3) -> Router:
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), max(float(x.std()), 1e-300)
    n_out = want.shape[1]
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.05, (HIDDEN, n_out)), np.zeros(n_out)]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step = 0
    for epoch in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            z = (x[rows] - mean) / scale
            h = np.maximum(z @ w[0] + w[1], 0)
            o = h @ w[2] + w[3]
            p = np.exp(o - o.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - want[rows]) / len(rows)
            gh = (g @ w[2].T) * (h > 0)
            step += 1
            rate = 3e-3 * (1 - epoch / EPOCHS)
            for k, grad in enumerate((z.T @ gh + 1e-4 * w[0], gh.sum(0), h.T @ g + 1e-4 * w[2], g.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *w)


def fit(x: np.ndarray, parts: int = PARTITIONS, target: float = TARGET) -> Router:
    """A router from sampled vectors; every fifth one only calibrates ``cover``."""
    parts = min(parts, 1 << max(0, (len(x) // 32).bit_length() - 1))
    if parts < 2:
        return Router(np.zeros(x.shape[1]), 1.0, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, min(NEIGHBOURS, len(x) - 1))
    part = balanced_partition(x, graph, parts)
    seen = np.arange(len(x)) % 5 > 0
    want = np.zeros((len(x), parts))
    np.add.at(want, (np.arange(len(x))[:, None], part[graph]), 0.5 / graph.shape[1])
    want[np.arange(len(x)), part] += 0.5
    router = _train(x[seen], want[seen])
    p = router.probabilities(x)
    held = p.argmax(1)
    late = np.flatnonzero(~seen)
    order = np.argsort(-p[late], axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(late), 0), 1)
    before = np.cumsum(np.take_along_axis(p[late], order, 1), axis=1) - np.take_along_axis(p[late], order, 1)
    # a neighbour is found once the probability before its partition is below ``cover``
    need = np.take_along_axis(before, np.take_along_axis(rank, held[graph[late]], 1), 1).ravel()
    return Router(router.mean, router.scale, router.w1, router.b1, router.w2, router.b2, float(np.quantile(need, target) + 1e-9))


# --- indexing and searching, on Spark -----------------------------------------------------------


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, key (hash of the vector), v of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().agg(F.max(F.struct("count", "n"))["n"]).head()[0]
    return rows.where(F.size("v") == F.lit(lengths or 0)).select("id", F.xxhash64("v").alias("key"), "v")


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """key, v, ids: each vector with its ``ids`` smallest row ids."""
    order = F.row_number().over(Window.partitionBy("key", "v").orderBy("id"))
    few = rows.withColumn("__n", order).where(F.col("__n") <= ids)
    return few.groupBy("key", "v").agg(F.array_sort(F.array_distinct(F.collect_list("id"))).alias("ids"))


def _routed(df: DataFrame, router: Router, all_visits: bool) -> DataFrame:
    """``df`` with ``part``: the node's own partition, or a row for each one that a query visits."""
    schema = df.select("*", F.lit(0).alias("part")).schema

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy())
            if all_visits:
                yield batch.assign(part=router.visits(x)).explode("part").astype({"part": "int32"})
            else:
                yield batch.assign(part=router.probabilities(x).argmax(1).astype(np.int32))

    return df.mapInPandas(route, schema)


def _nearest(nodes: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    c, q = np.stack(nodes["v"].to_numpy()), np.stack(queries["v"].to_numpy())
    least = np.array([i[0] for i in nodes["ids"]])
    norms = (c * c).sum(1)
    out = []
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        # within the rounding error of the expanded square nothing is left out
        own = (part * part).sum(1)
        near = norms[None, :] - 2 * part @ c.T + own[:, None]
        slack = 1e-12 * (norms.max() + own)
        cut = np.partition(near, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
        for row in range(len(part)):
            found = np.flatnonzero(near[row] <= cut[row] + slack[row])
            d = np.sqrt(((c[found] - part[row]) ** 2).sum(1))
            best = np.lexsort((least[found], d))[:k]
            out.append(pd.DataFrame({"key": queries["key"].iat[at + row], "d": d[best], "ids": nodes["ids"].iloc[found[best]].to_numpy()}).assign(v=[part[row]] * len(best)))
    return pd.concat(out)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTITIONS, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row with ``is_query`` (over a column ``id``)."""
    rows = usable(vectors, id_col, vector)
    nodes = materialise(distinct_vectors(rows, k + 1), "ann-nodes")
    asked = materialise(rows.where(is_query), "ann-queries")
    sample = nodes.orderBy(F.xxhash64("key", F.lit(1)), "v").select("v").limit(SAMPLE).collect()
    router = fit(np.array([r["v"] for r in sample]), parts, target) if sample else fit(np.zeros((0, 1)))
    nodes = materialise(_routed(nodes, router, False), "ann-index")
    asked_for = materialise(_routed(asked.select("key", "v").distinct(), router, True), "ann-visits")
    size = lambda df: {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}  # noqa: E731  a row for each partition
    blocks, groups = ({p: -(-n // most) for p, n in size(df).items()} for df, most in ((nodes, BLOCK), (asked_for, QUERIES)))
    number = lambda of: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), F.col("part")), F.lit(0)) if of else F.lit(0)
    every = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    left = nodes.withColumn("block", F.pmod(F.col("key"), F.greatest(number(blocks), F.lit(1))).cast("int")).select("*", every(number(groups)).alias("group"))
    right = asked_for.withColumn("group", F.pmod(F.xxhash64("key"), F.greatest(number(groups), F.lit(1))).cast("int")).select("*", every(number(blocks)).alias("block"))

    def meet(nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes) or not len(queries):
            return pd.DataFrame({"key": [], "v": [], "d": [], "ids": []})
        return _nearest(nodes, queries, k + 1)

    cell = ["part", "block", "group"]
    met = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(meet, "key long, v array<double>, d double, ids array<long>")
    best = Window.partitionBy("key", "v").orderBy("d", F.col("ids")[0])
    met = met.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k + 1)
    each = met.select("key", "v", "d", F.explode("ids").alias("id")).withColumn("__n", F.row_number().over(Window.partitionBy("key", "v").orderBy("d", "id"))).where(F.col("__n") <= k + 1)
    found = each.groupBy("key", "v").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("found"))
    out = asked.select(F.col("id").alias("query_id"), "key", "v").distinct().join(found, ["key", "v"])
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(own).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
