"""Merkle dataset manifest: one tree for each group of rows, one tree over their roots, and a proof for each row.

The rows of a group, in order of their keys, are the leaves of its tree. While a tree has more than one node in a level,
every ``arity`` consecutive ones (the last run may be shorter) become the hash of their digests. The roots of the groups, in
order of the groups, are the leaves of the top tree.

Leaves are ordered by a range partitioning, and numbered from counts by partition. Rows that follow each other (``CHUNK`` at
most) build a *fragment*: the forest over what they hold, of which only nodes without a complete run of siblings stay open,
keyed by tree, level and index. How long a run is follows from the size of its tree, so fragments merge in any order
(``settle`` is associative and commutative); a fragment has a number of open nodes that grows with the logarithm of its
leaves. Rounds of merges, ``FAN`` fragments into one, end with the root. On the way back each round tells the fragments
below it which siblings their open nodes met; so a proof is put together without looking up any node twice. The rounds stand in
place of RDD.treeReduce, which brings its result to the driver and keeps nothing of the way; no node passes through the driver.

Defined results: a null is a value of its own in every field (``-``), in the group (first) and in the key (first); rows with
equal keys are ordered by their digests, so that repeated rows have neighbouring leaves; empty and long texts are plain values;
an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialise, partitions

CHUNK = 1 << 13
FAN = 16
HEX = 64  # characters of a digest
TOP = -1  # the tree over the groups

Node = tuple[int, int, int]  # tree, level, index


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as length-prefixed text, ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """The digest of a row with these values."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


# --- the monoid --------------------------------------------------------------------------------


class Forest:
    """Open nodes over some leaves, and how they came about. ``sizes``: leaves of each tree; ``trees``: leaves of the top tree."""

    def __init__(self, arity: int, trees: int):
        self.arity, self.trees = arity, trees
        self.sizes: dict[int, int] = {TOP: trees}
        self.open: dict[Node, str] = {}
        self.above: dict[Node, tuple[Node, str]] = {}  # the node's parent and its siblings' digests, left to right
        self.subroots: dict[int, str] = {}

    def width(self, tree: int, level: int) -> int:
        n = self.sizes[tree]
        for _ in range(level):
            n = -(-n // self.arity)
        return n

    def add(self, node: Node, digest: str) -> None:
        """Takes a node in; completes every run that it completes."""
        while True:
            tree, level, index = node
            width = self.width(tree, level)
            if width == 1 and tree != TOP:
                self.subroots[tree] = digest
                self.above[node] = ((TOP, 0, tree), "")
                node = (TOP, 0, tree)
                continue
            self.open[node] = digest
            if width == 1:
                return
            first = index // self.arity * self.arity
            run = [(tree, level, k) for k in range(first, min(first + self.arity, width))]
            if not all(x in self.open for x in run):
                return
            digests = [self.open.pop(x) for x in run]
            node, digest = (tree, level + 1, index // self.arity), sha256("".join(digests))
            for k, x in enumerate(run):
                self.above[x] = (node, "".join(digests[:k] + digests[k + 1 :]))

    def way(self, node: Node) -> tuple[Node, str]:
        """The open node above a node, and the siblings met on the way."""
        siblings = []
        while node in self.above:
            node, met = self.above[node]
            siblings.append(met)
        return node, "".join(siblings)


def fold(value: str, node: Node, size: int, trees: int, proof: str, arity: int) -> tuple[str, str]:
    """Subroot and root that follow from the digest of a node and its proof; no subroot for a node of the top tree."""
    tree, level, index = node
    at, subroot = 0, ""
    ways = [(index, trees, level)] if tree == TOP else [(index, size, level), (tree, trees, 0)]
    for k, (i, n, up) in enumerate(ways):
        for _ in range(up):
            n = -(-n // arity)
        while n > 1:
            first = i // arity * arity
            end = at + HEX * (min(arity, n - first) - 1)
            met, at, left = proof[at:end], end, HEX * (i - first)
            value = sha256(met[:left] + value + met[left:])
            i, n = i // arity, -(-n // arity)
        if len(ways) - k == 2:
            subroot = value
    return subroot, value


# --- order and numbers of the leaves -----------------------------------------------------------


def _numbered(leaves: DataFrame) -> DataFrame:
    """part, chunk, key, leaf, claim, tree, index, size, trees; chunks of a part hold consecutive leaves."""
    order = [F.col(c).asc_nulls_first() for c in ("group", "key", "leaf", "n")]
    hashed = materialise(leaves.withColumn("n", F.monotonically_increasing_id()), "merkle-leaves")
    ordered = hashed.repartitionByRange(partitions(leaves.sparkSession), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = ordered.select("group", "key", "leaf", "claim", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("pos"))
    ordered = materialise(ordered, "merkle-ordered")
    # a row for each part and group: what of the group lies in earlier parts
    by_group = Window.partitionBy("group")
    runs = ordered.groupBy("part", "group").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    runs = runs.select(
        "*", F.coalesce(F.sum("n").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(by_group).alias("size"), F.min("part").over(by_group).alias("starts"),
    )
    # groups are numbered in order: first by the part in which they start (one row for each part), then within it
    starts = runs.where("part = starts")
    all_parts = Window.orderBy("part")
    parts = starts.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(all_parts) - F.col("n")).alias("earlier"), F.sum("n").over(all_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("trees")
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("group").asc_nulls_first())) - 1
    trees = starts.select("group", "part", within.alias("within")).join(parts, "part").select(F.col("group").alias("of"), (F.col("earlier") + F.col("within")).alias("tree"), "trees")
    runs = runs.join(trees, F.col("group").eqNullSafe(F.col("of"))).select(F.col("part").alias("in_part"), F.col("group").alias("of"), "first", "before", "size", "tree", "trees")
    runs = materialise(runs, "merkle-runs")
    placed = ordered.join(runs, (F.col("part") == F.col("in_part")) & F.col("group").eqNullSafe(F.col("of")))
    index = (F.col("before") + F.col("pos") - F.col("first")).alias("index")
    return placed.select("part", F.expr(f"pos div {CHUNK}").alias("chunk"), F.col("key").cast("string").alias("key"), "leaf", "claim", "tree", index, "size", "trees")


# --- merges ------------------------------------------------------------------------------------

_OPEN = "part long, chunk long, tree long, level long, index long, digest string, size long, trees long, in_part long, in_chunk long, out_tree long, out_level long, out_index long, way string"


def _forest(rows: pd.DataFrame, arity: int) -> Forest:
    forest = Forest(arity, int(rows["trees"].iloc[0]))
    forest.sizes.update((int(t), int(n)) for t, n in rows[["tree", "size"]].drop_duplicates().itertuples(index=False))
    forest.sizes[TOP] = forest.trees
    return forest


def _open_rows(key: tuple, forest: Forest) -> Iterator[tuple]:
    for (tree, level, index), value in forest.open.items():
        yield (*key, tree, level, index, value, forest.sizes[tree], forest.trees, None, None, None, None, None, None)


def _fragments(arity: int):
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        forest = _forest(rows, arity)
        for tree, index, leaf in zip(rows["tree"], rows["index"], rows["leaf"], strict=True):
            forest.add((int(tree), 0, int(index)), leaf)
        return pd.DataFrame(list(_open_rows(key, forest)), columns=_NAMES)

    return build


_NAMES = [x.split()[0] for x in _OPEN.split(", ")]


def _merge(arity: int):
    """Rows of open nodes, and for each node that came in the way to the open node above it."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        forest, came = _forest(rows, arity), []
        for r in rows.itertuples(index=False):
            node = (int(r.tree), int(r.level), int(r.index))
            came.append((node, r.in_part, r.in_chunk))
            forest.add(node, r.digest)
        out = list(_open_rows(key, forest))
        for node, in_part, in_chunk in came:
            above, way = forest.way(node)
            out.append((*key, *node, None, None, None, in_part, in_chunk, *above, way))
        return pd.DataFrame(out, columns=_NAMES)

    return build


def _reduced(fragments: DataFrame, arity: int) -> DataFrame:
    """part, chunk, tree, level, index, proof: for each open node of each fragment all siblings up to the root."""
    parts, chunks = fragments.agg(F.max("part"), F.max("chunk")).first()
    level, rounds = fragments, []
    while parts or chunks:
        to = (F.col("part"), F.expr(f"chunk div {FAN}")) if chunks else (F.expr(f"part div {FAN}"), F.lit(0).cast("long"))
        parts, chunks = (parts, chunks // FAN) if chunks else (parts // FAN, 0)
        came = level.where("digest is not null").select(to[0].alias("to_part"), to[1].alias("to_chunk"), F.col("part").alias("in_part"), F.col("chunk").alias("in_chunk"), "tree", "level", "index", "digest", "size", "trees")
        level = materialise(came.groupBy("to_part", "to_chunk").applyInPandas(_merge(arity), _OPEN), "merkle-merge")
        rounds.append(level)
    # from the root down: what an open node of a round met above it continues what its fragments met in it
    proofs = level.where("digest is not null").select("part", "chunk", "tree", "level", "index", F.lit("").alias("proof"))
    for merged in reversed(rounds):
        ways = merged.where("digest is null").select("part", "chunk", F.struct("in_part", "in_chunk", "tree", "level", "index", "way").alias("came"), F.col("out_tree").alias("tree"), F.col("out_level").alias("level"), F.col("out_index").alias("index"))
        proofs = ways.join(proofs, ["part", "chunk", "tree", "level", "index"]).select(
            F.col("came.in_part").alias("part"), F.col("came.in_chunk").alias("chunk"), "came.tree", "came.level", "came.index", F.concat("came.way", "proof").alias("proof")
        )
    return materialise(proofs, "merkle-proofs")


def _proved(arity: int, proofs: bool):
    """For a fragment's leaves and the proofs of its open nodes: a row for each leaf."""

    def build(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        forest = _forest(rows, arity)
        nodes = [(int(t), 0, int(i)) for t, i in zip(rows["tree"], rows["index"], strict=True)]
        for node, leaf in zip(nodes, rows["leaf"], strict=True):
            forest.add(node, leaf)
        rest = {(int(r.tree), int(r.level), int(r.index)): r.proof for r in known.itertuples(index=False)}
        ends = {node: fold(value, node, forest.sizes[node[0]], forest.trees, rest[node], arity) for node, value in forest.open.items()}
        out = []
        for node, key, leaf, claim in zip(nodes, rows["key"], rows["leaf"], rows["claim"], strict=True):
            above, way = forest.way(node)
            proof = way + rest[above]
            subroot, root = ends[above]
            folded = fold(claim, node, forest.sizes[node[0]], forest.trees, proof, arity)[1]
            out.append((key, leaf, subroot or forest.subroots[node[0]], root, sha256(proof), folded, folded == root, proof if proofs else None))
        return pd.DataFrame(out, columns=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"])

    return build


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", columns: Iterable[str] = ("doc_id", "source", "lang", "n_chars", "text"), claim: dict[str, Column] | None = None, arity: int = 2, proofs: bool = False) -> DataFrame:
    """A row for each document: key, leaf, subroot of its group, root, proof_sha256, folded_root, verified (and ``proof`` if asked for).

    ``key`` is an integer column. A proof holds the digests of the leaf's siblings, level by level up to the root, left to
    right. ``claim`` gives values that replace those of some columns in the row that is verified: ``folded_root`` is the root
    that follows from it and the untouched siblings, ``verified`` whether that is the root.
    """
    of = lambda values: digest(*(values[c] for c in columns))
    own = {c: F.col(f"`{c}`") for c in columns}
    leaf = of(own)
    leaves = docs.select(F.col(f"`{group}`").cast("string").alias("group"), F.col(f"`{key}`").cast("long").alias("key"), leaf.alias("leaf"), (of(own | claim) if claim else leaf).alias("claim"))
    placed = _numbered(leaves)
    fragments = materialise(placed.groupBy("part", "chunk").applyInPandas(_fragments(arity), _OPEN), "merkle-fragments")
    known = _reduced(fragments, arity)
    rows = placed.groupBy("part", "chunk").cogroup(known.groupBy("part", "chunk"))
    out = rows.applyInPandas(_proved(arity, proofs), "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof string")
    return out.select(F.col("key").cast("long").alias(key), *(c for c in out.columns[1:] if proofs or c != "proof"))
