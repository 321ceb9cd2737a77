"""Prefix trie of conversations, without a table of all shared prefixes.

A node of the trie is a sequence of first turns that some conversation begins with. It belongs to the smallest of these
conversations; so what a conversation owns are its prefixes from some depth on, a *chain*, and chains make up the trie.

1. Turns get their places from a range partitioning and counts by partition (``in_order``), never by gathering a conversation.
2. The digest of a prefix is the exclusive or of the digests of its turns, each taken together with its place: two 60-bit
   halves that add up in any grouping, here in blocks of ``BLOCK`` turns (``running``).
3. Grouping all prefixes by digest gives each node its owner (the minimum of a partial aggregate) and its members.
4. A binary search over the depths of all conversations at once finds each one's first owned depth: a round joins every
   conversation's middle prefix to the owners; rounds grow with the logarithm of the longest conversation. A last join gives
   the owner of the prefix just above: the node that the chain hangs from, or, where a conversation owns nothing, its end.
5. Chains are summed bottom-up by doubling: after round k a chain holds the sums over the chains less than 2**k links below;
   sums over the rest of a chain are running sums again.

Defined results: rows without conv_id belong to no conversation and are left out; a null role or text is empty; null turns come
first; rows of a conversation with the same turn come in the order of the digests of role and text (equal rows one after
another); a conversation without turns ends in the root; an empty table has no nodes; other columns are ignored.
Digests of 120 bits stand for prefixes; texts are not compared again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialise, partitions

BLOCK = 1 << 10


def in_order(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds ``place``, the number (from 1) of a row within its ``key`` by ``order``; one key may fill many partitions."""
    by = [F.col(key), *(F.col(c).asc_nulls_first() for c in order)]
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    ordered = materialise(ordered.withColumn("__part", F.shiftright("__at", 33)), name)
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = ordered.groupBy(key, "__part").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    runs = runs.select(key, "__part", "__first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    placed = ordered.join(runs, [key, "__part"]).withColumn("place", F.col("__before") + F.col("__at") - F.col("__first") + 1)
    return placed.drop("__at", "__part", "__first", "__before")


def running(rows: DataFrame, key: str, place: str, values: list[str], by: str = "sum", backwards: bool = False) -> DataFrame:
    """Replaces ``values`` by their running totals along ``place`` within ``key`` (``by``: sum or bit_xor), over blocks and then over what blocks come to."""
    total = lambda c: F.expr(f"{by}({c})")
    along = lambda c: F.desc(c) if backwards else F.asc(c)
    rows = rows.withColumn("__block", F.expr(f"{place} div {BLOCK}"))
    within = Window.partitionBy(key, "__block").orderBy(along(place)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(along("__block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(key, "__block").agg(*(total(c).alias(c) for c in values))
    blocks = blocks.select(key, "__block", *(F.coalesce(total(c).over(before), F.lit(0)).alias(f"__{c}") for c in values))
    rest = [c for c in rows.columns if c not in values]
    rows = rows.select(*rest, *(total(c).over(within).alias(c) for c in values)).join(blocks, [key, "__block"])
    add = (lambda a, b: a.bitwiseXOR(b)) if by == "bit_xor" else (lambda a, b: a + b)
    return rows.select(*(c for c in rest if c != "__block"), *(add(F.col(c), F.col(f"__{c}")).alias(c) for c in values))


def _half(hexed: Column, k: int) -> Column:
    return F.conv(F.substring(hexed, 15 * k + 1, 15), 16, 10).cast("long")


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place, said (digest of role and text), size (bytes of the text), of all turns in order."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    plain = rows.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), said.alias("said"), F.octet_length(text).cast("long").alias("size"))
    return in_order(plain, "conv_id", ["turn", "said"], "trie-turns").drop("turn")


def rebuilt(said: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Every conversation begins with the first ``head`` turns of conversation ``base`` and goes on with its own turns after its first ``head``.

    Returns the turns and all conversations (conv_id), also those left without turns. ``head`` must be small: it bounds what is copied.
    """
    convs = materialise(said.groupBy("conv_id").agg(F.max("place").alias("turns")).select("conv_id", "turns", base.alias("base"), head.cast("long").alias("head")), "trie-conversations")
    most = convs.agg(F.max("head")).first()[0] or 0
    first = said.where(F.col("place") <= most).withColumnRenamed("conv_id", "base")
    heads = first.join(convs.select("conv_id", "base", "head"), "base").where("place <= head").select("conv_id", "place", "said", "size")
    has = convs.select(F.col("conv_id").alias("base"), F.col("turns").alias("there"))
    shift = convs.join(has, "base", "left").select("conv_id", "head", (F.least("head", F.coalesce("there", F.lit(0))) - F.col("head")).alias("shift"))
    own = said.join(shift, "conv_id").where("place > head").select("conv_id", (F.col("place") + F.col("shift")).alias("place"), "said", "size")
    return heads.unionByName(own), convs.select("conv_id")


def prefixes(said: DataFrame) -> DataFrame:
    """conv_id, depth, x, y (digest of the first ``depth`` turns), size of the last."""
    hexed = F.sha2(F.concat("said", F.col("place").cast("string")).cast("binary"), 256)
    tagged = said.select("conv_id", F.col("place").alias("depth"), "size", hexed.alias("h")).select("conv_id", "depth", "size", _half(F.col("h"), 0).alias("x"), _half(F.col("h"), 1).alias("y"))
    return running(tagged, "conv_id", "depth", ["x", "y"], "bit_xor")


def chains(known: DataFrame, owners: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, turns, first (owned depth; turns + 1: none), up (owner of the prefix above it; null: the root)."""
    search = known.groupBy("conv_id").agg(F.max("depth").alias("turns"))
    search = convs.join(search, "conv_id", "left").select("conv_id", F.coalesce("turns", F.lit(0).cast("long")).alias("turns"))
    search = materialise(search.select("conv_id", "turns", F.lit(1).cast("long").alias("low"), (F.col("turns") + 1).alias("high")), "trie-search")
    longest = search.agg(F.max("turns")).first()[0] or 0
    owner = owners.select("depth", "x", "y", F.col("conv_id").alias("owner"))

    def looked_up(asked: DataFrame) -> DataFrame:
        return asked.join(known.select("conv_id", "depth", "x", "y"), ["conv_id", "depth"]).join(owner, ["depth", "x", "y"]).select("conv_id", "owner")

    for _ in range(int(longest).bit_length()):
        middle = F.expr("(low + high) div 2")
        found = looked_up(search.where("low < high").select("conv_id", middle.alias("depth")))
        mine = F.col("owner") == F.col("conv_id")
        low = F.when(F.col("owner").isNull() | mine, F.col("low")).otherwise(middle + 1)
        high = F.when(mine, middle).otherwise(F.col("high"))
        search = materialise(search.join(found, "conv_id", "left").select("conv_id", "turns", low.alias("low"), high.alias("high")), "trie-search")
    up = looked_up(search.select("conv_id", (F.col("low") - 1).alias("depth")))
    return materialise(search.join(up, "conv_id", "left").select("conv_id", "turns", F.col("low").alias("first"), F.col("owner").alias("up")), "trie-chains")


def summed_up(own: DataFrame, values: list[str]) -> DataFrame:
    """conv_id and ``values`` summed over a chain and all chains below it, from conv_id, up and the chain's own ``values``."""
    sums = materialise(own.select("conv_id", *values), "trie-sums")
    links = materialise(own.where("up IS NOT NULL").select("conv_id", "up"), "trie-links")
    while not links.isEmpty():
        below = links.join(sums, "conv_id").groupBy("up").agg(*(F.sum(c).alias(f"__{c}") for c in values)).withColumnRenamed("up", "conv_id")
        more = [(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in values]
        sums = materialise(sums.join(below, "conv_id", "left").select("conv_id", *more), "trie-sums")
        further = links.select(F.col("conv_id").alias("up"), F.col("up").alias("further"))
        links = materialise(links.join(further, "up").select("conv_id", F.col("further").alias("up")), "trie-links")
    return sums


def _hashed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (conv_id, depth, ids), those of a node one after another, to the sha256 of a node's ids; holds one node's state."""
    node, state = None, None
    for batch in batches:
        out = []
        for conv, depth, ids in zip(batch["conv_id"], batch["depth"], batch["ids"], strict=True):
            if (conv, depth) != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (conv, depth), hashlib.sha256()
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["conv_id", "depth", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])


def end_digests(ends: DataFrame, at_once: int = 1 << 12) -> DataFrame:
    """conv_id, depth, ends_sha256 of each node in which conversations end, from conv_id, depth, ended.

    Ids are sorted and joined in runs of ``at_once`` over many tasks; what a node's hash reads one after another are the runs.
    """
    ids = ends.withColumn("node", F.struct("conv_id", "depth"))
    placed = in_order(ids, "node", ["ended"], "trie-ends").withColumn("run", F.expr(f"(place - 1) div {at_once}"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("ended")), lambda x: x.cast("string")), ",")
    runs = placed.groupBy("conv_id", "depth", "run").agg(text.alias("ids"))
    order = ["conv_id", "depth", "run"]
    return runs.repartition(partitions(ends.sparkSession), "conv_id", "depth").sortWithinPartitions(*order).mapInPandas(_hashed, "conv_id long, depth long, ends_sha256 string")


def trie(said: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    known = materialise(prefixes(said), "trie-prefixes")
    owners = materialise(known.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size")), "trie-owners")
    every = convs.agg(F.min("conv_id").alias("root"), F.count("*").alias("n"))
    root, n_all = every.first()  # two numbers
    if root is None:
        root = -1
    of = chains(known, owners, convs)
    is_root = F.col("conv_id") == root
    own = of.where((F.col("first") <= F.col("turns")) | is_root)
    own = own.select("conv_id", "turns", F.when(is_root, 0).otherwise(F.col("first")).cast("long").alias("first"), F.when(~is_root, F.coalesce("up", F.lit(root))).alias("up"))
    own = materialise(own, "trie-owning")
    # what hangs from a node, and who ends in it
    hung = own.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    ends = of.select(F.when((F.col("first") <= F.col("turns")) | is_root, F.col("conv_id")).otherwise(F.coalesce("up", F.lit(root))).alias("conv_id"), F.col("turns").alias("depth"), F.col("conv_id").alias("ended"))
    top = convs.limit(1).select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(n_all).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("size"))
    nodes = owners.select("conv_id", "depth", "n_convs", "size").unionByName(top).join(hung, ["conv_id", "depth"], "left")
    nodes = nodes.join(own, "conv_id").withColumn("hung", F.coalesce("hung", F.lit(0).cast("long")))
    last = F.col("depth") == F.col("turns")
    nodes = nodes.select(
        "conv_id", "depth", "n_convs", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("up")).alias("parent_conv_id"), (F.col("hung") + F.when(last, 0).otherwise(1)).alias("n_children"),
        (last & (F.col("hung") == 0)).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
    )
    nodes = materialise(nodes, "trie-nodes")
    # sums over chains, then along each chain from its end
    values = ["n_leaves", "saved_tokens"]
    alone = nodes.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in values)).join(own.select("conv_id", "up"), "conv_id")
    below = summed_up(alone, values).join(own.where("up IS NOT NULL").select("conv_id", "up", "first"), "conv_id")
    below = below.groupBy(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(*(F.sum(c).alias(f"__{c}") for c in values))
    nodes = nodes.join(below, ["conv_id", "depth"], "left").select(*(c for c in nodes.columns if c not in values), *((F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in values))
    nodes = running(nodes, "conv_id", "depth", values, backwards=True)
    nodes = nodes.join(end_digests(ends), ["conv_id", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
