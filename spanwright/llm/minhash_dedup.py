"""Near duplicates by bottom-k sketches of one hash function.

1. A document's set of shingle hashes gives its size, a digest, and its ``SKETCH``
   smallest hashes. Documents with equal sets are one node from here on.
2. Inverted lists of retained values. Values that only one node retains cannot
   link; a node most of whose values are its own has no partner. The others enter the lists
   of their ``KEYS`` rarest values, per band of set sizes.
3. Rounds over the lists. Each list elects its most typical node, whose values have the longest lists, as leader (of several,
   the one whose full set agrees most with those of the others), and every node of another component meets it: one pair for an entry, never all pairs of a list. The sketch of the union
   estimates the similarity and what is clearly below the threshold goes. Exact Jaccard on full sets, which are read once,
   confirms each node's likeliest pair; then nodes that are linked with their leader leave the list, and the rest elects the
   next one. After the last round all other pairs whose components still differ are confirmed.
4. After ``ROUNDS`` the nodes of lists that still hold several components meet by their full sets:
   two sets that reach the threshold share one of the rarest shingles of each, at a place that
   leaves enough shingles for the overlap (``_unmet``). Such pairs are confirmed alike, so no link is lost to the leaders.

At similarity 0.85 a pair shares about 34 of 40 retained values; that fewer than the needed ones are
shared has a probability below 1e-5.

Defined results: null, empty and wordless texts have empty sets and link with nothing;
fewer words than a shingle make one shingle of the whole sequence; repeated rows are copies;
rows with a null doc_id take part, and name a component only where no other id is in it;
an empty table gives an empty table; other columns are ignored by ``near_duplicates`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import let, materialise, shingle_hashes
from .graph import components

SKETCH = 64
#: Retained values that are counted, those of them whose lists a node may enter, and lists that it enters. The last
#: values of a node may be beyond the counted ones of its copies, so they seem rarer than they are and make no lists.
RETAINED, LISTED, KEYS = 40, 30, 18
#: Nodes with a smaller share of values that others retain have no partner.
SHARED = 0.55
#: Longest list that needs no consensus on its leader.
SHORT = 8
#: Rounds of leaders, and parts into which a list is dealt.
ROUNDS, SALTS = 2, 32
#: Members of a long list of shingles that one task holds.
BLOCK = 1000
SKETCHES = "doc_id long, tkey long, n_shingles long, node long, sketch array<long>"
SETS = "node long, shingles array<long>"


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ np.uint64(1 << 63)).view(np.int64)  # keeps the order


def _node(hashes: np.ndarray) -> int:
    return (xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)) if len(hashes) else 0


def sketches(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tkey (hash of the text), n_shingles, node (digest of the set) and sketch of each document."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(t, width) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "tkey": batch["tkey"], "n_shingles": [len(s) for s in sets],
                "node": [_node(s) for s in sets], "sketch": [_signed(s[:SKETCH]) for s in sets],
            })

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), F.col(text).alias("text"))
    return rows.mapInPandas(scan, SKETCHES)


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """node, shingles of the nodes in ``wanted`` (node, doc_id, tkey), read again from the texts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(t, width) for t in batch["text"]]
            yield pd.DataFrame({"node": [_node(s) for s in sets], "shingles": [_signed(s) for s in sets]})

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text).alias("tkey"), F.col(text).alias("text"))
    rows = rows.join(wanted.select(F.col("doc_id").alias("j"), "tkey").distinct(), (rows["tkey"] == wanted["tkey"]) & F.col("i").eqNullSafe(F.col("j")), "left_semi")
    return rows.select("text").mapInPandas(scan, SETS).dropDuplicates(["node"])


def _log(count: str) -> Column:
    """A logarithm in thousandths: sums of whole numbers are equal in any order, so that equally typical nodes tie."""
    return F.round(F.log(count) * 1000).cast("long")


def lists(nodes: DataFrame, ratio: float) -> DataFrame:
    """value, band, own, node, typical: the lists that each node enters, and how common its values are."""
    values = nodes.where("n_shingles >= 1").select("node", "n_shingles", F.posexplode(F.slice("sketch", 1, RETAINED)).alias("at", "value"))
    counts = values.groupBy("value").count().where("count > 1")
    looked_at = F.least(F.lit(RETAINED), F.col("n_shingles"))
    listed = F.when(F.col("at") < LISTED, F.struct("count", "value"))
    rare = values.join(counts, "value").groupBy("node", "n_shingles").agg(F.sort_array(F.collect_list(listed)).alias("values"), F.count("*").alias("shared"), F.sum(_log("count")).alias("logs"))
    rare = rare.where(F.col("shared") >= SHARED * looked_at)
    # sets whose sizes are within the ratio are in one band or in neighbouring ones
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / -math.log(ratio) + 1e-9).cast("int")
    rare = rare.select("node", band.alias("own_band"), (F.col("logs") / looked_at).alias("typical"), F.explode(F.slice("values.value", 1, KEYS)).alias("value"))
    bands = F.array(F.struct(F.col("own_band").alias("band"), F.lit(True).alias("own")), F.struct((F.col("own_band") + 1).alias("band"), F.lit(False).alias("own")))
    return rare.select("value", "node", "typical", F.explode(bands).alias("b")).select("value", "b.*", "node", "typical")


def _consensus(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """``entries`` with agreed: how much the full sets of the nodes that are equally typical, in a list that is not short, agree with each other."""
    rows = entries.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    top = rows.groupBy("value", "band").agg(F.count("*").alias("length"), F.max("typical").alias("typical"), F.collect_set("salt").alias("salts")).where(f"length > {SHORT}")
    top = top.select("value", "band", "typical", F.explode("salts").alias("salt"))
    tied = materialise(rows.join(top, ["value", "band", "typical", "salt"], "left_semi").select("node").distinct(), "near-tied")
    each = sets.join(tied, "node").select("node", F.explode("shingles").alias("shingle"))
    agreed = each.join(each.groupBy("shingle").count(), "shingle").groupBy("node").agg(F.sum(_log("count")).alias("agreed"))
    return entries.join(agreed, "node", "left")


def _labelled(rows: DataFrame, labels: DataFrame | None, node: str = "node", label: str = "label") -> DataFrame:
    """``rows`` with the label of ``node``: itself where it has no link yet."""
    if labels is None:
        return rows.withColumn(label, F.col(node))
    return rows.join(labels.select(F.col("node").alias(node), F.col("label").alias(label)), node, "left").withColumn(label, F.coalesce(label, node))


def _meetings(entries: DataFrame) -> DataFrame:
    """The entries (with label) of other components than their list's leader has, with the leader; a list is dealt to ``SALTS`` parts."""
    rows = entries.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    lead = rows.groupBy("value", "band").agg(
        F.max_by(F.struct("node", "own", "label"), F.struct("typical", "agreed", "node")).alias("leader"), F.min("label").alias("low"), F.max("label").alias("high"), F.collect_set("salt").alias("salts")
    )
    lead = lead.where("low < high").select("value", "band", "leader", F.explode("salts").alias("salt"))
    met = rows.join(lead, ["value", "band", "salt"]).where("label <> leader.label")
    return met.select("value", "band", "own", "node", "typical", "agreed", F.col("leader.node").alias("leader"), F.col("leader.own").alias("leads"))


def _estimated(nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb, like (estimate) of the ``pairs`` (a, b) that are not clearly below the threshold."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    shared = let(F.array_intersect("sa", "sb"), lambda x: F.size(F.array_intersect(x, union)) / F.size(union))
    least = percent / 100 - 4.5 * math.sqrt(percent / 100 * (1 - percent / 100) / SKETCH)
    return both.select("a", "b", "na", "nb", shared.alias("like")).where(F.col("like") >= least)


def _confirmed(sets: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``near`` whose full sets reach the threshold."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"f{x}"))
    common = near.join(of("b"), "b").join(of("a"), "a").select("a", "b", "na", "nb", F.size(F.array_intersect("fa", "fb")).alias("common"))
    return common.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")


class _Groups:
    """Confirmed links so far and the components that they make."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int) -> None:
        self.nodes, self.sets, self.percent = nodes, sets, percent
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def near(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs`` (a, b) that may reach the threshold, with ``rank`` among those of b, the likeliest first."""
        near = materialise(_estimated(self.nodes, pairs, self.percent), "near-candidates")
        return near.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("like"), "a")))

    def apart(self, near: DataFrame) -> DataFrame:
        """The pairs of ``near`` that are in different components."""
        return _labelled(_labelled(near, self.labels, "a", "la"), self.labels, "b", "lb").where("la <> lb").drop("la", "lb")

    def add(self, near: DataFrame) -> None:
        """Confirms ``near`` and joins the components of the pairs that hold."""
        new = materialise(_confirmed(self.sets, near, self.percent), "near-links")
        if new.head(1):
            self.links = new if self.links is None else self.links.union(new)
            self.labels = components(self.links)


def _unmet(sets: DataFrame, entries: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """a, b of nodes of different components, both in lists of several components, whose full sets can reach the threshold.

    The shingles of each set are ranked, rarest first. Behind the first one that two sets share, at rank p
    (from 0) in a set of n, their overlap is at most n - p; the overlap they need follows from both sizes. So a set meets others
    only under its first ranks, and the smaller of two sets only under the first ranks that leave it enough for its own size.
    """
    rows = _labelled(entries.select("value", "band", "node"), labels).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    several = rows.groupBy("value", "band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.collect_set("salt").alias("salts")).where("low < high")
    several = several.select("value", "band", F.explode("salts").alias("salt"))
    members = materialise(rows.join(several, ["value", "band", "salt"], "left_semi").select("node", "label").distinct(), "near-members")
    each = sets.join(members, "node").select("node", "label", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    seen = each.groupBy("shingle").agg(F.count("*").alias("count"), F.min("label").alias("low"), F.max("label").alias("high")).where("count > 1")
    ranked = each.join(seen, "shingle").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("count", "shingle", (F.col("low") < F.col("high")).alias("open")))).alias("v"))
    # shingles of no other set come first
    ranked = ranked.select("node", "label", "n", (F.col("n") - F.size("v")).alias("own"), F.posexplode("v").alias("at", "v"))
    ranked = ranked.select("node", "label", "n", (F.col("own") + F.col("at")).alias("p"), "v.shingle", "v.open").where(f"open and 100 * (n - p) >= {percent} * n")
    about = ranked.groupBy("shingle", "label").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.count("*").alias("labels"), F.sum("k").alias("length")).where("labels > 1")
    # a long list is dealt to several tasks
    ranked = ranked.join(about.select("shingle", "most", F.ceil(F.col("length") / BLOCK).alias("salts")), "shingle")
    ranked = materialise(ranked.withColumn("salt", F.pmod(F.xxhash64("node"), "salts")), "near-ranked")
    small = ranked.where(f"(n - p) * {100 + percent} >= {2 * percent} * n")

    def side(rows: DataFrame, x: str, spread: bool) -> DataFrame:
        salt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)) if spread else F.col("salt")
        return rows.select("shingle", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}"), F.col("label").alias(f"l{x}"), salt.alias("salt"))

    able = f"la <> lb and na <= nb and 100 * na >= {percent} * nb and least(na - pa, nb - pb) * {100 + percent} >= {percent} * (na + nb)"
    outside = side(small.where("label <> most"), "a", True).join(side(ranked, "b", False), ["shingle", "salt"]).where(able)
    inside = side(small.where("label = most"), "a", False).join(side(ranked.where("label <> most"), "b", True), ["shingle", "salt"]).where(able)
    return outside.unionByName(inside).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, label (of the document's group), component_id (its smallest doc_id), kept for each row of ``docs``."""
    rows = materialise(sketches(docs, width), "near-sketches")
    found = rows.where("n_shingles > 0").groupBy("node").agg(F.min("n_shingles").alias("n_shingles"), F.min("doc_id").alias("doc_id"), F.min_by("tkey", "doc_id").alias("t"), F.min("tkey").alias("tkey"), F.first("sketch").alias("sketch"))
    nodes = materialise(found.withColumn("tkey", F.coalesce("t", "tkey")).drop("t"), "near-nodes")
    entries = materialise(lists(nodes, percent / 100), "near-lists")
    able = entries.select("node").distinct().join(nodes.select("node", "doc_id", "tkey"), "node")
    groups = _Groups(nodes, materialise(full_sets(docs, able, width), "near-sets"), percent)
    left, late = materialise(_consensus(entries, groups.sets), "near-entries"), None
    for k in range(ROUNDS):
        met = materialise(_meetings(_labelled(left, groups.labels)), "near-met")
        near = groups.near(met.where("own or leads").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
        late = near if late is None else late.union(near)
        if k < ROUNDS - 1:
            groups.add(near.where("rank = 1"))
            left = _labelled(_labelled(met, groups.labels), groups.labels, "leader", "lead").where("label <> lead").drop("label", "lead", "leader", "leads")
    groups.add(groups.apart(late))
    groups.add(groups.near(materialise(_unmet(groups.sets, entries, groups.labels, percent), "near-unmet")))
    labels = groups.labels if groups.labels is not None else nodes.select("node", F.col("node").alias("label")).limit(0)
    rows = rows.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    label = F.when(F.col("n_shingles") > 0, F.coalesce("label", "node"))
    rows = rows.select("doc_id", "n_shingles", label.alias("label"))
    first = materialise(rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("first")), "near-first")
    out = rows.join(first, "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("first")))
    return out.select("doc_id", "n_shingles", "label", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that head their group; of equal rows one; rows without words all stay."""
    label = near_duplicates(docs, percent, width)
    heads = label.where("kept and label is not null").select(F.col("doc_id").alias("__id")).distinct()
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    bare = row.where("not worded").select("row.*")
    full = row.where("worded").join(heads, F.col("id").eqNullSafe(F.col("__id")), "left_semi").select("row.*")
    return full.dropDuplicates().unionByName(bare)
