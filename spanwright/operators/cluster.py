"""Families of failures by the text of their evidence."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, cluster_terms, mask_numbers
from ..keeping import keep


def evidence_text(failures: DataFrame) -> DataFrame:
    """trace_id, taxonomy_id, text: the stage, then each key once with its value, numbers masked."""
    free = F.col("e.key").isin("query", "output", "context")
    rows = failures.select("trace_id", "taxonomy_id", "stage", F.posexplode("evidence").alias("i", "e"))
    part = F.concat_ws("=", "e.key", F.when(free, F.lit("<text>")).otherwise(clip(mask_numbers(F.col("e.value")), 60)))
    one = rows.withColumn("part", part).groupBy("trace_id", "taxonomy_id", "stage", F.col("e.key").alias("key")).agg(F.min_by("part", "i").alias("part"), F.min("i").alias("i"))
    texts = one.groupBy("trace_id", "taxonomy_id", "stage").agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("p"))
    return texts.select("trace_id", "taxonomy_id", F.concat_ws(" ", F.concat(F.lit("stage="), F.col("stage")), F.col("p.part")).alias("text"))


#: Texts of one task, and bytes of a table of terms that every task may hold.
TEXTS, HELD = 4096, 128_000_000


def term_counts(texts: DataFrame, id_col: str, text: str, n_texts: int = 0) -> DataFrame:
    """id, term, tf. The texts are shuffled by id, once, and not a row for each of their terms; what goes by id next needs no shuffle."""
    number = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_texts // TEXTS)
    own = texts.select(*dict.fromkeys((id_col, text))).repartition(number, id_col)
    return own.select(id_col, F.explode(cluster_terms(F.col(text))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame, n_texts: int, min_df: int = 1, copies: str | None = None) -> DataFrame:
    """term, df, idf (smoothed); ``copies``: the column that says how often a text occurs."""
    df = counts.groupBy("term").agg((F.sum(copies) if copies else F.count("*")).alias("df")).where(F.col("df") >= min_df)
    return df.withColumn("idf", F.log((1.0 + n_texts) / (1 + F.col("df"))) + 1)


def tfidf(texts: DataFrame, id_col: str = "trace_id", text: str = "text", min_df: int = 1, copies: str | None = None) -> DataFrame:
    """id, term, weight; the weights of a text have norm 1. ``copies``: a column of ``texts``, where a row stands for so many equal texts."""
    n_texts = texts.count()
    counts = own = term_counts(texts, id_col, text, n_texts)
    if copies:
        own, n_texts = counts.join(texts.select(id_col, copies), id_col), texts.agg(F.sum(copies)).head()[0] or 0
    terms = keep(document_frequency(own, n_texts, min_df, copies), "term-frequency")
    # the rows stay where their texts are, unless there are too many terms to hold; terms of one text have one idf and are not held
    once = F.lit(math.log((1.0 + n_texts) / 2) + 1) if min_df <= 1 and not copies else F.lit(None)
    some = terms.where("df > 1") if min_df <= 1 and not copies else terms
    held = some.agg(F.sum(F.octet_length("term") + 64)).head()[0] or 0
    rows = counts.join(F.broadcast(some), "term", "left") if held <= HELD else counts.join(terms.hint("merge"), "term")
    rows = rows.withColumn("idf", F.coalesce("idf", once)).where("idf is not null").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return rows.select(id_col, "term", (F.col("w") / norm).alias("weight"))


def _close(vectors: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """a, b (a < b), sim of the clusters whose mean cosine similarity is ``least`` or more, from c, term, w (sums of unit vectors) and c, n.

    The mean similarity of two clusters is the product of their mean vectors. A pair that close has a term in common among those of
    ``a`` that remain when its most frequent terms, up to a norm of ``least``, are left out; only these terms are joined, so that terms which all
    clusters share pair nothing.
    """
    means = vectors.join(sizes, "c").select("c", "term", (F.col("w") / F.col("n")).alias("m"))
    spread = means.groupBy("term").agg(F.count("*").alias("df"))
    frequent_first = Window.partitionBy("c").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    rare = means.join(spread, "term").withColumn("norm", F.sqrt(F.sum(F.col("m") * F.col("m")).over(frequent_first))).where(F.col("norm") >= least - 1e-9)
    there = means.select("term", F.col("c").alias("b"))
    found = rare.select("term", F.col("c").alias("a")).join(there, "term").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = means.select(F.col("c").alias("a"), "term", F.col("m").alias("x"))
    right = means.select(F.col("c").alias("b"), "term", F.col("m").alias("y"))
    sims = found.join(left, "a").join(right, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("sim"))
    return sims.withColumn("sim", F.round("sim", 12)).where(F.col("sim") >= least)  # so that equal sums in another order tie


def average_linkage(points: DataFrame, weights: DataFrame, cut: float = 0.62) -> DataFrame:
    """text, c: clusters of ``points`` (text, n), merged while the least mean distance stays within ``cut``; c is a cluster's smallest text.

    Clusters that are each other's nearest merge in rounds, which for average linkage gives what merging one pair after the
    other gives; ties go to the smaller texts. ``weights`` (text, term, weight) have norm 1.
    """
    member = keep(points.select("text", F.col("text").alias("c")), "linkage-members")
    sizes = keep(points.select(F.col("text").alias("c"), "n"), "linkage-sizes")
    vectors = keep(weights.join(points, "text").select(F.col("text").alias("c"), "term", (F.col("weight") * F.col("n")).alias("w")), "linkage-vectors")
    while True:
        close = keep(_close(vectors, sizes, 1 - cut), "linkage-pairs")
        if close.isEmpty():
            return member
        order = F.struct(-F.col("sim"), F.col("a"), F.col("b"))
        each = close.select("a", "b", "sim", F.explode(F.array("a", "b")).alias("own")).groupBy("own").agg(F.min_by(F.struct("a", "b"), order).alias("best"))
        merged = each.groupBy("best").agg(F.count("*").alias("sides")).where("sides = 2").select(F.col("best.b").alias("c"), F.col("best.a").alias("to"))
        merged = keep(merged, "linkage-merged")
        moved = lambda df: df.join(merged, "c", "left").withColumn("c", F.coalesce("to", "c")).drop("to")  # noqa: E731, B023
        member = keep(moved(member), "linkage-members")
        sizes = keep(moved(sizes).groupBy("c").agg(F.sum("n").alias("n")), "linkage-sizes")
        vectors = keep(moved(vectors).groupBy("c", "term").agg(F.sum("w").alias("w")), "linkage-vectors")


def kmeans(points: DataFrame, weights: DataFrame, k: int, seed: int = 7, rounds: int = 50) -> DataFrame:
    """text, cluster: ``points`` (text, n) in ``k`` parts by seeded k-means over all their terms; equal texts count ``n`` times.

    A part that runs empty begins again with a point drawn anew. ``k`` centres of as many terms as there are, at most, are all that is shared.
    """
    drawn = lambda turn: F.xxhash64(F.lit(seed), F.lit(turn), "text")
    first = points.select("text", drawn(0).alias("at")).orderBy("at", "text").limit(k)
    rows = keep(weights.join(points, "text"), "kmeans-points")
    norms = keep(rows.select("text").distinct(), "kmeans-texts")
    centres = keep(first.withColumn("cluster", F.row_number().over(Window.orderBy("at", "text")) - 1).join(rows, "text").select("cluster", "term", F.col("weight").alias("m")), "kmeans-centres")  # k rows are numbered
    assigned = None
    for turn in range(1, rounds + 1):
        # |x - c|^2 = 1 - 2 xc + |c|^2 for unit x
        size = centres.groupBy("cluster").agg(F.sum(F.col("m") * F.col("m")).alias("cc"))
        dots = rows.join(centres, "term").groupBy("text", "cluster").agg(F.sum(F.col("weight") * F.col("m")).alias("xc"))
        far = norms.crossJoin(F.broadcast(size)).join(dots, ["text", "cluster"], "left")  # k clusters for each text
        distance = F.round(F.col("cc") - 2 * F.coalesce("xc", F.lit(0.0)), 12)
        new = keep(far.groupBy("text").agg(F.min_by("cluster", F.struct(distance, F.col("cluster"))).alias("cluster")), "kmeans-assigned")
        if assigned is not None and new.join(assigned, ["text", "cluster"], "left_anti").isEmpty():
            break
        assigned = new
        held = rows.join(new, "text")
        sizes = new.join(points, "text").groupBy("cluster").agg(F.sum("n").alias("size"))
        means = held.groupBy("cluster", "term").agg(F.sum(F.col("weight") * F.col("n")).alias("s")).join(sizes, "cluster").select("cluster", "term", (F.col("s") / F.col("size")).alias("m"))
        empty = sorted(set(range(k)) - {r["cluster"] for r in sizes.select("cluster").collect()})  # at most k
        again = points.select("text", drawn(turn).alias("at")).orderBy("at", "text").limit(len(empty)).withColumn("i", F.row_number().over(Window.orderBy("at", "text")) - 1)
        if empty:
            restart = again.select("text", F.array(*map(F.lit, empty))[F.col("i")].alias("cluster")).join(rows, "text").select("cluster", "term", F.col("weight").alias("m"))
            means = means.unionByName(restart)
        centres = keep(means, "kmeans-centres")
    return new


def families(failures: DataFrame, cut: float = 0.62, max_clusters: int = 10, seed: int = 7) -> DataFrame:
    """trace_id, taxonomy_id, cluster. Equal texts are one point with its multiplicity.

    By average linkage; where that leaves more than ``max_clusters`` clusters, k-means parts the texts instead. No failures have no clusters.
    """
    texts = keep(evidence_text(failures), "family-texts")
    points = keep(texts.groupBy("text").agg(F.count("*").alias("n")), "family-points")
    weights = keep(tfidf(points, "text", "text", copies="n"), "family-weights")
    linked = average_linkage(points, weights, cut)
    names = linked.select("c").distinct().orderBy("c").limit(max_clusters + 1)
    if names.count() > max_clusters:
        found = kmeans(points, weights, max_clusters, seed)
    else:
        found = linked.join(names.withColumn("cluster", F.row_number().over(Window.orderBy("c")) - 1), "c").select("text", "cluster")  # at most ``max_clusters`` rows are numbered
    return texts.join(found, "text").select("trace_id", "taxonomy_id", "cluster")


def cards(members: DataFrame, min_size: int = 2) -> DataFrame:
    """cluster, size, share, dominant class, purity; largest first by number."""
    counts = members.groupBy("cluster", "taxonomy_id").agg(F.count("*").alias("n"))
    out = counts.groupBy("cluster").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.min_by("taxonomy_id", F.struct(-F.col("n"), F.col("taxonomy_id"))).alias("dominant"))
    out = out.withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy(F.lit(0)))).withColumn("purity", F.col("most") / F.col("size"))  # a row for each cluster
    return out.where(F.col("size") >= min_size).drop("most")


def family_cards(failures: DataFrame, members: DataFrame, min_size: int = 2, n_terms: int = 5, shown: int = 12) -> DataFrame:
    """cluster, size, share, dominant, purity, terms, representative, members of each cluster of ``members`` (``families``).

    Clusters are numbered from 0, largest first. terms: those of the highest mean weight, ties by term; members: the
    first ``shown`` trace ids; representative: the first. Clusters below ``min_size`` have no card, but count in the shares.
    """
    texts = evidence_text(failures).join(members.select("trace_id", "taxonomy_id", "cluster"), ["trace_id", "taxonomy_id"])
    points = texts.groupBy("cluster", "text").agg(F.count("*").alias("n"))
    weights = tfidf(points.groupBy("text").agg(F.sum("n").alias("n")), "text", "text", copies="n").join(points, "text")
    mean = weights.groupBy("cluster", "term").agg(F.round(F.sum(F.col("weight") * F.col("n")), 9).alias("w"))
    best = mean.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("w"), "term"))).where(F.col("k") <= n_terms)
    terms = best.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "term")))["term"].alias("terms"))
    # only the first ids of each partition are shuffled
    first = members.select("cluster", "trace_id").withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("trace_id"))).where(F.col("k") <= shown)
    ids = first.groupBy("cluster").agg(F.array_sort(F.collect_list("trace_id")).alias("members"))
    rows = cards(members, min_size).join(terms, "cluster", "left").join(ids, "cluster")
    number = F.row_number().over(Window.orderBy(F.desc("size"), "cluster")) - 1  # a row for each cluster
    return rows.select(
        number.alias("cluster"), "size", F.round("share", 4).alias("share"), "dominant", F.round("purity", 4).alias("purity"),
        F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.col("members")[0].alias("representative"), "members",
    ).orderBy("cluster")


def label_distances(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, n, mean cosine similarity of its pairs of unit vectors; from sums of vectors, without pairs."""
    long = vectors.select(label, F.posexplode(vector).alias("i", "x")).select(label, "i", F.col("x").cast("double").alias("x"))
    sums = long.groupBy(label, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    out = sums.groupBy(label).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"), F.max("n").alias("n"))
    return out.select(label, "n", ((F.col("ss") - F.col("q")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))).alias("mean_cosine"))


def pair_distances(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """One row: mean cosine distance of the pairs of unit vectors within labels (intra) and between labels (inter); from sums, without pairs."""
    long = vectors.select(label, F.posexplode(vector).alias("i", "x")).select(label, "i", F.col("x").cast("double").alias("x"))
    sums = long.groupBy(label, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    places = sums.groupBy("i").agg((F.sum("s") * F.sum("s")).alias("all"), F.sum(F.col("s") * F.col("s")).alias("own"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    out = places.agg(F.sum("all").alias("all"), F.sum("own").alias("own"), F.sum("q").alias("q"), F.max("n").alias("n"), F.max("nn").alias("nn"))
    part = lambda total, pairs: F.coalesce(1 - total / F.nullif(pairs, F.lit(0)), F.lit(0.0))
    return out.select(part(F.col("own") - F.col("q"), F.col("nn") - F.col("n")).alias("intra"), part(F.col("all") - F.col("own"), F.col("n") * F.col("n") - F.col("nn")).alias("inter"))
