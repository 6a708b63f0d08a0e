"""Problem 5: near-duplicate records judged by word counts and time.

Equal word counts are folded into classes. A class gets SetSketch registers of its words, each with the square of its count as
weight: if two texts have the same counts in what they share, whatever these are, their cosine fixes the weighted Jaccard
similarity from below. Bands of registers, together with a time cell where time bounds the pairs, are the join keys.
Candidates are estimated jointly by likelihood from their registers; those that may reach the threshold get the exact score.

The score is cosine_weight x cosine + date_weight x max(0, 1 - days / window).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.llm.blocks import block_pairs, vector
from quillspark.llm.sketch import joint_jaccard, registers
from quillspark.plans.components import connected_components
from quillspark.plans.session import materialise

DAY = 86_400_000_000
REGISTERS, BAND = 256, 4
#: A pair of similarity J shares no band with (1 - J^4)^64: 0.01 at 0.51, 0.0002 at 0.6, 1e-8 at 0.7. Cosines of LEAST_SKETCHED and more have
#: J = 0.51 at least, if common words have equal counts; lower ones are sought by blocks (see blocks.py).
LEAST_SKETCHED = 0.7
#: Deviation of an estimate, how many of them a candidate may lie below, and how far common words may differ in their counts.
DEVIATION, SLACK, COUNTS_APART = 0.5 / REGISTERS**0.5, 4, 1.5


@F.pandas_udf(T.BinaryType())
def _sketch(hashes: pd.Series, weights: pd.Series) -> pd.Series:
    return pd.Series([r.tobytes() for r in registers(list(hashes), list(weights), REGISTERS)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bands(regs: pd.Series) -> pd.Series:
    n = REGISTERS // BAND
    r = np.frombuffer(b"".join(regs), dtype=np.uint16).reshape(len(regs), n, BAND).astype(np.uint64)
    h = np.tile(np.arange(1, n + 1, dtype=np.uint64), (len(r), 1))
    for k in range(BAND):
        h = (h ^ r[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return pd.Series(list((h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)))


@F.pandas_udf(T.DoubleType())
def _estimate(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    """The greatest cosine that the registers of two classes leave likely, if common words have equal counts."""
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(len(s), REGISTERS) for s in (a, b))
    na, nb = na.to_numpy(dtype=float), nb.to_numpy(dtype=float)
    j = np.minimum(1, joint_jaccard(x, y, na, nb) + SLACK * DEVIATION)
    return pd.Series(j / (1 + j) * (na + nb) / np.sqrt(na * nb))


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: same, id, t) and (classes: same, entries, norm2); `same` is 16 bytes that equal entries share."""
    entries = F.sort_array(F.filter(F.map_entries("tokens"), lambda e: e["value"] > 0))
    r = rows.select("id", "t", entries.alias("entries")).filter(F.size("entries") > 0)
    r = r.withColumn("same", F.unhex(F.md5(F.to_json("entries").cast("binary"))))
    squares = F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["value"].cast("double") * e["value"])
    return r.select("same", "id", "t"), r.groupBy("same").agg(F.first("entries").alias("entries")).withColumn("norm2", squares)


def _sketch_pairs(classes: DataFrame, at: DataFrame | None, least: float) -> DataFrame:
    """(a, b), a < b: classes (cls, regs, norm2) that share a band and may have the cosine `least`; with `at` (cls, cell) only classes
    of one cell or neighbouring ones. A class that many share a band with is only split, not left out."""
    keys = classes.select("cls", F.explode(_bands("regs")).alias("band"))
    if at is None:
        found = keys.select("band", F.col("cls").alias("a")).join(keys.select("band", F.col("cls").alias("b")).hint("merge"), "band").filter("a < b").select("a", "b").distinct()
    else:
        keyed = keys.join(at, "cls")
        two = F.explode(F.array(F.struct(F.col("cell").alias("cell"), F.lit(True).alias("same")), F.struct((F.col("cell") - 1).alias("cell"), F.lit(False).alias("same"))))
        right = keyed.select("band", F.col("cls").alias("b"), two.alias("x")).select(F.xxhash64("band", "x.cell").alias("k"), "x.same", "b")
        found = keyed.select(F.xxhash64("band", "cell").alias("k"), F.col("cls").alias("a")).join(right.hint("merge"), "k")
        # pairs of one cell come once, in order; pairs of neighbouring cells in either order
        found = found.filter("a <> b and (not same or a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    regs = classes.select("cls", "regs", "norm2").hint("merge")
    est = found.join(regs.withColumnsRenamed({"cls": "a", "regs": "ra", "norm2": "na"}), "a").join(regs.withColumnsRenamed({"cls": "b", "regs": "rb", "norm2": "nb"}), "b")
    return est.filter(_estimate("ra", "rb", "na", "nb") * COUNTS_APART >= least).select("a", "b")


class Score:
    """The score's parameters and what follows from them."""

    def __init__(self, threshold: float, cosine_weight: float, window_days: float):
        self.threshold, self.cosine_weight, self.window = threshold, cosine_weight, window_days
        self.date_weight = 1 - cosine_weight
        if threshold <= self.date_weight:
            raise ValueError("the threshold must be above the date weight: else time alone makes pairs, and cosine doesn't bound them")
        self.any_time = cosine_weight >= threshold  # the cosine part alone may reach the threshold
        self.reach = int(window_days * min(1.0, 1 - (threshold - cosine_weight) / self.date_weight) * DAY) + 1
        self.least_cosine = (threshold - self.date_weight) / cosine_weight

    def alone(self, cosine: Column) -> Column:
        return cosine * self.cosine_weight >= self.threshold - 1e-9

    def micros(self, cosine: Column) -> Column:
        """How far apart in time two rows of that cosine may be."""
        return self.window * (1 - (self.threshold - 1e-9 - cosine * self.cosine_weight) / self.date_weight) * DAY

    def of(self, cosine: Column, micros_apart: Column) -> Column:
        by_date = F.greatest(F.lit(0.0), 1 - micros_apart / DAY / self.window)  # without a time: 0
        return cosine * self.cosine_weight + self.date_weight * by_date


def linked_classes(rows: DataFrame, score: Score) -> tuple[DataFrame, DataFrame]:
    """(members: cls, id, t, cell) and (links: a, b, cosine): all classes whose members may reach the threshold; a class of several rows is linked with itself.

    rows: (id STRING, t BIGINT micros, tokens MAP<STRING,INT>). Rows with null or empty tokens are in no class.
    """
    valid = rows.filter("id is not null and tokens is not null")
    members, classes = _classes(valid if score.any_time else valid.filter("t is not null"))
    hashes, counts = F.transform("entries", lambda e: F.xxhash64(e["key"])), F.transform("entries", lambda e: e["value"].cast("double"))
    far = score.any_time or score.least_cosine >= LEAST_SKETCHED
    near = score.least_cosine < LEAST_SKETCHED
    classes = classes.withColumns(({"regs": _sketch(hashes, F.transform(counts, lambda c: c * c))} if far else {}) | ({"vector": vector(hashes, counts)} if near else {}))
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "p5-classes")
    members = members.join(classes.select("same", "cls").hint("merge"), "same").drop("same")
    members = materialise(members.withColumn("cell", F.expr(f"t div {score.reach} - if(t < 0, 1, 0)")), "p5-members")
    found = []
    if near:
        at = members.filter("t is not null").groupBy("cls", "cell").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).join(classes.select("cls", "vector").hint("merge"), "cls")
        found.append(block_pairs(at, score.least_cosine, score.date_weight / score.window / score.cosine_weight))
    if far:
        at = None if score.any_time else members.select("cls", "cell").distinct()
        found.append(_sketch_pairs(classes, at, score.threshold / score.cosine_weight if score.any_time else score.least_cosine))
    pairs = found[0] if len(found) == 1 else found[0].unionByName(found[1]).distinct()
    words = classes.select("cls", F.map_from_entries("entries").alias("w"), "norm2").hint("merge")
    exact = materialise(pairs, "p5-found").join(words.withColumnsRenamed({"cls": "a", "w": "wa", "norm2": "xa"}), "a").join(words.withColumnsRenamed({"cls": "b", "w": "wb", "norm2": "xb"}), "b")
    dot = F.aggregate(F.map_entries("wa"), F.lit(0.0), lambda s, e: s + e["value"].cast("double") * F.coalesce(F.col("wb")[e["key"]], F.lit(0)))
    exact = exact.select("a", "b", (dot / F.sqrt(F.col("xa") * F.col("xb"))).alias("cosine")).filter(F.col("cosine") >= score.least_cosine - 1e-9)
    copies = members.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("cosine"))
    return members, materialise(exact.unionByName(copies), "p5-links")


def near_pairs(rows: DataFrame, threshold: float = 0.8, cosine_weight: float = 0.7, window_days: float = 7.0) -> DataFrame:
    """(memo_a, memo_b, cosine, score): all pairs of `rows` (id STRING, t BIGINT micros, tokens MAP<STRING,INT>) at or above threshold.

    Rows with null or empty tokens are in no pair. A pair with a row without time scores by its cosine alone.
    ids must be unique. Equal rows pair with score 1. An empty table gives no pairs.
    """
    score = Score(threshold, cosine_weight, window_days)
    members, linked = linked_classes(rows, score)
    alone = score.alone(F.col("cosine"))
    one = members.select(F.col("cls").alias("a"), F.col("id").alias("ia"), F.col("t").alias("ta"), "cell")
    two = members.select(F.col("cls").alias("b"), F.col("id").alias("ib"), F.col("t").alias("tb"), "cell")
    around = one.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    out = linked.filter(~alone).join(around, "a").join(two.hint("merge"), ["b", "cell"]).drop("cell")
    if score.any_time:
        out = out.unionByName(linked.filter(alone).join(one.drop("cell"), "a").join(two.drop("cell").hint("merge"), "b"))
    out = out.filter("ia <> ib and (a <> b or ia < ib)")
    out = out.select(F.least("ia", "ib").alias("memo_a"), F.greatest("ia", "ib").alias("memo_b"), "cosine", score.of(F.col("cosine"), F.abs(F.col("ta") - F.col("tb"))).alias("score"))
    return out.filter(F.col("score") >= threshold - 1e-9)


def groups(rows: DataFrame, threshold: float = 0.8, cosine_weight: float = 0.7, window_days: float = 7.0) -> DataFrame:
    """(id, group_id, n_links, n_copies): the groups that pairs at or above threshold make, without expanding copies into pairs.

    A knot is a class within one time cell: its members are all linked, since a cell is as wide as equal rows may be apart.
    Two knots are linked if some members of theirs are near enough. That follows from their first and last times, or, where these
    overlap too loosely to tell, from the closest neighbours in their merged order. group_id is the smallest id of the
    group, n_links counts the knots of other texts a row's knot is linked with, n_copies the equal rows in its knot. Rows in no pair
    are groups of their own. The threshold must lie above cosine_weight, so that time bounds the pairs.
    """
    score = Score(threshold, cosine_weight, window_days)
    if score.any_time:
        raise ValueError("the threshold must be above the cosine weight")
    members, links = linked_classes(rows, score)
    knots = materialise(members.groupBy("cls", "cell").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.min("id").alias("knot"), F.count("*").alias("n")), "p5-knots")
    order = Window.partitionBy("cls").orderBy("cell")  # over cells, not rows
    chain = knots.select("knot", F.lag("knot").over(order).alias("other"), (F.col("lo") - F.lag("hi").over(order)).alias("gap")).filter(F.col("gap") <= score.micros(F.lit(1.0))).select("knot", "other")
    one = knots.select(F.col("cls").alias("a"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"), F.col("cell").alias("ca"), F.col("lo").alias("la"), F.col("hi").alias("ha"), F.col("knot").alias("ka"))
    two = knots.select(F.col("cls").alias("b"), "cell", F.col("lo").alias("lb"), F.col("hi").alias("hb"), F.col("knot").alias("kb"))
    met = links.filter("a <> b").join(one, "a").join(two.hint("merge"), ["b", "cell"]).withColumn("most", score.micros(F.col("cosine")))
    gap = F.greatest(F.col("lb") - F.col("ha"), F.col("la") - F.col("hb"))
    half = F.greatest(F.col("ha") - F.col("la"), F.col("hb") - F.col("lb")) / 2  # an end of one lies within the other
    met = materialise(met.withColumn("state", F.when(gap > F.col("most"), 0).when((gap >= 0) | (half <= F.col("most")), 1).otherwise(2)).filter("state > 0"), "p5-met")
    open_ = met.filter("state = 2").select("ka", "kb", "most", F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("ca").alias("cell"), F.lit(True).alias("first")), F.struct(F.col("b").alias("cls"), F.col("cell").alias("cell"), F.lit(False).alias("first")))).alias("x"))
    merged = open_.select("ka", "kb", "most", "x.*").join(members.select("cls", "cell", "t").hint("merge"), ["cls", "cell"])
    w = Window.partitionBy("ka", "kb").orderBy("t", "first")
    near = merged.withColumns({"was": F.lag("first").over(w), "apart": F.col("t") - F.lag("t").over(w)}).filter("was <> first and apart <= most").select("ka", "kb").distinct()
    cross = met.filter("state = 1").select("ka", "kb").unionByName(near)
    edges = materialise(cross.select(F.col("ka").alias("knot"), F.col("kb").alias("other"), F.lit(1).alias("n")).unionByName(chain.withColumn("n", F.lit(0))), "p5-edges")
    cc = connected_components(edges, "knot", "other").withColumnRenamed("node", "knot")
    n_links = edges.filter("n = 1").select(F.explode(F.array("knot", "other")).alias("knot")).groupBy("knot").agg(F.count("*").alias("n_links"))
    of_knot = knots.join(cc, "knot", "left").join(n_links, "knot", "left").select("cls", "cell", F.coalesce("component", "knot").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    mine = members.join(of_knot, ["cls", "cell"]).select("id", "group_id", "n_links", "n_copies")
    r = rows.select("id").filter("id is not null").distinct().join(mine.hint("merge"), "id", "left")
    return r.select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))


def settle_events(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, event, canonical, seeded, demoted) of rows (id, event, authority, t, flagged) by their clusters (id, cluster_id).

    A cluster's event is the one that its founder names, else one made from the founder's id, with which members without an event are
    seeded. Canonical is the member of the lowest authority, then the earliest t (null last), then the smallest id; a flagged member that
    isn't canonical is demoted. Rows alone in their cluster stay as they are, flagged or not.
    """
    m = clusters.select("id", "cluster_id").join(rows.select("id", "event", "authority", "t", "flagged"), "id")
    rank = F.struct("authority", F.coalesce("t", F.lit(2**62)).alias("t"), "id")
    heads = m.groupBy("cluster_id").agg(F.min(rank)["id"].alias("best"), F.max(F.when(F.col("id") == F.col("cluster_id"), F.col("event"))).alias("named"), F.count("*").alias("n"))
    made = F.coalesce("named", F.concat(F.lit("evt-"), F.substring(F.sha2("cluster_id", 256), 1, 16)))
    j = m.join(heads.hint("merge"), "cluster_id")
    alone, canonical = F.col("n") == 1, F.col("id") == F.col("best")
    return j.select(
        "id", F.when(alone, F.col("event")).otherwise(F.coalesce("event", made)).alias("event"), F.when(alone, F.coalesce("flagged", F.lit(False))).otherwise(canonical).alias("canonical"),
        (~alone & F.col("event").isNull()).alias("seeded"), (~alone & F.coalesce("flagged", F.lit(False)) & ~canonical).alias("demoted"),
    )


def best_match_clusters(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Incremental clusters: each arriving row joins the cluster of its single best match among the rows before it, or founds one.

    pairs: (memo_a, memo_b, score); rows: (id, t), arriving in order of t, then id; rows without time arrive first. Ties go to
    the smaller id. A row's best match doesn't depend on the clusters, so all rows choose at once and clusters are the
    trees of these choices: a row that could bridge two clusters joins one of them, unlike in connected components.
    Gives (id, cluster_id, n_members), cluster_id being the founder's id.
    """
    r = rows.filter("id is not null").groupBy("id").agg(F.min(F.struct(F.coalesce("t", F.lit(-(2**62))).alias("t"), "id")).alias("ord"))
    both = pairs.select(F.col("memo_a").alias("id"), F.col("memo_b").alias("other"), "score").unionByName(pairs.select(F.col("memo_b").alias("id"), F.col("memo_a").alias("other"), "score"))
    seen = both.join(r, "id").join(r.select(F.col("id").alias("other"), F.col("ord").alias("other_ord")), "other").filter("other_ord < ord")
    chosen = seen.groupBy("id").agg(F.min_by("other", F.struct(-F.col("score"), "other")).alias("other"))
    cc = connected_components(materialise(chosen, "st1-chosen"), "id", "other")
    m = r.join(cc.withColumnRenamed("node", "id"), "id", "left").withColumn("tree", F.coalesce("component", "id"))
    heads = m.groupBy("tree").agg(F.min("ord").alias("head"), F.count("*").alias("n_members"))
    return m.join(heads, "tree").select("id", F.col("head.id").alias("cluster_id"), "n_members")
