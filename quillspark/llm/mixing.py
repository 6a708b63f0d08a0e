"""Problem 9: mixing sources to target weights, by the cube method of balanced sampling.

Every document of a source starts with the same expected number of copies. Its whole part is given; its
fractional part is an inclusion probability. The flight phase moves the probabilities of three documents
at a time along the null space of the two balancing constraints (the source's tokens and documents stay what they
are) until one of them is 0 or 1, block by block; what blocks leave undecided, two documents at most, flies again
in larger company. Landing decides the last two documents of each source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.session import materialise

BLOCK = 5000
_EPS = 1e-9


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inclusion probabilities after the flight: at most two lie strictly between 0 and 1; sums of pi and pi x size are kept."""
    p, t = pi.astype(float).tolist(), size.astype(float).tolist()
    draws = rng.random(len(p)).tolist()
    active: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = float(round(p[i]))
            continue
        active.append(i)
        while len(active) == 3 or (len(active) == 2 and t[active[0]] == t[active[1]]):
            if len(active) == 3:
                a, b, c = active
                u = (t[b] - t[c], t[c] - t[a], t[a] - t[b])
                if u == (0.0, 0.0, 0.0):
                    u = (1.0, -1.0, 0.0)
            else:
                u = (1.0, -1.0)
            up = min(((1 - p[k]) / x if x > 0 else -p[k] / x) for k, x in zip(active, u) if x)
            down = min((p[k] / x if x > 0 else (p[k] - 1) / x) for k, x in zip(active, u) if x)
            step = up if draws[i] * (up + down) < down else -down
            draws[i] = (draws[i] * 7919.0) % 1.0
            for k, x in zip(active, u):
                p[k] += step * x
            left = [k for k in active if _EPS < p[k] < 1 - _EPS]
            for k in active:
                if k not in left:
                    p[k] = float(round(p[k]))
            active = left
    return np.array(p)


def land(units: pd.DataFrame, room: float) -> pd.DataFrame:
    """Decide the undecided units (source, doc_id, size, pi), two at most per source, so that their tokens stay within room.

    Per source the choice nearest to its expected tokens is taken; while the total is above room, the source that loses
    least by its next smaller choice gives way.
    """
    options = []
    for _, g in units.groupby("source", dropna=False, sort=True):
        ids, size, want = g["doc_id"].tolist(), g["size"].tolist(), float((g["pi"] * g["size"]).sum())
        sets = [[k for k in range(len(ids)) if m >> k & 1] for m in range(1 << len(ids))]
        ways = sorted((sum(size[k] for k in s), [ids[k] for k in s]) for s in sets)
        best = min(range(len(ways)), key=lambda w: abs(ways[w][0] - want))
        options.append([ways, best, want])
    while sum(w[b][0] for w, b, _ in options) > room + _EPS:
        able = [o for o in options if o[1] > 0]
        if not able:
            break
        o = min(able, key=lambda o: abs(o[0][o[1] - 1][0] - o[2]) - abs(o[0][o[1]][0] - o[2]))
        o[1] -= 1
    chosen = {i for ways, b, _ in options for i in ways[b][1]}
    return pd.DataFrame({"doc_id": units["doc_id"], "pi": units["doc_id"].isin(chosen).astype(float)})


def plan_quotas(docs: DataFrame, targets: DataFrame, total: int, keep_shares: bool = False) -> DataFrame:
    """Per target source: tokens and documents at hand, its quota of tokens (what max_repeats uses of all its documents can give, at most), and copies per document.

    A source that can't fill its share leaves the mixture short and the shares of the others high. With keep_shares the whole mixture shrinks
    to what the scarcest source that has documents can fill its share of.
    """
    have = docs.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("documents"))
    q = targets.join(have, "source", "left").fillna(0, ["tokens", "documents"])
    most = F.lit(float(total))
    if keep_shares:
        scarce = q.filter("tokens > 0 and target_share > 0").agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("most"))  # one row
        q = q.crossJoin(F.broadcast(scarce))
        most = F.least(most, F.coalesce("most", most))
    quota = F.least(F.col("target_share") * most, (F.col("max_repeats") * F.col("tokens")).cast("double"))
    return q.select("source", "target_share", "max_repeats", "tokens", "documents", quota.alias("quota"), F.when(F.col("tokens") > 0, quota / F.col("tokens")).otherwise(0.0).alias("copies"))


def draw(docs: DataFrame, targets: DataFrame, total: int, seed: int = 42, keep_shares: bool = False) -> DataFrame:
    """(doc_id, source, size, expected, copies) for every document of a target source.

    docs: (doc_id BIGINT unique, source STRING, size BIGINT); targets: (source STRING unique, target_share, max_repeats).
    No document is used more than max_repeats times and the tokens of all copies stay within total. Documents without
    tokens or outside the target sources are in no mixture and give no row; a target without documents contributes
    nothing, which the reached shares show. Equal inputs and seeds give equal draws. A source with a third of all
    rows flies in many blocks.
    """
    docs = materialise(docs.filter("doc_id is not null and size > 0").select("doc_id", "source", "size"), "p9-docs")
    plan = materialise(plan_quotas(docs, targets, total, keep_shares), "p9-plan")
    units = docs.join(F.broadcast(plan.select("source", "copies")), "source")  # one row per row of mix_targets, a fixed table
    units = units.withColumns({"base": F.floor("copies"), "pi": F.col("copies") - F.floor("copies")})
    units = materialise(units, "p9-units")

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order", kind="stable")
        rng = np.random.default_rng([seed, len(pdf), int(pdf["doc_id"].min()) & 0x7FFFFFFF])
        return pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "size": pdf["size"], "pi": flight(pdf["pi"].to_numpy(), pdf["size"].to_numpy(), rng)})

    undecided, decided = units.filter(f"pi > {_EPS}").select("doc_id", "source", "size", "pi"), None
    level = 0
    n = undecided.count()
    while n:
        # several blocks per source, so that none is larger than BLOCK by much, whatever share of the rows a source has
        blocks = max(1, -(-n // BLOCK))
        dealt = undecided.withColumns({"block": F.pmod(F.xxhash64("doc_id", F.lit(seed + level)), F.lit(blocks)), "order": F.xxhash64("doc_id", F.lit(seed - 1 - level))})
        flown = materialise(dealt.groupBy("source", "block").applyInPandas(fly, "doc_id long, source string, size long, pi double"), f"p9-flight{level}")
        done = flown.filter("pi = 0 or pi = 1").select("doc_id", "pi")
        decided = done if decided is None else decided.unionByName(done)
        undecided = flown.filter("pi > 0 and pi < 1")
        n, level = undecided.count(), level + 1
        if blocks == 1:
            break
    out = units.select("doc_id", "source", "size", "copies", "base")
    if decided is None:
        return out.select("doc_id", "source", "size", F.col("copies").alias("expected"), F.col("base").cast("int").alias("copies"))
    if n:
        fixed = units.join(decided.filter("pi = 1"), "doc_id", "left_semi").agg(F.sum("size")).first()[0] or 0
        base = units.agg(F.sum(F.col("base") * F.col("size"))).first()[0] or 0
        room = float(total - fixed - base)
        landed = undecided.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: land(pdf.sort_values(["source", "doc_id"]), room), "doc_id long, pi double")
        decided = decided.unionByName(landed)
    out = out.join(decided.filter("pi = 1").select("doc_id", F.lit(1).alias("drawn")), "doc_id", "left")
    copies = (F.col("base") + F.coalesce("drawn", F.lit(0))).cast("int")
    return out.select("doc_id", "source", "size", F.col("copies").alias("expected"), copies.alias("copies"))


def reached_shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target share, reached share of all tokens, tokens, documents and the greatest number of uses."""
    per = drawn.filter("copies > 0").groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("mixture_tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_uses"))
    all_ = per.agg(F.sum("mixture_tokens").alias("all_tokens"))
    out = targets.join(per, "source", "left").fillna(0, ["mixture_tokens", "n_documents", "most_uses"]).crossJoin(F.broadcast(all_))
    return out.select("source", "target_share", F.coalesce(F.col("mixture_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"), "mixture_tokens", "n_documents", "most_uses")
