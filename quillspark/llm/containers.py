"""Problem 8: filling fixed-capacity containers, by conflict-constrained best fit.

Items are dealt to shards of a bounded number of items. In a shard, from the largest item down, bins are kept
in the order of their residual capacity, each with bitmaps of the sources and of the duplicate clusters it holds.
The successor search starts at the least residual that takes the item and goes on until a compatible bin is
found. Bins left poorly filled are emptied and their items packed once more together.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.splitting import split_pieces
from quillspark.llm.tokens import TOKENIZER, token_count
from quillspark.plans.session import materialise

SHARD_ITEMS = 4000
GOOD_FILL = 0.97


def best_fit(sizes: Iterable[int], sources: Iterable[str], clusters: Iterable[int], capacity: int, apart: dict[str, set[str]] | None = None) -> list[int]:
    """The bin of each item. No bin exceeds capacity, holds two items of one cluster, or two sources that must stay apart."""
    sizes, sources, clusters = list(sizes), list(sources), list(clusters)
    apart = apart or {}
    source_bit = {s: 1 << k for k, s in enumerate(sorted({str(x) for x in sources} | set(apart) | {y for v in apart.values() for y in v}))}
    against = {s: 0 for s in source_bit}
    for s, others in apart.items():
        for o in others:
            against[s] |= source_bit[o]
            against[o] |= source_bit[s]
    # only clusters with several items here can clash: they get a bit, the others none
    seen: dict[int, int] = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in seen.items() if n > 1)}
    bins: list[list[int]] = []  # [source bitmap, cluster bitmap]
    by_residual: list[tuple[int, int]] = []
    out = [-1] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, s, c = sizes[i], str(sources[i]), cluster_bit.get(clusters[i], 0)
        k = bisect_left(by_residual, (size, -1))
        while k < len(by_residual):
            held = bins[by_residual[k][1]]
            if not held[0] & against[s] and not held[1] & c:
                break
            k += 1
        if k < len(by_residual):
            residual, b = by_residual.pop(k)
        else:
            residual, b = capacity, len(bins)
            bins.append([0, 0])
        bins[b][0] |= source_bit[s]
        bins[b][1] |= c
        out[i] = b
        if residual > size:
            insort(by_residual, (residual - size, b))
    return out


def _pack_shards(items: DataFrame, capacity: int, apart: dict[str, set[str]] | None, round_no: int) -> DataFrame:
    n = items.count()
    shards = max(1, -(-n // SHARD_ITEMS))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", "part", F.lit(round_no)), F.lit(shards)).cast("long"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "part"], kind="stable")
        b = pd.Series(best_fit(pdf["size"], pdf["source"], pdf["cluster"], capacity, apart), index=pdf.index)
        ids = (pdf["shard"] * (1 << 24) + b) * 2 + round_no
        return pd.DataFrame({"container_id": ids, "item": pdf["item"], "part": pdf["part"], "size": pdf["size"], "source": pdf["source"], "cluster": pdf["cluster"], "filled": pdf["size"].groupby(b).transform("sum")})

    return dealt.groupBy("shard").applyInPandas(pack, "container_id long, item long, part int, size long, source string, cluster long, filled long")


def fill_containers(items: DataFrame, capacity: int, apart: dict[str, set[str]] | None = None) -> DataFrame:
    """(container_id, item, part, size, filled) of items (item BIGINT, part INT, size BIGINT <= capacity, source STRING, cluster BIGINT).

    Items of size 0 or null take no room and are in no container. Items of one duplicate cluster never share a container,
    nor do sources named in `apart`. Null sources count as one source, null clusters as no cluster. Equal sizes are
    placed in the order of (item, part). An empty table gives no container.
    """
    clean = items.filter("size > 0").select("item", "part", "size", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("cluster", F.xxhash64("item", "part", F.lit("alone"))).alias("cluster"))
    first = materialise(_pack_shards(materialise(clean, "p8-items"), capacity, apart, 0), "p8-first")
    good = first.filter(F.col("filled") >= GOOD_FILL * capacity)
    tail = first.filter(F.col("filled") < GOOD_FILL * capacity).select("item", "part", "size", "source", "cluster")
    return good.unionByName(_pack_shards(tail, capacity, apart, 1)).select("container_id", "item", "part", "size", "filled")


def document_items(docs: DataFrame, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """Items of documents (doc_id, text, source): whole texts as part 0, those above the capacity as parts from 1.

    Texts equal but for case, spacing and punctuation form a duplicate cluster.
    """
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")
    source = F.lower(F.trim("source"))
    sized = docs.filter("text is not null").select("doc_id", source.alias("source"), F.xxhash64(plain).alias("cluster"), token_count(F.col("text"), tokenizer).alias("size"))
    sized = materialise(sized, "p8-sizes")
    fits = sized.filter(F.col("size") <= capacity).select(F.col("doc_id").alias("item"), F.lit(0).alias("part"), "size", "source", "cluster")
    large = docs.join(sized.filter(F.col("size") > capacity).select("doc_id"), "doc_id", "left_semi")
    parts = split_pieces(large, "doc_id", "text", capacity, 0, tokenizer).drop("piece")
    parts = parts.join(sized.select("doc_id", "source", "cluster"), "doc_id")
    return fits.unionByName(parts.select(F.col("doc_id").alias("item"), F.col("piece_no").alias("part"), "size", "source", F.xxhash64("cluster", "piece_no").alias("cluster")))
