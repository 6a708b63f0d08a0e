"""Low similarities within a time cell: all classes of a block compared with all of another by one product of matrices.

The columns are hashed words: as no entry is negative, words that share a column can only raise the product, so it bounds the
cosine from above and no pair is lost. For thresholds under which sketches would let through most pairs of a cell anyway; the
work grows with the square of the classes in a time cell, dealt into many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400_000_000
#: Columns of a product and classes of a block.
WIDTH, BLOCK = 2048, 2048
_ENTRY = np.dtype([("column", "<u2"), ("weight", "<f4")])


@F.pandas_udf(T.BinaryType())
def vector(hashes: pd.Series, counts: pd.Series) -> pd.Series:
    """Hashed words with their weights in the vector of length one."""
    out = []
    for h, c in zip(hashes, counts):
        c = np.asarray(c, dtype=np.float64)
        v = np.empty(len(c), dtype=_ENTRY)
        v["column"], v["weight"] = np.asarray(h, dtype=np.int64) & 0xFFFF, c / np.sqrt((c * c).sum())
        out.append(v.tobytes())
    return pd.Series(out)


def _dense(vectors: pd.Series, width: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(vectors), dtype=_ENTRY)
    row = np.repeat(np.arange(len(vectors)), [len(v) // _ENTRY.itemsize for v in vectors])
    return np.bincount(row * width + flat["column"] % width, weights=flat["weight"], minlength=len(vectors) * width).astype(np.float32).reshape(-1, width)


def _compare(width: int, least: float, slope: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Pairs of two blocks, or of one with itself, whose bound reaches least + slope x days between them."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        first, second = g[~g["second"]], g[g["second"]]
        alone = g["step"].iloc[0] == 0 and g["i"].iloc[0] == g["j"].iloc[0]
        if alone:
            second = first
        found = []
        if len(first) and len(second):
            x = _dense(first["vector"], width)
            y = x if alone else _dense(second["vector"], width)
            (ca, la, ha), (cb, lb, hb) = ((d["cls"].to_numpy(), d["lo"].to_numpy(), d["hi"].to_numpy()) for d in (first, second))
            for s in range(0, len(x), 256):
                bound = x[s : s + 256] @ y.T
                a, b = np.nonzero(bound >= least - 1e-4)  # single precision
                days = np.maximum(0, np.maximum(lb[b] - ha[a + s], la[a + s] - hb[b])) / DAY
                ok = (bound[a, b] >= least + slope * days - 1e-4) & ((ca[a + s] < cb[b]) if alone else (ca[a + s] != cb[b]))
                found.append(np.stack([ca[a + s][ok], cb[b][ok]]))
        p = np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)
        return pd.DataFrame({"a": p.min(axis=0), "b": p.max(axis=0)})

    return run


def block_pairs(at: DataFrame, least: float, slope: float) -> DataFrame:
    """(a, b), a < b: classes of `at` (cls, cell, lo, hi, vector) in one cell or neighbouring ones that may reach the bound.

    A cell is dealt into blocks by its number of classes, so that a hot one is many tasks.
    """
    n = at.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    n = n.join(n.select((F.col("cell") - 1).alias("cell"), F.col("n").alias("after")), "cell", "left")
    n = n.join(n.select((F.col("cell") + 1).alias("cell"), F.col("n").alias("before")), "cell", "left").fillna(0)
    own = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("n"))

    def each(count: str, make: Callable) -> F.Column:
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(count) - 1), make)).otherwise(F.array().cast("array<struct<cell:bigint,i:bigint,step:int,j:bigint,second:boolean>>"))

    def task(cell, i, step, j, second):
        return F.struct(cell.alias("cell"), i.alias("i"), F.lit(step).alias("step"), j.alias("j"), second.alias("second"))

    me, cell = F.col("own"), F.col("cell")
    tasks = F.concat(
        each("n", lambda j: task(cell, F.least(me, j), 0, F.greatest(me, j), j < me)),
        each("after", lambda j: task(cell, me, 1, j, F.lit(False))),
        each("before", lambda j: task(cell - 1, j, 1, me, F.lit(True))),
    )
    dealt = at.join(n, "cell").withColumn("own", own).select("cls", "lo", "hi", "vector", F.explode(tasks).alias("x")).select("cls", "lo", "hi", "vector", "x.*")
    return dealt.groupBy("cell", "i", "step", "j").applyInPandas(_compare(WIDTH, least, slope), "a long, b long").distinct()
