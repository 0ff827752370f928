"""Titles compared by their matching blocks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.operators.ranking import rank_within


def longest_block(a: str, b: str, at: dict[str, list[int]], ends: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """Start in a, start in b and length of the longest common block within ends; of equal ones the first in a, then in b. at: places of b's characters."""
    lo_a, hi_a, lo_b, hi_b = ends
    best, runs = (lo_a, lo_b, 0), {}
    for i in range(lo_a, hi_a):
        grown = {}
        for j in at.get(a[i], ()):
            if lo_b <= j < hi_b:
                grown[j] = n = runs.get(j - 1, 0) + 1
                if n > best[2]:
                    best = i - n + 1, j - n + 1, n
        runs = grown
    return best


def block_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks over all: the longest common block, then the same to its left and to its right."""
    if not a and not b:
        return 1.0
    at: dict[str, list[int]] = {}
    for j, ch in enumerate(b):
        at.setdefault(ch, []).append(j)
    if len(b) >= 200:  # the known ratio takes no account of frequent characters in long texts
        at = {ch: js for ch, js in at.items() if len(js) <= len(b) // 100 + 1}
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        i, j, n = longest_block(a, b, at, (lo_a, hi_a, lo_b, hi_b))
        while i > lo_a and j > lo_b and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < hi_a and j + n < hi_b and a[i + n] == b[j + n]:
            n += 1
        if n:
            total += n
            todo += [(lo_a, i, lo_b, j), (i + n, hi_a, j + n, hi_b)]
    return 2.0 * total / (len(a) + len(b))


def block_ratios(pairs: pd.Series, others: pd.Series, least: float) -> pd.Series:
    """block_ratio of each pair, or null where the characters that two titles share, in any order, already give less than `least`."""
    known: dict[tuple[str, str], float | None] = {}
    for a, b in zip(pairs, others, strict=True):
        if (a, b) not in known:
            shared = sum((Counter(a) & Counter(b)).values())
            found = block_ratio(a, b) if 2 * shared >= least * (len(a) + len(b)) else None
            known[a, b] = found if found is not None and found >= least else None
    return pd.Series([known[p] for p in zip(pairs, others, strict=True)], dtype="float64")


def best_titles(left: DataFrame, right: DataFrame, block: str, least: float) -> DataFrame:
    """id, other, ratio: of each left row (id, name) the right row (other, oname) of its block with the highest matching-block ratio, `least` or more, then the smallest key.

    Ratios are taken once for each pair of distinct titles of a block, and only where lengths and
    shared characters, which bound the ratio from above, allow it.
    """
    sizes = F.length("name") + F.length("oname")
    names = left.select(block, "name").distinct().join(right.select(block, "oname").distinct(), block)
    names = names.where(2 * F.least(F.length("name"), F.length("oname")) >= least * sizes).select("name", "oname").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(ratio=block_ratios(f["name"], f["oname"], least)).dropna()

    rated = names.mapInPandas(run, "name string, oname string, ratio double")
    firsts = right.groupBy(block, "oname").agg(F.min("other").alias("other"))
    found = left.select(block, "id", "name").join(rated, "name").join(firsts, [block, "oname"])
    return found.withColumn("__k", rank_within("id", F.desc("ratio"), F.asc("other"))).where("__k = 1").select("id", "other", "ratio")
