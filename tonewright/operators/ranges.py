"""Readable ranges: runs of equal signatures, merged until few are left."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a reader is shown.
MOST = 12


def signature_runs(states: DataFrame, track: str = "track", order: str = "segment", start: str = "start_s", end: str = "end_s", signature: str = "signature") -> DataFrame:
    """(track, run, start, end, signature, first, n): maximal runs of states with one signature; `first` is the place of the first state, from 0."""
    w = Window.partitionBy(track).orderBy(order)
    new = F.when(F.lag(signature).over(w).eqNullSafe(F.col(signature)), 0).otherwise(1)
    df = states.withColumns({"_place": F.row_number().over(w) - 1, "_new": new}).withColumn("run", F.sum("_new").over(w))
    return df.groupBy(track, "run").agg(F.min_by(start, "_place").alias("start"), F.max_by(end, "_place").alias("end"), F.first(signature).alias("signature"), F.min("_place").alias("first"), F.count("*").alias("n"))


def merge_shortest(starts: list, ends: list, most: int) -> list[list[int]]:
    """Which ranges, in order of time, end up together: [first, last, the one whose signature stays].

    While more than `most` are left, the shortest (the earliest of equals) goes into its shorter neighbour (the one before, of
    equals), whose signature stays. A heap holds every range once for each length that it had; neighbours are links.
    """
    n = len(starts)
    start, end, keeps = list(starts), list(ends), list(range(n))
    before, after, length = list(range(-1, n - 1)), list(range(1, n + 1)), [b - a for a, b in zip(starts, ends, strict=True)]
    heap = [(x, i) for i, x in enumerate(length)]
    heapq.heapify(heap)
    gone, left = [False] * n, n
    while left > most and left > 1:
        x, i = heapq.heappop(heap)
        if gone[i] or x != length[i]:
            continue
        a, b = before[i], after[i]
        target = b if a < 0 else a if b >= n else a if length[a] <= length[b] else b
        first, second = min(i, target), max(i, target)
        keeps[first] = keeps[target]
        start[first], end[first] = min(start[i], start[target]), max(end[i], end[target])
        gone[second] = True
        after[first] = after[second]
        if after[second] < n:
            before[after[second]] = first
        length[first] = end[first] - start[first]
        heapq.heappush(heap, (length[first], first))
        left -= 1
    return [[i, after[i] - 1, keeps[i]] for i in range(n) if not gone[i]]


def readable_ranges(runs: DataFrame, track: str = "track", most: int = MOST) -> DataFrame:
    """(track, part, start, end, signature, middle, n): signature_runs() merged until `most` are left; `middle` is the place of the middle state.

    Which range goes next hangs on all merges before it, so a track is one group, of its runs and not its states.
    Runs come in the order of their starts, which do not repeat; n runs take n log n steps.
    """
    kinds = dict(runs.dtypes)
    schema = f"{track} {kinds[track]}, part int, start {kinds['start']}, end {kinds['end']}, signature string, middle long, n long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", ignore_index=True)
        starts, ends = pdf["start"].tolist(), pdf["end"].tolist()
        parts = merge_shortest(starts, ends, most)
        n = [int(pdf["n"].iloc[a : b + 1].sum()) for a, b, _ in parts]
        first = [int(pdf["first"].iloc[a]) for a, _, _ in parts]
        return pd.DataFrame(
            {
                track: pdf[track].iloc[0], "part": range(len(parts)),
                "start": [min(starts[a : b + 1]) for a, b, _ in parts], "end": [max(ends[a : b + 1]) for a, b, _ in parts],
                "signature": [pdf["signature"].iloc[k] for *_, k in parts], "middle": [f + c // 2 for f, c in zip(first, n, strict=True)], "n": n,
            }
        )

    return runs.groupBy(track).applyInPandas(one, schema)


def merged_sql(source: str, most: int = MOST) -> str:
    """readable_ranges() as CTEs mg, one row a track whose list g holds its ranges, and mr, its rows; `source` has track, start, end, signature, first and n."""
    size = "list_transform(g, lambda x: x.e - x.s)"
    joined = "{'s': least(g[a].s, g[a + 1].s), 'e': greatest(g[a].e, g[a + 1].e), 'sig': g[CASE WHEN a = i THEN i + 1 ELSE a END].sig, 'f': g[a].f, 'n': g[a].n + g[a + 1].n}"
    return f"""mg AS (SELECT track, list({{'s': start, 'e': "end", 'sig': signature, 'f': first, 'n': n}} ORDER BY first) AS g FROM {source} GROUP BY track
      UNION ALL SELECT track, g[:a - 1] || [{joined}] || g[a + 2:] FROM (SELECT *, CASE WHEN i = 1 THEN 1 WHEN i = len(g) THEN i - 1 WHEN g[i - 1].e - g[i - 1].s <= g[i + 1].e - g[i + 1].s THEN i - 1 ELSE i END AS a
        FROM (SELECT track, g, list_position({size}, list_min({size})) AS i FROM mg WHERE len(g) > {most}))),
    mr AS (SELECT track, unnest(g) AS r, CAST(generate_subscripts(g, 1) - 1 AS INTEGER) AS part FROM mg WHERE len(g) <= {most})"""
