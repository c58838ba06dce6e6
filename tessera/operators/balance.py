"""Dealing rows out to workers by load.

Partitioning one batch is a sequential choice over its items, so it runs as a
grouped Arrow function: one task for each batch, all batches side by side.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def workload(length: Column) -> Column:
    """Cost of a sequence: linear and quadratic parts of a transformer's work."""
    n = length.cast("long")
    return n * 24576 + n * n


def largest_differencing(loads: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Places of loads in k parts, by repeatedly joining the two states whose parts differ most.

    A state is k parts with their sums; joining puts the heaviest part of one
    with the lightest of the other. With equal_size a state starts from k items
    and all parts have as many. Parts are compared by sum, number of items and
    items in the order in which they came; of states that differ alike, the one
    with the larger heaviest part comes first. Parts come out heaviest first.
    """
    if equal_size and len(loads) % k:
        raise ValueError(f"{len(loads)} items don't make {k} parts of one size")
    order = sorted(range(len(loads)), key=lambda i: (loads[i], i))

    def state(parts):
        parts = sorted(parts, reverse=True)
        top = parts[0]
        return (parts[-1][0] - top[0], -top[0], -top[1], tuple(-i for i in top[2])), parts

    step = k if equal_size else 1
    heap = [state([(loads[i], 1, (i,)) for i in order[a : a + step]] + [(0, 0, ())] * (k - step)) for a in range(0, len(order), step)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        heapq.heappush(heap, state([(x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x, y in zip(a, reversed(b))]))
    return [sorted(p[2]) for p in heap[0][1]] if heap else [[] for _ in range(k)]


def greedy(loads: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Each item in turn to the lightest part, the first of equal ones; with equal_size every item carries a bias that evens sizes out."""
    bias = sum(loads) + 1 if equal_size else 0
    lightest, parts = [(0, j) for j in range(k)], [[] for _ in range(k)]
    for i, load in enumerate(loads):
        total, j = lightest[0]
        heapq.heapreplace(lightest, (total + load + bias, j))
        parts[j].append(i)
    return parts


METHODS = {"differencing": largest_differencing, "greedy": greedy}


def deal(df: DataFrame, batch: str, row: str, load: str, k: int, equal_size: bool = False, method: str = "differencing") -> DataFrame:
    """(batch, row, part): each batch's rows, ordered by row, in k parts. A batch is what one task can hold."""
    choose = METHODS[method]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row, ignore_index=True)
        part = [0] * len(pdf)
        for p, items in enumerate(choose([int(x) for x in pdf[load]], k, equal_size)):
            for i in items:
                part[i] = p
        return pd.DataFrame({batch: pdf[batch], row: pdf[row], "part": part})

    types = dict(df.dtypes)
    return df.select(batch, row, load).groupBy(batch).applyInPandas(one, f"{batch} {types[batch]}, {row} {types[row]}, part int")


def micro_batch_count(total: int, most: int, groups: int, multiple: int = 1) -> int:
    """How many parts keep each under a token budget, rounded up to a multiple."""
    k = min(groups, max(1, math.ceil(total / most)))
    return math.ceil(k / multiple) * multiple


def ends_small(df: DataFrame, batch: str, row: str, part: str = "part", load: str = "load") -> DataFrame:
    """(batch, part, turn): parts by falling load, of equal ones the one whose first row comes later, every other one, the rest behind them in rising order, so that small ones come first and last."""
    sums = df.groupBy(batch, part).agg(F.sum(load).alias("_sum"), F.min(row).alias("_first"))
    w = W.partitionBy(batch)
    ranked = sums.withColumn("_r", F.row_number().over(w.orderBy(F.col("_sum").desc(), F.col("_first").desc())) - 1).withColumn("_n", F.count("*").over(w))
    evens = F.floor((F.col("_n") + 1) / 2)
    turn = F.when(F.col("_r") % 2 == 0, evens - 1 - F.floor(F.col("_r") / 2)).otherwise(evens + F.floor(F.col("_r") / 2))
    return ranked.select(batch, part, F.col("_sum").alias(load), turn.cast("int").alias("turn"))


def part_stats(df: DataFrame, part: str, load: str, k: int) -> DataFrame:
    """One row: smallest and largest sum of a part, their difference, and the mean over k parts."""
    sums = df.groupBy(part).agg(F.sum(load).alias("s"))
    return sums.agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("diff"), (F.sum("s") / k).alias("mean"))


def inverse(permutation: DataFrame, ord_: str = "ord", idx: str = "idx") -> DataFrame:
    """The permutation that undoes one."""
    return permutation.select(F.col(idx).alias(ord_), F.col(ord_).alias(idx))


def deal_groups(df: DataFrame, batch: str, group: str, load: str, k: int, method: str = "differencing") -> DataFrame:
    """(batch, group, part): whole groups dealt out by their summed load."""
    sums = df.groupBy(batch, group).agg(F.sum(load).alias(load))
    return deal(sums, batch, group, load, k, False, method)
