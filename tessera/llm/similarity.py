"""Exact components of similar sets, from band keys.

Sets that share a band key are candidates. Testing all pairs of a bucket would
cost its square, so each bucket has a leader, the member that meets most
others, and members are tested against it. That settles a bucket whose members
all fall into one component. In the buckets left over, all pairs are compared,
but neither as rows nor in one task: members are dealt into blocks, a task
takes two blocks and counts all intersections by matrix products, and only
links that join components leave it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import cut, light

BLOCK = 256


def hashed_sets(column) -> list[np.ndarray]:
    """Sets that are sent as their sorted distinct hashes."""
    return [np.frombuffer(x.as_py(), np.uint64) for x in column]


def _similar(common, x, y, num: int, den: int):
    return den * common >= num * (x + y - common)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _verified(num: int, den: int, sets):
    def verified(batches):
        for batch in batches:
            # a node's set is made once, in however many pairs it is
            nodes, first, which = np.unique(np.concatenate([batch["a"].to_numpy(), batch["b"].to_numpy()]), return_index=True, return_inverse=True)
            column = pa.concat_arrays([batch["a_items"], batch["b_items"]])
            made = sets(column.take(pa.array(first)))
            size = np.array([len(x) for x in made], np.int64)
            i, j = which[: batch.num_rows], which[batch.num_rows :]
            ok = _similar(np.minimum(size[i], size[j]), size[i], size[j], num, den)
            for k in np.flatnonzero(ok):
                ok[k] = _similar(_common(made[i[k]], made[j[k]]), size[i[k]], size[j[k]], num, den)
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    return verified


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int, decode=hashed_sets) -> DataFrame:
    """Those of pairs (a, b) whose sets (node, items) have a similarity of num / den or more."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("a_items"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("b_items"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "a_items", "b_items").mapInArrow(light(_verified(num, den, decode)), "a long, b long")


def _whole(batches):
    """Rows in order of band, i and j, in tables that don't cut a group of these, and where each group begins."""

    def begins(rows: pa.Table) -> np.ndarray:
        new = np.append(True, np.zeros(rows.num_rows - 1, bool))
        for c in ("band", "i", "j"):
            x = rows[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if rows.num_rows:
            at = begins(rows)
            if len(at) > 1:
                yield rows.slice(0, at[-1]), at
            held = rows.slice(at[-1])
    if held is not None:
        yield held, np.array([0, held.num_rows])


#: Bits of a set's map, and sets that are mapped at once.
_BITS, _MAPPED = 1024, 2048


def _maps(items: list[np.ndarray]) -> np.ndarray:
    """A map of bits for each set, one for each of its elements; elements may share bits."""
    out = []
    for a in range(0, len(items), _MAPPED):
        part = items[a : a + _MAPPED]
        bits = np.zeros((len(part), _BITS), bool)
        owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
        bits[owner, (np.concatenate(part) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)] = True
        out.append(np.packbits(bits, axis=1).view(np.uint64))
    return np.concatenate(out)


def _products(items: list[np.ndarray], size: np.ndarray, l: np.ndarray, r: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the sets l are similar to which of the sets r."""
    flat, member = np.concatenate(items), np.repeat(np.arange(len(items)), size)
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    column, member = number[at[keep]], member[keep]
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    left, right = np.zeros(len(items), bool), np.zeros(len(items), bool)
    left[l], right[r] = True, True
    place_l, place_r = np.full(len(items), -1), np.full(len(items), -1)
    place_l[l], place_r[r] = np.arange(len(l)), np.arange(len(r))
    common, total, wide = np.zeros((len(l), len(r))), int(shared.sum()), 2048
    for c in range(0, total, wide):  # a slice of the shared elements at a time
        lo, hi = np.searchsorted(column, [c, c + wide])
        m, k = member[lo:hi], column[lo:hi] - c
        x, y = np.zeros((len(l), wide), np.float32), np.zeros((len(r), wide), np.float32)
        x[place_l[m[left[m]]], k[left[m]]] = 1
        y[place_r[m[right[m]]], k[right[m]]] = 1
        common += x @ y.T
    return _similar(np.rint(common), size[l][:, None], size[r][None, :], num, den)


def _forest(num: int, den: int, sets):
    """Links between components among the members of two blocks.

    What a set's map has besides another's is a bound of what they share, so
    most pairs need no look at the sets.
    """

    def links(rows: pa.Table, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, own = rows["node"].to_numpy(), rows["root"].to_numpy()
        left, right = rows["block"].to_numpy() == rows["i"].to_numpy(), rows["block"].to_numpy() == rows["j"].to_numpy()
        # a node's set is made once, in however many groups it is
        _, first, which = np.unique(node, return_index=True, return_inverse=True)
        items = sets(rows["items"].take(pa.array(first)))
        size = np.array([len(x) for x in items], np.int64)
        maps = _maps(items)
        filled = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)

        def may(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            meet = (left[p] & right[q]) | (right[p] & left[q])
            meet &= own[p] != own[q]
            p, q = p[meet], q[meet]
            x, y = which[p], which[q]
            meet = _similar(np.minimum(size[x], size[y]), size[x], size[y], num, den)
            p, q, x, y = p[meet], q[meet], x[meet], y[meet]
            both = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64)
            most = np.minimum(size[x] - filled[x], size[y] - filled[y]) + both
            meet = _similar(most, size[x], size[y], num, den)
            return p[meet], q[meet]

        roots, parent, out = own.tolist(), {}, []

        def top(v):
            while parent.get(v, v) != v:
                parent[v] = parent.get(parent[v], parent[v])
                v = parent[v]
            return v

        def look(p: np.ndarray, q: np.ndarray, sure: bool) -> None:
            for a, b in zip(p.tolist(), q.tolist()):
                x, y = top(roots[a]), top(roots[b])
                if x != y:
                    a, b = which[a], which[b]
                    if sure or _similar(_common(items[a], items[b]), size[a], size[b], num, den):
                        parent[max(x, y)] = min(x, y)
                        out.append((a, b))

        begin, many = at[:-1], np.diff(at)
        for g in np.unique(many[many > 1]).tolist():
            i, j = np.triu_indices(g, 1)
            of = begin[many == g]
            for a in range(0, len(of), step := max(1, (1 << 15) // len(i))):
                k = of[a : a + step, None]
                p, q = may((k + i).ravel(), (k + j).ravel())
                if step > 1 or len(p) <= 4 * g:
                    look(p, q, False)
                else:  # products pay
                    own_rows = np.arange(k[0, 0], k[0, 0] + g)
                    l, r = np.flatnonzero(left[own_rows]), np.flatnonzero(right[own_rows])
                    close = _products([items[x] for x in which[own_rows]], size[which[own_rows]], l, r, num, den)
                    p, q = np.nonzero(close)
                    look(own_rows[l[p]], own_rows[r[q]], True)
        names = node[first]
        return names[[a for a, _ in out]], names[[b for _, b in out]]

    def forest(batches):
        for rows, at in _whole(batches):
            a, b = links(rows, np.append(at[at < rows.num_rows], rows.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return forest


def similar_components(bands: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, screen: Callable[[DataFrame], DataFrame] | None = None, decode=hashed_sets) -> tuple[DataFrame, DataFrame]:
    """bands: band and node, both long, each pair once; where it has columns size,
    x and y, one row of each band holds the number of its nodes and 128 bits that
    other nodes wouldn't have, and all bands have several nodes. sets_of: from distinct
    nodes to their sets (node, items: binary, which ``decode`` makes sorted
    distinct 64-bit hashes of). screen: may drop pairs (a, b) before they are
    verified.

    Returns the components (node, root) of all nodes linked with others, and
    the links found (a, b), which join each component.
    """
    if "x" in bands.columns:  # of buckets with the same members one is enough
        size = bands.filter("x IS NOT NULL").groupBy("x", "y", "size").agg(F.min("band").alias("band")).select("band", "size")
    else:
        size = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    met = cut(bands.select("band", "node").join(size, "band"))
    weight = met.groupBy("node").agg(F.sum("size").alias("weight"))
    # buckets with the same members are one
    ranked = met.join(weight, "node")
    seal = [F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 40))).alias("y"), F.max(F.struct("weight", "node")).alias("lead"), F.max("size").alias("size")]
    buckets = ranked.groupBy("band").agg(*seal).groupBy("x", "y", "size").agg(F.min("band").alias("band"), F.min(F.col("lead")["node"]).alias("leader"))
    members = cut(met.drop("size").join(buckets.select("band", "leader", "size"), "band"))
    pairs = members.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    sets = cut(sets_of(members.select("node").distinct()))
    links = cut(verify(screen(pairs) if screen else pairs, sets, num, den, decode))
    roots = components(links)
    placed = members.filter("size > 2 AND node != leader").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    # nothing is left to find among the members of a bucket's largest component
    per = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = per.groupBy("band").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all")).filter("all > main.n")
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    few = F.col("all") <= BLOCK  # one task takes them all
    odd, even = parts(F.col("all") - F.col("main")["n"]), parts(F.col("main")["n"])
    mixed = mixed.select("band", F.col("main")["root"].alias("main"), F.when(few, 1).otherwise(odd).alias("odd"), F.when(few, 0).otherwise(even).alias("even"))
    dealt = placed.join(mixed, "band").withColumn("is_odd", (F.col("root") != F.col("main")) | (F.col("even") == 0))
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("is_odd"), F.col("odd")).otherwise(F.col("even"))).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("is_odd"), own).otherwise(F.col("odd") + own))
    meets = F.col("odd") + F.when(F.col("is_odd"), F.col("even")).otherwise(0) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), meets)))
    dealt = dealt.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root").join(sets, "node")
    dealt = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    rest = cut(dealt.mapInArrow(light(_forest(num, den, decode)), "a long, b long"))
    if rest.isEmpty():
        return roots, links
    stars = roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(stars.union(rest)), links.union(rest)
