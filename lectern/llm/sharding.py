"""Sharding: Karmarkar-Karp differencing over indivisible groups.

A group is all rows of one text. Groups are hashed to tasks; every task differences
its groups into ``n_shards`` sets, always merging the two partial partitions of
largest spread, the one's large sets with the other's small ones. The tasks'
partitions (``n_shards`` sums each) are themselves such partial partitions and are
differenced again, ``fan`` at a time, until one is left. So the work is spread
however many groups there are, and what moves is one small row for each group.

A group heavier than a shard's share stays whole and that shard is as much heavier.
Null texts form one group of size 1 each row; empty texts another. Rows are kept
one by one, repeated rows too. Ties of weight follow the groups' digests, slots those of
doc_id the text's CRC; a null doc_id comes first. Very long texts are groups like others,
and only their digest and size move. An empty table gives an empty result. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def difference(nodes: Sequence[Sequence[int]]) -> list[list[int]]:
    """Karmarkar-Karp over partial partitions (k sums each): for every node, the set
    of the result that each of its k parts joins."""
    k = len(nodes[0])
    heap, order = [], []
    for i, sums in enumerate(nodes):
        perm = sorted(range(k), key=sums.__getitem__, reverse=True)
        order.append(perm)
        ranked = [sums[p] for p in perm]
        heap.append((ranked[-1] - ranked[0], i, ranked))
    heapq.heapify(heap)
    merges = []
    fresh = len(nodes)
    while len(heap) > 1:
        _, a, large = heapq.heappop(heap)
        _, b, small = heapq.heappop(heap)
        sums = [x + y for x, y in zip(large, reversed(small), strict=True)]
        perm = sorted(range(k), key=sums.__getitem__, reverse=True)
        ranked = [sums[p] for p in perm]
        merges.append((a, b, perm))
        heapq.heappush(heap, (ranked[-1] - ranked[0], fresh, ranked))
        fresh += 1
    place: dict[int, list[int]] = {fresh - 1: list(range(k))}
    for a, b, perm in reversed(merges):
        fresh -= 1
        whole = place.pop(fresh)
        of = [0] * k
        for new, old in enumerate(perm):
            of[old] = whole[new]
        place[a], place[b] = of, of[::-1]
    out = []
    for i, perm in enumerate(order):
        sets = [0] * k
        for rank, part in enumerate(perm):
            sets[part] = place[i][rank]
        out.append(sets)
    return out


def assign_groups(groups: DataFrame, n_shards: int, tasks: int, fan: int) -> DataFrame:
    """groups (group, weight) -> group, shard."""

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group", ignore_index=True)
        zeros = [0] * (n_shards - 1)
        sets = difference([[int(w), *zeros] for w in pdf["weight"]])
        return pd.DataFrame({"group": pdf["group"], "weight": pdf["weight"], "node": pdf["task"], "part": [s[0] for s in sets]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(pdf["node"].unique())
        sums = {n: [0] * n_shards for n in nodes}
        for n, p, w in zip(pdf["node"], pdf["part"], pdf["weight"], strict=True):
            sums[n][p] += int(w)
        sets = difference([sums[n] for n in nodes])
        rows = [(n, p, int(pdf["parent"].iloc[0]), sets[i][p]) for i, n in enumerate(nodes) for p in range(n_shards)]
        return pd.DataFrame(rows, columns=["node", "part", "parent", "into"])

    hashed = groups.withColumn("task", F.pmod(F.xxhash64("group"), F.lit(tasks)))
    leaves = materialize(hashed.groupBy("task").applyInPandas(first, "group binary, weight long, node long, part int"), "kk")
    now, names = leaves.groupBy("node", "part").agg(F.sum("weight").alias("weight")), tasks
    route = None  # (node, part) of the leaves -> (parent, into)
    while names > 1:
        names = math.ceil(names / fan)
        up = materialize(now.withColumn("parent", F.floor(F.col("node") / fan)).groupBy("parent").applyInPandas(merge, "node long, part int, parent long, into int"), "kk-merge")
        sums = now.join(up, ["node", "part"]).groupBy(F.col("parent").alias("node"), F.col("into").alias("part")).agg(F.sum("weight").alias("weight"))
        step = up.select(F.col("node").alias("parent"), F.col("part").alias("into"), F.col("parent").alias("to_node"), F.col("into").alias("to_part"))
        route = up if route is None else route.join(step, ["parent", "into"]).select("node", "part", F.col("to_node").alias("parent"), F.col("to_part").alias("into"))
        now = sums
    if route is None:
        return leaves.select("group", F.col("part").alias("shard"))
    return leaves.join(route, ["node", "part"]).select("group", F.col("into").alias("shard"))


def shard(docs: DataFrame, n_shards: int = 16, groups_per_task: int = 20_000, fan: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)."""
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"\0")).alias("group"),
    )
    n = docs.count()
    tasks = max(1, math.ceil(n / groups_per_task))
    groups = rows.groupBy("group").agg(F.sum("size").alias("weight"))
    # A group with most rows makes a skewed join, which AQE splits.
    placed = rows.join(assign_groups(groups, n_shards, tasks, fan), "group").withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.lit(tasks)))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "sub"), "placed")
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n")).select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32"))
    return (
        placed.withColumn("within", within)
        .join(offset, ["shard", "sub"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
