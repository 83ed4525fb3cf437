"""Mixing sources to target weights: Pfair blocks, earliest deadline first.

Every source's rows form blocks of ``block_rows``. A schedule has one block in each
slot. While sources with weights c_s of M in sum have blocks, block i of source s is
released at floor(M i / c_s) and due at ceil(M (i + 1) / c_s); the earliest deadline
among the released goes next, so after every slot each source is less than one block
away from its share. These cycles of M slots repeat until a source is exhausted: the
cycle is cut at that slot, and the others go on from there with their own weights. No
row is dropped or repeated: with all of a source's blocks placed, its weight is no
longer due.

The cycles are planned from one row count for each source; the driver folds one cycle for
each source, to see where it is cut. The earliest-deadline fold of the rows' slots runs
inside Spark SQL's ``aggregate``, one row for each kind of cycle, and rows find their slot
by arithmetic and two joins, so the schedule is made in parallel whatever its length. A
source's order is by hash slice and doc_id, which needs no task to see a whole source.

Any number of sources works. There are as many kinds of cycles as sources, each of as many
slots as the weights' sum (``max_cycle`` at most for given weights), and the fold of one
takes slots times sources steps: plans are cheap up to some hundreds of sources. The tables
of slots are broadcast up to ``BROADCAST`` rows and joined plainly beyond.

A null source is a source of its own. A null doc_id is the smallest. Ties of doc_id follow
the text's CRC; equal rows are placed one by one, in any order. Texts of any length move
once at most. An empty table gives an empty result. Columns of the input are kept in the
struct ``doc``, so no name can clash.
"""

from __future__ import annotations

import bisect
import heapq
import json
import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of the planned tables (some 40 bytes each) that are broadcast.
BROADCAST = 200_000


def default_weights(rows: list[int], resolution: int = 1000) -> list[int]:
    """Whole-number weights in proportion to the square root of the row counts."""
    total = sum(math.sqrt(n) for n in rows)
    return [max(1, round(resolution * math.sqrt(n) / total)) for n in rows]


def earliest_deadlines(c: list[int]) -> list[int]:
    """Source of each slot of one cycle, as ``EDF`` has it."""
    total, given, out = sum(c), [0] * len(c), []
    window = lambda s, i: (-(-total * (i + 1) // c[s]), s)
    ready = [window(s, 0) for s, x in enumerate(c) if x]
    heapq.heapify(ready)
    later: list[tuple[int, int]] = []
    for t in range(total):
        while later and later[0][0] <= t:
            s = heapq.heappop(later)[1]
            heapq.heappush(ready, window(s, given[s]))
        s = heapq.heappop(ready)[1]
        given[s] += 1
        if given[s] < c[s]:
            heapq.heappush(later, (total * given[s] // c[s], s))
        out.append(s)
    return out


def plan_cycles(blocks: list[int], weights: list[int]) -> list[dict]:
    """Kinds of cycles in order: blocks of each source in a whole one (``c``), its first
    slot, each source's first block (``first``) and how many blocks it places before the
    cycles are cut (``given``)."""
    left, start, slot, out = list(blocks), [0] * len(blocks), 0, []
    while any(left):
        c = [w if n else 0 for w, n in zip(weights, left, strict=True)]
        g = reduce(math.gcd, c)
        c = [x // g for x in c]
        order = earliest_deadlines(c)
        at: list[list[int]] = [[] for _ in c]
        for t, s in enumerate(order):
            at[s].append(t)
        # The slot after the last block of the source that ends first.
        cut = min((n - 1) // x * len(order) + at[s][(n - 1) % x] + 1 for s, (n, x) in enumerate(zip(left, c, strict=True)) if x)
        given = [cut // len(order) * x + bisect.bisect_left(at[s], cut % len(order)) for s, x in enumerate(c)]
        out.append({"c": c, "slot": slot, "first": list(start), "given": given})
        start = [n + x for n, x in zip(start, given, strict=True)]
        left = [n - x for n, x in zip(left, given, strict=True)]
        slot += cut
    return out


#: Earliest deadline first over one cycle: state ``a`` is blocks given by source,
#: ``o`` the list of (source, block in cycle) by slot.
EDF = """
aggregate(
  sequence(0L, aggregate(c, 0L, (m, x) -> m + x) - 1L),
  named_struct('a', transform(c, x -> 0L), 'o', cast(array() as array<struct<s:int,i:bigint>>)),
  (st, t) -> transform(
    array(array_min(filter(
      transform(c, (x, s) -> named_struct(
        'due', if(x > st.a[s], ceil(total * (st.a[s] + 1) / x), null),
        'released', x > st.a[s] and (total * st.a[s]) div x <= t,
        's', s, 'i', st.a[s])),
      e -> e.released))),
    p -> named_struct('a', transform(st.a, (n, s) -> if(s = p.s, n + 1L, n)),
                      'o', concat(st.o, array(named_struct('s', p.s, 'i', p.i))))
  )[0],
  st -> st.o)
"""


def cycle_slots(spark: SparkSession, cycles: list[dict]) -> DataFrame:
    """cycle, s, i, at: the slot of block i of source s in each kind of cycle. Only sources
    with a weight in the cycle are folded; ``of`` has their numbers."""
    kinds = []
    for k, x in enumerate(cycles):
        of = [s for s, c in enumerate(x["c"]) if c]
        kinds.append({"cycle": k, "of": of, "c": [x["c"][s] for s in of]})
    return (
        spark.range(1)
        .select(F.explode(F.from_json(F.lit(json.dumps(kinds)), "array<struct<cycle:int,of:array<int>,c:array<bigint>>>")).alias("x"))
        .repartition(max(1, len(kinds) // 8), "x.cycle")
        .select("x.cycle", "x.of", "x.c", F.expr("aggregate(x.c, 0L, (m, v) -> m + v)").alias("total"))
        .select("cycle", "of", F.posexplode(F.expr(EDF)).alias("at", "e"))
        .select("cycle", F.expr("of[e.s]").alias("s"), F.col("e.i").alias("i"), F.col("at").cast("long"))
    )


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = 16, rows_per_slice: int = 4_000, max_cycle: int = 10_000, columns: list[str] | None = None) -> DataFrame:
    """doc (struct of the input's columns, or of ``columns``), block, slot, mix_order.

    ``block`` counts a source's blocks, ``slot`` the blocks of the whole schedule;
    ascending ``mix_order`` (unique) is the mixed order. ``weights`` are whole numbers
    by source, of at most ``max_cycle`` in sum after division by their greatest common
    divisor; sources without one get the mean of the others'.
    """
    spark = docs.sparkSession
    counted = sorted(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r["source"] is not None, r["source"]))  # one row for each source
    names, rows = [r["source"] for r in counted], [r["n"] for r in counted]
    if weights is None:
        ws = default_weights(rows)
    else:
        mean = max(1, round(sum(weights.values()) / max(1, len(weights))))
        ws = [weights.get(s, mean) for s in names]
        if any(w < 1 or w != int(w) for w in ws):
            raise ValueError("weights are whole numbers from 1")
        if ws and sum(ws) // reduce(math.gcd, ws) > max(max_cycle, len(ws)):
            raise ValueError(f"weights of more than {max_cycle} in sum; give the same shares in smaller numbers")
    cycles = plan_cycles([-(-n // block_rows) for n in rows], ws) if rows else []
    slices = max(1, math.ceil(sum(rows) / rows_per_slice))

    sources = [{"source": s, "s": k} for k, s in enumerate(names)]
    parts = [
        {"s": s, "cycle": k, "from": x["first"][s], "to": x["first"][s] + x["given"][s], "c": c, "total": sum(x["c"]), "slot": x["slot"]}
        for k, x in enumerate(cycles)
        for s, c in enumerate(x["c"])
        if x["given"][s]
    ]
    table = lambda rows, kind: spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")).alias("x")).select("x.*")

    key = F.pmod(F.xxhash64("doc_id"), F.lit(slices))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        docs.groupBy("source", key.alias("slice"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("source", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        .join(F.broadcast(table(sources, "source:string,s:int")).withColumnRenamed("source", "name"), F.expr("source <=> name"))
        .select(F.col("source").alias("of_source"), F.col("slice").alias("of_slice"), "s", "offset")
    )
    within = F.row_number().over(Window.partitionBy("src", "slice").orderBy("id", "tie"))
    tie = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("tie")
    placed = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("doc"), F.col("source").alias("src"), key.alias("slice"), F.col("doc_id").alias("id"), tie)
        .withColumn("within", within)
        .join(offsets, F.expr("src <=> of_source and slice = of_slice"))
        .withColumn("at", F.col("offset") + F.col("within") - 1)
        .select("doc", "s", F.expr(f"at div {block_rows}").alias("block"), F.expr(f"at % {block_rows}").alias("row"))
    )
    small = lambda df, rows: F.broadcast(df) if rows <= BROADCAST else df
    where = small(table(parts, "s:int,cycle:int,`from`:bigint,`to`:bigint,c:bigint,total:bigint,slot:bigint").withColumnRenamed("s", "of"), len(parts))
    found = placed.join(where, F.expr("s = of and block >= `from` and block < `to`")).withColumn("nth", F.expr("block - `from`"))
    slots = cycle_slots(spark, cycles) if cycles else spark.createDataFrame([], "cycle int, s int, i long, at long")
    return (
        found.withColumn("i", F.expr("nth % c"))
        .join(small(slots, sum(sum(x["c"]) for x in cycles)), ["cycle", "s", "i"])
        .withColumn("in_slot", F.expr("slot + (nth div c) * total + at"))
        .select("doc", "block", F.col("in_slot").alias("slot"), (F.col("in_slot") * block_rows + F.col("row")).alias("mix_order"))
    )
