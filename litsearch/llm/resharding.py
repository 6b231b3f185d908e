"""Resharding by minimum-cost flow: new shards of near equal bytes, moving as few bytes as possible.

Old shards supply their bytes, new shards take up to their capacity; a byte costs 0 if it stays in
the shard of its own number and 1 if it moves. The cheapest flow is solved exactly on the shard graph
(as many edges as old times new shards, independent of the number of rows). It is then laid out
over blocks of rows in a fixed order: a block's place in the running sum of its old shard's bytes
says to which new shard it goes; only blocks that a border of two targets cuts are split by row.
Everything that grows with the data is aggregation and joins by block; texts are not shuffled until
the files of affected shards are rewritten.

Defined results: a null text has size 1 (no bytes, plus 1) and the checksum of no bytes. Rows are
told apart by id and checksum of the text; repeated rows each get their own slot. A row without
id is a row like others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsearch.llm.common import stored

BLOCKS_PER_SHARD = 512


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow (i, j) -> amount of all supply into capacities at the least total ``cost(i, j)``, by
    shortest augmenting paths with potentials."""
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are too small")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, capacity left, cost; the reverse edge has the neighbouring number
    of: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, most: int, price: int) -> None:
        of[a].append(len(edges))
        edges.append([b, most, price])
        of[b].append(len(edges))
        edges.append([a, 0, -price])

    for i in range(n):
        add(source, i, supply[i], 0)
        for j in range(m):
            add(i, n + j, supply[i], cost(i, j))
    for j in range(m):
        add(n + j, sink, capacity[j], 0)
    potential, left = [0] * (n + m + 2), sum(supply)
    while left:
        distance, via = {source: 0}, {}
        todo = [(0, source)]
        while todo:
            d, a = heapq.heappop(todo)
            if d > distance[a]:
                continue
            for e in of[a]:
                b, most, price = edges[e]
                if most and (b not in distance or d + price + potential[a] - potential[b] < distance[b]):
                    distance[b] = d + price + potential[a] - potential[b]
                    via[b] = e
                    heapq.heappush(todo, (distance[b], b))
        far = max(distance.values())
        potential = [p + distance.get(v, far) for v, p in enumerate(potential)]
        push, at = left, sink
        while at != source:
            push, at = min(push, edges[via[at]][1]), edges[via[at] ^ 1][0]
        at = sink
        while at != source:
            edges[via[at]][1] -= push
            edges[via[at] ^ 1][1] += push
            at = edges[via[at] ^ 1][0]
        left -= push
    return {(i, edges[e][0] - n): edges[e ^ 1][1] for i in range(n) for e in of[i]
            if edges[e][0] != source and edges[e ^ 1][1]}


def reshard(docs: DataFrame, new_shards: int, id_col: str = "doc_id", text_col: str = "text",
            old_shard=None, capacities: list[int] | None = None, row_col: str | None = None) -> DataFrame:
    """One row per input row: the id column, ``row_col`` if given, ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``old_shard``,
    ``shard``, ``slot`` (gapless from 0 in each shard), ``moved``.

    ``old_shard`` is a column expression for the present shard (int, from 0; default: rows hashed by
    id over half as many shards, as after a doubling). Without ``capacities`` each new shard takes
    an equal share of the bytes. ``row_col`` names a column that is different in every row
    (:func:`with_row_key` adds one); rewriting files needs it.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    if old_shard is None:
        old_shard = F.pmod(F.xxhash64(F.col(id_col)), F.lit(max(1, new_shards // 2)))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), old_shard.cast("int").alias("old_shard"), *([F.col(row_col).alias("row_key")] if row_col else []))
    rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(BLOCKS_PER_SHARD)).cast("int")), "shard-rows")
    blocks = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    sizes = {r[0]: r[1] for r in blocks.groupBy("old_shard").agg(F.sum("bytes")).collect()}
    supply = [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]
    if capacities is None:
        capacities = [sum(supply) // new_shards + (j < sum(supply) % new_shards) for j in range(new_shards)]
    flow = min_cost_flow(supply, capacities, lambda i, j: int(i != j))
    # targets of an old shard, its own number first, as intervals of the running sum of its bytes
    intervals, at = [], {}
    for (i, j), amount in sorted(flow.items(), key=lambda x: (x[0][0], x[0][1] != x[0][0], x[0][1])):
        intervals.append((i, j, at.get(i, 0), at.get(i, 0) + amount))
        at[i] = at.get(i, 0) + amount
    spark = docs.sparkSession
    targets = spark.createDataFrame(intervals, "old_shard int, target int, low long, high long")

    running = Window.partitionBy("old_shard").orderBy("block")
    blocks = blocks.withColumn("begin", F.sum("bytes").over(running) - F.col("bytes"))
    # at most old shards x blocks rows: few, whatever the size of the input
    reach = (blocks.join(targets, "old_shard").where("begin < high and begin + bytes > low")
             .groupBy("old_shard", "block", "begin").agg(F.sort_array(F.collect_list(F.struct("low", "high", "target"))).alias("to")))
    placed = rows.join(F.broadcast(reach), ["old_shard", "block"])
    within = Window.partitionBy("old_shard", "block").orderBy("id", "text_crc32", "size")
    whole = placed.where("size(to) = 1").withColumn("shard", F.col("to")[0]["target"])
    cut = (placed.where("size(to) > 1")
           .withColumn("place", F.col("begin") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
           .withColumn("shard", F.element_at(F.filter("to", lambda t: t.low <= F.col("place")), -1)["target"]).drop("place"))
    keys = ["row_key"] if row_col else []
    columns = ["id", *keys, "size", "text_crc32", "old_shard", "block", "shard"]
    placed = stored(whole.select(*columns).unionAll(cut.select(*columns)), "sharded")

    numbered = Window.partitionBy("shard").orderBy("old_shard", "block")
    first = (placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"))
             .withColumn("first", F.sum("n").over(numbered) - F.col("n")).drop("n"))
    slot = Window.partitionBy("shard", "old_shard", "block").orderBy("id", "text_crc32", "size")
    out = placed.join(F.broadcast(first), ["shard", "old_shard", "block"])
    return out.select(
        F.col("id").alias(id_col), *([F.col("row_key").alias(row_col)] if row_col else []), "size", "text_crc32", "old_shard", "shard",
        (F.col("first") + F.row_number().over(slot) - 1).cast("long").alias("slot"),
        (F.col("shard") != F.col("old_shard")).alias("moved"))


def with_row_key(docs: DataFrame, out: str = "row_key") -> DataFrame:
    """``docs`` written once, with a number that is different in every row and stays with it."""
    return stored(docs.withColumn(out, F.monotonically_increasing_id()), "keyed-rows")


def rewrite_affected(docs: DataFrame, plan: DataFrame, path: str, row_col: str = "row_key") -> list[int]:
    """Write the documents of every shard that a move leaves or enters, one folder per shard, and
    return their numbers; files of other shards can stay as they are.

    ``docs`` and ``plan`` meet by ``row_col``, so each row is written once, however often its id and text are repeated.
    """
    moves = plan.where("moved").select("old_shard", "shard").distinct()
    touched = sorted({r[0] for r in moves.select("old_shard").unionAll(moves.select("shard")).distinct().collect()})
    to = plan.where(F.col("shard").isin(touched)).select(row_col, "shard")
    docs.drop("shard").join(to, row_col).drop(row_col).write.partitionBy("shard").parquet(path)
    return touched
