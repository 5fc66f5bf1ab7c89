"""Minimum-cost-flow resharding.

Old shards supply bytes, new ones take them up to their capacity, a byte that stays costs nothing and one that moves
costs one (or what a cost table says). The flow over these few nodes, solved on shard sizes alone, says how many bytes
of each old shard go where. Rows follow by their place in the old shard: blocks (input splits) are summed, running
sums of the blocks place every row, and the row whose middle lies in a flow's byte range goes with it. Only shards that
take or give rows have to be written again.

Defined results: a null text has no bytes and the checksum 0; rows that repeat an id are placed one by one; a null id
is placed like any other; a row whose old shard is null lies in none so far, comes back with the old shard -1 and has to
move; further columns are ignored, unless whole rows are asked for; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import kept, read, remove

#: Bytes that every row has besides its text.
ROW_BYTES = 8


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Flows (i, j) -> amount that ship all supply within the capacities at the least cost; costs are not negative.

    Primal and dual by turns: cheapest distances under potentials (Dijkstra on a dense table), then as much flow as the
    arcs without reduced cost carry. There are no more turns than different path costs, two where moving costs the same
    everywhere, so a thousand shards take seconds."""
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards can't hold the old ones")
    if not supply or not capacity:
        return {}
    left, room, c = np.array(supply, np.int64), np.array(capacity, np.int64), np.array(cost, np.int64)
    flow, up, down = np.zeros(c.shape, np.int64), np.zeros(len(left), np.int64), np.zeros(len(room), np.int64)
    while left.any():
        far = np.iinfo(np.int64).max // 4
        # Distances under reduced costs, which are never negative; flow may be taken back along its arc.
        forth, back = c + up[:, None] - down, np.where(flow > 0, -(c + up[:, None] - down), far)
        old, new = np.where(left > 0, 0, far), np.full(len(room), far)
        todo_old, todo_new = np.ones(len(left), bool), np.ones(len(room), bool)
        while True:
            at_old, at_new = np.where(todo_old, old, far).min(), np.where(todo_new, new, far).min()
            if min(at_old, at_new) >= far:
                break
            if at_old <= at_new:
                for i in np.flatnonzero(todo_old & (old == at_old)):
                    todo_old[i] = False
                    new = np.minimum(new, at_old + forth[i])
            else:
                for j in np.flatnonzero(todo_new & (new == at_new)):
                    todo_new[j] = False
                    old = np.minimum(old, np.minimum(at_new + back[:, j], far))
        least = min(new[room > 0])
        up, down = up + np.minimum(old, least), down + np.minimum(new, least)
        _ship(left, room, flow, c + up[:, None] - down == 0)
    return {(int(i), int(j)): int(flow[i, j]) for i, j in zip(*np.nonzero(flow), strict=True)}


def _ship(left: np.ndarray, room: np.ndarray, flow: np.ndarray, free: np.ndarray) -> None:
    """Ship what the free arcs can carry, breadth first from all shards with something left to any with room."""
    while True:
        from_old = np.full(len(room), -1)  # the old shard that each new one was reached from
        from_new = np.where(left > 0, -1, -2)  # and the new one whose flow an old one takes back; -2: not reached
        front, end = np.flatnonzero(left > 0), None
        while len(front) and end is None:
            fresh: list[int] = []
            for i in front:
                for j in np.flatnonzero(free[i] & (from_old < 0)):
                    from_old[j] = i
                    fresh.append(j)
            end = next((j for j in fresh if room[j] > 0), None)
            front = []
            for j in fresh if end is None else ():
                for i in np.flatnonzero((flow[:, j] > 0) & (from_new == -2)):
                    from_new[i] = j
                    front.append(i)
        if end is None:
            return
        path, j, amount = [], end, room[end]
        while True:
            i = from_old[j]
            path.append((i, j, 1))
            if from_new[i] < 0:
                break
            j = from_new[i]
            path.append((i, j, -1))
            amount = min(amount, flow[i, j])
        amount = min(amount, left[i])
        for x, y, sign in path:
            flow[x, y] += sign * amount
        left[i] -= amount
        room[end] -= amount


def transfers(sizes: dict[int, int], shards: int, weights: list[int] | None = None, cost: list[list[int]] | None = None) -> list[tuple[int, int, int, int]]:
    """(old, new, from byte, to byte) ranges of every old shard; capacities follow the weights, equal ones by default."""
    weights = weights or [1] * shards
    total, old = sum(sizes.values()), sorted(sizes)
    ends = [total * sum(weights[: j + 1]) // sum(weights) for j in range(shards)]
    capacity = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    flow = min_cost_flow([sizes[o] for o in old], capacity, cost or [[int(o != j) for j in range(shards)] for o in old])
    out = []
    for i, o in enumerate(old):
        at = 0
        for j in sorted((j for k, j in flow if k == i), key=lambda j: (j != o, j)):
            out.append((o, j, at, at + flow[i, j]))
            at += flow[i, j]
    return out


def reshard(docs: DataFrame, old_shard: Column, shards: int, id_col: str = "doc_id", text_col: str = "text", weights: list[int] | None = None, whole: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot[, record]) per row; record holds all columns of docs. At most about a thousand shards, whose sizes fit the driver."""
    text = F.coalesce(F.col("text"), F.lit(""))
    record = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record")] * whole
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(old_shard.cast("int"), F.lit(-1)).alias("old_shard"), *record)
    sized = rows.withColumns({"size": F.octet_length(text).cast("long") + ROW_BYTES, "text_crc32": F.crc32(text.cast("binary")), "block": F.shiftright("row", 33)})
    sized = kept(sized.drop("text"), "sizes")
    blocks = kept(sized.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")), "blocks")
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("old_shard", "block", F.coalesce(F.sum("bytes").over(before("old_shard").orderBy("block")), F.lit(0)).alias("start"))
    sizes = {r["old_shard"]: r["bytes"] for r in blocks.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect()}
    ranges = docs.sparkSession.createDataFrame(transfers(sizes, shards, weights) or [(0, 0, 0, 0)], "old_shard int, shard int, low long, high long")
    within = F.coalesce(F.sum("size").over(before("old_shard", "block").orderBy("row")), F.lit(0))
    placed = sized.join(starts, ["old_shard", "block"]).withColumn("middle", F.col("start") + within + F.floor(F.col("size") / 2))
    # At most old + new - 1 flows come out of the solver.
    placed = placed.join(F.broadcast(ranges), "old_shard").filter("middle >= low and middle < high").drop("middle", "start", "low", "high")
    placed = kept(placed, "placed")
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    firsts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before("shard").orderBy("block")), F.lit(0)).alias("first"))
    slot = F.col("first") + F.row_number().over(W.partitionBy("shard", "block").orderBy("row")) - 1
    return placed.join(firsts, ["shard", "block"]).select("doc_id", "size", "text_crc32", "old_shard", "shard", slot.alias("slot"), *["record"] * whole)


def rewrite(placed: DataFrame, path: str) -> list[int]:
    """Write the shards that the plan changes, each in its folder shard=k of the path, and return them; the folders of the others are not touched.

    placed comes from reshard() with whole rows, which are kept apart from the path, so the path may be the one they were
    read from. A changed shard that no row is left in loses its folder."""
    spark = placed.sparkSession
    moved = placed.filter("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    changed = sorted(r["shard"] for r in moved.collect() if r["shard"] >= 0)
    rows = placed.filter(F.col("shard").isin(changed))
    filled = {r["shard"] for r in rows.select("shard").distinct().collect()}
    columns = [F.col(f"record.`{c}`") for c in placed.schema["record"].dataType.names if c != "shard"]
    rows = rows.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").select(*columns, "shard")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for shard in changed:
        if shard not in filled:
            remove(spark, f"{path}/shard={shard}")
    return changed


#: The shards that documents are dealt to so far, by a hash of the id, and the ones to come.
OLD, NEW = 16, 24


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.pmod(F.xxhash64("doc_id"), F.lit(OLD))
    placed = reshard(read(spark, sf_dir, "documents"), old, NEW)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


SQL = None
