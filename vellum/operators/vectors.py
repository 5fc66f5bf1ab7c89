"""Nearest and similar vectors by cosine, in blocks of matrix products.

Vectors are dealt into blocks by a hash of their id. A pair of blocks is one task's work at a time: one product of two matrices
and a list of bounded length, or the pairs that are similar enough. Neither side is collected or broadcast, and a
task's memory is that of two blocks and a strip of their product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.storage import kept

#: Vectors of a block, and rows of a strip of a product.
BLOCK, STRIP = 8192, 512
#: Vectors that blocks gather around, which the driver holds.
MOST_PIVOTS = 1024


def _blocks(n: int, block: int) -> int:
    return max(1, -(-n // block))


def _dealt(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))


def _matrix(table: pa.Table) -> np.ndarray:
    """Unit vectors of a table's rows; a vector of zeros stays."""
    m = np.array(table["vec"].combine_chunks().values.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(table.num_rows, -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def nearest(asked: DataFrame, rows: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(query, id, cosine, rank): the k vectors of rows (id long, vec) closest by cosine to each of asked (id long, vec), itself left out; of equally close ones the least ids.

    Each pair of blocks returns the k best of its rows for each query; the lists are merged by rank. Vectors have one length and no nulls."""
    block = BLOCK if block is None else block
    asked, rows = (kept(df.select("id", F.col("vec").cast("array<double>").alias("vec")), name) for df, name in ((asked, "asked"), (rows, "vectors")))
    n_asked, n_rows = _blocks(asked.count(), block), _blocks(rows.count(), block)
    left = _dealt(asked, n_asked, "a").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    right = _dealt(rows, n_rows, "b").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if x.num_rows and y.num_rows:
            y = y.sort_by("id")
            ids, mine, theirs, unit = y["id"].to_numpy(), x["id"].to_numpy(), _matrix(y), _matrix(x)
            for at in range(0, len(mine), STRIP):
                product = unit[at : at + STRIP] @ theirs.T
                product[mine[at : at + STRIP, None] == ids[None, :]] = -np.inf
                # Candidates by value, those that equal the k-th among them, then the first k by value and id.
                for query, row in zip(mine[at : at + STRIP], product, strict=True):
                    least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    found = np.flatnonzero((row >= least) & (row > -np.inf))
                    found = found[np.argsort(-row[found], kind="stable")][:k]
                    out[0].extend([query] * len(found))
                    out[1].extend(ids[found])
                    out[2].extend(row[found])
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query", "id", "cosine"])

    every = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(best, "query long, id long, cosine double")
    return every.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "id"))).filter(F.col("rank") <= k)


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, vec) as one for each different vector, (id, vec, n) by its least id, and (id, class) for all of them."""
    found = kept(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes")
    return found.select("id", "vec", "n"), rows.join(found.select("vec", F.col("id").alias("class")), "vec").select("id", "class")


def similar(rows: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """(id1, id2, cosine): all pairs, id1 < id2, of rows (id long, vec) whose cosine is at least `least`. Rows should be different vectors, one of each class.

    Blocks hold near vectors together: each vector goes to the closest of some that are chosen by a hash of their id, one for each block, and groups that are too large are cut. Of two blocks, each
    with its mean and radius, nothing is compared where the triangle inequality rules a pair out; the rest is compared in full, so the result is exact."""
    block = BLOCK if block is None else block
    rows = kept(rows.select("id", F.col("vec").cast("array<double>").alias("vec")), "vectors")
    n = _blocks(rows.count(), block)
    pivots = rows.orderBy(F.xxhash64("id"), "id").limit(min(n, MOST_PIVOTS)).toArrow()  # a bounded number of vectors
    centres = _matrix(pivots) if pivots.num_rows else np.zeros((1, 1))

    def deal(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            home = np.argmax(_matrix(t) @ centres.T, axis=1) if t.num_rows else np.array([], dtype=int)
            yield from t.append_column("home", pa.array(home, pa.int32())).to_batches()

    homed = kept(rows.mapInArrow(deal, "id long, vec array<double>, home int"), "homed")
    sizes = homed.groupBy("home").agg(F.count("*").alias("n"))
    cut = homed.join(F.broadcast(sizes), "home")  # a row for each pivot
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block)).cast("int")).select("id", "vec", F.concat_ws("-", "home", "part").alias("cell"))

    def outline(t: pa.Table) -> pa.Table:
        m = _matrix(t)
        mean = m.mean(axis=0)
        return pa.table([t["cell"][:1], pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([float(np.linalg.norm(m - mean, axis=1).max())])], ["cell", "mean", "radius"])

    cells = kept(cut.groupBy("cell").applyInArrow(outline, "cell string, mean array<double>, radius double"), "cells")
    other = cells.select(F.col("cell").alias("to"), F.col("mean").alias("m2"), F.col("radius").alias("r2"))
    apart = F.sqrt(F.aggregate(F.zip_with("mean", "m2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    met = kept(cells.join(other, F.col("cell") <= F.col("to")).filter((F.col("cell") == F.col("to")) | (apart - F.col("radius") - F.col("r2") <= reach)).select("cell", "to"), "met")  # blocks, not rows
    left = cut.join(met, "cell").select("cell", "to", "id", "vec")
    right = cut.select(F.col("cell").alias("to"), "id", "vec").join(met, "to")
    right = right.select(*(F.col(c).alias(f"_{c}") for c in ("cell", "to", "id", "vec")))  # names and columns of their own, as both sides come of one table

    def pairs(x: pa.Table, y: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if x.num_rows and y.num_rows:
            same = x["cell"][0].as_py() == x["to"][0].as_py()
            mine, ids, unit, theirs = x["id"].to_numpy(), y["_id"].to_numpy(), _matrix(x), _matrix(y.rename_columns(x.column_names))
            for at in range(0, len(mine), STRIP):
                product = unit[at : at + STRIP] @ theirs.T
                i, j = np.nonzero(product >= least)
                a, b = mine[at + i], ids[j]
                once = a < b if same else a != b
                out[0].append(np.minimum(a, b)[once])
                out[1].append(np.maximum(a, b)[once])
                out[2].append(product[i, j][once])
        joined = [np.concatenate(c) if c else np.array([]) for c in out]
        return pa.table([pa.array(joined[0].astype(np.int64)), pa.array(joined[1].astype(np.int64)), pa.array(joined[2].astype(np.float64))], ["id1", "id2", "cosine"])

    return left.groupBy("cell", "to").cogroup(right.groupBy("_cell", "_to")).applyInArrow(pairs, "id1 long, id2 long, cosine double")

