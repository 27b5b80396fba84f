"""Near-duplicate vectors: spherical k-means cells and blocked cosine products, with no link lost.

Vectors with equal labels are linked from a cosine of ``cosine`` on. Spherical
k-means over all vectors gives unit centres; a vector lives in the cell of its
nearest one. A vector x of cell i can have a link into cell j only if it is near
enough to the plane between both centres: with u = (c_i - c_j) / |c_i - c_j|,
any y of cell j has y . u <= 0, so x . y >= t asks for x . u <= sqrt(1 - t^2).
It must also be near enough to c_j given how far cell j reaches. Only then x is
sent to cell j as a guest, and only for j > i, which covers each pair of cells
once. So cells cut work, and every link is found, whatever the centres are.

Equal vectors of a label are one node with a count, so copies cost nothing. Cells
are cut into blocks of at most ``block`` residents; blocks of a cell meet in
pairs, each pair one task. A task multiplies two blocks in double precision and
returns one row per vector with links: how many, and the least node it is tied
to within the block. That is enough for counts and components, so pairs
are never listed, and no group however large is gathered.

Vectors that are null, of length zero or hold null or non-finite numbers, and
vectors without label, have no links. Vectors of different dimension are never
compared. Rows are vectors, also when ids repeat; a null id names no component:
its row has the least id linked to it, or null, and is kept only then. Extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import map_batches, settle
from hostloom.llm.components import connected


@dataclass(frozen=True)
class Cells:
    """``per_root``: cells are sqrt(vectors) / per_root, at least one."""

    cosine: float = 0.93
    per_root: float = 16.0
    rounds: int = 4
    block: int = 2048


def _unit(rows: list | pa.Array) -> np.ndarray:
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(rows), -1)
    # by a power of two first, which is exact: squares of very large or small components would leave the range
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dimension(column: pa.Array) -> Iterator[np.ndarray]:
    """Row numbers of vectors of one dimension each."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield np.flatnonzero(sizes == d)


def usable(vector: str) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, label, dim, v, copies, least): one row for each different labelled vector."""
    return rows.filter("node is not null").groupBy("node", "label", "v").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")).withColumn("dim", F.size("v"))


def _centres(nodes: DataFrame, dim: int, cells: int, rounds: int) -> np.ndarray:
    """Unit centres by spherical k-means over all vectors of one dimension."""
    # as many rows as there are cells
    start = nodes.orderBy("node").limit(cells).select("v").toArrow().column(0).combine_chunks()
    centres = _unit(start)

    def assign(batch: pa.RecordBatch, centres: np.ndarray) -> pa.RecordBatch:
        x = _unit(batch.column(0))
        cell = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        used = np.unique(cell)
        at = np.repeat(used, dim)
        return pa.RecordBatch.from_arrays([pa.array(at * dim + np.tile(np.arange(dim), len(used))),
                                           pa.array(sums[used].ravel())], names=["at", "x"])

    for _ in range(rounds if cells > 1 else 0):
        moved = map_batches(nodes.select("v"), lambda b, c=centres: assign(b, c), "at bigint, x double").groupBy(
            "at").agg(F.sum("x").alias("x")).toPandas()
        total = np.zeros(centres.size)
        total[moved["at"].to_numpy()] = moved["x"].to_numpy()
        total = total.reshape(centres.shape)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), centres)
    return centres


def _homes(nodes: DataFrame, centres: np.ndarray) -> DataFrame:
    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        alike = _unit(batch.column(3)) @ centres.T
        home = alike.argmax(1)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(alike.max(1))],
                                          names=["node", "label", "copies", "v", "home", "near"])

    return map_batches(nodes.select("node", "label", "copies", "v"), place,
                       "node bigint, label bigint, copies bigint, v array<double>, home int, near double")


def _placed(homes: DataFrame, centres: np.ndarray, reach: np.ndarray, how: Cells) -> DataFrame:
    """(node, label, copies, v, cell, guest): each vector in its own cell and in later ones it may link into."""
    side = math.sqrt(1 - how.cosine ** 2) + 1e-9
    # angle to a centre at most the angle of a link plus the reach of the cell
    nearest = np.cos(np.minimum(math.acos(how.cosine) + reach, math.pi)) - 1e-9

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        home = batch.column(4).to_numpy()
        alike = _unit(batch.column(3)) @ centres.T
        own = np.take_along_axis(alike, home[:, None], 1)
        # distance of both centres, from their product; the added trace outweighs its rounding
        gap = np.sqrt(np.maximum(2 - 2 * (centres[home] @ centres.T), 0) + 1e-12)
        guest = (own - alike <= side * gap) & (alike >= nearest) & (np.arange(len(centres)) > home[:, None])
        row, cell = np.nonzero(guest)
        rows = np.concatenate([np.arange(batch.num_rows), row])
        cells = np.concatenate([home, cell]).astype(np.int32)
        moved = batch.take(pa.array(rows))
        flag = np.arange(len(rows)) >= batch.num_rows
        return pa.RecordBatch.from_arrays([*moved.columns[:4], pa.array(cells), pa.array(flag)],
                                          names=["node", "label", "copies", "v", "cell", "guest"])

    return map_batches(homes, send,
                       "node bigint, label bigint, copies bigint, v array<double>, cell int, guest boolean")


def _least_tied(left: np.ndarray, right: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each place the least name in its component of the links left[k] - right[k]."""
    tied = names.copy()
    while True:
        low = np.minimum(tied[left], tied[right])
        new = tied.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        if (new == tied).all():
            return tied
        tied = new


def _compare(placed: DataFrame, how: Cells) -> DataFrame:
    """(node, linked, tie): per vector and task the copies linked to it, and a node of its component."""
    count = F.count(F.lit(1))
    sizes = placed.groupBy(F.col("label").alias("_l"), F.col("cell").alias("_c")).agg(
        F.ceil((count - F.count_if("guest")) / how.block).cast("int").alias("blocks"),
        F.ceil(F.count_if("guest") / how.block).cast("int").alias("parts")).filter("blocks > 0")
    rows = placed.join(sizes, (F.col("label") == F.col("_l")) & (F.col("cell") == F.col("_c")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("guest"), F.col("parts")).otherwise(
        F.col("blocks"))).cast("int"))

    def each(n: str) -> Column:
        return F.filter(F.sequence(F.lit(0), F.col(n)), lambda b: b < F.col(n))

    # guests go in parts that meet every resident block; a resident block meets the later ones, itself and all parts
    meets = F.when(F.col("guest"), F.transform(each("blocks"), lambda b: F.struct(
        b.alias("i"), (-1 - F.col("own")).alias("j")))).otherwise(F.concat(
            F.transform(each("blocks"), lambda b: F.struct(F.least(b, F.col("own")).alias("i"),
                                                           F.greatest(b, F.col("own")).alias("j"))),
            F.transform(each("parts"), lambda b: F.struct(F.col("own").alias("i"), (-1 - b).alias("j")))))
    dealt = rows.withColumn("m", F.explode(meets)).select(
        "label", "cell", "m.i", "m.j", "guest", "own", "node", "copies", "v")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        x = _unit(table.column("v").combine_chunks())
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        if j < 0:
            a, b = np.flatnonzero(~table.column("guest").to_numpy()), np.flatnonzero(table.column("guest").to_numpy())
        elif i == j:
            a = b = np.arange(len(names))
        else:
            own = table.column("own").to_numpy()
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        linked = np.zeros(len(names), dtype=np.int64)
        lefts, rights = [], []
        for low in range(0, len(a), 1024):
            some = a[low: low + 1024]
            p, q = np.nonzero(x[some] @ x[b].T >= how.cosine)
            p, q = some[p], b[q]
            apart = p < q if a is b else p != q
            p, q = p[apart], q[apart]
            np.add.at(linked, p, copies[q])
            np.add.at(linked, q, copies[p])
            tied = _least_tied(p, q, names)
            moved = np.flatnonzero(tied != names)
            lefts.append(moved)
            rights.append(tied[moved])
        touched = np.flatnonzero(linked)
        left = np.concatenate([touched, *lefts]) if lefts else touched
        right = np.concatenate([names[touched], *rights]) if lefts else names[touched]
        amounts = np.concatenate([linked[touched], np.zeros(len(left) - len(touched), dtype=np.int64)])
        return pa.table({"node": names[left], "linked": amounts, "tie": right})

    return dealt.groupBy("label", "cell", "i", "j").applyInArrow(compare, "node bigint, linked bigint, tie bigint")


def near_vectors(vectors: DataFrame, how: Cells = Cells(), id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
                          v.alias("v"))
    node = F.when(usable("v") & F.col("label").isNotNull(), F.xxhash64("label", "v"))
    rows = rows.withColumn("node", node)
    nodes = settle(_nodes(rows), "vector-nodes")
    found = None
    # one row per dimension
    for size in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        some = nodes.filter(F.col("dim") == size["dim"])
        cells = max(1, math.ceil(math.sqrt(size["n"]) / how.per_root))
        centres = _centres(some, size["dim"], cells, how.rounds)
        homes = settle(_homes(some, centres), "vector-homes")
        reach = np.zeros(len(centres))
        for r in homes.groupBy("home").agg(F.min("near").alias("near")).collect():
            reach[r["home"]] = math.acos(max(-1.0, min(1.0, r["near"])))
        links = _compare(_placed(homes, centres, reach, how), how)
        found = links if found is None else found.union(links)
    if found is None:
        places = nodes.select("node", F.lit(0).cast("bigint").alias("linked"), "copies", "least",
                              F.col("node").alias("component"))
    else:
        found = settle(found, "vector-links")
        labels = connected(found.select(F.col("node").alias("a"), F.col("tie").alias("b")))
        linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
        places = nodes.join(linked, "node", "left").join(labels, "node", "left").select(
            "node", F.coalesce("linked", F.lit(0)).alias("linked"), "copies", "least",
            F.coalesce("component", "node").alias("component"))
    least = places.groupBy("component").agg(F.min("least").alias("component_id"))
    places = places.join(least, "component").select("node", (F.col("linked") + F.col("copies") - 1).alias("n_links"),
                                                    "component_id")
    out = rows.select("vec_id", "node").join(places, "node", "left")
    component = F.when(F.col("node").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
