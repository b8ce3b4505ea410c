"""Near-duplicate vectors by cover trees and their dual traversal.

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c), so the search works with distances and
their triangle inequality. Equal vectors are one point with a weight. The points of a label are dealt to cells around
pivots, and large cells are cut into tiles, so that no task holds more than two tiles. A pair of cells is skipped
when the distance of its pivots exceeds both covering radii by more than the search radius: the top level of the
traversal. For each remaining pair of tiles a task builds two cover trees, whose levels have halving radii, and walks
down pairs of nodes: a pair that is too far apart by its covering radii is dropped, one that is close enough as a whole
is counted at once, and others go on with their children until leaves are compared point by point in double precision.

The pairs themselves never leave a task: it reports the number of partners of each point and a spanning forest of the
links, so results stay linear in the input however large a group of copies is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, components, settled

LEAF = 48
BLOCK = 64


# ---- one task --------------------------------------------------------------------------


class Node:
    """Points ``rows`` of a tree, all within ``radius`` of the point ``center``."""

    __slots__ = ("center", "children", "radius", "rows", "weight")

    def __init__(self, center: int, rows: np.ndarray, radius: float, weight: int, children: list[Node]):
        self.center, self.rows, self.radius, self.weight, self.children = center, rows, radius, weight, children


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors; rounding makes them at most 1e-7 too small or too large."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


def cover_tree(x: np.ndarray, weights: np.ndarray, finest: float) -> Node:
    """A tree over the rows of ``x``: children of a node cover its points with half the level's radius."""

    def build(rows: np.ndarray, center: int, far: np.ndarray, level: float) -> Node:
        radius = float(far.max(initial=0.0))
        weight = int(weights[rows].sum())
        if len(rows) <= LEAF or radius <= finest:
            return Node(center, rows, radius, weight, [])
        while level >= radius:
            level /= 2
        # Uncovered points become centres of the next level, the node's own centre being the first, a block at a time.
        nearest, owner, centres = far.copy(), np.zeros(len(rows), dtype=np.int64), [center]
        while len(block := np.flatnonzero(nearest > level)[:BLOCK]):
            d = distances(x[rows], x[rows[block]])
            d[block, np.arange(len(block))] = 0.0
            chosen: list[int] = []
            for k, point in enumerate(block):
                if (d[point, chosen] > level).all():
                    chosen.append(k)
            best = d[:, chosen].argmin(axis=1)
            least = d[np.arange(len(rows)), np.array(chosen)[best]]
            closer = least < nearest
            nearest[closer], owner[closer] = least[closer], len(centres) + best[closer]
            centres.extend(rows[block[chosen]].tolist())
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        children = [
            build(rows[part], c, nearest[part], level / 2)
            for c, part in ((c, order[i:j]) for c, i, j in zip(centres, cuts, cuts[1:]))
            if len(part)
        ]
        return Node(center, rows, radius, weight, children)

    every = np.arange(len(x))
    return build(every, 0, distances(x, x[:1])[:, 0], 2.0)


class Links:
    """Numbers of partners and connected sets of the points of two trees (or of one with itself)."""

    def __init__(self, x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray, cosine: float, same: bool):
        self.x, self.y, self.wx, self.wy, self.same = x, y, wx, wy, same
        self.cosine, self.reach = cosine, math.sqrt(max(2.0 - 2.0 * cosine, 0.0))
        self.nx, self.ny = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
        self.shift = 0 if same else len(x)
        self.label = np.arange(len(x) + (0 if same else len(y)))

    def join(self, points: np.ndarray) -> None:
        found = np.unique(self.label[points])
        if len(found) > 1:
            self.label[np.isin(self.label, found)] = found[0]

    def walk(self, a: Node, b: Node) -> None:
        stack = [(a, b)]
        slack = 1e-6  # more than rounding can do
        while stack:
            a, b = stack.pop()
            left, right = a.children or [a], b.children or [b]
            if not a.children and not b.children:
                self.compare(a, b)
                continue
            ra, rb = np.array([n.radius for n in left]), np.array([n.radius for n in right])
            d = distances(self.x[[n.center for n in left]], self.y[[n.center for n in right]])
            reach = ra[:, None] + rb[None, :]
            near = d - reach <= self.reach + slack
            if self.same and a is b:
                near = np.triu(near)
            for i, k in zip(*np.nonzero(near)):
                if d[i, k] + reach[i, k] <= self.reach - slack:
                    self.whole(left[i], right[k])
                else:
                    stack.append((left[i], right[k]))

    def whole(self, a: Node, b: Node) -> None:
        """Every point of one node links with every point of the other."""
        self.nx[a.rows] += b.weight
        if self.same and a is b:
            self.nx[a.rows] -= self.wx[a.rows]
        else:
            (self.nx if self.same else self.ny)[b.rows] += a.weight
        self.join(np.concatenate((a.rows, b.rows + self.shift)))

    def compare(self, a: Node, b: Node) -> None:
        hit = self.x[a.rows] @ self.y[b.rows].T >= self.cosine
        if self.same and a is b:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        self.nx[a.rows] += hit @ self.wy[b.rows]
        if not (self.same and a is b):
            (self.nx if self.same else self.ny)[b.rows] += self.wx[a.rows] @ hit
        for i in np.flatnonzero(hit.any(axis=1)):
            self.join(np.append(b.rows[hit[i]] + self.shift, a.rows[i]))


def unit(vectors: list[np.ndarray] | pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tile_links(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """(node, n, root) of the points of one pair of tiles; ``side`` is 0, 1, or 2 for a tile with itself."""
    a, b = rows[rows["side"] != 1], rows[rows["side"] != 0]
    same = bool((rows["side"] == 2).all())
    if not len(a) or not len(b):
        return pd.DataFrame({"node": [], "n": [], "root": []})
    x, wx = unit(a["v"]), a["copies"].to_numpy(dtype=np.int64)
    y, wy = (x, wx) if same else (unit(b["v"]), b["copies"].to_numpy(dtype=np.int64))
    links = Links(x, wx, y, wy, cosine, same)
    top = cover_tree(x, wx, links.reach / 16)
    links.walk(top, top if same else cover_tree(y, wy, links.reach / 16))
    nodes = a["node"].to_numpy() if same else np.concatenate((a["node"].to_numpy(), b["node"].to_numpy()))
    n = links.nx if same else np.concatenate((links.nx, links.ny))
    linked = np.flatnonzero(n)
    return pd.DataFrame({"node": nodes[linked], "n": n[linked], "root": nodes[links.label[linked]]})


# ---- the join --------------------------------------------------------------------------


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.98,
    tile_rows: int = 2048,
    pivots: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row (id, n_links, component_id, kept) per vector.

    Two vectors link when their labels are equal and not null, they have the same number of components, and their
    cosine in double precision is at least ``cosine``. Vectors that are null, empty or zero, or hold null or
    non-finite components, link with nothing. ``n_links`` counts other rows, so repeated rows link with each other;
    ``component_id`` is the smallest id that links reach, ``kept`` says that it is the row's own. Null ids take part and
    are not kept. Other columns are ignored; an empty table gives no rows.

    ``pivots`` bounds the sample of points that cells form around; it changes the plan, never the result.
    """
    v = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), v.alias("v"))
    sound = (
        F.col("label").isNotNull()
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("v", lambda c: c != 0)
    )
    identity = F.concat(F.hex(F.xxhash64("label", "v")), F.hex(F.xxhash64(F.lit(1), "v", "label")))
    rows = rows.select("id", "label", "v", F.when(F.coalesce(sound, F.lit(False)), identity).alias("node"))
    points = rows.where("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("first")
    )
    points = settled(points.withColumn("space", F.xxhash64("label", F.size("v"))), "vectors-points")
    found = settled(_tile_pairs(points, cosine, tile_rows, pivots), "vectors-links")

    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    reached = components(found.select("node", "root"), "node", "root", "vectors")
    named = points.join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    result = named.join(names, "root").join(counts, "node", "left")
    result = result.select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "node").join(result, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _pivots(points: DataFrame, tile_rows: int, most: int) -> dict[int, np.ndarray]:
    """For each label and length a few points, at most ``most`` in all; the choice depends on their hashes only."""
    sizes = points.groupBy("space").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows)
    sizes = sizes.orderBy(F.desc("n"), "space").limit(most // 2).collect()
    total = sum(r["n"] for r in sizes)
    if not total:
        return {}
    share = min(1.0 / tile_rows, most / 2 / total)
    spark = points.sparkSession
    chances = spark.createDataFrame([(r["space"], max(share, 1.0 / r["n"])) for r in sizes], "space bigint, p double")
    hashed = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = points.join(F.broadcast(chances), "space").where(hashed < F.col("p")).select("space", "v", "node")
    out: dict[int, list] = {}
    for r in taken.orderBy("node").limit(most).collect():
        out.setdefault(r["space"], []).append(r["v"])
    return {k: unit(x) for k, x in out.items()}


def _tile_pairs(points: DataFrame, cosine: float, tile_rows: int, most: int) -> DataFrame:
    spark, reach = points.sparkSession, math.sqrt(max(2.0 - 2.0 * cosine, 0.0))
    pivots = _pivots(points, tile_rows, most)

    def assign(batch: dict[str, list]) -> dict[str, list]:
        cell, far = [0] * len(batch["space"]), [2.0] * len(batch["space"])
        by_space: dict[int, list[int]] = {}
        for i, s in enumerate(batch["space"]):
            if s in pivots:
                by_space.setdefault(s, []).append(i)
        for s, at in by_space.items():
            d = distances(unit([batch["v"][i] for i in at]), pivots[s])
            for i, c, f in zip(at, d.argmin(axis=1).tolist(), d.min(axis=1).tolist()):
                cell[i], far[i] = c, f
        return {**{k: batch[k] for k in ("space", "node", "copies", "v")}, "cell": cell, "far": far}

    placed = by_batch(
        points.select("space", "node", "copies", "v"), assign, "space bigint, node string, copies bigint, v array<double>, cell int, far double"
    )
    placed = settled(placed, "vectors-cells")
    cells = placed.groupBy("space", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    tiles = cells.withColumn("tiles", F.ceil(F.col("n") / tile_rows).cast("int"))
    # Cells of spaces with pivots are at most as many as pivots; other spaces are one cell each and pair with themselves.
    near = []
    known = tiles.where(F.col("space").isin(list(pivots))).collect() if pivots else []
    by_space: dict[int, list] = {}
    for r in known:
        by_space.setdefault(r["space"], []).append(r)
    for s, found in by_space.items():
        d = distances(pivots[s], pivots[s])
        for a in found:
            for b in found:
                if a["cell"] <= b["cell"] and d[a["cell"], b["cell"]] - a["radius"] - b["radius"] <= reach + 1e-6:
                    near.append((s, a["cell"], a["tiles"], b["cell"], b["tiles"]))
    pairs = spark.createDataFrame(near, "space bigint, ca int, ta int, cb int, tb int")
    alone = tiles.where(~F.col("space").isin(list(pivots))) if pivots else tiles
    alone = alone.select("space", F.col("cell").alias("ca"), F.col("tiles").alias("ta"), F.col("cell").alias("cb"), F.col("tiles").alias("tb"))
    pairs = alone.union(pairs)
    pairs = pairs.withColumn("ia", F.explode(F.sequence(F.lit(0), F.col("ta") - 1)))
    pairs = pairs.withColumn("ib", F.explode(F.sequence(F.lit(0), F.col("tb") - 1)))
    pairs = pairs.where("ca < cb or ia <= ib").withColumn("task", F.concat_ws("/", "space", "ca", "ia", "cb", "ib"))
    self_pair = (F.col("ca") == F.col("cb")) & (F.col("ia") == F.col("ib"))
    ends = pairs.select(
        "space", "task", F.explode(F.when(self_pair, F.array(_end("ca", "ia", 2))).otherwise(F.array(_end("ca", "ia", 0), _end("cb", "ib", 1)))).alias("e")
    ).select("space", "task", "e.*")
    tiled = placed.join(tiles.select("space", "cell", "tiles"), ["space", "cell"])
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = tiled.join(ends, ["space", "cell", "tile"]).select("task", "side", "node", "copies", "v")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        return tile_links(group, cosine)

    return rows.groupBy("task").applyInPandas(link, "node string, n bigint, root string")


def _end(cell: str, tile: str, side: int):
    return F.struct(F.col(cell).alias("cell"), F.col(tile).alias("tile"), F.lit(side).alias("side"))
