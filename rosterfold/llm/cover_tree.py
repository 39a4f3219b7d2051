"""Near duplicates among embeddings: exact pairs above a cosine, by dual traversal of cover trees.

Vectors are compared when their labels are equal. Scaled to length 1, a cosine is a distance on
the sphere, and a pair is linked when that is at most ``sqrt(2 - 2 * threshold)``.

Equal vectors are one node. The nodes of a label are dealt into cells by the nearest of a few centres,
and a cell into blocks of about ``BLOCK`` nodes. Each block is a cover tree: nested levels
whose radii halve; a node's children are centres that cover its vectors at half its radius, its own centre first, and every
node keeps the distance of its farthest vector. Blocks whose balls are too far apart are dropped
in pairs; the others, and every block with itself, are traversed together from the roots:

- nodes whose centres are farther apart than the limit and both radii hold no pair;
- nodes whose centres and radii together stay within the limit are linked as wholes: their sizes are
  added to each other's counts, and no pair is listed;
- any other two are replaced by their children; single vectors are compared in double precision.

A pair of blocks gives counts and the edges of a forest, at most one for each vector, so
groups of near copies cost their size and not its square.

The centres come from a sample of at most ``SAMPLE`` nodes and ``SAMPLE_BYTES`` (fitted on the driver; farthest first,
the order in which a cover tree takes them). They decide only where vectors are worked on, never the
result: every vector is in a block, and every two blocks of a label are tested. Where vectors have no
clusters, as in random ones of many dimensions, no ball excludes another, and the pairs of blocks grow with the square of a label; they
are dealt over ``GRID`` by ``GRID`` squares and independent tasks.

Vectors that are null, empty, zero, or hold a null or a number that is not finite, and those without a label, are
linked with nothing, as are vectors of different lengths. Rows that repeat are separate vectors. A null id takes part, and the
smallest id of a component is one that is not null if there is any. Only the three columns named are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterfold.llm.common import blob, pin, prepare
from rosterfold.llm.components import components

#: Nodes of a block, about.
BLOCK = 2048

#: Nodes, and bytes of them, that may propose centres of cells.
SAMPLE = 8192
SAMPLE_BYTES = 1 << 22

#: Blocks whose balls one task compares with as many others.
GRID = 512

#: Radii of the levels under the root; beneath the last, each vector is a node.
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)

#: Distances this close to a bound are decided further down; cosines this close to the threshold are summed exactly.
_MARGIN = 1e-6
_CLOSE = 1e-12

#: Pairs of nodes looked at at once.
_PAIRS = 1 << 16


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    out = vectors.astype(np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


class Level:
    """Nodes of one level: node k holds the vectors ``starts[k]`` to ``starts[k + 1]``, and is centred on vector ``centres[k]``."""

    def __init__(self, starts: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> None:
        self.starts, self.centres, self.radii = starts, centres, radii

    def __len__(self) -> int:
        return len(self.centres)


def _net(distance: np.ndarray, members: np.ndarray, centre: int, radius: float) -> list[tuple[int, np.ndarray, float]]:
    """Centres among ``members`` that cover them at ``radius``, each with the members nearest to it and the farthest's distance."""
    best = distance[centre, members]
    owner = np.zeros(len(members), np.int64)
    open_ = best > radius
    centres = [centre]
    while True:
        k = int(open_.argmax())
        if not open_[k]:
            break
        near = distance[members[k], members]
        closer = near < best
        best[closer] = near[closer]
        owner[closer] = len(centres)
        open_ &= near > radius
        centres.append(int(members[k]))
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
    return [(c, members[order[i:j]], float(best[order[i:j]].max())) for c, i, j in zip(centres, cuts[:-1], cuts[1:], strict=True)]


def build(points: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """The order that puts each node's vectors together, and the levels, root first, each vector a node of the last."""
    distance = _distance(points @ points.T)
    np.fill_diagonal(distance, 0)
    nodes = [(0, np.arange(len(points)), float(distance[0].max()))]
    levels = [nodes]
    for radius in RADII:
        if all(len(members) == 1 for _, members, _ in nodes):
            break
        nodes = [child for c, members, far in nodes for child in ([(c, members, far)] if len(members) == 1 else _net(distance, members, c, radius))]
        levels.append(nodes)
    order = np.concatenate([members for _, members, _ in nodes])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    made = [
        Level(
            np.concatenate(([0], np.cumsum([len(m) for _, m, _ in found]))),
            place[[c for c, _, _ in found]],
            np.array([far for _, _, far in found]),
        )
        for found in levels
    ]
    single = np.arange(len(points) + 1)
    return order, [*made, Level(single, single[:-1], np.zeros(len(points)))]


class Block:
    """Vectors in tree order with their nodes' numbers and weights, and the tree's levels."""

    def __init__(self, raw: np.ndarray, nodes: np.ndarray, weights: np.ndarray, levels: list[Level]) -> None:
        self.raw, self.nodes, self.weights, self.levels = raw, nodes, weights, levels
        self.points = unit(raw)
        self.sums = np.concatenate(([0], np.cumsum(weights)))

    @classmethod
    def of(cls, raw: np.ndarray, nodes: np.ndarray, weights: np.ndarray) -> Block:
        order, levels = build(unit(raw))
        return cls(raw[order], nodes[order], weights[order], levels)

    def packed(self) -> dict:
        root = self.levels[0]
        return {
            "n": len(self.nodes), "block": int(self.nodes.min()), "centre": blob(self.points[root.centres[0]]), "radius": float(root.radii[0]),
            "raw": blob(self.raw), "nodes": blob(self.nodes), "weights": blob(self.weights),
            "sizes": blob(np.array([len(x) for x in self.levels])), "starts": blob(np.concatenate([x.starts for x in self.levels])),
            "centres": blob(np.concatenate([x.centres for x in self.levels])), "radii": blob(np.concatenate([x.radii for x in self.levels])),
        }

    @classmethod
    def read(cls, row: dict, kind: str) -> Block:
        sizes = np.frombuffer(row["sizes"], np.int64)
        starts, centres, radii = (np.frombuffer(row[c], t) for c, t in (("starts", np.int64), ("centres", np.int64), ("radii", np.float64)))
        levels, at = [], 0
        for k, size in enumerate(sizes.tolist()):
            levels.append(Level(starts[at + k : at + k + size + 1], centres[at : at + size], radii[at : at + size]))
            at += size
        return cls(np.frombuffer(row["raw"], kind).reshape(row["n"], -1), np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["weights"], np.int64), levels)


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the smallest label of each pair's ends to all that have either end's."""
    while len(a):
        x, y = labels[a], labels[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _exact(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    a, b = ((x.astype(np.float64) / np.abs(x).max().astype(np.float64)).tolist() for x in (a, b))
    dot, x, y = (math.fsum(p * q for p, q in zip(u, v, strict=True)) for u, v in ((a, b), (a, a), (b, b)))
    return dot / (math.sqrt(x) * math.sqrt(y)) >= threshold


class Traversal:
    """Links between two blocks, or within one: ``counts`` of each block's vectors, and ``labels`` of connected ones (first block's before the second's)."""

    def __init__(self, a: Block, b: Block | None, threshold: float) -> None:
        self.a, self.b, self.same, self.threshold = a, b or a, b is None, threshold
        self.limit = math.sqrt(2 - 2 * threshold)
        self.shift = 0 if b is None else len(a.nodes)
        self.steps = [np.zeros(len(x.nodes) + 1, np.int64) for x in (self.a, self.b)]  # differences of counts
        self.chains = np.zeros(self.shift + len(self.b.nodes) + 1, np.int64)  # differences: vectors linked to the next one
        self.labels = np.arange(self.shift + len(self.b.nodes))
        depth = max(len(self.a.levels), len(self.b.levels))
        levels_a, levels_b = ([*x.levels[:-1], *[x.levels[-1]] * (depth - len(x.levels) + 1)] for x in (self.a, self.b))
        pairs = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for k in range(depth - 1):
            final = k == depth - 2
            found = [
                self._look(u, v, cosine, levels_a[k + 1], levels_b[k + 1], final)
                for u, v, cosine in self._children(*pairs, levels_a[k], levels_a[k + 1], levels_b[k], levels_b[k + 1])
            ]
            pairs = tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            if not len(pairs[0]):
                break
        linked = np.flatnonzero(np.cumsum(self.chains)[:-1])
        _merge(self.labels, linked, linked + 1)
        self.counts = [np.cumsum(x)[:-1] for x in self.steps]
        if self.same:
            self.counts = [self.counts[0] + self.counts[1]]

    def _children(self, u, v, above_a: Level, below_a: Level, above_b: Level, below_b: Level):
        """Pairs of children of the pairs (u, v), with the cosines of their centres, a bounded number at once."""
        if not len(u):
            return
        first_a, first_b = (np.searchsorted(below.starts, above.starts) for above, below in ((above_a, below_a), (above_b, below_b)))
        size_a, size_b = np.diff(first_a), np.diff(first_b)
        total = int((size_a[u] * size_b[v]).sum())
        left, right = self.a.points[below_a.centres], self.b.points[below_b.centres]
        if total * 8 > len(below_a) * len(below_b):  # most pairs: as a matrix
            wanted = np.zeros((len(above_a), len(above_b)), bool)
            wanted[u, v] = True
            own_a, own_b = (np.repeat(np.arange(len(s)), s) for s in (size_a, size_b))
            for at in range(0, len(below_a), 256):
                cosine = left[at : at + 256] @ right.T
                good = wanted[own_a[at : at + 256]][:, own_b]
                if self.same:
                    good &= np.arange(at, at + len(cosine))[:, None] <= np.arange(len(below_b))
                i, j = np.nonzero(good & (_distance(cosine) <= self.limit + _MARGIN + below_a.radii[at : at + 256, None] + below_b.radii))
                yield i + at, j, cosine[i, j]
            return
        owner = np.repeat(np.arange(len(u)), size_a[u])
        x = np.arange(len(owner)) - np.repeat(np.cumsum(size_a[u]) - size_a[u], size_a[u]) + first_a[u][owner]
        each = size_b[v][owner]
        ends = np.cumsum(each)
        at = 0
        while at < len(x):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
            n = each[at:stop]
            i = np.repeat(x[at:stop], n)
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_b[v][owner[at:stop]], n)
            if self.same:
                i, j = i[i <= j], j[i <= j]
            yield i, j, np.einsum("ij,ij->i", left[i], right[j])
            at = stop

    def _look(self, u, v, cosine, level_a: Level, level_b: Level, final: bool):
        """Link what is linked for sure; the pairs that have to be looked into."""
        if final:
            good = cosine >= self.threshold
            for k in np.flatnonzero(np.abs(cosine - self.threshold) < _CLOSE).tolist():
                good[k] = _exact(self.a.raw[u[k]], self.b.raw[v[k]], self.threshold)
            if self.same:
                good &= u != v
            self._link(u[good], v[good], level_a, level_b)
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        distance, radii = _distance(cosine), level_a.radii[u] + level_b.radii[v]
        if self.same:
            distance[u == v] = 0
        whole = distance + radii <= self.limit - _MARGIN
        self._link(u[whole], v[whole], level_a, level_b)
        rest = ~whole & (distance <= self.limit + _MARGIN + radii)
        return u[rest], v[rest]

    def _link(self, u, v, level_a: Level, level_b: Level) -> None:
        """Every vector of node u with every one of node v."""
        if not len(u):
            return
        a, b, (steps_a, steps_b) = self.a, self.b, self.steps
        i, j, k, m = level_a.starts[u], level_a.starts[u + 1], level_b.starts[v], level_b.starts[v + 1]
        own = (u == v) if self.same else np.zeros(len(u), bool)
        for steps, start, stop, added in ((steps_a, i, j, b.sums[m] - b.sums[k]), (steps_b, k, m, np.where(own, 0, a.sums[j] - a.sums[i]))):
            np.add.at(steps, start, added)
            np.add.at(steps, stop, -added)
        for s, e in zip(i[own].tolist(), j[own].tolist(), strict=True):  # not a vector with itself
            steps_a[s:e] -= a.weights[s:e]
            steps_a[s + 1 : e + 1] += a.weights[s:e]
        for start, stop in ((i, j), (k + self.shift, m + self.shift)):
            np.add.at(self.chains, start, 1)
            np.add.at(self.chains, stop - 1, -1)
        _merge(self.labels, i, k + self.shift)


_FOUND = "kind int, node bigint, n bigint, other bigint"


def _rows(found: Traversal) -> pa.RecordBatch:
    """Kind 0: vectors with the number of their links. Kind 1: edges of the forest."""
    blocks = [found.a] if found.same else [found.a, found.b]
    nodes, counts = np.concatenate([x.nodes for x in blocks]), np.concatenate(found.counts)
    some, ends = np.flatnonzero(counts), np.flatnonzero(found.labels != np.arange(len(found.labels)))
    both = len(some) + len(ends)
    return pa.record_batch(
        [
            pa.array(np.repeat([0, 1], [len(some), len(ends)]).astype(np.int32)),
            pa.array(np.concatenate((nodes[some], nodes[ends]))),
            pa.array(np.concatenate((counts[some], np.zeros(len(ends), np.int64)))),
            pa.array(np.concatenate((np.zeros(len(some), np.int64), nodes[found.labels[ends]]))) if both else pa.array([], pa.int64()),
        ],
        names=["kind", "node", "n", "other"],
    )


def _matrix(column) -> np.ndarray:
    """Rows of a column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _farthest_first(points: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` centres of a cover tree over ``points``."""
    chosen, far = [0], 1 - points @ points[0]
    while len(chosen) < k:
        nearest = int(far.argmax())
        if far[nearest] <= 0:
            break
        chosen.append(nearest)
        far = np.minimum(far, 1 - points @ points[nearest])
    return points[chosen]


def cells(nodes: DataFrame) -> DataFrame:
    """Add ``cell`` and ``part`` to nodes (node, weight, vector, gid, size), a table: blocks of about ``BLOCK``."""
    spark = nodes.sparkSession
    large = nodes.where(F.col("size") > BLOCK)
    longest = large.agg(F.max(F.size("vector"))).first()[0] or 1
    sample = large.select("gid", "size", "vector").orderBy(F.xxhash64("node"), "node").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * longest))))
    by_group: dict[int, list] = {}
    for row in sample.collect():
        by_group.setdefault(row.gid, []).append(row)
    centres = {
        gid: _farthest_first(unit(np.array([r.vector for r in rows])), rows[0]["size"] // BLOCK) for gid, rows in by_group.items() if rows[0]["size"] >= 2 * BLOCK
    }
    known = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            gids, cell = batch.column("gid").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for gid in np.unique(gids).tolist():
                if gid in known.value:
                    at = np.flatnonzero(gids == gid)
                    cell[at] = (unit(_matrix(batch.column("vector").take(pa.array(at)))) @ known.value[gid].T).argmax(axis=1)
            yield batch.append_column("cell", pa.array(cell))

    kind = nodes.schema["vector"].dataType.simpleString()
    dealt = nodes.mapInArrow(assign, f"node bigint, weight bigint, vector {kind}, gid bigint, size bigint, cell int") if centres else nodes.withColumn("cell", F.lit(0))
    dealt = pin(dealt)
    sizes = dealt.groupBy("gid", "cell").agg(F.expr(f"(count(1) + {BLOCK - 1}) div {BLOCK}").alias("parts"))
    return dealt.join(sizes, ["gid", "cell"]).withColumn("part", F.expr("pmod(xxhash64(node), parts)"))


def blocks(nodes: DataFrame) -> DataFrame:
    """One packed block for each (gid, cell, part)."""

    def make(table):
        made = Block.of(_matrix(table.column("vector")), table.column("node").to_numpy(), table.column("weight").to_numpy())
        return pa.Table.from_pylist([{"gid": table.column("gid")[0].as_py(), **made.packed()}])

    schema = "gid bigint, n bigint, block bigint, centre binary, radius double, raw binary, nodes binary, weights binary, sizes binary, starts binary, centres binary, radii binary"
    return pin(nodes.select("gid", "cell", "part", "node", "weight", "vector").groupBy("gid", "cell", "part").applyInArrow(make, schema))


def near_blocks(found: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of different blocks of a group whose balls may hold a linked pair."""
    reach = math.sqrt(2 - 2 * threshold) + _MARGIN
    balls = found.select("gid", "block", "centre", "radius")
    several = balls.groupBy("gid").agg(F.expr(f"(count(1) + {GRID - 1}) div {GRID}").alias("salts"), F.count(F.lit(1)).alias("many")).where("many > 1")
    salted = balls.join(several, "gid").withColumn("salt", F.expr("pmod(xxhash64(block), salts)"))
    squares = salted.withColumn("other", F.explode(F.expr("sequence(0L, salts - 1)"))).select(
        "gid", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "block", "centre", "radius"
    )

    def compare(table):
        salt, block, radius = (table.column(c).to_numpy() for c in ("salt", "block", "radius"))
        centre = np.stack([np.frombuffer(x, np.float64) for x in table.column("centre").to_pylist()])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        rows, columns = np.flatnonzero(salt == i), np.flatnonzero(salt == j)
        near = _distance(centre[rows] @ centre[columns].T) <= reach + radius[rows, None] + radius[columns]
        if i == j:
            near &= block[rows, None] < block[columns]
        x, y = np.nonzero(near)
        return pa.table({"a": block[rows[x]], "b": block[columns[y]]})

    return squares.groupBy("gid", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def links(found: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Counts and edges (see ``_rows``) of all pairs of blocks; ``kind`` is the type of the vectors' numbers."""
    columns = [c for c in found.columns if c not in ("gid", "block", "centre", "radius")]

    def within(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _rows(Traversal(Block.read(row, kind), None, threshold))

    def across(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _rows(Traversal(Block.read(row["x"], kind), Block.read(row["y"], kind), threshold))

    def side(name: str, key: str) -> DataFrame:
        return found.select(F.col("block").alias(key), F.struct(*columns).alias(name))

    pairs = near_blocks(found, threshold).join(side("x", "a"), "a").join(side("y", "b"), "b").select("x", "y")
    return pin(found.select(*columns).mapInArrow(within, _FOUND).unionByName(pairs.mapInArrow(across, _FOUND)))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    prepare(spark)
    finite = "forall(vector, x -> x IS NOT NULL AND abs(x) < double('Infinity')) AND exists(vector, x -> x <> 0)"
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label")).withColumn(
        "usable", F.coalesce(F.expr(f"label IS NOT NULL AND {finite}"), F.lit(False))
    )
    usable = rows.where("usable")
    classes = pin(
        usable.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    groups = pin(classes.groupBy("label", F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("size")).withColumn("gid", F.monotonically_increasing_id()))
    nodes = classes.withColumn("dim", F.size("vector")).join(groups, ["label", "dim"]).select("node", "weight", "vector", "gid", "size")
    kind = {"array<float>": "<f4", "array<double>": "<f8"}[rows.schema["vector"].dataType.simpleString()]
    found = links(blocks(cells(pin(nodes))), threshold, kind)

    counts = found.where("kind = 0").groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.where("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b"))
    known = classes.join(counts, "node", "left")
    if edges.isEmpty():
        known = known.withColumn("component_id", F.col("first"))
    else:
        known = known.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
        known = known.join(known.groupBy("component").agg(F.min("first").alias("component_id")), "component")
    known = known.select("label", "vector", "first", "weight", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    alone = known.where("weight = 1").select(F.col("first").alias("vec_id"), "n_links", "component_id")
    copies = usable.join(known.where("weight > 1"), ["label", "vector"]).select("vec_id", "n_links", "component_id")
    others = rows.where("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return alone.unionByName(copies).unionByName(others).withColumn("kept", F.expr("vec_id <=> component_id"))
