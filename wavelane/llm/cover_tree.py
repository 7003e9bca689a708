"""Embedding near-duplicates: all pairs of vectors within a cosine threshold, by cover trees traversed in pairs.

Valid vectors are scaled to length one and equal ones become one row with their number, so copies cost one row. Rows are dealt
to cells: each goes to the nearest of a bounded set of pivots, and a cell with many rows is dealt to blocks of bounded size. A
vector is sent to another block only if its distance to that block's pivot is within the block's covering radius plus the
link distance. In a task each block becomes a cover tree: nested levels whose radii halve, a node's children within the radius
of its level, each node with the largest distance to any vector below it. Two trees are traversed together; a pair of nodes goes
when the distance of their centres exceeds the link distance plus both covering radii. Pairs of vectors that are left are
decided by their cosine in double precision. A task returns the number of links of each vector and a spanning forest.

Cases: null and empty vectors, zero ones, and ones with a null or non-finite component link with nothing and keep their row.
Vectors of different lengths never link. Repeated rows are copies of each other. Rows without an id keep a row with no links and
no component. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wavelane.llm.common import partitions
from wavelane.llm.components import components, local_roots
from wavelane.llm.shingles import groups
from wavelane.runtime import write_through

PIVOTS = 1_024    # most pivots, so a bound of what is sent to all tasks
BLOCK = 8_192     # vectors of a block
SLACK = 1e-4      # for the rounding of 32-bit bounds; cosines in double precision decide


class CoverTree:
    """Nodes over unit vectors: a centre (row), a covering radius (largest distance to a row below) and children; 0 is the root.

    The children of a node at one level lie more than that level's radius apart; radii halve from level to level. Below the
    finest level, and where the vectors are too far apart for inner nodes to cover any, the children are single rows.
    """

    def __init__(self, vectors: np.ndarray, finest: float = 0.25):
        self.vectors = vectors.astype(np.float32)
        centres, reach, self.kids = [0], [self._far(np.arange(len(vectors)))], [None]
        open_, radius = [(0, np.arange(len(vectors)))] if len(vectors) > 1 else [], 1.0
        while open_:
            below = []
            for node, rows in open_:
                parts = self._net(rows, radius) if radius >= finest else [rows[k:k + 1] for k in range(len(rows))]
                self.kids[node] = np.arange(len(centres), len(centres) + len(parts))
                for part in parts:
                    if len(part) > 1:
                        below.append((len(centres), part))
                    centres.append(part[0])
                    reach.append(self._far(part) if len(part) > 1 else 0.0)
                    self.kids.append(None)
            open_, radius = below, radius / 2
        self.centre, self.reach = np.array(centres), np.array(reach, np.float32)
        self.leaf = np.array([k is None for k in self.kids])

    def _far(self, rows: np.ndarray) -> float:
        """From differences in double precision: 2 - 2 cos of 32-bit vectors is too coarse for near copies."""
        centre, most = self.vectors[rows[0]].astype(np.float64), 0.0
        for k in range(0, len(rows), 1_024):
            apart = self.vectors[rows[k:k + 1_024]] - centre
            most = max(most, float(np.einsum("ij,ij->i", apart, apart).max()))
        return float(np.sqrt(most))

    def _net(self, rows: np.ndarray, radius: float) -> list[np.ndarray]:
        """Centres more than ``radius`` apart in row order, each with the rows within it that no earlier centre has."""
        least, parts, left = 1 - radius * radius / 2, [], rows
        while len(left):
            # Several centres at a time: those of the first rows that are far from each other.
            head = left[:64]
            near = np.triu(self.vectors[head] @ self.vectors[head].T >= least, 1)
            chosen = []
            for k in range(len(head)):
                if not near[chosen, k].any():
                    chosen.append(k)
            fit = self.vectors[left] @ self.vectors[head[chosen]].T >= least
            first = np.where(fit.any(axis=1), fit.argmax(axis=1), -1)
            first[chosen] = np.arange(len(chosen))
            for k, c in enumerate(chosen):
                inside = np.flatnonzero(first == k)
                parts.append(left[np.concatenate(([c], inside[inside != c]))])
            sparse = (first >= 0).sum() < 2 * len(chosen)
            left = left[first < 0]
            if sparse:
                parts.extend(left[k:k + 1] for k in range(len(left)))
                break
        return parts


def _near_nodes(one: CoverTree, two: CoverTree, a: np.ndarray, b: np.ndarray, distance: float):
    """Pairs of the nodes ``a`` and ``b`` that their centres and covering radii do not rule out."""
    right, leaf_b = two.vectors[two.centre[b]].T, two.leaf[b]
    inner_b = np.flatnonzero(~leaf_b)
    for k in range(0, len(a), 512):
        part = a[k:k + 512]
        cosines = one.vectors[one.centre[part]] @ right
        close = cosines >= 1 - distance * distance / 2

        def widen(rows, columns):
            bound = distance + one.reach[part[rows]][:, None] + two.reach[b[columns]][None, :]
            close[np.ix_(rows, columns)] = cosines[np.ix_(rows, columns)] >= 1 - bound * bound / 2
        inner_a = np.flatnonzero(~one.leaf[part])
        if len(inner_a):
            widen(inner_a, np.arange(len(b)))
        if len(inner_b):
            widen(np.arange(len(part)), inner_b)
        x, y = np.nonzero(close)
        yield part[x], b[y]


def dual_traverse(one: CoverTree, two: CoverTree, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of one, of two) of single-vector node pairs that no bound prunes."""
    found_a, found_b = [], []
    left, right = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(left):
        done = one.leaf[left] & two.leaf[right]
        found_a.append(one.centre[left[done]])
        found_b.append(two.centre[right[done]])
        left, right = left[~done], right[~done]
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        starts = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1]))).tolist() if len(left) else []
        deeper = []
        for s, e in zip(starts, [*starts[1:], len(left)]):
            kids_a = left[s:s + 1] if one.leaf[left[s]] else one.kids[left[s]]
            kids_b = np.concatenate([right[k:k + 1] if two.leaf[right[k]] else two.kids[right[k]] for k in range(s, e)])
            deeper.extend(_near_nodes(one, two, kids_a, kids_b, distance + SLACK))
        left = np.concatenate([x for x, _ in deeper]) if deeper else np.zeros(0, np.int64)
        right = np.concatenate([y for _, y in deeper]) if deeper else np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def linked_pairs(one: np.ndarray, two: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact pairs between two blocks of unit vectors, or inside one (then left < right)."""
    tree = CoverTree(one)
    a, b = dual_traverse(tree, tree if two is None else CoverTree(two), float(np.sqrt(2 - 2 * cosine)))
    if two is None:
        a, b = a[a < b], b[a < b]
    other, keep = one if two is None else two, np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 16):
        keep[k:k + (1 << 16)] = np.einsum("ij,ij->i", one[a[k:k + (1 << 16)]], other[b[k:k + (1 << 16)]]) >= cosine
    return a[keep], b[keep]


def _distances(vectors, centres: list[np.ndarray]) -> np.ndarray:
    """Distances of packed unit vectors to centres; 9 where the lengths differ."""
    found = np.full((len(vectors), len(centres)), 9.0)
    held = [np.frombuffer(v, np.float64) for v in vectors]
    for dim in {len(v) for v in held}:
        rows, columns = [k for k, v in enumerate(held) if len(v) == dim], [k for k, c in enumerate(centres) if len(c) == dim]
        if columns:
            cosines = np.stack([held[k] for k in rows]) @ np.stack([centres[k] for k in columns]).T
            found[np.ix_(rows, columns)] = np.sqrt(np.maximum(2 - 2 * cosines, 0))
    return found


def _visit(cosine: float):
    def run(batches):
        for g in groups(batches, ["i", "j"]):
            vectors = [np.frombuffer(v, np.float64) for v in g["vector"]]
            lone = g["i"][0] == g["j"][0]
            for dim in sorted({len(v) for v in vectors}):
                rows = np.array([k for k, v in enumerate(vectors) if len(v) == dim])
                ones, twos = rows[g["side"][rows] == 0], rows[g["side"][rows] == 1]
                if not len(ones) or (not lone and not len(twos)):
                    continue
                a, b = linked_pairs(np.stack([vectors[k] for k in ones]), None if lone else np.stack([vectors[k] for k in twos]), cosine)
                left, right = ones[a], (ones if lone else twos)[b]
                links = np.zeros(len(vectors), np.int64)
                np.add.at(links, left, g["copies"][right])
                np.add.at(links, right, g["copies"][left])
                root, at = local_roots(len(vectors), left, right), np.flatnonzero(links)
                yield pd.DataFrame({"node": g["node"][at], "links": links[at], "peer": g["node"][root[at]]})
    return run


def near_duplicates(table: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS,
                    block: int = BLOCK) -> DataFrame:
    """key, n_links (other vectors linked directly), component_id (smallest key reachable), kept; one row per row."""
    spark = table.sparkSession
    rows = table.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    top = F.array_max(F.transform("v", F.abs))
    sound = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (top > 0), F.lit(False))

    def scale(batches):
        for batch in batches:
            out = []
            for one in batch["v"]:
                one = np.asarray(one, np.float64)
                one = one / np.abs(one).max()
                out.append((one / np.sqrt(one @ one) + 0.0).tobytes())
            yield pd.DataFrame({"key": batch["key"], "vector": out})

    usable = rows.where(F.col("key").isNotNull() & sound)
    units = write_through(usable.mapInPandas(scale, "key long, vector binary"))
    reps = write_through(units.groupBy("vector").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"))
                         .withColumn("node", F.monotonically_increasing_id()))
    n = reps.count()
    chosen = reps.orderBy(F.xxhash64("node")).limit(min(max(n // block, 1), pivots)).select("vector").collect()
    centres = spark.sparkContext.broadcast([np.frombuffer(r["vector"], np.float64) for r in chosen])  # at most ``pivots`` vectors

    def assign(batches):
        for batch in batches:
            far = _distances(batch["vector"], centres.value)
            cells = far.argmin(axis=1) if len(batch) else np.zeros(0, int)
            yield batch.assign(cell=cells, far=far[np.arange(len(batch)), cells])

    schema = "node long, copies long, vector binary, cell int, far double"
    placed = write_through(reps.select("node", "copies", "vector").mapInPandas(assign, schema))
    # Small cells are one block, large ones several: at most one per pivot and one per ``block`` vectors.
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
    layout, at = np.zeros((3, len(centres.value))), 0  # first block, blocks, and reach of each cell
    for c in sorted(cells, key=lambda c: c["cell"]):
        blocks = -(-c["n"] // block)
        layout[:, c["cell"]] = at, blocks, c["radius"] + float(np.sqrt(2 - 2 * cosine)) + SLACK
        at += blocks

    def send(batches):
        first, blocks, reach = layout
        for batch in batches:
            near = _distances(batch["vector"], centres.value) <= reach[None, :]
            home, mine, others = batch["cell"].to_numpy(), [], []
            for k, node in enumerate(batch["node"].to_numpy()):
                near[k, home[k]] = True
                mine.append(int(first[home[k]] + (node * 2_654_435_761 >> 7) % blocks[home[k]]))
                others.append(np.concatenate([np.arange(first[c], first[c] + blocks[c]) for c in np.flatnonzero(near[k])]).astype(np.int64))
            yield pd.DataFrame({"node": batch["node"], "copies": batch["copies"], "vector": batch["vector"], "mine": mine, "others": others})

    # If two vectors are within the link distance, each is within reach of the other's cell, so both go to the pair of their blocks.
    sent = placed.mapInPandas(send, "node long, copies long, vector binary, mine long, others array<long>") \
        .select("node", "copies", "vector", "mine", F.explode("others").alias("other"))
    dealt = sent.select("node", "copies", "vector", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                        (F.col("mine") > F.col("other")).cast("int").alias("side"))
    found = write_through(dealt.repartition(partitions(spark), "i", "j").sortWithinPartitions("i", "j")
                          .mapInPandas(_visit(cosine), "node long, links long, peer long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    least = linked.join(reps.select("node", "key"), "node").groupBy("root").agg(F.min("key").alias("component_id"))
    told = reps.select("vector", "node", "key", "copies").join(links, "node", "left") \
        .join(linked.join(least, "root").select("node", "component_id"), "node", "left") \
        .select("vector", F.coalesce("component_id", "key").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    valid = units.join(told, "vector").select("key", F.col("n_links").cast("long"), "component_id")
    rest = rows.where(F.col("key").isNull() | ~sound).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return valid.unionByName(rest).select(F.col("key").alias(key), "n_links", "component_id",
                                          F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
