"""Embedding near-dedup by cover trees.

Unit vectors of one label at cosine COSINE or more lie within a Euclidean radius of each other.
Equal vectors are one point with a weight. Cover trees have nested levels with halving
radii, and every node its true covering radius. The first levels are those of a tree over a bounded sample of a large
label: its nodes take the points nearest to them, a node's points are dealt to blocks of bounded
size, and a point is sent to a block only if the covering radius of the block's node lets it reach
a point there. A task takes a pair of blocks, builds a cover tree for each and descends both at once, dropping node
pairs that the covering radii keep apart. What is left is checked by the cosine itself in double precision.
A task returns link counts and a spanning forest, never a list of all pairs.

Where vectors have no structure (random directions in many dimensions) no metric bound prunes above the
last levels; there pairs of blocks grow with the square of a label's rows divided by the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, mix64, stored, table

COSINE = 0.93
BLOCK = 2048
#: Labels with top nodes (the largest ones), nodes and sampled points of each at most, blocks a label needs to have any.
#: What is collected and broadcast for them is bounded by these numbers.
TOP_LABELS, TOP_NODES, TOP_SAMPLE, TOP_BLOCKS = 64, 128, 1024, 4
#: A list of labels up to this many rows is broadcast.
SMALL_ROWS = 1_000_000
#: Points looked at together for new centres; pairs of children from which a product is taken.
CENTRES, GRID = 256, 4096
#: Rows of an Arrow batch of points sent.
SENT_ROWS = 4096
#: Distance slack for rounding in the bounds; links are decided by the cosine.
SLACK = 1e-9


class CoverTree:
    """Levels of nodes over unit vectors x. level[k]: (centre row, covering radius, first
    child, end of children) with children in level[k + 1]; the last level's nodes are points."""

    def __init__(self, x: np.ndarray):
        self.x = x
        root_d = np.linalg.norm(x - x[0], axis=1)
        centres, members = np.array([0]), [np.arange(len(x))]
        self.levels: list[dict] = []
        radius = 1.0
        dist = [root_d]
        while True:
            self.levels.append({"centre": centres, "radius": np.array([d.max() if len(d) else 0.0 for d in dist])})
            if all(len(m) == 1 for m in members):
                break
            new_c, new_m, new_d, first = [], [], [], [0]
            for m, d in zip(members, dist):
                for c, mm, dd in self._split(m, d, radius):
                    new_c.append(c)
                    new_m.append(mm)
                    new_d.append(dd)
                first.append(len(new_c))
            self.levels[-1]["first"] = np.array(first)
            centres, members, dist, radius = np.array(new_c), new_m, new_d, radius / 2

    def _split(self, m: np.ndarray, d: np.ndarray, radius: float):
        """A net of m at this radius: the parent's own centre is the first child (nesting);
        points further than the radius from every child so far found children of their own."""
        if len(m) == 1:
            return [(m[0], m, d)]
        if radius < 1e-6:  # what is closer than this stays apart at once
            return [(k, np.array([k]), np.zeros(1)) for k in m]
        best, owner, nets = d.copy(), np.zeros(len(m), np.int64), [m[d.argmin()]]
        while True:
            left = np.flatnonzero(best > radius)[:CENTRES]
            if not len(left):
                break
            # points of a handful that are apart from each other become centres together
            x = self.x[m[left]]
            apart = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T))) > radius
            free, chosen = np.ones(len(left), bool), []
            for k in range(len(left)):
                if free[k]:
                    chosen.append(k)
                    free &= apart[k]
            new = left[chosen]
            dd = np.sqrt(np.maximum(0, 2 - 2 * (self.x[m] @ self.x[m[new]].T)))
            dd[new, np.arange(len(new))] = 0
            near = dd.argmin(axis=1)
            dist = dd[np.arange(len(m)), near]
            closer = dist < best
            best[closer], owner[closer] = dist[closer], len(nets) + near[closer]
            nets += m[new].tolist()
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(nets) + 1))
        return [(c, m[order[i:j]], best[order[i:j]]) for c, i, j in zip(nets, cuts, cuts[1:]) if j > i]


def _children(t: CoverTree, k: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the parent in nodes, child) pairs for nodes of level k."""
    first = t.levels[k]["first"]
    n = first[nodes + 1] - first[nodes]
    parent = np.repeat(np.arange(len(nodes)), n)
    return parent, np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[nodes], n)


def dual_pairs(a: CoverTree, b: CoverTree, reach: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (of a.x, of b.x) at most reach apart, by descending both trees."""
    last_a, last_b = len(a.levels) - 1, len(b.levels) - 1
    stack = [(0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64), False)]
    while stack:
        i, j, p, q, checked = stack.pop()
        la, lb = a.levels[i], b.levels[j]
        if same and i == j:
            up = p <= q
            p, q = p[up], q[up]
        if not checked:
            keep = np.empty(len(p), bool)
            for s in range(0, len(p), 1 << 16):  # distances of node pairs, a slice at a time
                e = slice(s, s + (1 << 16))
                dots = np.einsum("ij,ij->i", a.x[la["centre"][p[e]]], b.x[lb["centre"][q[e]]])
                keep[e] = np.sqrt(np.maximum(0, 2 - 2 * dots)) <= reach + la["radius"][p[e]] + lb["radius"][q[e]] + SLACK
            p, q = p[keep], q[keep]
        if not len(p):
            continue
        if i == last_a and j == last_b:
            yield la["centre"][p], lb["centre"][q]
            continue
        ni, nj = min(i + 1, last_a), min(j + 1, last_b)
        ca = np.diff(la["first"])[p] if i < last_a else np.ones(len(p), np.int64)
        cb = np.diff(lb["first"])[q] if j < last_b else np.ones(len(p), np.int64)
        wide = ca * cb >= GRID
        for x, y in zip(p[wide].tolist(), q[wide].tolist()):  # two wide nodes: one matrix product
            xs = np.arange(*la["first"][[x, x + 1]]) if i < last_a else np.array([x])
            ys = np.arange(*lb["first"][[y, y + 1]]) if j < last_b else np.array([y])
            right, rb = b.x[b.levels[nj]["centre"][ys]].T, b.levels[nj]["radius"][ys]
            for s in range(0, len(xs), 512):
                part = xs[s : s + 512]
                bound = reach + SLACK + a.levels[ni]["radius"][part][:, None] + rb[None]
                u, v = np.nonzero(a.x[a.levels[ni]["centre"][part]] @ right >= 1 - bound * bound / 2)
                if len(u):
                    stack.append((ni, nj, part[u], ys[v], True))
        p, q = p[~wide], q[~wide]
        for s in range(0, len(p), 4096):
            pp, qq = p[s : s + 4096], q[s : s + 4096]
            if i < last_a:
                at, pp = _children(a, i, pp)
                qq = qq[at]
            if j < last_b:
                at, qq = _children(b, j, qq)
                pp = pp[at]
            stack.append((ni, nj, pp, qq, False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, exactly, so that no square overflows or vanishes."""
    most = np.abs(vectors).max(axis=1, keepdims=True)
    return np.ldexp(vectors, -np.frexp(most)[1])


def top_nodes(vectors: np.ndarray, most: int = TOP_NODES) -> np.ndarray:
    """Centres of the deepest cover tree level with so many nodes at most, as unit vectors."""
    x = scaled(vectors)
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    levels = [v["centre"] for v in CoverTree(x).levels if len(v["centre"]) <= most]
    return x[levels[-1]]


def distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    x = scaled(vectors)
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ centres.T)))


def _rows_by_label(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(label with dimension, rows, their vectors) of a batch with columns kind and v."""
    kinds = b.column("kind").dictionary_encode()
    flat, ends = b.column("v").flatten().to_numpy(), np.asarray(b.column("v").offsets)
    ends = ends - ends[0]
    for k, kind in enumerate(kinds.dictionary.to_pylist()):
        at = np.flatnonzero(np.asarray(kinds.indices) == k)
        yield kind, at, np.stack([flat[ends[i] : ends[i + 1]] for i in at])


def _measure(nodes):
    """Rows (kind, node, n, radius): how many points of a batch are nearest to each node, and how far."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            out: list[tuple] = []
            for kind, _, v in _rows_by_label(b):
                d = distances(v, nodes.value[kind])
                near = d.argmin(axis=1)
                close = d <= d.min(axis=1, keepdims=True) + SLACK  # nearest, were it rounded otherwise
                for c in np.flatnonzero(close.any(axis=0)).tolist():
                    out.append((kind, c, int((near == c).sum()), float(d[close[:, c], c].max())))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.float64()))], ["kind", "node", "n", "radius"])

    return run


def _send(nodes, reach: float):
    """Rows (pair, id, v, w, block, other): each point for each pair of its block and a block whose
    node it may reach. Blocks of a label are numbered node by node."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            ids, m = b.column("id").to_numpy(), b.column("m").to_numpy()
            deal = mix64(ids.view(np.uint64) + np.uint64(0x7F4A7C15))
            row, own, other, names = [], [], [], []
            for kind, at, v in _rows_by_label(b):
                if kind in nodes.value:
                    centres, radius, blocks = nodes.value[kind]
                    d = distances(v, centres)
                    node = d.argmin(axis=1)
                    may = d <= radius[None] + reach + SLACK
                    may[np.arange(len(at)), node] = True
                else:
                    blocks, node, may = np.array([m[at[0]]]), np.zeros(len(at), np.int64), np.ones((len(at), 1), bool)
                first = np.cumsum(blocks) - blocks
                mine = first[node] + (deal[at] % blocks[node].astype(np.uint64)).astype(np.int64)
                i, j = np.nonzero(np.repeat(may, blocks, axis=1))
                row.append(at[i])
                own.append(mine[i])
                other.append(j)
                names += [f"{kind}/{x}/{y}" for x, y in zip(np.minimum(mine[i], j).tolist(), np.maximum(mine[i], j).tolist())]
            if not row:
                continue
            take = pa.array(np.concatenate(row))
            own, other = np.concatenate(own), np.concatenate(other)
            for s in range(0, len(take), SENT_ROWS):
                e = slice(s, s + SENT_ROWS)
                part = take[s : s + SENT_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[e]), b.column("id").take(part), b.column("v").take(part), b.column("w").take(part), pa.array(own[e], pa.int32()), pa.array(other[e], pa.int32())],
                    ["pair", "id", "v", "w", "block", "other"],
                )

    return run


def block_links(ids: np.ndarray, vectors: np.ndarray, block: np.ndarray, weight: np.ndarray, cosine: float):
    """(id, links, parent) rows of one pair of blocks (or one block with itself)."""
    vectors = scaled(vectors)
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    unit = vectors / norm[:, None]
    names = np.unique(block)
    one = np.flatnonzero(block == names[0])
    two = np.flatnonzero(block == names[-1])
    same = len(names) == 1
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-7
    ta = CoverTree(unit[one])
    tb = ta if same else CoverTree(unit[two])
    links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for p, q in dual_pairs(ta, tb, reach, same):
        p, q = one[p], two[q]
        if same:
            p, q = np.minimum(p, q)[p != q], np.maximum(p, q)[p != q]
        near = np.einsum("ij,ij->i", vectors[p], vectors[q]) / (norm[p] * norm[q]) >= cosine
        p, q = p[near], q[near]
        np.add.at(links, p, weight[q])
        np.add.at(links, q, weight[p])
        for x, y in zip(p.tolist(), q.tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    at = np.flatnonzero(links)
    return ids[at], links[at], ids[[root(k) for k in at]] if len(at) else ids[:0]


_NO_LINKS = pa.table({k: pa.array([], pa.int64()) for k in ("id", "links", "parent")})


def _task(cosine: float):
    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        v = np.array(t.column("v").to_pylist(), np.float64)[order]
        block, other = t.column("block").to_numpy()[order], t.column("other").to_numpy()[order]
        if block[0] != other[0] and (block == block[0]).all():  # nothing on the other side may reach these
            return _NO_LINKS
        got = block_links(ids[order], v, block, t.column("w").to_numpy()[order], cosine)
        return pa.table({"id": pa.array(got[0], pa.int64()), "links": pa.array(got[1], pa.int64()), "parent": pa.array(got[2], pa.int64())})

    return run


def sent(points: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """points (label, v, id, w) -> (pair, id, v, w, block, other): which point goes to which pair of blocks.
    Any two points of a label at `cosine` or more meet in exactly one pair."""
    spark = points.sparkSession
    rows = points.select(F.concat_ws("/", "label", F.size("v")).alias("kind"), "id", "v", "w")
    m = F.ceil(F.col("n") / block).cast("int").alias("m")
    sizes = stored(rows.groupBy("kind").agg(F.count("*").alias("n")).where(F.col("n") > block).select("kind", "n", m), "emb-sizes")
    top = sizes.where(F.col("m") >= TOP_BLOCKS).orderBy(F.desc("n"), "kind").limit(TOP_LABELS).collect()
    nodes: dict[str, np.ndarray] = {}
    if top:
        rate = F.lit(0)
        for r in top:
            rate = F.when(F.col("kind") == r.kind, min(1_000_000, TOP_SAMPLE * 1_000_000 // r.n)).otherwise(rate)
        sample = rows.where(F.pmod(F.xxhash64("id", F.lit("top")), F.lit(1_000_000)) < rate).select("kind", "v").toArrow()  # TOP_LABELS x TOP_SAMPLE, about
        for kind, _, v in (x for b in sample.combine_chunks().to_batches() for x in _rows_by_label(b)):
            centres = top_nodes(v)
            if len(centres) > 1:
                nodes[kind] = centres
    held = {}
    if nodes:
        mine = rows.where(F.col("kind").isin(list(nodes))).select("kind", "v")
        found = mine.mapInArrow(_measure(spark.sparkContext.broadcast(nodes)), "kind string, node int, n long, radius double")
        got = found.groupBy("kind", "node").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()  # TOP_LABELS x TOP_NODES at most
        for kind, centres in nodes.items():
            n, radius = np.zeros(len(centres), np.int64), np.full(len(centres), -np.inf)
            for r in got:
                if r.kind == kind:
                    n[r.node], radius[r.node] = r.n, r.radius
            held[kind] = centres, radius, -(-n // block)
    known = sizes.select("kind", "m")
    known = F.broadcast(known) if known.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else known
    counted = rows.join(known, "kind", "left").select("kind", "id", "v", "w", F.coalesce("m", F.lit(1)).alias("m"))
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-7
    return counted.mapInArrow(_send(spark.sparkContext.broadcast(held), reach), "pair string, id long, v array<double>, w long, block int, other int")


def near_vectors(rows: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of rows (vec_id, embedding, label).

    Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite
    components, have no links and are their own components (a null vec_id stays null, kept). Vectors of different
    lengths never link; a cosine of exactly the threshold links. Rows that repeat a vec_id count as vectors of their own. An empty table gives no rows.
    """
    v = F.col("embedding").cast("array<double>")
    base = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    ok = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine, F.lit(False))
    base = base.withColumn("v", F.when(ok, F.transform("v", lambda x: x + 0.0)))
    # -0.0 + 0.0 is 0.0, so equal vectors have equal bytes
    points = stored(
        base.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")), "emb-points"
    )
    found = stored(sent(points, cosine, block).groupBy("pair").applyInArrow(_task(cosine), "id long, links long, parent long"), "emb-links")
    comps = connected_components(found.select(F.col("id").alias("src"), F.col("parent").alias("dst")))
    count = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "lid")
    named = points.join(count, F.col("id") == F.col("lid"), "left").join(comps.withColumnRenamed("id", "cid"), F.col("id") == F.col("cid"), "left")
    named = named.select(F.col("label").alias("l"), F.col("v").alias("pv"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("comp", "id").alias("comp"))
    out = base.join(named, (F.col("label") == F.col("l")) & (F.col("v") == F.col("pv")), "left")
    comp = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
