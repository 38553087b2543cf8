"""Decimation of a mesh to an error bound, by quadrics of the planes around each vertex.

A vertex carries the sum of the squared distances to the planes of its own faces (and, at a border, to planes that stand on it), as a
symmetric 4 x 4 form. Contracting an edge adds both ends' forms; its cost is the sum's value at the place where this is least. Edges whose
cost is at most tolerance^2 are contracted, cheapest first, until none is left.

The mesh is cut into blocks by medians of a bounded sample of vertices; every block is a task's work. A vertex may move if
all faces around its neighbours lie in the block, so blocks never touch the same face. Within a block whole sets of edges are contracted at once: those
that are cheapest among all edges of their ends' neighbours, and so change no common face. Then the mesh is cut anew at other places, until
``quiet`` cuts in a row contract nothing.

Kept as in the input: holes, borders that aren't straight, and edges at which more than two faces meet. A contraction is refused if it would
turn a face over or join parts that only touch (a common neighbour without a common face).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.operators.spatial import keep, many

#: Vertices of a block, about; blocks as a power of two, at most; vertices of the sample for each block.
BLOCK, DEPTH, SAMPLE = 8192, 14, 32
#: The ten entries of a symmetric form over (x, y, z, 1).
FORM = ["xx", "xy", "xz", "xw", "yy", "yz", "yw", "zz", "zw", "ww"]
_AT = [(i, j) for i in range(4) for j in range(i, 4)]
_VERTEX = ", ".join(["vid long", *(f"{c} double" for c in "xyz"), *(f"{c} double" for c in FORM)])


def with_corners(faces: DataFrame, vertices: DataFrame, columns: list[str]) -> DataFrame:
    """Faces (fid, a, b, c) with columns of their corners' vertices, named a<column>, b<column> and c<column>."""
    for k in "abc":
        faces = faces.join(many(vertices.select(F.col("vid").alias(k), *(F.col(c).alias(k + c) for c in columns))), k)
    return faces


def forms(faces: DataFrame, vertices: DataFrame, border: float = 1.0) -> DataFrame:
    """The vertices (vid, x, y, z) that faces use, with the sums of their faces' forms; a border edge adds a plane of weight ``border``."""
    rows = with_corners(faces.select("fid", "a", "b", "c"), vertices, ["x", "y", "z"])
    corner = lambda k: [F.col(k + c) for c in "xyz"]
    n = g.cross(g.minus(corner("b"), corner("a")), g.minus(corner("c"), corner("a")))
    rows = rows.withColumns({f"n{c}": v for c, v in zip("xyz", n, strict=True)}).withColumn("_s", g.norm([F.col(f"n{c}") for c in "xyz"])).where("_s > 0")
    rows = rows.withColumns({f"n{c}": F.col(f"n{c}") / F.col("_s") for c in "xyz"})

    def of(plane: list, at: list, weight: float) -> list:
        """A plane's form from its unit normal and a point of it."""
        v = [*plane, -g.dot(plane, at)]
        return [(weight * v[i] * v[j]).alias(name) for name, (i, j) in zip(FORM, _AT, strict=True)]

    normal = [F.col(f"n{c}") for c in "xyz"]
    flat = rows.select(F.explode(F.array("a", "b", "c")).alias("vid"), *of(normal, corner("a"), 1.0))
    side = lambda u, v: F.struct(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), *(F.when(F.col(u) <= F.col(v), F.col(k + c)).otherwise(F.col(m + c)).alias(o + c) for o, k, m in (("p", u, v), ("q", v, u)) for c in "xyz"))
    sides = rows.select(*normal, F.inline(F.array(side("a", "b"), side("b", "c"), side("c", "a"))))
    names = [f"{o}{c}" for o in "pqn" for c in "xyz"]
    single = sides.groupBy("u", "v").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in names)).where("_n = 1")
    p, q = ([F.col(o + c) for c in "xyz"] for o in "pq")
    up = g.cross(g.minus(q, p), normal)
    single = single.withColumns({f"_u{c}": v for c, v in zip("xyz", up, strict=True)}).withColumn("_l", g.norm([F.col(f"_u{c}") for c in "xyz"])).where("_l > 0")
    standing = single.select(F.explode(F.array("u", "v")).alias("vid"), *of([F.col(f"_u{c}") / F.col("_l") for c in "xyz"], p, border))
    sums = flat.unionAll(standing).groupBy("vid").agg(*(F.sum(c).alias(c) for c in FORM))
    return many(vertices.select("vid", "x", "y", "z")).join(sums, "vid")


def least(q: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) where each form (n, 10) is least, or at the best of the ends and their middle where it has no such place near them."""
    m = np.zeros((len(q), 4, 4))
    for k, (i, j) in enumerate(_AT):
        m[:, i, j] = m[:, j, i] = q[:, k]
    a, b = m[:, :3, :3], -m[:, :3, 3]
    good = np.linalg.det(a) > 1e-9 * np.maximum(np.trace(a, axis1=1, axis2=2), 1e-300) ** 3
    best = (u + v) / 2
    if good.any():
        found = np.linalg.solve(a[good], b[good][:, :, None])[:, :, 0]
        near = np.linalg.norm(found - best[good], axis=1) <= 2 * np.linalg.norm((u - v)[good], axis=1)
        best[np.flatnonzero(good)[near]] = found[near]
    places = np.stack([best, (u + v) / 2, u, v])
    whole = np.concatenate([places, np.ones((*places.shape[:2], 1))], axis=2)
    values = np.maximum(np.einsum("kni,nij,knj->kn", whole, m, whole), 0)
    k = values.argmin(0)
    return places[k, np.arange(len(q))], values[k, np.arange(len(q))]


def contracted(place: np.ndarray, form: np.ndarray, faces: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Contract a block: (place, form, faces, alive vertices, greatest cost). Corners of -1 are outside and hold their face's vertices still."""
    n = len(place)
    place, form, faces, alive, worst = place.copy(), form.copy(), faces.copy(), np.ones(n, bool), 0.0
    still = np.zeros(n, bool)
    out = faces[(faces < 0).any(1)]
    still[out[out >= 0]] = True
    inner = (faces >= 0).all(1)
    # a vertex with a neighbour that touches the outside holds still as well: that neighbour's faces are not all here
    fixed = still.copy()
    fixed[faces[inner][still[faces[inner]].any(1)].ravel()] = True
    refused = np.zeros(0, np.int64)
    while True:
        own = faces[(faces >= 0).all(1)]
        sides = np.sort(np.concatenate([own[:, [0, 1]], own[:, [1, 2]], own[:, [2, 0]]]), axis=1)
        key, shared = np.unique(sides[:, 0].astype(np.int64) * n + sides[:, 1], return_counts=True)
        u, v = key // n, key % n
        border = np.zeros(n, bool)
        border[np.concatenate([u[shared == 1], v[shared == 1]])] = True
        able = ~fixed[u] & ~fixed[v] & (shared <= 2) & ~((shared == 2) & border[u] & border[v]) & ~np.isin(key, refused)
        to, cost = np.zeros((len(u), 3)), np.full(len(u), np.inf)
        e = np.flatnonzero(able)
        if len(e):
            to[e], cost[e] = least(form[u[e]] + form[v[e]], place[u[e]], place[v[e]])
        e = np.flatnonzero(cost <= limit)
        if not len(e):
            return place, form, faces, alive, worst
        rank = np.full(len(u), len(u))
        rank[e[np.lexsort((key[e], cost[e]))]] = np.arange(len(e))
        one = np.full(n, len(u))
        np.minimum.at(one, u, rank)
        np.minimum.at(one, v, rank)
        two = one.copy()
        np.minimum.at(two, u, one[v])
        np.minimum.at(two, v, one[u])
        s = e[(rank[e] == two[u[e]]) & (rank[e] == two[v[e]])]
        # common neighbours are the far corners of common faces, and nothing else
        ends = np.concatenate([u, v]), np.concatenate([v, u])
        order = np.argsort(ends[0], kind="stable")
        near, first = ends[1][order], np.searchsorted(ends[0][order], np.arange(n + 1))
        linked = np.array([len(np.intersect1d(near[first[u[k]] : first[u[k] + 1]], near[first[v[k]] : first[v[k] + 1]], True)) == shared[k] for k in s], bool)
        # faces with one end must not turn over
        edge = np.full(n, -1)
        edge[u[s]] = edge[v[s]] = np.arange(len(s))
        of = edge[own]
        touched = np.flatnonzero((of >= 0).sum(1) == 1)
        before = place[own[touched]]
        after = np.where((of[touched] >= 0)[..., None], to[s][np.maximum(of[touched], 0)], before)
        turn = lambda p: np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
        x, y = turn(before), turn(after)
        over = (x * y).sum(1) <= 0.1 * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        turned = np.zeros(len(s), bool)
        turned[of[touched][over].max(1)] = True
        good = linked & ~turned
        refused = np.union1d(refused, key[s[~good]])
        s = s[good]
        if len(s):
            worst = max(worst, float(cost[s].max()))
            place[u[s]], form[u[s]], alive[v[s]] = to[s], form[u[s]] + form[v[s]], False
            named = np.arange(n)
            named[v[s]] = u[s]
            faces = np.where(faces >= 0, named[faces], faces)
            faces[(faces[:, 0] == faces[:, 1]) | (faces[:, 1] == faces[:, 2]) | (faces[:, 2] == faces[:, 0])] = -2  # gone
            # what was refused may be good where something has changed
            changed = np.zeros(n, bool)
            changed[u[s]] = changed[v[s]] = True
            refused = refused[~changed[refused // n] & ~changed[refused % n]]


def _cuts(sample: np.ndarray, depth: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and place of each split of an even tree; the first ones lie elsewhere at each turn."""
    axis, at, held = np.zeros(1 << depth, np.int64), np.zeros(1 << depth), {1: sample}
    share = (0.5, 0.36, 0.64, 0.43, 0.57)[turn % 5]
    for node in range(1, 1 << depth):
        own = held.pop(node)
        if len(own):
            axis[node] = np.argsort(np.ptp(own, axis=0))[-1 - (turn % 2 if node == 1 else 0)]
            at[node] = np.quantile(own[:, axis[node]], share)
        right = own[:, axis[node]] > at[node]
        held[2 * node], held[2 * node + 1] = own[~right], own[right]
    return axis, at


def decimated(vertices: DataFrame, faces: DataFrame, tolerance: float = 0.01, spike: float | None = 2.0, border: float = 1.0, quiet: int = 2) -> tuple[DataFrame, DataFrame, float]:
    """(vertices, faces, greatest cost) of the mesh (vid, x, y, z) and (fid, a, b, c) with as few vertices as ``tolerance`` allows.

    Faces with an edge over ``spike`` go first. What is left keeps its ids; vertices have their summed forms, and
    vertices without a face are left out. The greatest cost is that of any contraction, tolerance^2 at most.
    """
    if spike is not None:
        placed = with_corners(faces.select("fid", "a", "b", "c"), vertices, ["x", "y", "z"])
        faces = placed.where(g.longest_edge(*([F.col(k + c) for c in "xyz"] for k in "abc")) <= spike)
    faces = keep(faces.select(*(F.col(c).cast("long").alias(c) for c in ("fid", "a", "b", "c"))).where("a <> b AND b <> c AND c <> a"), "mesh")
    vertices = keep(forms(faces, vertices.select(F.col("vid").cast("long").alias("vid"), *(F.col(c).cast("double").alias(c) for c in "xyz")), border), "mesh")
    worst, turn, calm = 0.0, 0, 0
    while calm < quiet:
        n = vertices.count()
        if not n:
            break
        depth = min(DEPTH, max(0, math.ceil(math.log2(n / BLOCK))))
        some = vertices.select("x", "y", "z").orderBy(F.xxhash64("vid", F.lit(turn))).limit(SAMPLE << depth).toArrow()  # a bounded number
        axis, at = _cuts(np.column_stack([some.column(c).to_numpy() for c in "xyz"]), depth, turn)
        vertices, faces, done, cost = _round(vertices, faces, axis, at, depth, tolerance)
        worst, turn = max(worst, cost), turn + 1
        calm = calm + 1 if not done or not depth else 0
        if not depth:
            break  # one block has nothing left
    used = faces.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    return vertices.join(used, "vid", "left_semi"), faces, worst


def _round(vertices: DataFrame, faces: DataFrame, axis: np.ndarray, at: np.ndarray, depth: int, tolerance: float) -> tuple[DataFrame, DataFrame, int, float]:
    """Vertices, faces, contractions and greatest cost after all blocks of one cut."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.column_stack([batch.column(c).to_numpy() for c in "xyz"])
            node = np.ones(len(p), np.int64)
            for _ in range(depth):
                node = 2 * node + (p[np.arange(len(p)), axis[node]] > at[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node.astype(np.int32))], [*batch.schema.names, "block"])

    placed = keep(vertices.mapInArrow(routed, f"{_VERTEX}, block int"), "mesh")
    own = with_corners(faces, placed, ["block"])
    # a face goes to every block that has a corner of it; the first corner's keeps it
    sent = own.select("fid", "a", "b", "c", F.col("ablock").alias("home"), "ablock", "bblock", "cblock", F.explode(F.array_distinct(F.array("ablock", "bblock", "cblock"))).alias("block"))
    limit = tolerance * tolerance

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        vid = left.column("vid").to_numpy()
        order = np.argsort(vid)
        place, form = (np.column_stack([left.column(c).to_numpy() for c in names])[order] for names in ("xyz", FORM))
        vid, block = vid[order], left.column("block")[0].as_py()
        inside = np.column_stack([right.column(f"{k}block").to_numpy() == block for k in "abc"])
        ids = np.column_stack([right.column(k).to_numpy() for k in "abc"])
        corners = np.where(inside, np.searchsorted(vid, ids), -1)
        place, form, after, alive, cost = contracted(place, form, corners, limit)
        kept = np.flatnonzero((after[:, 0] != -2) & (right.column("home").to_numpy() == block))
        ids = np.where(after >= 0, vid[np.maximum(after, 0)], ids)[kept]
        live = np.flatnonzero(alive)
        n, m = len(live), len(kept)
        both = lambda a, b: pa.concat_arrays([a, b])
        cols = [both(pa.array(vid[live]), pa.array(right.column("fid").to_numpy()[kept]))]
        cols += [both(pa.array(x[live]), pa.nulls(m, pa.float64())) for x in (*place.T, *form.T)]
        cols += [both(pa.nulls(n, pa.int64()), pa.array(ids[:, k])) for k in range(3)]
        cols += [pa.array(np.repeat([len(vid) - n, 0], [n, m])), pa.array(np.repeat([cost, 0.0], [n, m]))]
        return pa.Table.from_arrays(cols, ["vid", *"xyz", *FORM, *"abc", "lost", "cost"])

    made = placed.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, f"{_VERTEX}, a long, b long, c long, lost long, cost double")
    made = keep(made, "mesh")
    after = made.where("a IS NULL").select("vid", "x", "y", "z", *FORM)
    result = made.where("a IS NOT NULL").select(F.col("vid").alias("fid"), "a", "b", "c")
    cost = made.agg(F.max("cost")).first()[0] or 0.0
    return after, result, vertices.count() - after.count(), cost
