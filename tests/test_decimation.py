import heapq

import numpy as np
import pytest

from wayfold.operators import decimation

RNG = np.random.default_rng(13)


def grid(n, z):
    place = np.array([(i / 10, j / 10, z(i, j)) for i in range(n) for j in range(n)], float)
    faces = [(a, a + n, a + n + 1) if h else (a, a + n + 1, a + 1) for i in range(n - 1) for j in range(n - 1) for h in (0, 1) for a in [i * n + j]]
    return place, np.array(faces)


def frames(spark, place, faces):
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(place)], "vid long, x double, y double, z double").repartition(3)
    f = spark.createDataFrame([(i, *map(int, t)) for i, t in enumerate(faces)], "fid long, a long, b long, c long").repartition(3)
    return v, f


def planes(place, faces):
    """The forms of all vertices by plain loops, borders included."""
    q, uses = np.zeros((len(place), 4, 4)), {}
    for f in faces:
        a, b, c = place[f]
        n = np.cross(b - a, c - a)
        n = n / np.linalg.norm(n)
        p = np.append(n, -n @ a)
        for v in f:
            q[v] += np.outer(p, p)
        for u, v in ((0, 1), (1, 2), (2, 0)):
            uses.setdefault(tuple(sorted((f[u], f[v]))), []).append(n)
    for (u, v), normals in uses.items():
        if len(normals) == 1:
            n = np.cross(place[v] - place[u], normals[0])
            n = n / np.linalg.norm(n)
            p = np.append(n, -n @ place[u])
            q[u] += np.outer(p, p)
            q[v] += np.outer(p, p)
    return q


def by_heap(place, faces, limit):
    """One edge at a time, the cheapest first: the number of faces left."""
    place, faces = place.copy(), {i: list(f) for i, f in enumerate(faces)}
    q, around, stamp = planes(place, np.array(list(faces.values()))), {}, [0] * len(place)
    for i, f in faces.items():
        for v in f:
            around.setdefault(v, set()).add(i)
    near = lambda v: {w for i in around[v] for w in faces[i]} - {v}
    flat = lambda m: np.array([[m[i, j] for i in range(4) for j in range(i, 4)]])

    def cost(u, v):
        p, c = decimation.least(flat(q[u] + q[v]), place[None, u], place[None, v])
        return c[0], p[0]

    heap = [(cost(u, v)[0], u, v, 0, 0) for u in around for v in near(u) if u < v]
    heapq.heapify(heap)
    while heap:
        c, u, v, s, t = heapq.heappop(heap)
        if c > limit:
            break
        if u not in around or v not in around or (s, t) != (stamp[u], stamp[v]):
            continue
        both = around[u] & around[v]
        rim = lambda w: any(len([i for i in around[w] if x in faces[i]]) == 1 for x in near(w))  # noqa: B023, E731
        if len(near(u) & near(v)) != len(both) or len(both) > 2 or (len(both) == 2 and rim(u) and rim(v)):
            continue
        _, to = cost(u, v)
        normal = lambda pts: np.cross(pts[1] - pts[0], pts[2] - pts[0])
        bad = False
        for i in (around[u] | around[v]) - both:
            x = normal([place[w] for w in faces[i]])
            y = normal([to if w in (u, v) else place[w] for w in faces[i]])
            bad |= x @ y <= 0.1 * np.linalg.norm(x) * np.linalg.norm(y)
        if bad:
            continue
        place[u], q[u] = to, q[u] + q[v]
        for i in both:
            for w in faces.pop(i):
                around[w].discard(i)
        for i in around.pop(v):
            faces[i] = [u if w == v else w for w in faces[i]]
            around[u].add(i)
        stamp[u] += 1
        for w in near(u):
            a, b = min(u, w), max(u, w)
            heapq.heappush(heap, (cost(a, b)[0], a, b, stamp[a], stamp[b]))
    return len(faces)


def test_forms_are_sums_of_planes(spark):
    place, faces = grid(5, lambda i, j: 0.02 * ((3 * i + 5 * j) % 7))
    got = {r.vid: r for r in decimation.forms(*reversed(frames(spark, place, faces))).collect()}
    want = planes(place, faces)
    for v in range(25):
        assert [got[v][c] for c in decimation.FORM] == pytest.approx([want[v][i, j] for i in range(4) for j in range(i, 4)])


def check(place, faces, v, f, limit, worst):
    """The result is a mesh of the kept vertices, no contraction cost more than allowed, and the surface stays near."""
    vertices = {r.vid: np.array([r.x, r.y, r.z]) for r in v.collect()}
    rows = f.collect()
    assert all(x in vertices for r in rows for x in (r.a, r.b, r.c)) and {x for r in rows for x in (r.a, r.b, r.c)} == set(vertices)
    assert all(len({r.a, r.b, r.c}) == 3 for r in rows) and len({frozenset((r.a, r.b, r.c)) for r in rows}) == len(rows)
    assert worst <= limit
    sides = {}
    for r in rows:
        for e in ((r.a, r.b), (r.b, r.c), (r.c, r.a)):
            sides[tuple(sorted(e))] = sides.get(tuple(sorted(e)), 0) + 1
    assert max(sides.values()) <= 2
    for r in v.collect():  # the summed form at each vertex is within the bound: no removed plane is farther than the tolerance
        m, p = np.zeros((4, 4)), np.array([r.x, r.y, r.z, 1])
        for k, (i, j) in enumerate((i, j) for i in range(4) for j in range(i, 4)):
            m[i, j] = m[j, i] = r[decimation.FORM[k]]
        assert p @ m @ p <= limit + 1e-12
    return len(rows)


@pytest.mark.parametrize("block", [8192, 60])
def test_against_one_heap(spark, monkeypatch, block):
    monkeypatch.setattr(decimation, "BLOCK", block)
    place, faces = grid(21, lambda i, j: 0.3 * np.sin(i / 6) * np.cos(j / 7))
    v, f, worst = decimation.decimated(*frames(spark, place, faces), 0.02)
    left = check(place, faces, v, f, 0.02**2, worst)
    plain = by_heap(place, faces, 0.02**2)
    assert left < len(faces) / 3 and left <= 1.35 * plain + 10


def test_flat_ground_and_spikes(spark, monkeypatch):
    monkeypatch.setattr(decimation, "BLOCK", 100)
    place, faces = grid(17, lambda i, j: 0.0)
    place = np.vstack([place, [[0, 0, 50.0]]])
    v, f, worst = decimation.decimated(*frames(spark, place, np.vstack([faces, [[0, 1, 289], [40, 41, 289]]])), 0.01)
    left = check(place, faces, v, f, 1e-4, worst)
    corners = {(0.0, 0.0), (0.0, 1.6), (1.6, 0.0), (1.6, 1.6)}
    assert left <= len(faces) / 5 and corners <= {(round(r.x, 6), round(r.y, 6)) for r in v.collect()} and all(abs(r.z) < 0.02 for r in v.collect())


def test_sharp_shapes_and_nothing_to_do(spark):
    place, faces = grid(6, lambda i, j: RNG.uniform(0, 5))
    v, f, worst = decimation.decimated(*frames(spark, place, faces), 0.01, spike=None)
    assert (v.count(), f.count(), worst) == (36, 50, 0.0)
    v, f, worst = decimation.decimated(*(x.limit(0) for x in frames(spark, place, faces)))
    assert (v.count(), f.count(), worst) == (0, 0, 0.0)


def test_a_hole_of_three_edges_stays():
    place = np.array([(0, 0, 0), (1, 0, 0), (0.5, 1, 0), (0.5, -1, 0), (1.5, 1, 0), (-0.5, 1, 0.0)])
    ring = np.array([(0, 1, 3), (1, 2, 4), (2, 0, 5)])
    form = np.zeros((6, 10))
    form[3:, decimation.FORM.index("ww")] = 9.0  # only the hole's edges cost nothing
    _, _, after, alive, worst = decimation.contracted(place, form, ring, 1.0)
    assert alive.all() and (after == ring).all() and worst == 0
