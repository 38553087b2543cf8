"""Poses, cameras and triangles as column expressions.

A quaternion is (w, x, y, z), a rotation a list of nine columns (row by row), a point three columns. World
axes are metres with Z up; camera axes are X right, Y down, Z forward.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def norm(v: Vector) -> Column:
    return F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))


def dot(a: Vector, b: Vector) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def minus(a: Vector, b: Vector) -> Vector:
    return [x - y for x, y in zip(a, b, strict=True)]


def quaternion_to_matrix(q: Vector) -> Vector:
    """The rotation of a quaternion, which is normalised first."""
    n = norm(q)
    w, x, y, z = (c / n for c in q)
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def matrix_to_quaternion(m: Vector) -> Vector:
    """Without branches on the largest element; w is not negative. A sign that is zero counts as positive."""
    root = lambda t: F.sqrt(F.greatest(F.lit(0.0), t)) / 2
    signed = lambda value, d: F.when(d < 0, -value).otherwise(value)
    q = [root(1 + m[0] + m[4] + m[8]), signed(root(1 + m[0] - m[4] - m[8]), m[7] - m[5]), signed(root(1 - m[0] + m[4] - m[8]), m[2] - m[6]), signed(root(1 - m[0] - m[4] + m[8]), m[3] - m[1])]
    n = norm(q)
    return [c / n for c in q]


def matrix_to_quaternion_by_largest(m: Vector) -> Vector:
    """Divides by the largest of the four elements; the sign of w is left as it comes."""
    trace = m[0] + m[4] + m[8]
    a, b, c = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    d, e, f = m[1] + m[3], m[2] + m[6], m[5] + m[7]
    s = [F.sqrt(F.greatest(F.lit(1e-300), t)) * 2 for t in (trace + 1, 1 + m[0] - m[4] - m[8], 1 - m[0] + m[4] - m[8], 1 - m[0] - m[4] + m[8])]
    ways = [[s[0] / 4, a / s[0], b / s[0], c / s[0]], [a / s[1], s[1] / 4, d / s[1], e / s[1]], [b / s[2], d / s[2], s[2] / 4, f / s[2]], [c / s[3], e / s[3], f / s[3], s[3] / 4]]
    x_largest, y_largest = (m[0] > m[4]) & (m[0] > m[8]), m[4] > m[8]
    return [F.when(trace > 0, w).when(x_largest, x).when(y_largest, y).otherwise(z) for w, x, y, z in zip(*ways, strict=True)]


def rotate(m: Vector, p: Vector) -> Vector:
    return [dot(m[i : i + 3], p) for i in (0, 3, 6)]


def transposed(m: Vector) -> Vector:
    return [m[i] for i in (0, 3, 6, 1, 4, 7, 2, 5, 8)]


def transform(m: Vector, t: Vector, p: Vector) -> Vector:
    return [a + b for a, b in zip(rotate(m, p), t, strict=True)]


def inverse(m: Vector, t: Vector) -> tuple[Vector, Vector]:
    back = transposed(m)
    return back, [-c for c in rotate(back, t)]


def compose(a: tuple[Vector, Vector], b: tuple[Vector, Vector]) -> tuple[Vector, Vector]:
    """First ``b``, then ``a``."""
    columns = [rotate(a[0], b[0][j::3]) for j in range(3)]
    return [columns[j][i] for i in range(3) for j in range(3)], transform(a[0], a[1], b[1])


def flipped(m: Vector) -> Vector:
    """The rotation with its second and third column negated (other camera axes)."""
    return [c if i % 3 == 0 else -c for i, c in enumerate(m)]


def rotation_angle(a: Vector, b: Vector) -> Column:
    """Degrees between two rotations."""
    trace = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    return F.degrees(F.acos(clip((trace - 1) / 2, -1.0, 1.0)))


def slerp(a: Vector, b: Vector, w: Column) -> Vector:
    """Along the shorter arc; a normalised blend where the two are nearly equal."""
    raw = dot(a, b)
    b = [F.when(raw < 0, -c).otherwise(c) for c in b]
    cosine = F.least(F.abs(raw), F.lit(1.0))
    angle = F.acos(cosine)
    near = cosine > 0.9995
    sine = F.when(near, F.lit(1.0)).otherwise(F.sin(angle))
    u, v = F.when(near, 1 - w).otherwise(F.sin((1 - w) * angle) / sine), F.when(near, w).otherwise(F.sin(w * angle) / sine)
    q = [u * x + v * y for x, y in zip(a, b, strict=True)]
    n = norm(q)
    return [c / n for c in q]


def lerp(a: Column, b: Column, w: Column) -> Column:
    return a + (b - a) * w


def interpolated(values: dict[str, tuple[Column, Column]], ratio: Column) -> dict[str, Column]:
    """Each value between its two ends; null where the ratio is not from 0 to 1."""
    return {n: F.when((ratio >= 0) & (ratio <= 1), lerp(a, b, ratio)) for n, (a, b) in values.items()}


def smallest_rotation(a: list[float], b: list[float]) -> list[float]:
    """Nine numbers that turn direction a into b; the identity where they are parallel, in either sense."""
    a, b = ([x / math.sqrt(sum(y * y for y in v)) for x in v] for v in (a, b))
    v = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    s2 = sum(x * x for x in v)
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    if math.sqrt(s2) < 1e-12:
        return eye
    k = [0, -v[2], v[1], v[2], 0, -v[0], -v[1], v[0], 0]
    square = [sum(k[3 * i + n] * k[3 * n + j] for n in range(3)) for i in range(3) for j in range(3)]
    scale = (1 - sum(x * y for x, y in zip(a, b, strict=True))) / s2
    return [e + x + y * scale for e, x, y in zip(eye, k, square, strict=True)]


def project(p: Vector, focal: Vector, centre: Vector) -> Vector:
    """(u, v, z) of a point in camera axes; u and v are null unless it lies before the camera."""
    u, v = (F.when(p[2] > 0, focal[i] * p[i] / p[2] + centre[i]) for i in (0, 1))
    return [u, v, p[2]]


def in_frame(uvz: Vector, width: Column, height: Column) -> Column:
    """Strictly inside the image and before the camera."""
    u, v, z = uvz
    return F.coalesce((u > 0) & (u < width) & (v > 0) & (v < height) & (z > 0), F.lit(False))


def unproject(u: Column, v: Column, z: Column, focal: Vector, centre: Vector) -> Vector:
    return [z * (u - centre[0]) / focal[0], z * (v - centre[1]) / focal[1], z]


def field_of_view(pixels: Column, focal: Column) -> Column:
    return 2 * F.atan(pixels / (2 * focal))


def focal_length(pixels: Column, fov: Column) -> Column:
    return pixels / (2 * F.tan(fov / 2))


def inverse_depth(d: Column, least: float = 0.1) -> Column:
    return F.when(d > least, 1 / d).otherwise(0.0)


def rescaled(width: Column, old_height: Column, new_height: Column) -> Column:
    """Width for a new height, cut to a whole number."""
    return (new_height / old_height * width).cast("int")


def fitting(side: int, aspect: Column) -> tuple[Column, Column]:
    """(width, height) of the largest picture of that aspect within a square, cut to whole numbers."""
    wide = aspect > 1
    return F.when(wide, side).otherwise((side * aspect).cast("int")), F.when(wide, (side / aspect).cast("int")).otherwise(side)


def affordable(side: int, aspect: Column, rays_per_second: Column, frames_per_second: float) -> tuple[Column, Column]:
    """(width, height) of a picture whose pixels the ray budget allows: the height in tens, from 30 to ``side``, and no side longer than that."""
    tens = (F.rint(F.sqrt(rays_per_second / frames_per_second / aspect) / 10) * 10).cast("int")
    height = F.greatest(F.least(F.lit(side), tens), F.lit(30))
    width = (height * aspect).cast("int")
    return F.least(width, F.lit(side)), F.when(width > side, (side / aspect).cast("int")).otherwise(height)


def equidistant(x: Column, y: Column, k: list[float]) -> tuple[Column, Column]:
    """Fisheye coordinates of a pinhole direction: r = angle * (1 + k1 angle^2 + ... + k4 angle^8)."""
    radius = F.sqrt(x * x + y * y)
    t = F.atan(radius)
    t2 = t * t
    bent = t * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))
    scale = F.when(radius > 1e-8, bent / F.when(radius > 1e-8, radius).otherwise(1.0)).otherwise(1.0)
    return x * scale, y * scale


def fisheye_map(x: Column, y: Column, params: list[float], shrink: int = 1) -> tuple[Column, Column]:
    """Where a pixel of an equidistant picture lies in the distorted one: f x (1 + k1 r^2 + ... + k4 r^8) + c, with r the distance from the centre in focal lengths.

    ``params`` are fx, fy, cx, cy, k1..k4; the first four are divided by ``shrink`` without remainder.
    """
    fx, fy, cx, cy = (p // shrink for p in params[:4])
    u, v = (x - cx) / fx, (y - cy) / fy
    r2, k = u * u + v * v, params[4:]
    bent = 1 + r2 * (k[0] + r2 * (k[1] + r2 * (k[2] + r2 * k[3])))
    return fx * u * bent + cx, fy * v * bent + cy


def pinhole_map(x: Column, y: Column, camera: list[float], k: list[float]) -> tuple[Column, Column]:
    """Where a pixel of an undistorted picture lies in the distorted one: two radial (k[0], k[1]) and two tangential (k[2], k[3]) terms."""
    fx, fy, cx, cy = camera
    u, v = (x - cx) / fx, (y - cy) / fy
    r2 = u * u + v * v
    radial = 1 + r2 * (k[0] + r2 * k[1])
    return fx * (u * radial + 2 * k[2] * u * v + k[3] * (r2 + 2 * u * u)) + cx, fy * (v * radial + k[2] * (r2 + 2 * v * v) + 2 * k[3] * u * v) + cy


def bent(u: Column, v: Column, k: Vector) -> tuple[Column, Column]:
    """Normalised coordinates under two radial (k[0], k[1]) and two tangential (k[2], k[3]) terms."""
    r2 = u * u + v * v
    radial = 1 + r2 * (k[0] + r2 * k[1])
    return u * radial + 2 * k[2] * u * v + k[3] * (r2 + 2 * u * u), v * radial + k[2] * (r2 + 2 * v * v) + 2 * k[3] * u * v


def straightened(u: Column, v: Column, k: Vector, steps: int = 12) -> Column:
    """The struct (u, v) that :func:`bent` takes to the given place, by Newton steps from that place on.

    Null where the steps don't end at such a place, as beyond a fold of the distortion.
    """

    def step(at: Column, _: Column) -> Column:
        x, y = at["u"], at["v"]
        r2 = x * x + y * y
        slope, cross_ = 2 * (k[0] + 2 * k[1] * r2), 2 * (k[2] * x + k[3] * y)
        radial = 1 + r2 * (k[0] + r2 * k[1])
        a, b, d = radial + x * x * slope + 2 * k[2] * y + 6 * k[3] * x, x * y * slope + cross_, radial + y * y * slope + 6 * k[2] * y + 2 * k[3] * x
        e, f = (p - q for p, q in zip(bent(x, y, k), (u, v), strict=True))
        det = a * d - b * b
        return F.struct((x - F.try_divide(d * e - b * f, det)).alias("u"), (y - F.try_divide(a * f - b * e, det)).alias("v"))

    def settled(at: Column) -> Column:
        x, y = bent(at["u"], at["v"], k)
        return F.when((F.abs(x - u) <= 1e-9 * (1 + F.abs(u))) & (F.abs(y - v) <= 1e-9 * (1 + F.abs(v))), at)

    last = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(u.cast("double").alias("u"), v.cast("double").alias("v")), step)
    return F.transform(F.array(last), settled)[0]


def fisheye_pixel(ray: Vector, focal: Column, centre: Vector, k: Vector, p: Vector, s: Vector) -> tuple[Column, Column]:
    """Where a direction lies in a fisheye picture; null unless it points forward.

    The angle from the axis is bent by six odd powers ``k``, then two tangential ``p`` and four thin prism terms ``s`` are added.
    """
    r = F.sqrt(ray[0] * ray[0] + ray[1] * ray[1])
    angle = F.atan2(r, ray[2])
    t2 = angle * angle
    series = k[5]
    for x in (*k[4::-1], F.lit(1.0)):
        series = x + t2 * series
    scale = F.when(r > 0, angle * series / r).otherwise(F.try_divide(F.lit(1.0), ray[2]))
    u, v = scale * ray[0], scale * ray[1]
    r2 = u * u + v * v
    along = 2 * (u * p[0] + v * p[1])
    moved = u + u * along + p[0] * r2 + r2 * (s[0] + r2 * s[1]), v + v * along + p[1] * r2 + r2 * (s[2] + r2 * s[3])
    return tuple(F.when(ray[2] > 0, focal * x + c) for x, c in zip(moved, centre, strict=True))


def rotation_between(a: Vector, b: Vector) -> Vector:
    """Nine numbers that turn the unit vector a into b by the smallest angle; the identity where they are parallel, in either sense."""
    v = cross(a, b)
    s2, c = dot(v, v), dot(a, b)
    k = (1 - c) / F.when(s2 >= 1e-24, s2)
    zero = F.lit(0.0)
    skew = [zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero]
    out = []
    for i in range(3):
        for j in range(3):
            square = v[i] * v[j] - (s2 if i == j else zero)
            eye = 1.0 if i == j else 0.0
            out.append(F.coalesce(eye + skew[3 * i + j] + k * square, F.lit(eye)))
    return out


def longest_edge(a: Vector, b: Vector, c: Vector) -> Column:
    return F.greatest(norm(minus(a, b)), norm(minus(b, c)), norm(minus(c, a)))


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    return norm(cross(minus(b, a), minus(c, a))) / 2
