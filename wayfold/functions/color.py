"""Colour, exposure and splat activations as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SH_DC = 0.28209479177387814  # fixed value: the constant spherical harmonic


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b  # fixed values: BT.601


def to_ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    # fixed values: BT.601
    return [luma(r, g, b), -0.168736 * r - 0.331264 * g + 0.5 * b + 0.5, 0.5 * r - 0.418688 * g - 0.081312 * b + 0.5]


def from_ycbcr(y: Column, cb: Column, cr: Column) -> list[Column]:
    # fixed values: BT.601
    return [y + 1.402 * (cr - 0.5), y - 0.344136 * (cb - 0.5) - 0.714136 * (cr - 0.5), y + 1.772 * (cb - 0.5)]


def srgb_encode(x: Column, gamma: float = 2.4) -> Column:
    return F.when(x < 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(F.greatest(x, F.lit(0.0031308)), 1 / gamma) - 0.055)


def srgb_decode(x: Column, gamma: float = 2.4) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((F.greatest(x, F.lit(0.04045)) + 0.055) / 1.055, gamma))


def two_segment_gamma(x: Column, low: float = 1.6, high: float = 2.2, split: float = 0.5) -> Column:
    """One exponent up to ``split`` and another beyond."""
    x = F.greatest(x, F.lit(0.0))
    return F.when(x < split, F.pow(x, low)).otherwise(F.pow(x, high))


def expose(value: Column, gain: Column, vignette: Column, mask: Column) -> Column:
    """Decode, multiply by gain and vignette, encode again, mask and clamp to [0, 1]."""
    linear = srgb_decode(value) * gain * vignette
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), srgb_encode(linear) * mask))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def to_sh(c: Column) -> Column:
    return (c - 0.5) / SH_DC


def depth_filter(depth: Column, focal: Column, kernel: float = 0.2) -> Column:
    """The filter's width at the least depth that a camera of this focal length sees."""
    return depth / focal * math.sqrt(kernel)


def smoothed_scales(scales: list[Column], filter_: Column) -> list[Column]:
    return [F.sqrt(s * s + filter_ * filter_) for s in scales]


def smoothed_opacity(opacity: Column, scales: list[Column], filter_: Column) -> Column:
    product = lambda v: v[0] * v[1] * v[2]
    before, after = product([s * s for s in scales]), product([s * s + filter_ * filter_ for s in scales])
    return opacity * F.sqrt(before / after + 1e-7)


def palette_index(v: Column) -> Column:
    """Index into a palette of 256: 0 alone falls before the first and takes the last."""
    i = F.floor(F.abs(v * 256 - 1)) * F.signum(v * 256 - 1)
    return F.when(i < 0, i + 256).otherwise(i).cast("int")


def coefficient_major(rest: Column, channels: int, per_channel: int) -> Column:
    """Reorder coefficients from channel after channel to one of each channel in turn."""
    return F.transform(F.sequence(F.lit(0), F.lit(channels * per_channel - 1)), lambda i: F.get(rest, ((i % channels) * per_channel + F.floor(i / channels)).cast("int")))
