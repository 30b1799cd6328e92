"""Column expressions of the raster operators.

All of them are native expressions: they stay inside generated code and can be
pushed past joins.  ANSI mode is assumed: casts are clamped before they can
overflow, and divisions that may meet zero use ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Micrometres of one unit of length.
UNIT_UM = {"km": 1e9, "m": 1e6, "dm": 1e5, "cm": 1e4, "mm": 1e3, "um": 1.0, "nm": 1e-3, "pm": 1e-6, "in": 25400.0}
# Other spellings of units, after trimming and lower-casing.
UNIT_NAMES = {
    "kilometer": "km", "meter": "m", "decimeter": "dm", "centimeter": "cm", "millimeter": "mm", "micrometer": "um",
    "micron": "um", "microns": "um", "µm": "um", "nanometer": "nm", "picometer": "pm", "inch": "in",
}


def clip(v: Column, low, high) -> Column:
    return F.greatest(F.least(v, _c(high)), _c(low))


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def rescale(v: Column, low: Column, high: Column) -> Column:
    """To 0..1 between two limits; equal or inverted limits count as one apart."""
    top = F.when(high <= low, low + 1.0).otherwise(high)
    return (clip(v.cast("double"), low, top) - low) / (top - low)


def rescale_soft(v: Column, low: Column, high: Column) -> Column:
    """To 0..1 with a millionth added to the span."""
    return clip((v - low) / (high - low + 1e-6), 0.0, 1.0)


def to_pixel(v: Column, bits: int) -> Column:
    """Round half to even and clamp to an unsigned integer of so many bits."""
    return clip(F.rint(v), 0.0, float(2**bits - 1)).cast("long")


def stretch_u8(v: Column, low: Column, high: Column) -> Column:
    return F.floor(rescale(v, low, high) * 255.0).cast("int")


def tent(i: Column, n: Column) -> Column:
    """1 at both ends, rising by 1 towards the middle."""
    return F.least(i + 1, n - i)


def tent_weight(y: Column, x: Column, h: Column, w: Column, border: int = 0, trim: tuple[bool, bool, bool, bool] = (False,) * 4) -> Column:
    """Product of tents; ``trim`` (top, bottom, left, right) zeroes that border."""
    weight = tent(y, h) * tent(x, w)
    if not border:
        return weight
    inside = F.lit(True)
    for cut, keep in zip(trim, (y >= border, y < h - border, x >= border, x < w - border)):
        inside = inside & keep if cut else inside
    return F.when(inside, weight).otherwise(F.lit(0))


def edge_weight(overlap: Column, score: Column, unmasked: Column, fallback: Column) -> Column:
    """Trust in a neighbour estimate: larger overlaps and scores weigh more, doubtful kinds less."""
    quality = 0.25 + 0.75 * clip((score + 1.0) / 2.0, 0.0, 1.0)
    quality = quality * F.when(score < -0.5, F.lit(0.1)).otherwise(F.lit(1.0))
    kind = F.when(unmasked, F.lit(0.85)).otherwise(F.lit(1.0)) * F.when(fallback, F.lit(0.05)).otherwise(F.lit(1.0))
    return F.greatest(overlap, F.lit(1.0)) * quality * kind


def symmetric_eigenvalues(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Larger and smaller eigenvalue of [[a, b], [b, c]]."""
    half, root = (a + c) / 2.0, F.sqrt((a - c) * (a - c) / 4.0 + b * b)
    return half + root, half - root


def unit_name(unit: Column) -> Column:
    low = F.lower(F.trim(unit))
    names = F.create_map(*[F.lit(x) for kv in UNIT_NAMES.items() for x in kv])
    return F.coalesce(names[low], low)


def to_micrometres(value: Column, unit: Column) -> Column:
    """Null for unknown units and sizes that are not positive and finite."""
    factor = F.create_map(*[F.lit(x) for kv in UNIT_UM.items() for x in kv])[unit_name(unit)]
    good = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))
    return F.when(good, value * factor)


def letter_suffix(i: Column) -> Column:
    """a..z, then aa, ab, ...: bijective base 26 of a number from 0."""
    one = lambda k: F.char((k + 97).cast("int"))
    two = F.concat(one(F.floor(i / 26) - 1), one(i % 26))
    three = F.concat(one(F.floor((i - 702) / 676)), one(F.floor((i - 702) / 26) % 26), one((i - 702) % 26))
    return F.when(i < 26, one(i)).when(i < 702, two).otherwise(three)


def find_channel(names: Column, marker: Column) -> Column:
    """Place (from 0) of the name equal to the marker but for case, else of the first that holds it; null if none."""
    want = F.lower(F.trim(marker))
    low = F.transform(names, lambda n: F.lower(F.trim(n)))
    exact = F.array_position(low, want)
    part = F.array_position(F.transform(low, lambda n: F.contains(n, want)), True)
    place = F.when(exact > 0, exact).when(part > 0, part)
    return F.when(F.length(want) > 0, place - 1)


def folder_markers(folder: Column, n: int) -> Column:
    """``DAPI`` and the last n - 1 parts of a folder name, padded with empty names."""
    tokens = F.filter(F.split(folder, "_"), lambda t: t != "")
    last = F.slice(tokens, F.greatest(F.size(tokens) - (n - 1) + 1, F.lit(1)), F.lit(n - 1))
    return F.concat(F.array(F.lit("DAPI")), last, F.array_repeat(F.lit(""), n - 1 - F.size(last)))


def moments_correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, least: int) -> Column:
    """Pearson correlation from sums; -1 for fewer than ``least`` pairs or no variance."""
    count = n.cast("double")
    vx, vy = sxx.cast("double") - sx.cast("double") * sx.cast("double") / count, syy.cast("double") - sy.cast("double") * sy.cast("double") / count
    cross = sxy.cast("double") - sx.cast("double") * sy.cast("double") / count
    return F.when((n >= least) & (vx > 1e-8) & (vy > 1e-8), cross / F.sqrt(F.greatest(vx, F.lit(1e-300)) * F.greatest(vy, F.lit(1e-300)))).otherwise(F.lit(-1.0))
