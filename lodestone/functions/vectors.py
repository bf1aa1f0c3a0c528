"""Column functions over ARRAY<FLOAT> vectors, computed in double precision without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero, so that thresholds drop it."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def truncate(v: Column, dim: int) -> Column:
    """The first dim components, renormalised; shorter vectors as they are."""
    return F.when(F.size(v) > dim, l2_normalize(F.slice(v, 1, dim))).otherwise(doubles(v))


def fit_to(v: Column, dim: int) -> Column:
    """Cut or padded with zeros to dim components, renormalised."""
    padded = F.concat(F.slice(doubles(v), 1, dim), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), dim - F.size(v))))
    return l2_normalize(padded)


def fingerprint(v: Column) -> Column:
    """The first 8 components rounded to 6 places, as text."""
    return F.array_join(F.transform(F.slice(doubles(v), 1, 8), lambda x: F.format_number(F.round(x, 6), 6)), ",")


def audit_status(sim: Column) -> Column:
    return F.when(sim > 0.99, "ok").when(sim > 0.95, "warn").otherwise("corrupt")


def sign_hash(v: Column) -> Column:
    """A LONG with bit i set where element i, of the first 64, is above zero."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bits = F.transform(F.slice(v, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(none))
    return F.aggregate(bits, none, lambda acc, b: acc.bitwiseOR(b))


def dhash(grey: Column, width: Column, height: Column) -> Column:
    """64 bits of a picture's gradient: its grey values (rows one after another) are averaged in a grid of 9 x 8 areas, and
    each bit says whether an area is lighter than the one to its right, from the lowest bit on by rows.

    An area has a row and a column at least, so small pictures repeat them; missing values count as 0. Null for no width
    or height.
    """
    ends = lambda i, n, size: (F.floor(F.lit(i) * size / n), F.greatest(F.floor(F.lit(i + 1) * size / n), F.floor(F.lit(i) * size / n) + 1))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def area(x: int, y: int) -> Column:
        (x0, x1), (y0, y1) = ends(x, 9, width), ends(y, 8, height)
        row = lambda r: F.aggregate(F.slice(grey, (r * width + x0 + 1).cast("int"), (x1 - x0).cast("int")), zero, lambda s, v: s + F.coalesce(v.cast("long"), zero))
        total = F.aggregate(F.transform(F.sequence(y0, y1 - 1), row), zero, lambda s, v: s + v)
        return F.struct(total.alias("sum"), ((x1 - x0) * (y1 - y0)).alias("n"))

    def bits(areas: Column) -> Column:
        out = zero
        for y in range(8):
            for x in range(8):
                left, right = areas[y * 9 + x], areas[y * 9 + x + 1]
                out = out.bitwiseOR(F.when(left["sum"] * right["n"] > right["sum"] * left["n"], F.shiftleft(one, y * 8 + x)).otherwise(zero))
        return out

    areas = F.array(*(area(x, y) for y in range(8) for x in range(9)))
    # areas are computed once: a lambda binds them
    return F.when((width > 0) & (height > 0), F.element_at(F.transform(F.array(areas), bits), 1))
