"""Vector expressions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelake.functions.text import column, tokens


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(column(a), column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a side is null, empty, of another length or all zero."""
    a, b = column(a), column(b)
    length = norm(a) * norm(b)
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits & (length > 0), dot(a, b) / length).otherwise(0.0)


def unit(a: Column | str) -> Column:
    """The vector in doubles with length 1; null if it has none."""
    length = norm(a)
    return F.when(length > 0, F.transform(column(a), lambda x: x.cast("double") / length))


def usable(a: Column | str, dim: int) -> Column:
    """Whether the vector has ``dim`` finite numbers, not all zero."""
    a = column(a)
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dim) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def hashed_embedding(text: Column | str, dim: int = 64) -> Column:
    """Signed feature hashing of the tokens: the offline stand-in for an embedding model.

    Each token adds 1 or -1 in a cell given by the first digits of its md5.
    """
    def cell(t: Column) -> Column:
        return F.pmod(F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"), F.lit(dim))

    def sign(t: Column) -> Column:
        return F.when(F.conv(F.substring(F.md5(t), 5, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)

    placed = F.transform(tokens(text), lambda t: F.struct(cell(t).alias("c"), sign(t).alias("s")))
    cells = F.sequence(F.lit(0), F.lit(dim - 1))

    def spread(p: Column) -> Column:
        return F.transform(cells, lambda i: F.aggregate(F.filter(p, lambda x: x["c"] == i), F.lit(0.0), lambda s, x: s + x["s"]))

    # A one-element array carries the hashed tokens, so that they are worked out once and not per cell.
    return F.flatten(F.transform(F.array(placed), spread))
