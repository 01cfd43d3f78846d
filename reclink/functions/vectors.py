"""Vector maths on array<float|double> columns with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v) -> Column:
    """v / |v| (a zero vector is returned unchanged).

    The norm is bound once as a lambda variable; named inside the element lambda
    it would be computed again for every element.
    """
    return F.transform(F.array(norm(v)), lambda n: F.transform(
        _c(v), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))[0]


def blend(a, b, wa: float = 0.2, wb: float = 0.8) -> Column:
    """element-wise wa*a + wb*b."""
    return F.zip_with(_c(a), _c(b), lambda x, y: F.lit(wa) * x.cast("double") + F.lit(wb) * y.cast("double"))


def sparse_to_dense(v) -> Column:
    """ML (sparse) vector -> dense array<double>."""
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(_c(v))


def checksum(v) -> Column:
    """Order-sensitive scalar summary of a vector: sum of (i+1) * x_i."""
    return F.aggregate(F.zip_with(_c(v), F.sequence(F.lit(1), F.size(_c(v))),
                                  lambda x, i: x.cast("double") * i), F.lit(0.0), lambda acc, x: acc + x)
