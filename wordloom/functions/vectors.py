"""Column functions over vectors, the logistic function and the loss.

All arithmetic is in double.  Vectors of unequal length raise an error where
two meet; a null vector gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SATURATION = 10.0
LOG_GUARD = 1e-5


def _same_length(u: Column, v: Column, result: Column) -> Column:
    wrong = F.raise_error(F.lit("vectors of different length"))
    return F.when(F.size(u) == F.size(v), result).when(u.isNull() | v.isNull(), None).otherwise(wrong)


def dot(u: Column, v: Column) -> Column:
    products = F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double"))
    return _same_length(u, v, F.aggregate(products, F.lit(0.0), lambda a, x: a + x))


def scale(u: Column, a: Column | float) -> Column:
    a = a if isinstance(a, Column) else F.lit(float(a))
    return F.transform(u, lambda x: x.cast("double") * a)


def scaled_add(u: Column, v: Column, a: Column | float = 1.0) -> Column:
    a = a if isinstance(a, Column) else F.lit(float(a))
    return _same_length(u, v, F.zip_with(u, v, lambda x, y: x.cast("double") + a * y.cast("double")))


def l2_norm(u: Column) -> Column:
    return F.sqrt(dot(u, u))


def l2_normalize(u: Column) -> Column:
    """The unit vector; a vector without length becomes NaN throughout."""
    # repeated beside the vector, the norm is computed once and not for each component
    norms = F.array_repeat(l2_norm(u), F.size(u))
    return F.zip_with(u, norms, lambda x, n: F.when(n == 0, F.lit(float("nan"))).otherwise(F.try_divide(x.cast("double"), n)))


def logistic(a: Column) -> Column:
    """The logistic function, exactly 0 or 1 beyond 10."""
    return F.when(a > SATURATION, 1.0).when(a < -SATURATION, 0.0).otherwise(1.0 / (1.0 + F.exp(-a)))


def safe_log(v: Column) -> Column:
    return F.log(v + F.lit(LOG_GUARD))


def logistic_loss(activation: Column, label: Column) -> Column:
    """``struct(loss, grad)`` of an activation against a label of 0 or 1."""
    y = logistic(activation)
    return F.struct(
        (-F.when(label == 1, safe_log(y)).otherwise(safe_log(1.0 - y))).alias("loss"),
        (label.cast("double") - y).alias("grad"),
    )
