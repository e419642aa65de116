"""Vector expressions on ARRAY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.functions.text import col

# Scores are compared at this many decimals, so that a ranking does not depend on the order
# in which a task happened to add up products.
RANK_DIGITS = 9


def dot(a, b) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine of two vectors; 0 when either has no length. Pass stored norms to save work."""
    length = (col(norm_a) if norm_a is not None else norm(a)) * (col(norm_b) if norm_b is not None else norm(b))
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)

