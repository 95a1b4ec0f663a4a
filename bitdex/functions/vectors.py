"""Array-of-double vector algebra as Spark SQL higher-order functions.

These are for narrow vectors and for per-row work inside a larger plan (unit
scoring, centring). Wide matrix work (PCA projection of a whole corpus) goes
through Spark ML instead, see ``bitdex.operators.pca``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Spark's higher-order functions re-evaluate any outer expression a lambda
    refers to, once per element; binding it through a one-element array
    evaluates it once per row instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def settle(df, *cols: Column | str):
    """``df.select(*cols)`` through a one-row ``inline`` generator.

    Columns built from nested lambdas that refer to an outer lambda variable
    (``transform(us, u -> dot(u, t))``) cannot be the input of a Python UDF
    once Catalyst collapses the projections (the UDF is then never
    extracted). A generator node is not collapsed, so later Python UDFs see
    plain attributes; filters still push through it.
    """
    return df.select(F.inline(F.array(F.struct(*cols))))


def vsum(v: Column | str) -> Column:
    """Left-to-right sum of an array of numbers (0.0 for an empty array)."""
    return F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, summed left to right (V1)."""
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def sq_norm(v: Column | str) -> Column:
    return vsum(F.transform(_c(v), lambda x: x * x))


def l2_normalize(v: Column | str) -> Column:
    """Divide by the L2 norm; a zero vector stays zero (V2)."""
    return let(_c(v), lambda c: let(sq_norm(c), lambda ss: F.when(
        ss > 0, F.transform(c, lambda x: x.cast("double") / F.sqrt(ss))
    ).otherwise(F.transform(c, lambda x: F.lit(0.0).cast("double")))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product of the two normalised vectors (V3)."""
    return dot(l2_normalize(a), l2_normalize(b))


def center(v: Column | str, mean: Column | str) -> Column:
    """Subtract the mean vector element-wise (V4)."""
    return F.zip_with(_c(v), _c(mean), lambda x, m: x - m)


def project(v: Column | str, components: Column | str) -> Column:
    """``y_i = components_i . v`` for every component row (V5, narrow dims)."""
    return let(_c(v), lambda vc: F.transform(_c(components),
                                              lambda r: dot(r, vc)))


def has_dim(v: Column | str, dim: int) -> Column:
    """Guard before ``zip_with``: exactly ``dim`` elements (it pads with NULL
    otherwise and the dot product becomes NULL)."""
    return _c(v).isNotNull() & (F.size(_c(v)) == F.lit(dim))
