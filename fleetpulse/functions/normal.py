"""Upper tail of the standard normal distribution.

Spark SQL has no ``erf``. W. J. Cody's rational Chebyshev approximations (Math.
Comp. 23, 1969) give double precision with plain arithmetic and ``exp``, so one tail
stays inside code generation. Many tails of a row are too much code to generate, and a
lambda over them is interpreted node by node; ``normal_sf_cells`` takes the same
formulas over Arrow batches instead.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published approximation, by range of |x|.
SMALL_P = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2,
           3.77485237685302021e2, 3.20937758913846947e3)
SMALL_Q = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3,
           2.84423683343917062e3)
MIDDLE_P = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0,
            6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
            1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
MIDDLE_Q = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
            1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
            3.43936767414372164e3, 1.23033935480374942e3)
LARGE_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
           1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
LARGE_Q = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1,
           6.05183413124413191e-2, 2.33520497626869185e-3)
SQRT_PI = math.sqrt(math.pi)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def erfc(x: Column) -> Column:
    y = F.abs(x)
    sq = y * y
    small = 1.0 - x * (_poly(SMALL_P, sq) / _poly(SMALL_Q, sq))
    middle = F.exp(-sq) * (_poly(MIDDLE_P, y) / _poly(MIDDLE_Q, y))
    inv = 1.0 / sq
    large = (F.exp(-sq) / y) * (1.0 / SQRT_PI - inv * (_poly(LARGE_P, inv) / _poly(LARGE_Q, inv)))
    tail = F.when(y <= 4.0, middle).otherwise(large)
    return F.when(y <= 0.46875, small).when(x > 0, tail).otherwise(2.0 - tail)


def normal_sf(z: Column) -> Column:
    """P(Z > z)."""
    return 0.5 * erfc(z / math.sqrt(2.0))


def _sf_numbers(z: np.ndarray) -> np.ndarray:
    """The same tail of many numbers; each range only where it holds."""
    def poly(coefficients, v):
        out = np.full_like(v, coefficients[0])
        for c in coefficients[1:]:
            out = out * v + c
        return out
    x = z / math.sqrt(2.0)
    y = np.abs(x)
    out = np.full_like(x, np.nan)
    near, far = y <= 0.46875, y > 4.0
    between = (y > 0.46875) & ~far
    sq = x[near] * x[near]
    out[near] = 1.0 - x[near] * (poly(SMALL_P, sq) / poly(SMALL_Q, sq))
    v = y[between]
    out[between] = np.exp(-(v * v)) * (poly(MIDDLE_P, v) / poly(MIDDLE_Q, v))
    v = y[far]
    sq = v * v
    inv = 1.0 / sq
    out[far] = (np.exp(-sq) / v) * (1.0 / SQRT_PI - inv * (poly(LARGE_P, inv) / poly(LARGE_Q, inv)))
    mirrored = ~near & (x < 0)
    out[mirrored] = 2.0 - out[mirrored]
    return 0.5 * out


def normal_sf_cells():
    """P(Z > z) of every number of an array column, null where it is null."""
    @F.arrow_udf("array<double>")
    def tails(cells: pa.Array) -> pa.Array:
        flat = cells.flatten()
        missing = flat.is_null().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            found = _sf_numbers(flat.fill_null(0.0).to_numpy(zero_copy_only=False))
        starts = np.concatenate([[0], np.cumsum(cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found, pa.float64(), mask=missing))
    return tails


def erfc_sql(x: str) -> str:
    """The same approximation as SQL text over a column named ``x``."""
    def poly(cs, v):
        out = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * {v} + {c!r}::DOUBLE)"
        return out
    y, sq, inv = f"abs({x})", f"({x} * {x})", f"(1.0::DOUBLE / ({x} * {x}))"
    small = f"1.0::DOUBLE - {x} * ({poly(SMALL_P, sq)} / {poly(SMALL_Q, sq)})"
    middle = f"exp(-{sq}) * ({poly(MIDDLE_P, y)} / {poly(MIDDLE_Q, y)})"
    large = (f"(exp(-{sq}) / {y}) * ({1.0 / SQRT_PI!r}::DOUBLE - {inv} * "
             f"({poly(LARGE_P, inv)} / {poly(LARGE_Q, inv)}))")
    tail = f"(CASE WHEN {y} <= 4 THEN {middle} ELSE {large} END)"
    return (f"(CASE WHEN {y} <= 0.46875::DOUBLE THEN {small} WHEN {x} > 0 THEN {tail} "
            f"ELSE 2.0::DOUBLE - {tail} END)")


def _normal_sf_batch(z: pd.Series) -> pd.Series:
    root = math.sqrt(2.0)
    return z.map(lambda v: 0.5 * math.erfc(v / root), na_action="ignore").astype(float)


def normal_sf_udf():
    """Arrow-batched variant on the C library's ``erfc``, for cross-checks."""
    return F.pandas_udf(_normal_sf_batch, "double")

