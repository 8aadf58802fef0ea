"""Expressions on arrays of doubles (higher-order functions; for wide vectors see ``operators.kernels``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and bind it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def layer_norm(v: Column, eps: float = 1e-6) -> Column:
    """(x - mean) / sqrt(population variance + eps), no scale or shift."""

    def scaled(centred: Column) -> Column:
        return let(F.sqrt(total(F.transform(centred, lambda x: x * x)) / F.size(centred) + eps), lambda s: F.transform(centred, lambda x: x / s))

    return let(total(v) / F.size(v), lambda m: let(F.transform(v, lambda x: x - m), scaled))


def rms_norm(v: Column, weight: Column | None = None, eps: float = 1e-6) -> Column:
    out = let(F.sqrt(total(F.transform(v, lambda x: x * x)) / F.size(v) + eps), lambda s: F.transform(v, lambda x: x / s))
    return out if weight is None else F.zip_with(out, weight, lambda x, w: x * w)


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def modulate(v: Column, shift: Column | None, scale: Column) -> Column:
    """x * (1 + scale) + shift, element by element; a null shift is none."""
    out = F.zip_with(v, scale, lambda x, s: x * (1 + s))
    return out if shift is None else F.when(shift.isNull(), out).otherwise(F.zip_with(out, shift, lambda x, s: x + s))


def rotate_half(v: Column) -> Column:
    """(first half, second half) -> (-second half, first half)."""
    half = (F.size(v) / 2).cast("int")
    return F.concat(F.transform(F.slice(v, half + 1, half), lambda x: -x), F.slice(v, F.lit(1), half))


def softmax(v: Column) -> Column:
    return let(F.transform(v, lambda x: F.exp(x - F.array_max(v))), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def log_sum_exp(v: Column) -> Column:
    return let(F.array_max(v), lambda m: m + F.log(total(F.transform(v, lambda x: F.exp(x - m)))))


def p_norm(v: Column, p: float) -> Column:
    return F.pow(total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(float(p))))), F.lit(1.0 / p))


def all_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol * |b| in every place."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: ok)
