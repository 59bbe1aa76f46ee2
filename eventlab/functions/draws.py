"""Seeded draws as column expressions.

A draw is HMAC-SHA256 of a key and a message made of the row's identity, so it is
the same in any partitioning, in batch and in streams.  Keys are derived on the driver
and enter the plan as literals.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Acklam's rational approximation of the inverse normal distribution (published fixed values).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
Z95 = 1.6448536269514722
YEAR_S = 365 * 86400.0


def subseed(seed: int, namespace: str) -> bytes:
    """The 32-byte key of a namespace under a seed."""
    return hmac.new(seed.to_bytes(8, "big"), namespace.encode(), hashlib.sha256).digest()


def pads(key: bytes) -> tuple[str, str]:
    """Hex of the inner and outer pad block of a key of at most 64 bytes."""
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def hmac_hex(key: bytes, message: Column) -> Column:
    """Hex of HMAC-SHA256 over a string or binary column."""
    inner, outer = (F.lit(bytes.fromhex(p)) for p in pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def prf_digest(key: bytes, *parts: Column | str | int) -> Column:
    """Hex digest of the parts joined with ``:``."""
    return hmac_hex(key, F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def u64(digest: Column) -> Column:
    """The first 8 bytes as decimal(20,0)."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def unit(digest: Column) -> Column:
    """The first 8 bytes as a double in [0, 1)."""
    return u64(digest).cast("double") / F.lit(2.0**64)


def prf_u(key: bytes, *parts: Column | str | int) -> Column:
    return unit(prf_digest(key, *parts))


def counter_digest(key: bytes, n: Column) -> Column:
    """Draw ``n`` of a keyed stream: the message is n as 8 bytes, big end first."""
    return hmac_hex(key, F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0")))


def low_bits(digest: Column, width: int) -> Column:
    """The low ``width`` (at most 48) bits of a digest."""
    return F.conv(F.substring(digest, 53, 12), 16, 10).cast("long").bitwiseAND(F.lit((1 << width) - 1))


def weighted_choice(u: Column, weights: Sequence[float]) -> Column:
    """The index whose cumulative weight is the first above ``u`` times all weights."""
    x, upto, out = u * F.lit(float(sum(weights))), 0.0, None
    for i, w in enumerate(weights[:-1]):
        upto += w
        out = F.when(x < upto, i) if out is None else out.when(x < upto, i)
    return F.lit(0) if out is None else out.otherwise(len(weights) - 1)


def inverse_normal(u: Column) -> Column:
    """The normal quantile by a rational approximation (relative error 1.2e-9)."""

    def poly(x: Column, cs: Sequence[float]) -> Column:
        out = F.lit(cs[0])
        for c in cs[1:]:
            out = out * x + c
        return out

    p = F.least(F.greatest(u, F.lit(1e-15)), F.lit(1 - 1e-15))
    q = p - 0.5
    r = q * q
    mid = poly(r, _A) * q / (poly(r, _B) * r + 1.0)
    tail = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    side = poly(tail, _C) / (poly(tail, _D) * tail + 1.0)
    return F.when(p < 0.02425, side).when(p > 1 - 0.02425, -side).otherwise(mid)


def clamp(x: Column, low: float = 0.0, high: float = YEAR_S) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def dist(kind: str, u: Column, **p: float) -> Column:
    """Seconds from a distribution, between 0 and 365 days."""
    if kind == "fixed":
        x = F.lit(float(p["value"]))
    elif kind == "uniform":
        x = p["min"] + u * (p["max"] - p["min"])
    elif kind == "exponential":
        x = -p["mean"] * F.log(F.lit(1.0) - F.least(u, F.lit(1 - 2.0**-53)))
    elif kind == "lognormal":
        import math

        x = F.exp(math.log(p["median"]) + (math.log(p["p95"]) - math.log(p["median"])) / Z95 * inverse_normal(u))
    else:
        raise ValueError(f"unknown distribution {kind}")
    return clamp(x)


def uuid7(ms: Column, digest: Column) -> Column:
    """UUID version 7 of 48 bits of milliseconds and the digest's low 74 bits."""
    stamp = F.lpad(F.lower(F.hex(ms)), 12, "0")
    low = F.substring(digest, 46, 19)  # 76 bits; 12 for rand_a, 62 of the rest for rand_b
    a = F.substring(low, 1, 3)
    b = F.substring(low, 4, 16)
    first = F.lower(F.hex((F.conv(F.substring(b, 1, 1), 16, 10).cast("int") % 4 + 8).cast("int")))
    return F.concat_ws("-", F.substring(stamp, 1, 8), F.substring(stamp, 9, 4), F.concat(F.lit("7"), a), F.concat(first, F.substring(b, 2, 3)), F.substring(b, 5, 12))
