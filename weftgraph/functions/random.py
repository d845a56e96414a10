"""Random numbers from integers by arithmetic that any SQL engine shares.

The generator is the multiplicative congruential one of Lewis, Goodman and Miller: x * 16807 modulo 2^31 - 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the generator.
MULTIPLIER = 16807
MODULUS = 2147483647
RANGE = MODULUS - 1


#: Bits of an id that one round takes in.
PIECE = 30


def _scrambled(v: Column, iteration: int) -> Column:
    """Another number below the modulus for each iteration but the first, of the whole id. The generator is linear, so that what
    an iteration adds must not be added alone: two neighbours would start as far apart in every iteration, and what one does
    not bring together the next ones would not either. Each round adds a piece of the id and the iteration's own number, and squares."""
    if not iteration:
        return v
    x, own = F.lit(0).cast("long"), iteration
    for k in range(3):
        own = (own * own + (k + 1) * 48271) * MULTIPLIER % MODULUS
        piece = F.pmod(F.shiftright(v.cast("long"), PIECE * k), F.lit(1 << PIECE))
        x = F.pmod(x + piece + own, F.lit(MODULUS))
        x = F.pmod(x * x, F.lit(MODULUS)) * MULTIPLIER % MODULUS
    return x


def _state(v: Column, seed: int, n: int, iteration: int) -> Column:
    v = _scrambled(v, iteration)
    s = F.pmod(F.pmod(v, F.lit(4294967296)) + F.lit(seed + iteration * (n + seed)), F.lit(4294967296)) % MODULUS
    return F.when(s == 0, F.lit(1).cast("long")).otherwise(s)


def _next(x: Column) -> Column:
    return (x * MULTIPLIER) % MODULUS


def start_time(v: Column, beta: float, seed: int, n: int, iteration: int = 0) -> Column:
    """A vertex's start, the floor of an exponential variate of rate ``beta``: depends on vertex, seed and iteration alone."""
    x1 = _next(_state(v, seed, n, iteration))
    x2 = _next(x1)
    u = ((x1 - 1).cast("double") + (x2 - 1).cast("double") * RANGE) / (float(RANGE) * RANGE)
    return F.floor(-F.ln(1 - u) / beta).cast("long")


def uniform_below(v: Column, n: int, seed: int, iteration: int = 0) -> Column:
    """A whole number from 0 to n - 1."""
    return _next(_next(_state(v, seed, 0, iteration))) % n


def hashed(a: Column, b: Column, seed: int) -> Column:
    """A number below 2^31 - 1 of two ids, for samples that can be repeated."""
    mixed = F.pmod(F.pmod(a, F.lit(MODULUS)) * 48271 + F.pmod(b, F.lit(MODULUS)) * MULTIPLIER + seed, F.lit(MODULUS))
    return _next(_next(mixed))


def mixed(v: Column, salt: int, seed: int) -> Column:
    """A number below 2^31 - 1 of an id, by three rounds, since one is linear in the id. Salts give independent numbers."""
    a = hashed(v, F.lit(7919 * (salt + 1)).cast("long"), seed)
    b = hashed(F.pmod(a * a, F.lit(MODULUS)) + v, F.lit(104729 + salt).cast("long"), seed + salt)
    return F.pmod(b * F.pmod(a + 12345, F.lit(MODULUS)), F.lit(MODULUS))
