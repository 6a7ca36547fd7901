"""A seeded permutation of ``0 .. n-1`` as arithmetic: any place without a sort, and back.

A number below ``n`` is written with two digits to the bases ``a = ceil(sqrt(n))`` and ``b = ceil(n / a)``. Rounds add a keyed
function of one digit to the other (a Feistel network), which can be undone whatever that function is. ``a * b`` exceeds
``n`` by less than ``a``; a result beyond ``n`` is permuted again until it lies below (cycle walking), which happens to
one number in ``sqrt(n)`` at most.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Products of numbers below this prime fit into 64 bits.
_PRIME = (1 << 31) - 1
_ROUNDS = 6
# Steps after which a walk is not expected to go on: each step goes on with probability 1/sqrt(n).
_LONGEST_WALK = 64


def round_keys(seed: int) -> list[int]:
    """28 bits of the md5 of ``seed:permute:round`` each."""
    return [int(hashlib.md5(f"{seed}:permute:{r}".encode()).hexdigest()[:7], 16) for r in range(_ROUNDS)]


@dataclass(frozen=True)
class Permutation:
    """``place`` and ``item`` undo each other; both are null for null and for numbers outside ``0 .. n-1``.

    The order of training is that item ``item(0)`` comes first, then ``item(1)``, ...; rows with ``place < k`` are
    an exact sample of ``k`` rows, and samples of one seed are nested.
    """

    n: int
    seed: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.n < 1 << 61:
            raise ValueError("n must be from 0 to 2^61")

    @property
    def digits(self) -> tuple[int, int]:
        a = math.isqrt(self.n - 1) + 1 if self.n else 1
        return a, max(-(-self.n // a), 1)

    def place(self, item: Column) -> Column:
        """Where an item stands in the permuted order."""
        return self._walk(item, range(_ROUNDS), 1)

    def item(self, place: Column) -> Column:
        """What stands at a place of the permuted order."""
        return self._walk(place, reversed(range(_ROUNDS)), -1)

    def _walk(self, number: Column, rounds, sign: int) -> Column:
        rounds = list(rounds)
        a, b = self.digits
        x = number.cast("bigint")
        once = self._once(x, rounds, sign)
        beyond = a * b - self.n
        if beyond:
            steps = min(beyond, _LONGEST_WALK)
            again = F.aggregate(
                F.sequence(F.lit(1), F.lit(steps)),
                once,
                lambda y, _: F.when(y < self.n, y).otherwise(self._once(y, rounds, sign)),
                lambda y: F.when(y < self.n, y).otherwise(F.raise_error(F.lit("a walk did not end")).cast("bigint")),
            )
            once = F.when(once < self.n, once).otherwise(again)
        return F.when((x >= 0) & (x < self.n), once)

    def _once(self, x: Column, rounds: list[int], sign: int) -> Column:
        """All rounds on one number below ``a * b``, folded over their keys."""
        a, b = self.digits
        keys = round_keys(self.seed)
        steps = F.array(*[F.struct(F.lit(r % 2 == 0).alias("upper"), F.lit(keys[r]).cast("bigint").alias("key")) for r in rounds])

        def step(state: Column, r: Column) -> Column:
            upper, lower = state["u"], state["l"]
            mixed = sign * _mixed(F.when(r["upper"], lower).otherwise(upper), r["key"])
            return F.struct(
                F.when(r["upper"], F.pmod(upper + mixed, F.lit(a).cast("bigint"))).otherwise(upper).alias("u"),
                F.when(r["upper"], lower).otherwise(F.pmod(lower + mixed, F.lit(b).cast("bigint"))).alias("l"),
            )

        base = F.lit(b).cast("bigint")
        digits = F.struct(F.call_function("div", x, base).alias("u"), (x % base).alias("l"))
        return F.aggregate(steps, digits, step, lambda s: s["u"] * b + s["l"])


def _mixed(digit: Column, key: Column) -> Column:
    """Two squarings modulo a prime; digits are below 2^31."""
    first = (digit + key) % _PRIME
    second = (first * first + key) % _PRIME
    return second * second % _PRIME
