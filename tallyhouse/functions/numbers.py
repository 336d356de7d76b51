"""Arithmetic expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL if the denominator is zero."""
    return F.try_divide(numerator, denominator)


def draw(id_: Column, stream: int) -> Column:
    """Repeatable integer in ``[0, PRIME)`` from an id; ``stream`` keeps the columns of a row independent.

    Depends on the id only, so a retried task or another partitioning draws the same values. The bits of the id above
    the 31st change the offset of each stream, so tables of many billion rows do not repeat. Every intermediate value
    stays below 2**62.
    """
    whole = id_.cast("long")
    offset = F.pmod((F.shiftright(whole, 31) * 15485863 + 7919) * stream, F.lit(PRIME))
    first = (F.pmod(whole, F.lit(PRIME)) * 48271 + offset + 7) % PRIME
    return ((first * first) % PRIME * 69621 + 104729 * stream) % PRIME


def uniform(id_: Column, stream: int) -> Column:
    """Repeatable double in ``[0, 1)``."""
    return draw(id_, stream).cast("double") / F.lit(float(PRIME))


def pick(values: list[str] | tuple[str, ...], id_: Column, stream: int) -> Column:
    """Repeatable choice; every entry can be drawn."""
    options = F.array(*[F.lit(v) for v in values])
    return F.element_at(options, (draw(id_, stream) % len(values) + 1).cast("int"))
