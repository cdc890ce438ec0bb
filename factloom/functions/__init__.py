"""Column functions that Spark's own don't cover."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrapping_sum(terms: list[tuple[int, Column]]) -> Column:
    """Signed sum of longs modulo 2**64, as a long; also under ANSI mode, where overflow is an error otherwise."""
    plain = None
    for sign, c in terms:
        term = c if sign > 0 else F.try_subtract(F.lit(0).cast("long"), c)
        plain = term if plain is None else F.try_add(plain, term)
    if len(terms) == 1 and terms[0][0] > 0:
        return plain
    total = None
    for sign, c in terms:
        d = c.cast("decimal(20,0)")
        d = d if sign > 0 else -d
        total = d if total is None else (total + d).cast("decimal(38,0)")
    half, whole = F.lit(str(2**63)).cast("decimal(20,0)"), F.lit(str(2**64)).cast("decimal(21,0)")
    return F.coalesce(plain, (F.pmod((total + half).cast("decimal(38,0)"), whole) - half).cast("long"))  # decimals only on overflow
