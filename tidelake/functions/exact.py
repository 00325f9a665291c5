"""Totals that do not depend on the order of partial sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_units(value, places: int) -> Column:
    """A number as a whole count of ``10 ** -places``; one with more places raises."""
    value = F.col(value) if isinstance(value, str) else value
    scaled = value.cast("double") * 10 ** places
    whole = F.rint(scaled)
    # a double is a few units of its last digit away from the decimal it stands for
    rest = F.abs(scaled - whole) > F.greatest(F.abs(scaled), F.lit(1.0)) * 1e-12
    more = F.raise_error(F.concat(F.lit(f"more than {places} decimal places: "), value.cast("string"))).cast("long")
    return F.when(rest, more).otherwise(whole.cast("long"))


def exact_sum(value, places: int = 2) -> Column:
    """Sum of amounts with up to ``places`` decimals, added as whole numbers."""
    return F.sum(whole_units(value, places)) / F.lit(10 ** places)
