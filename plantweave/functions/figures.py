"""Figures of the map and its legend."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST, LARGEST = 3.0, 46.0


def energy_label(mwh: Column) -> Column:
    """12 MWh, 1.2 GWh, 1.23 TWh."""
    return F.when(mwh >= 1e6, F.format_string("%.2f TWh", mwh / 1e6)).when(mwh >= 1e3, F.format_string("%.1f GWh", mwh / 1e3)).otherwise(F.concat(F.round(mwh).cast("long").cast("string"), F.lit(" MWh")))


def share_label(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.format_string("%.1f%%", 100 * part / whole)).otherwise("—")


def round_number(v: Column) -> Column:
    """The number of 1, 2, 5 or 10 times a power of ten that stands for v; 0 if v isn't positive."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    lead = v / base
    step = F.when(lead < 1.5, 1.0).when(lead < 3, 2.0).when(lead < 7, 5.0).otherwise(10.0)
    return F.when(v <= 0, 0.0).otherwise(step * base)


def legend_values(top: Column) -> Column:
    """Up to three ascending round numbers for a size legend."""
    largest = round_number(top)
    values = F.array(round_number(largest / 25), round_number(largest / 5), largest)
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v > 0)))


def marker_radius(mwh: Column, reference: Column) -> Column:
    """A circle whose area grows with the volume, within limits."""
    return F.when(mwh <= 0, 0.0).otherwise(F.greatest(F.lit(SMALLEST), F.least(F.lit(LARGEST), LARGEST * F.sqrt(mwh / reference))))


def balance(inc: Column, dec: Column) -> Column:
    """increase, decrease, or balanced if the net is under a tenth of the total."""
    total, net = inc + dec, inc - dec
    return F.when((total <= 0) | (F.abs(net) / total < 0.1), "balanced").when(net > 0, "increase").otherwise("decrease")
