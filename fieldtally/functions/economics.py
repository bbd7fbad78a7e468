"""Yield and money of a plot season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.functions.keys import as_column


def revenue(grain="grain_tha", price: float = fixed.GRAIN_PRICE) -> Column:
    return as_column(grain) * F.lit(float(price))


def spray_bill(sprays="spray_count", cost="cost_per_spray") -> Column:
    return as_column(sprays) * as_column(cost)


def net_profit(price: float = fixed.GRAIN_PRICE) -> Column:
    return revenue("grain_tha", price) - spray_bill()


def with_net_profit(df: DataFrame, price: float = fixed.GRAIN_PRICE) -> DataFrame:
    return df.withColumn("net_profit", net_profit(price))


def to_tha(
    biomass, harvest_index: float = fixed.HARVEST_INDEX, conversion: float = fixed.BIOMASS_TO_THA
) -> Column:
    """Grain in t/ha from dry matter in g/m2; the same holds for lost dry matter."""
    return as_column(biomass) * F.lit(harvest_index) * F.lit(conversion)


def yield_loss_share(grain="grain_tha", loss="pest_loss_tha") -> Column:
    """Lost part of the pest-free yield; null where there was none to lose."""
    total = as_column(grain) + as_column(loss)
    return F.when(total != 0, as_column(loss) / total)
