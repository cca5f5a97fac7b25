"""Premium rating: loaded premiums, referral flag and totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.functions.coerce import as_double


def round_half_even(x: Column, places: int = 3) -> Column:
    """Round like numpy/pandas ``round``: scale, round half to even, unscale."""
    scale = float(10 ** places)
    return F.rint(x * scale) / scale


# P11 / P12
def calculate_premiums(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Final building / contents premium = premium x flood x theft x subsidence loading (3 places);
    'Referral' when the subsidence score is above 8, else the text 'None'."""
    m = dict(mapping or {k: k for k in ("building_prem", "contents_prem", "flood_loading", "theft_loading",
                                         "subsidence_loading", "subsidence")})
    types = {f.name: f.dataType for f in df.schema.fields}

    def num(k: str) -> Column:
        return as_double(F.col(f"`{m[k]}`"), types[m[k]])

    def loaded(base: str) -> Column:
        # left to right, like the rating sheet: premium x flood x theft x subsidence
        return num(base) * num("flood_loading") * num("theft_loading") * num("subsidence_loading")

    subs = num("subsidence")
    return df.select(
        "*",
        round_half_even(loaded("building_prem")).alias("final_building_premium"),
        round_half_even(loaded("contents_prem")).alias("final_contents_premium"),
        F.when(subs > 8, "Referral").otherwise("None").alias("referral_flag"),
    )


# F7
def postcodes(df: DataFrame, postcode: str = "postcode") -> DataFrame:
    return df.select(postcode).where(F.col(postcode).isNotNull()).distinct().orderBy(postcode)


def addresses(df: DataFrame, selected_postcode: str, postcode: str = "postcode",
              address: str = "address") -> DataFrame:
    return (df.where(F.col(postcode) == selected_postcode).select(address)
              .where(F.col(address).isNotNull()).distinct().orderBy(address))


# F6
def select_addresses(df: DataFrame, selected_postcode: str, selected: Sequence[str] | DataFrame,
                     postcode: str = "postcode", address: str = "address") -> DataFrame:
    """Rows of one postcode whose address is in the selection (a list, or a DataFrame of addresses
    for selections too large to inline — then a semi join)."""
    rows = df.where(F.col(postcode) == selected_postcode)
    if isinstance(selected, DataFrame):
        return rows.join(selected.select(F.col(address).alias("__a")).distinct(),
                         F.col(address) == F.col("__a"), "left_semi")
    return rows.where(F.col(address).isin(list(selected)))


# A18
def premium_totals(priced: DataFrame, address: str = "address") -> DataFrame:
    return priced.agg(
        F.count_distinct(F.col(address)).alias("addresses_selected"),
        F.sum("final_building_premium").alias("total_building_premium"),
        F.sum("final_contents_premium").alias("total_contents_premium"),
        F.count_if(F.col("referral_flag") == "Referral").alias("referrals"),
    )
