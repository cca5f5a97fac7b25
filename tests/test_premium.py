"""Premium rating on a hand table: half-even rounding ties, unparsable premiums, null scores."""
from veracity.operators import premium as pm

SCHEMA = ("postcode string, address string, subsidence double, building_prem string, contents_prem double, "
          "flood_loading double, theft_loading double, subsidence_loading double")


def test_premiums_round_half_even_and_flag(spark):
    rows = [("PC1", "a", 9.0, "0.0625", 0.0625, 1.0, 1.0, 1.0),     # exact tie 0.0625 -> 0.062
            ("PC1", "b", 8.0, "0.1875", 0.1875, 1.0, 1.0, 1.0),     # exact tie 0.1875 -> 0.188
            ("PC1", "c", None, "n/a", 10.0, 1.5, 1.1, 1.0),         # unparsable building premium
            ("PC2", "d", 8.5, "100", 40.0, 1.2, 1.05, 1.125)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.address: r for r in pm.calculate_premiums(df).collect()}
    assert got["a"].final_building_premium == 0.062 and got["b"].final_building_premium == 0.188
    assert got["c"].final_building_premium is None and got["c"].referral_flag == "None"
    assert got["a"].referral_flag == "Referral" and got["b"].referral_flag == "None"    # strictly above 8
    assert got["d"].final_building_premium == round(100 * 1.2 * 1.05 * 1.125, 3)
    totals = pm.premium_totals(pm.calculate_premiums(df)).collect()[0]
    assert (totals.addresses_selected, totals.referrals) == (4, 2)


def test_postcode_and_address_selection(spark):
    rows = [("PC2", "z", 1.0, "1", 1.0, 1.0, 1.0, 1.0), ("PC1", "b", 1.0, "1", 1.0, 1.0, 1.0, 1.0),
            ("PC1", "a", 1.0, "1", 1.0, 1.0, 1.0, 1.0), (None, "q", 1.0, "1", 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.postcode for r in pm.postcodes(df).collect()] == ["PC1", "PC2"]
    assert [r.address for r in pm.addresses(df, "PC1").collect()] == ["a", "b"]
    picked = pm.select_addresses(df, "PC1", ["b"])
    assert [r.address for r in picked.collect()] == ["b"]
    chosen = spark.createDataFrame([("a",), ("z",)], "address string")
    assert [r.address for r in pm.select_addresses(df, "PC1", chosen).collect()] == ["a"]
