import pytest
from pyspark.sql import functions as F

from ledgerfold.functions import money
from ledgerfold.operators import pricing, usage
from ledgerfold.sources import tables


def book(spark):
    p = spark.createDataFrame([("opus-4", "2026-01-01", 10.0, 1.0, 12.5, 20.0, 50.0, False, "confirmed"), ("opus-4", "2026-07-01", 5.0, 0.5, 6.25, 10.0, 25.0, False, "confirmed"), ("opus-4", "2026-08-01", 1.0, 1.0, 1.0, 1.0, 1.0, False, "proposed")], "model_key string, d string, input double, cache_read double, cache_write_5m double, cache_write_1h double, output double, assumption boolean, status string")
    a = spark.createDataFrame([("opus", "opus-4", "2026-01-01"), ("opus", "opus-5", "2026-08-01")], "alias string, target string, d string")
    day = F.to_date("d").alias("effective_from")
    return p.select("*", day).drop("d"), a.select("alias", "target", day)


@pytest.mark.parametrize("model,day,cost,today,status", [("claude-opus-4-1m", "2026-03-10", 62.0, 31.0, "priced"), ("opus", "2026-07-10", 31.0, 31.0, "priced"), ("opus", "2026-08-10", None, None, "unpriced"), ("opus-4", "2025-12-01", None, 31.0, "unpriced")])
def test_price_on_date_and_today(spark, model, day, cost, today, status):
    u = spark.createDataFrame([(model, 1_000_000, 2_000_000, 3_000_000, 1_000_000, 100_000, 0)], "model string, uncached_input_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long, cache_creation_1h_input_tokens long, output_tokens long, unclassified_tokens long").withColumn("day", F.lit(day).cast("date"))
    r = pricing.price_usage(u, *book(spark), today="2026-07-20").first()
    close = lambda x, y: (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9)
    assert close(r["cost_usd"], cost) and close(r["cost_today_usd"], today) and r["price_status"] == status


def test_missing_rate_is_partial(spark):
    c, s = money.cost(*[F.lit(10)] * 5, {"input": F.lit(1.0), "cache_read": F.lit(None).cast("double"), "cache_write_5m": F.lit(1.0), "cache_write_1h": F.lit(1.0), "output": F.lit(1.0)})
    assert spark.range(1).select(s.alias("s")).first()["s"] == "partial"


def test_model_family(spark):
    df = spark.createDataFrame([("claude-opus-4-8-1m",), (" Opus-4[1m]",), ("claude-haiku-20240115",)], "m string")
    assert [r[0] for r in df.select(money.model_family(F.col("m"))).collect()] == ["opus-4-8", "opus-4", "haiku"]


def test_trailing_windows(spark):
    led = spark.createDataFrame([("2026-09-20 23:00:00", 1020), ("2026-09-21 01:00:00", 2030)], "h string, total_tokens long").select(F.col("h").cast("timestamp").alias("usage_hour"), "total_tokens")
    got = {r["window"]: r["tokens"] for r in usage.usage_summary(led, "2026-09-21 02:15:00").collect()}
    assert (got["1h"], got["6h"], got["30d"], got["all"]) == (1523, 3050, 3050, 3050)


def test_carbon(spark):
    z = {"low": 0.0, "central": 0.0, "high": 0.0}
    same = lambda x: {"low": x, "central": x, "high": x}
    f = {"tiers": [{"key": "small", "match": ["haiku"], "output_wh_per_mtok": same(100.0)}, {"key": "large", "match": ["opus"], "output_wh_per_mtok": same(1000.0)}], "default_tier": "small", "ratios": {"input": same(0.1), "write": same(0.2), "read": same(0.02)}, "pue": same(1.2), "grids": [{"key": "g", "g_co2e_per_kwh": 400}], "default_grid": "g"}
    u = spark.createDataFrame([("haiku", 2_000_000, 0, 10_000_000, 1_000_000, 0), ("opus", 0, 1_000_000, 0, 500_000, 0)], "model string, uncached_input_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long, output_tokens long, unclassified_tokens long").withColumn("day", F.lit("2026-01-01").cast("date"))
    r = usage.carbon(u, f, "2026-01-02").where("window = 'all' and scenario = 'central'").first()
    assert (round(r["input_wh"]), round(r["read_wh"]), round(r["write_wh"]), round(r["output_wh"]), round(r["total_wh"])) == (20, 20, 200, 600, 840)
    assert abs(r["co2e_g"] - 840 * 1.2 * 0.4) < 1e-6
    assert tables.validate_carbon(f) == [] and tables.validate_carbon(f | {"default_tier": "x", "pue": {"low": 2.0, "central": 1.0, "high": 3.0}}) == ["unknown default tier", "range of pue"]
    assert z
