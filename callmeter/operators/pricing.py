"""Prices of models and costs of calls, in exact decimals."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmeter.functions import fixed
from callmeter.functions.scalar import MONEY, canonical_model, currency_symbol

PRICE = "key string, input decimal(18,12), output decimal(18,12), cache_write decimal(18,12), cache_read decimal(18,12), web_search decimal(18,12), fast decimal(9,3)"


def small_table(spark: SparkSession, rows: list[tuple], kinds: str) -> DataFrame:
    """A table of a few rows as one literal: Spark knows that it is small, and no Python is asked for it. kinds: of its columns."""
    names = [k.split(" ", 1)[0] for k in kinds.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kinds.replace(' ', ':').replace(',:', ',')}>>")))


def price_table(spark: SparkSession, prices: dict[str, tuple]) -> DataFrame:
    return small_table(spark, [(k, *map(str, v[:4]), fixed.WEB_SEARCH_PRICE, str(v[4])) for k, v in prices.items()], PRICE)


def fallback_prices(spark: SparkSession) -> DataFrame:
    return price_table(spark, fixed.FALLBACK_PRICES)


def scan_prices(spark: SparkSession, path: str) -> DataFrame:
    """Prices from a JSON map of models. Entries without an input or output price, or with both 0, are left out.

    Missing prices follow from the input price (cache write 1.25 times, cache read 0.1 times); a name after a provider/
    prefix is an alias unless it has an entry of its own.
    """
    one = "struct<input_cost_per_token:decimal(18,12),output_cost_per_token:decimal(18,12),cache_creation_input_token_cost:decimal(18,12),cache_read_input_token_cost:decimal(18,12),provider_specific_entry:struct<fast:decimal(9,3)>>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string,{one}>")).alias("key", "p"))
    d = lambda c: c.cast("decimal(18,12)")
    priced = rows.filter("p.input_cost_per_token IS NOT NULL AND p.output_cost_per_token IS NOT NULL AND NOT (p.input_cost_per_token = 0 AND p.output_cost_per_token = 0)").select(
        "key", F.col("p.input_cost_per_token").alias("input"), F.col("p.output_cost_per_token").alias("output"),
        d(F.coalesce("p.cache_creation_input_token_cost", F.col("p.input_cost_per_token") * F.lit("1.25").cast("decimal(4,2)"))).alias("cache_write"),
        d(F.coalesce("p.cache_read_input_token_cost", F.col("p.input_cost_per_token") * F.lit("0.1").cast("decimal(4,2)"))).alias("cache_read"),
        F.lit(fixed.WEB_SEARCH_PRICE).cast("decimal(18,12)").alias("web_search"), F.coalesce("p.provider_specific_entry.fast", F.lit(1).cast("decimal(9,3)")).alias("fast"),
    )
    alias = priced.filter(F.col("key").contains("/")).withColumn("full", F.col("key")).withColumn("key", F.substring_index("key", "/", -1))
    both = priced.withColumn("full", F.lit("")).unionByName(alias)
    best = both.groupBy("key").agg(F.min_by(F.struct(*[c for c in priced.columns if c != "key"]), "full").alias("p"))
    return best.select("key", "p.*")


def scan_rates(spark: SparkSession, path: str) -> DataFrame:
    """code, rate (of one dollar), symbol (its own or the usual one, else the code). A missing rate is 1, as is that of USD."""
    return rates(spark.read.schema("code string, rate double, symbol string").json(path))


def rates(rows: DataFrame) -> DataFrame:
    rate = F.when(F.col("code") == "USD", 1.0).otherwise(F.coalesce("rate", F.lit(1.0)))
    return rows.filter("code IS NOT NULL").select("code", rate.alias("rate"), F.coalesce("symbol", currency_symbol(F.col("code"))).alias("symbol"))


def in_currency(df: DataFrame, table: DataFrame, code: str) -> DataFrame:
    """df with code, rate, symbol of one currency: of its row in table, which reaches the driver, else rate 1 and the usual symbol."""
    own = table.filter(F.col("code") == code).first()
    symbol = F.lit(own["symbol"]) if own else currency_symbol(F.lit(code))
    return df.select("*", F.lit(code).alias("code"), F.lit(own["rate"] if own else 1.0).alias("rate"), symbol.alias("symbol"))


def cursor_price_model(model: Column) -> Column:
    """The model that stands for the editor's default one in prices."""
    return F.when(model.isin("", "default") | model.isNull(), F.lit("claude-sonnet-4-5")).otherwise(model)


def _prefixes(name: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(name)), lambda n: F.substr(F.col(name), F.lit(1), n))


def resolve_price(models: DataFrame, prices: DataFrame, fallback: DataFrame) -> DataFrame:
    """model and its price row for the distinct models of `models`; unmatched models are left out.

    In order: exact in prices, exact in fallback, a fallback key with a hyphen after it as prefix, prices by prefix
    either way, a fallback key as prefix. Of several keys the longest, then the first by name. A key that begins a name is
    found by the name's prefixes, a name that begins a key by the key's: joins on equal strings, of the distinct names and
    of the price tables, which have a row for each model that is sold.
    """
    names = models.select("model", canonical_model(F.col("model")).alias("name")).distinct().filter("name IS NOT NULL")
    table = prices.withColumn("own", F.lit(True)).unionByName(fallback.withColumn("own", F.lit(False)))
    whole = lambda key: F.struct(F.lit("key").alias("of"), key.alias("part"))
    begins = lambda name: F.struct(F.lit("name").alias("of"), name.alias("part"))
    asked = F.explode(F.concat(F.transform(_prefixes("name"), whole), F.array(begins(F.col("name")))))
    offered = F.explode(F.concat(F.array(whole(F.col("key"))), F.transform(F.filter(_prefixes("key"), lambda p: F.col("own") & (p != "") & (p != F.col("key"))), begins)))
    met = names.select("*", asked.alias("at")).join(table.select("*", offered.alias("at")), "at")
    exact, hyphen = F.col("name") == F.col("key"), F.col("name").startswith(F.concat("key", F.lit("-")))
    tier = F.when(F.col("own") & exact, 1).when(~F.col("own") & exact, 2).when(~F.col("own") & hyphen, 3).when(F.col("own") & (F.col("name") != ""), 4).when(~F.col("own"), 5)
    met = met.withColumn("tier", tier).filter("tier IS NOT NULL")
    best = F.min_by(F.struct(*table.columns), F.struct("tier", -F.length("key"), "key")).alias("p")
    return met.groupBy("model").agg(best).select("model", "p.key", "p.input", "p.output", "p.cache_write", "p.cache_read", "p.web_search", "p.fast")


def call_cost(input_tokens: Column, output_tokens: Column, cache_write: Column, cache_read: Column, web: Column, speed: Column) -> Column:
    """Cost by the price columns of the row; 0 where the model has none."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(18,0)")
    total = n(input_tokens) * F.col("input") + n(output_tokens) * F.col("output") + n(cache_write) * F.col("cache_write") + n(cache_read) * F.col("cache_read") + n(web) * F.col("web_search")
    times = F.when(speed == "fast", F.col("fast")).otherwise(F.lit(1).cast("decimal(9,3)"))
    return F.coalesce((total.cast(MONEY) * times).cast(MONEY), F.lit(0).cast(MONEY))


def with_cost(calls: DataFrame, prices: DataFrame, fallback: DataFrame | None = None, models: DataFrame | None = None) -> DataFrame:
    """Adds cost_usd by provider: codex and opencode bill reasoning as output (codex's input_tokens are without cached ones).

    cursor's default model has the price of the model that stands for it; opencode keeps the logged cost (cost_logged, if
    there is such a column) where the computed one is 0. models: column model, all that calls can have; without it calls
    are evaluated once more for their distinct models. What is broadcast has a row for each model on sale.
    """
    fallback = prices.limit(0) if fallback is None else fallback
    priced = F.when(F.col("provider") == "cursor", cursor_price_model(F.col("model"))).otherwise(F.col("model"))
    rows = calls.withColumn("_priced", priced)
    names = rows.select(F.col("_priced").alias("model")) if models is None else models.select("model").union(models.select(cursor_price_model(F.col("model"))))
    table = resolve_price(names, prices, fallback).withColumnRenamed("model", "_priced")
    c = lambda x: F.coalesce(F.col(x), F.lit(0)) if x in calls.columns else F.lit(0)
    codex, opencode = F.col("provider") == "codex", F.col("provider") == "opencode"
    rows = rows.join(F.broadcast(table), "_priced", "left")
    out = F.when(codex | opencode, c("output_tokens") + c("reasoning_tokens")).otherwise(c("output_tokens"))
    cost = call_cost(c("input_tokens"), out, c("cache_write_tokens"), c("cache_read_tokens"), c("web_search_requests"), F.col("speed"))
    if "cost_logged" in calls.columns:
        logged = F.coalesce(F.col("cost_logged"), F.lit(0)).cast(MONEY)
        cost = F.when(opencode & (cost == 0) & (logged > 0), logged).otherwise(cost)
    return rows.withColumn("cost_usd", cost).drop(*table.columns)
