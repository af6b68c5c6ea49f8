"""Usage, cost and budget analytics. Sums are of decimals or of whole cents, never of floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layers import running_total


def cents(amount: Column) -> Column:
    return (amount.cast("decimal(18,2)") * 100).cast("long")


def budget_alerts(spent: DataFrame, day: str, amount: str, budget: DataFrame, levels: tuple[int, ...] = (110, 100, 90), forecast: int = 110) -> DataFrame:
    """day, spent, level, forecast_over: the month's cents so far, the highest level of percent reached, and whether the run rate ends over `forecast`.

    budget is one row with `budget` in cents a month. Rows are summed by day first, so a window holds
    a month of days at most.
    """
    days = spent.groupBy(F.col(day).cast("date").alias("day")).agg(F.sum(cents(F.col(amount))).alias("cents")).withColumn("month", F.trunc("day", "month"))
    so_far = running_total(days, ["month"], "day", "cents").join(F.broadcast(budget))
    level = F.coalesce(*[F.when(100 * F.col("total") >= n * F.col("budget"), n) for n in levels], F.lit(0))
    over = 100 * F.col("total") * F.dayofmonth(F.last_day("day")) > forecast * F.col("budget") * F.dayofmonth("day")
    return so_far.select("day", F.col("total").alias("spent"), level.cast("int").alias("level"), over.alias("forecast_over"))


def summary(usage: DataFrame, levels: list[str], amount: str) -> DataFrame:
    """levels, grouping, rows, cents: sums over every prefix of the levels."""
    return usage.rollup(*levels).agg(F.grouping_id().alias("grouping"), F.count("*").alias("rows"), F.sum(cents(F.col(amount))).alias("cents"))


def top_drivers(usage: DataFrame, key: str, amount: str, k: int) -> DataFrame:
    """The k keys that cost most; ties go to the smaller key."""
    return usage.groupBy(key).agg(F.sum(cents(F.col(amount))).alias("cents")).orderBy(F.col("cents").desc(), key).limit(k)


def cost_per_unit(usage: DataFrame, group: str, unit: str, amount: str) -> DataFrame:
    """group, units (distinct), cents, cents_per_unit."""
    by_unit = usage.groupBy(group, unit).agg(F.sum(cents(F.col(amount))).alias("c"))
    return by_unit.groupBy(group).agg(F.count("*").alias("units"), F.sum("c").alias("cents")).withColumn("cents_per_unit", F.round(F.col("cents") / F.col("units"), 6))


def feedback(ratings: DataFrame, epic: str, rating: str, categories: str) -> DataFrame:
    """epic, category, responses, mean_rating: all responses as `all`, and by category those rated 1 or 2."""
    kinds = F.when(F.col(rating) <= 2, F.col(categories)).otherwise(F.array().cast("array<string>"))
    each = ratings.select(epic, rating, F.explode(F.concat(F.array(F.lit("all")), kinds)).alias("category"))
    return each.groupBy(epic, "category").agg(F.count("*").alias("responses"), F.round(F.avg(rating), 6).alias("mean_rating"))


def monthly_cost(usage: DataFrame, ts: str, quantity: str, price: str) -> DataFrame:
    """month, cents: quantity times unit price, each line rounded to cents."""
    line = cents(F.col(quantity).cast("decimal(18,2)") * F.col(price).cast("decimal(18,2)"))
    return usage.groupBy(F.trunc(F.col(ts).cast("date"), "month").alias("month")).agg(F.sum(line).alias("cents"))


def estimate(lines: DataFrame, environment: str, epic: str, monthly: str) -> DataFrame:
    """environment, epic, monthly, annual and daily cents, and the epic's share of its environment; monthly amounts are of one month."""
    by = lines.groupBy(environment, epic).agg(F.sum(cents(F.col(monthly))).alias("monthly"))
    whole = F.sum("monthly").over(Window.partitionBy(environment))
    return by.select(environment, epic, "monthly", (12 * F.col("monthly")).alias("annual"), F.round(12 * F.col("monthly") / 365, 6).alias("daily"), F.round(F.try_divide(F.col("monthly"), whole), 6).alias("share"))


def against_budget(actual: DataFrame, budget: DataFrame, key: list[str], amount: str) -> DataFrame:
    """key, budget, actual, left and used (share, null without a budget) in cents; keys of either side."""
    spent = actual.groupBy(*key).agg(F.sum(cents(F.col(amount))).alias("actual"))
    both = budget.select(*key, "budget").join(spent, key, "full")
    some = lambda c: F.coalesce(c, F.lit(0))
    return both.select(*key, some("budget").alias("budget"), some("actual").alias("actual"), (some("budget") - some("actual")).alias("left"), F.round(F.try_divide(some("actual"), F.col("budget")), 6).alias("used"))


def at_list_price(calls: DataFrame, prices: DataFrame, group: str, model: str, tokens: str, started: str, ended: str) -> DataFrame:
    """group, calls, cents and days (from the first start to the last end) of calls at prices(model, price) a token; calls without a price cost nothing and are counted in `unpriced`."""
    by = calls.groupBy(group, model).agg(F.count("*").alias("calls"), F.sum(F.col(tokens).cast("decimal(18,0)")).alias("tokens"), F.min(started).alias("first"), F.max(ended).alias("last"))
    priced = by.join(prices.select(model, F.col("price").cast("decimal(10,4)").alias("price")), model, "left")
    cost = F.sum(F.coalesce(F.round(F.col("tokens") * F.col("price") * 100, 0).cast("long"), F.lit(0)))
    days = F.datediff(F.max("last"), F.min("first"))
    return priced.groupBy(group).agg(F.sum("calls").alias("calls"), F.sum(F.when(F.col("price").isNull(), F.col("calls")).otherwise(0)).alias("unpriced"), cost.alias("cents"), days.alias("days"))


def retiring(models: DataFrame, retires: str, today: str, days: int) -> DataFrame:
    """Models whose date of retirement is at most so many days after `today` (a date as text), the past included."""
    return models.where(F.col(retires) <= F.date_add(F.lit(today).cast("date"), days))


def unrated(finished: DataFrame, ratings: DataFrame, epic: str) -> DataFrame:
    """Finished epics that nobody has rated yet."""
    return finished.select(epic).distinct().join(ratings, epic, "left_anti")


def payback(years: DataFrame, project: str, year: str, net: str) -> DataFrame:
    """project, payback_year: the first year whose running net is not negative, null if none is."""
    total = F.sum(net).over(Window.partitionBy(project).orderBy(year).rowsBetween(Window.unboundedPreceding, 0))
    return years.withColumn("net_", total).groupBy(project).agg(F.min(F.when(F.col("net_") >= 0, F.col(year))).alias("payback_year"))


def returns(years: DataFrame, project: str, year: str, cost: str, gain: str) -> DataFrame:
    """project, year, net, running_net and running_return (net gain so far over cost so far, null without cost) in cents; years that repeat are one, a null amount is none."""
    amount = lambda c: F.coalesce(F.sum(c), F.lit(0))
    by = years.groupBy(project, year).agg(amount(cost).alias("cost_"), amount(gain).alias("gain_"))
    # a row a project and year
    so_far = Window.partitionBy(project).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    spent, net = F.sum("cost_").over(so_far), F.sum(F.col("gain_") - F.col("cost_")).over(so_far)
    return by.select(project, year, (F.col("gain_") - F.col("cost_")).alias("net"), net.alias("running_net"), F.round(F.try_divide(net, spent), 6).alias("running_return"))


def delivered(stories: DataFrame, epic: str, status: str, closed: DataFrame) -> DataFrame:
    """Epics of which every story is done and no close-out exists."""
    return stories.groupBy(epic).agg(F.bool_and(F.col(status) == "done").alias("done_")).where("done_").select(epic).join(closed, epic, "left_anti")


def drifted(artefacts: DataFrame, sources: DataFrame, key: str, updated: str) -> DataFrame:
    """Artefacts older than their source."""
    return artefacts.join(sources.select(key, F.col(updated).alias("source_")), key).where(F.col("source_") > F.col(updated)).drop("source_")


def not_allowed(grants: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    return grants.join(allowed, keys, "left_anti")
