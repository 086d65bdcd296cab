"""Quotes: the reference line, the side, the best executable quote, settlement and audits.

Quotes are held long: game_id, target (spread or total), provider, point, price, captured_at,
quote_id.  Every step first cuts a game's quotes to the latest per provider with a map-side
combined aggregation, so a game with very many captures is small before it is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import odds
from ..session import stage_table

LINK = ["game_id", "target"]


def long_quotes(quotes: DataFrame) -> DataFrame:
    rows = F.array(F.struct(F.lit("spread").alias("target"), F.col("spread").cast("double").alias("point")),
                   F.struct(F.lit("total").alias("target"), F.col("total").cast("double").alias("point")))
    return quotes.select("game_id", "quote_id", "provider", "captured_at", F.col("side_price").alias("price"), F.inline(rows)).where(
        "point IS NOT NULL")


def long_predictions(slate: DataFrame) -> DataFrame:
    rows = F.array(F.struct(F.lit("spread").alias("target"), F.col("pred_margin").alias("prediction"),
                            (F.col("home_points") - F.col("away_points")).cast("double").alias("actual")),
                   F.struct(F.lit("total").alias("target"), F.col("pred_total").alias("prediction"),
                            (F.col("home_points") + F.col("away_points")).cast("double").alias("actual")))
    return slate.select("season", "week", "game_id", "kickoff", F.inline(rows))


def latest_per_provider(quotes: DataFrame) -> DataFrame:
    """SO-2: the newest quote of each provider by (captured_at, quote_id)."""
    return quotes.groupBy(*LINK, F.lower("provider").alias("provider")).agg(F.max_by(
        F.struct("point", "price", "captured_at", "quote_id"), F.struct("captured_at", "quote_id")).alias("q")).select(
        *LINK, "provider", "q.*")


def reference_line(latest: DataFrame) -> DataFrame:
    """MK-1: the consensus line if quoted, else the median over providers; with rule, count and ids."""
    consensus = F.col("provider") == "consensus"
    out = latest.groupBy(*LINK).agg(
        F.max(F.when(consensus, F.struct("point", "quote_id"))).alias("_c"), F.median("point").alias("_m"), F.count("*").alias("_n"),
        F.array_sort(F.collect_list(F.col("quote_id").cast("string"))).alias("_ids"), F.max("captured_at").alias("snapshot_at"))
    has = F.col("_c").isNotNull()
    return out.select(*LINK, F.coalesce("_c.point", "_m").alias("line"),
                      F.when(has, "consensus").otherwise("provider_median").alias("rule"),
                      F.when(has, F.lit(1).cast("long")).otherwise(F.col("_n")).alias("provider_count"),
                      F.when(has, F.array(F.col("_c.quote_id").cast("string"))).otherwise(F.col("_ids")).alias("quote_ids"), "snapshot_at")


def direction(prediction: Column, line: Column) -> Column:
    """MK-2: the side is fixed by the reference line, before any shopping."""
    return F.when(F.col("target") == "spread", odds.spread_direction(prediction, line)).otherwise(odds.total_direction(prediction, line))


def preference(side: Column, require_price: bool = False) -> Column:
    """SO-4: sort key, smallest first: best point for the side, then the best price, then the id."""
    point = F.when(side.isin("home", "under"), -F.col("point")).otherwise(F.col("point"))
    price = F.col("price") if require_price else F.coalesce("price", F.lit(odds.STANDARD_PRICE))
    return F.struct(point.alias("p"), (-odds.profit_per_unit(price)).alias("v"), F.col("quote_id").alias("i"))


def admissible(quotes: DataFrame, predictions: DataFrame, cutoff: Column | None = None, declared: DataFrame | None = None) -> DataFrame:
    """Quotes of the game captured before its kickoff, or declared exceptions, and not after the cutoff."""
    games = predictions.select("game_id", "kickoff").distinct()
    q = quotes.join(games, "game_id")
    ok = F.col("captured_at") < F.col("kickoff")
    if declared is not None:
        q = late_exceptions(q, declared)
        ok = ok | F.col("accepted_late")
    q = q.where(ok)
    return q.where(F.col("captured_at") <= cutoff) if cutoff is not None else q


def late_exceptions(quotes: DataFrame, declared: DataFrame) -> DataFrame:
    """MK-7: a late quote passes only if every declared field is its own."""
    d = declared.select("game_id", "target", "quote_id", "provider").distinct().withColumn("_d", F.lit(True))
    return quotes.join(d, ["game_id", "target", "quote_id", "provider"], "left").withColumn(
        "accepted_late", F.coalesce("_d", F.lit(False))).drop("_d")


def best_quote(predictions: DataFrame, quotes: DataFrame) -> DataFrame:
    """MK-3: side from the reference line, then the best of the latest quotes, and its edge.

    The latest quotes and the sides are written: both are read twice, and in one plan their sorts would all be held by one task.
    """
    latest = stage_table(latest_per_provider(quotes))
    ref = reference_line(latest)
    p = stage_table(predictions.join(ref, LINK).withColumn("side", direction(F.col("prediction"), F.col("line"))))
    best = latest.join(p.select(*LINK, "side"), LINK).groupBy(*LINK).agg(
        F.min_by(F.struct("quote_id", "provider", "point", F.coalesce("price", F.lit(odds.STANDARD_PRICE)).alias("price"), "captured_at"),
                 preference(F.col("side"))).alias("b"))
    out = p.join(best, LINK).select(*p.columns, "b.*")
    edge = F.when(F.col("target") == "spread", F.col("prediction") + F.col("point")).otherwise(F.col("prediction") - F.col("point"))
    return out.withColumn("edge", F.abs(edge))


def signed_margin() -> Column:
    """MK-4: how far the selected side is ahead of its point; stored spreads are home-signed."""
    spread = F.when(F.col("side") == "home", F.col("actual") + F.col("point")).otherwise(-F.col("actual") - F.col("point"))
    total = F.when(F.col("side") == "over", F.col("actual") - F.col("point")).otherwise(F.col("point") - F.col("actual"))
    return F.when(F.col("target") == "spread", spread).otherwise(total)


def grade(predictions: DataFrame, retained: DataFrame, fallback: DataFrame) -> DataFrame:
    """MK-5: the best retained pre-kickoff quote, else the best fallback line, else ungraded."""
    first = stage_table(best_quote(predictions, admissible(retained, predictions)).withColumn("benchmark", F.lit("retained_prekickoff")))
    open_ = predictions.join(first.select(*LINK), LINK, "left_anti")
    second = stage_table(best_quote(open_, fallback.join(open_.select(*LINK), LINK, "left_semi")).withColumn("benchmark", F.lit("retrospective")))
    chosen = first.unionByName(second).select(*LINK, "benchmark", "side", "point", "price", "quote_id", "provider", "line", "rule", "edge")
    out = predictions.join(chosen, LINK, "left")
    units = odds.settle(signed_margin(), odds.profit_per_unit(F.col("price")))
    return out.withColumns({
        "benchmark": F.coalesce("benchmark", F.lit("ungraded")),
        "units": F.when(F.col("side").isNotNull(), units)}).withColumn(
        "result", F.when(F.col("units") > 0, "win").when(F.col("units") < 0, "loss").when(F.col("units") == 0, "push"))


def coverage_audit(predictions: DataFrame, quotes: DataFrame) -> DataFrame:
    """MK-6: per prediction the candidate and eligible counts and the first failing reason."""
    q = quotes.groupBy(*LINK).agg(F.count("*").alias("_all"), F.min("captured_at").alias("_first"))
    raw = predictions.join(q, LINK, "left")
    ok = quotes.join(predictions.select(*LINK, "kickoff"), LINK).where("captured_at < kickoff").groupBy(*LINK).agg(F.count("*").alias("eligible"))
    out = raw.join(ok, LINK, "left")
    return out.select(*LINK, F.coalesce("_all", F.lit(0)).alias("candidates"), F.coalesce("eligible", F.lit(0)).alias("eligible"),
                      F.when(F.col("_all").isNull(), "no_quote").when(F.col("eligible").isNull(), "post_kickoff").otherwise("ok").alias("reason"))


def kickoff_moves(old: DataFrame, new: DataFrame, quotes: DataFrame) -> DataFrame:
    """MK-8: games where a corrected kickoff moves a quote from one side of it to the other."""
    k = old.select("game_id", F.col("kickoff").alias("_old")).join(new.select("game_id", F.col("kickoff").alias("_new")), "game_id").where(
        "_old <> _new")
    hit = quotes.join(k, "game_id").where((F.col("captured_at") < F.col("_old")) != (F.col("captured_at") < F.col("_new")))
    return hit.groupBy("game_id").agg(F.count("*").alias("moved_quotes"))


def selection_problems(selected: DataFrame, latest: DataFrame) -> DataFrame:
    """MK-9: selections that are not among the linked quotes, or not the best point for their side."""
    take_max = F.col("side").isin("home", "under")
    linked = latest.select(*LINK, F.col("quote_id").alias("_id"), F.col("point").alias("_pt"))
    both = selected.join(linked, LINK, "left").groupBy(*LINK, "side", "quote_id", "point").agg(
        F.max("_pt").alias("_hi"), F.min("_pt").alias("_lo"), F.bool_or(F.col("_id") == F.col("quote_id")).alias("_linked"))
    best = F.when(take_max, F.col("_hi")).otherwise(F.col("_lo"))
    why = F.when(~F.coalesce("_linked", F.lit(False)), "not_linked").when(F.abs(F.col("point") - best) > 1e-9, "not_best")
    return both.select(*LINK, "side", "quote_id", why.alias("why")).where("why IS NOT NULL")


def price_presence(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """MK-10: share of quotes with a price."""
    return quotes.groupBy(*keys).agg(F.count("*").alias("quotes"), F.avg(F.col("price").isNotNull().cast("int")).alias("priced"))


def reference_quotes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AG-32: reference lines from usable quotes, and every excluded quote with a reason."""
    reason = F.when(F.col("spread").isNull() & F.col("total").isNull(), "no_value").when(F.col("captured_at").isNull(), "no_capture_time")
    tagged = raw.withColumn("reason", reason)
    usable = long_quotes(tagged.where("reason IS NULL"))
    return reference_line(latest_per_provider(usable)), tagged.where("reason IS NOT NULL").select("quote_id", "reason")
