"""Grading must not chain the sorts of all its steps in one stage: their memory adds up in a task."""

from priorline.operators import market as K


def test_grading_reads_written_steps(spark):
    quotes = spark.createDataFrame([(1, 10, "a", "2024-01-01", -110, -3.0, 40.0), (1, 11, "b", "2024-01-02", 120, -2.5, 41.0), (2, 12, "view", "2024-03-01", None, 4.0, 44.0)],
                                   "game_id LONG, quote_id LONG, provider STRING, captured_at STRING, side_price INT, spread DOUBLE, total DOUBLE")
    quotes = K.long_quotes(quotes.withColumn("captured_at", quotes.captured_at.cast("timestamp")))
    slate = spark.createDataFrame([(2024, 1, 1, "2024-02-01", 5.0, 39.0, 20, 10), (2024, 1, 2, "2024-02-01", -6.0, 50.0, 10, 20)],
                                  "season INT, week INT, game_id LONG, kickoff STRING, pred_margin DOUBLE, pred_total DOUBLE, home_points INT, away_points INT")
    predictions = K.long_predictions(slate.withColumn("kickoff", slate.kickoff.cast("timestamp")))
    out = K.grade(predictions, quotes, quotes.where("provider = 'view'"))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "max_by" not in plan and "median" not in plan and "percentile" not in plan
    assert {(r.game_id, r.target): (r.benchmark, r.quote_id) for r in out.collect()} == {
        (1, "spread"): ("retained_prekickoff", 11), (1, "total"): ("retained_prekickoff", 11),
        (2, "spread"): ("retrospective", 12), (2, "total"): ("retrospective", 12)}
