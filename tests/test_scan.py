"""Two-level scans, ranks and as-of operators against plain Python, with a hot key and ties."""

import random

import pytest
from pyspark.sql import functions as F

from priorline.operators import joins as J, scan, windows as W


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = 1 if rng.random() < 0.4 else rng.randint(2, 40)
        data.append((key, rng.randint(0, 200), i, None if rng.random() < 0.1 else rng.randint(-20, 20)))
    return data


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "k INT, t INT, i INT, x INT").repartition(parts)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values(spark, rows, inclusive):
    specs = {"s": ("sum", F.col("x")), "n": ("count", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x")), "last": ("last", F.col("x"))}
    got = {r["i"]: r for r in scan.running(frame(spark, rows), ["k"], ["t", "i"], F.floor(F.col("t") / 20), specs, inclusive).collect()}
    assert len(got) == len(rows)
    for series in by_key(rows).values():
        seen = []
        for r in series:
            if inclusive:
                seen.append(r[3])
            xs = [x for x in seen if x is not None]
            g = got[r[2]]
            assert (g["s"], g["n"], g["hi"], g["lo"], g["last"]) == (
                sum(xs) if xs else None, len(xs), max(xs, default=None), min(xs, default=None), xs[-1] if xs else None)
            if not inclusive:
                seen.append(r[3])


def test_rank_matches_sort(spark, rows):
    got = scan.competition_rank(frame(spark, rows), ["k"], F.col("x"), slices=8, cohort="size").collect()
    for g in got:
        xs = [r[3] for r in rows if r[0] == g["k"] and r[3] is not None]
        want = None if g["x"] is None else (1 + sum(x > g["x"] for x in xs), len(xs))
        assert (None if g["rank"] is None else (g["rank"], g["size"])) == want


def test_prior_totals_leave_out_the_same_time(spark, rows):
    got = scan.prior_totals(frame(spark, rows), ["k"], "t", {"n": F.lit(1)}).collect()
    for g in got:
        assert g["n"] == sum(r[0] == g["k"] and r[1] < g["t"] for r in rows)


def test_latest_state(spark, rows):
    probes = spark.createDataFrame([(k, t) for k in (1, 2, 3, 99) for t in range(0, 220, 7)], "k INT, p INT")
    got = J.latest_state(probes, frame(spark, rows), ["k"], "p", "t", ["i"]).collect()
    for g in got:
        want = max(((r[1], r[2]) for r in rows if r[0] == g["k"] and r[1] <= g["p"]), default=None)
        assert (None if g["i"] is None else (g["matched_t"], g["i"])) == want


def test_ewma_over_many_blocks(spark, rows):
    alpha = 0.9  # short blocks, so several of them are crossed
    got = {r["i"]: r["e"] for r in W.ewma_prior(frame(spark, rows), ["k"], ["t", "i"], F.floor(F.col("t") / 20), "x", alpha, "e").collect()}
    for series in by_key(rows).values():
        num = den = 0.0
        for r in series:
            g = got[r[2]]
            assert g is None if den == 0 else g == pytest.approx(num / den, rel=1e-9, abs=1e-9)
            num, den = num * (1 - alpha), den * (1 - alpha)
            if r[3] is not None:
                num, den = num + r[3] * (1 - alpha), den + (1 - alpha)


def test_segments(spark):
    data = [(1, 1, "A", "Rush"), (1, 2, "A", "Punt"), (1, 3, "A", "Rush"), (1, 4, "B", "Rush"), (1, 5, "B", "Rush"), (1, 6, "B", "Kickoff")]
    df = spark.createDataFrame(data, "g INT, n INT, o STRING, p STRING")
    out = W.assign_segments(df, ["g"], ["n"], F.floor(F.col("n") / 2), "o", F.col("p") == "Punt", F.col("p") == "Kickoff")
    assert [r["drive_number"] for r in out.orderBy("n").collect()] == [1, 1, 2, 3, 3, 4]


def test_order_and_partitioning_do_not_matter(spark, rows):
    specs = {"s": ("sum", F.col("x"))}
    run = lambda data, parts: sorted(map(tuple, scan.running(frame(spark, data, parts), ["k"], ["t", "i"], F.floor(F.col("t") / 50), specs).select("i", "s").collect()))
    assert run(rows, 2) == run(rows[::-1], 9)


def test_later_rows_do_not_change_earlier_ones(spark, rows):
    cut = [r for r in rows if r[1] < 100]
    run = lambda data: {tuple(r) for r in scan.prior_totals(frame(spark, data), ["k"], "t", {"n": F.lit(1)}).where("t < 100").collect()}
    assert run(rows) == run(cut)


def test_ranks_when_rows_differ_between_readings(spark):
    # sums of doubles and approximate percentiles may come out otherwise each time a plan is run
    draw = F.udf(lambda i: random.random(), "double").asNondeterministic()
    drawn = spark.range(0, 4000, 1, 8).select((F.col("id") % 2).alias("k"), draw("id").alias("x"))
    got = scan.competition_rank(drawn, ["k"], F.col("x")).collect()
    for k in (0, 1):
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: -r["x"])
        assert [r["rank"] for r in mine] == list(range(1, 2001))


def test_equal_means_share_a_rank(spark, monkeypatch):
    from priorline.plans import wn
    from priorline.plans.registry import QUERIES
    half = 0.0000015625  # the same mean, added up in other orders
    rows = [(1, half), (2, 1.5624999999999998e-06), (3, 1.5625000000000002e-06), (4, 1.0)]
    monkeypatch.setattr(wn, "long_measures", lambda d: spark.createDataFrame([(t, "offense", "ppa_per_play", v) for t, v in rows], "team INT, role STRING, metric STRING, value DOUBLE"))
    got = {r["team"]: r["rank"] for r in QUERIES["wn7_directional_rank"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {4: 1, 1: 2, 2: 2, 3: 2}


def test_running_shuffles_rows_once(spark, rows):
    """Rows meet what their slice starts from without a join."""
    out = scan.running(frame(spark, rows), ["k"], ["t", "i"], "CAST(t / 20 AS INT)", {"s": ("sum", F.col("x")), "l": ("last", F.col("x"))})
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_long_keys_alone_are_sliced(spark, rows, monkeypatch):
    """Only keys of more rows than the limit are set apart, null keys as well, and both forms of a scan agree."""
    monkeypatch.setattr(scan, "LONG", 500)
    df = frame(spark, rows + [(None, t, 5000 + t, t % 7) for t in range(600)])
    parts = scan.apart(df, ["k"])
    assert [(sliced, {r["k"] for r in part.select("k").distinct().collect()} == {1, None}) for part, sliced in parts] == [(False, False), (True, True)]
    spec = {"c": ("count", F.col("x")), "l": ("last", F.col("x")), "m": ("min", F.col("x"))}
    for part, _ in parts:
        both = [{(r["k"], r["i"]): (r["c"], r["l"], r["m"]) for r in scan.running(part, ["k"], ["t", "i"], "CAST(t / 20 AS INT)", spec, inclusive=False, sliced=s).collect()} for s in (True, False)]
        assert both[0] and both[0] == both[1]
    assert len(scan.apart(df, ["k"], 10_000)) == 1


def test_game_log_has_more_tasks_for_more_rows(spark, monkeypatch):
    from priorline.plans.registry import QUERIES
    import __spark_entry__  # noqa: F401  registers the queries
    parts = lambda: QUERIES["po5_game_log"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    monkeypatch.setattr(J, "ROWS", 500, raising=False)
    assert f", {-(-n // 500)}), REPARTITION_BY_NUM" in parts()
    monkeypatch.setattr(J, "ROWS", 100, raising=False)
    assert f", {-(-n // 100)}), REPARTITION_BY_NUM" in parts()
