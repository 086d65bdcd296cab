"""The analytical core against plain-Python twins on small fixtures."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorline.operators import joins, population
from priorline.operators.guards import ContractError
from priorline.operators import adjust as A, components as C, forecast as M, guards, ledger as L, normalize as N, ratings as R, resume as S, windows as W


def league(seed=3, teams=8, games=60):
    rng = random.Random(seed)
    out = []
    for _ in range(games):
        a, b = rng.sample(range(teams), 2)
        out.append((2024, a, b, rng.uniform(5, 40), rng.choice([0.0, 10.0, 25.0])))
    return out


def four_pass(rows):
    """Reference loop over (team, opponent, role, num, den)."""
    edges = [(a, b, "offense", n, d) for _, a, b, n, d in rows] + [(b, a, "defense", n, d) for _, a, b, n, d in rows]
    flip = {"offense": "defense", "defense": "offense"}
    tot = {}
    for t, _, r, n, d in edges:
        x = tot.setdefault((t, r), [0.0, 0.0])
        if d > 0:
            x[0] += n
            x[1] += d
    raw = {k: n / d for k, (n, d) in tot.items() if d > 0}
    cur = dict(raw)
    for _ in range(4):
        center = {}
        for r in flip:
            w = [(cur[k], tot[k][1]) for k in cur if k[1] == r]
            center[r] = sum(v * x for v, x in w) / sum(x for _, x in w)
        nxt = {}
        for (t, r), base in raw.items():
            met = [(cur[(o, flip[r])] - center[flip[r]], d) for a, o, q, _, d in edges if a == t and q == r and d > 0 and (o, flip[r]) in cur]
            nxt[(t, r)] = base - (sum(v * d for v, d in met) / sum(d for _, d in met) if met else 0.0)
        cur = nxt
    return cur


def test_four_pass_equals_loop(spark):
    rows = [(s, a, b, n if d > 0 else 0.0, d) for s, a, b, n, d in league()]
    df = spark.createDataFrame(rows, "season INT, offense INT, defense INT, num DOUBLE, den DOUBLE")
    got = {(r["team"], r["role"]): r["value"] for r in A.adjust(A.pair_edges(df, ["season"]), ["season"]).collect()}
    want = four_pass(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_venue_coefficient_equals_least_squares(spark):
    rng = random.Random(5)
    rows, n = [], 7
    for _ in range(120):
        a, b = rng.sample(range(n), 2)
        s = rng.choice([-1, 0, 1])
        rows.append((2024, a, b, s, 0.3 * a - 0.2 * b + 1.7 * s + rng.gauss(0, 1), float(rng.randint(1, 5))))
    df = spark.createDataFrame(rows, "season INT, offense INT, defense INT, sign INT, y DOUBLE, w DOUBLE")
    got = A.venue_coefficient(df, ["season"]).first()
    x = np.zeros((len(rows), 2 * n + 2))
    for i, (_, a, b, s, _, _) in enumerate(rows):
        x[i, [0, 1 + a, 1 + n + b, -1]] = [1, 1, 1, s]
    w = np.sqrt([r[5] for r in rows])
    want = np.linalg.lstsq(x * w[:, None], np.array([r[4] for r in rows]) * w, rcond=None)[0][-1]
    assert got["identified"] and got["venue"] == pytest.approx(want, abs=1e-6)


def test_venue_not_identified(spark):
    rows = [(2024, a, b, 1, 1.0 * a, 1.0) for a in range(4) for b in range(4) if a != b]
    df = spark.createDataFrame(rows, "season INT, offense INT, defense INT, sign INT, y DOUBLE, w DOUBLE")
    got = A.venue_coefficient(df, ["season"]).first()
    assert (got["identified"], got["venue"]) == (False, 0.0)


def test_venue_that_has_not_settled_fails(spark):
    rows = [(2024, a, b, (a + 2 * b) % 3 - 1, 1.0 * a + (a * b) % 5, 1.0) for a in range(12) for b in (a, a + 1)]
    df = spark.createDataFrame(rows, "season INT, offense INT, defense INT, sign INT, y DOUBLE, w DOUBLE")
    with pytest.raises(ContractError):
        A.venue_coefficient(df, ["season"], rounds=2)


def kalman(series, q, r):
    m, v, last, out = 0.0, 1.0, None, []
    for at, z, n in series:
        v += q * ((at - last) if last is not None else 0.0) / 86400 / 7
        last = at
        if z is not None and n > 0:
            k = v / (v + r / n)
            m, v = m + k * (z - m), (1 - k) * v
        out.append((m, v))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_kalman_chunks_do_not_matter(spark, chunk):
    rng = random.Random(11)
    rows, want = [], {}
    for key in (1, 2, 3):
        series = sorted(((rng.randint(0, 40) * 86400.0, None if rng.random() < 0.2 else rng.gauss(0, 1), rng.choice([0.0, 1.0, 3.0])) for _ in range(40)), key=lambda x: x[0])
        for i, ((at, z, n), mv) in enumerate(zip(series, kalman(series, 0.1, 0.7))):
            rows.append((key, i, at, z, n))
            want[(key, i)] = mv
    df = spark.createDataFrame(rows, "k INT, i INT, at DOUBLE, z DOUBLE, n DOUBLE")
    out = R.kalman_filter(df, ["k"], ["at", "i"], F.floor(F.col("at") / 864000), F.col("z"), F.col("n"), F.col("at"), F.lit(0.1), F.lit(0.7), F.lit(0.0), F.lit(1.0), chunk=chunk)
    got = {(r["k"], r["i"]): (r["mean"], r["variance"]) for r in out.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def attribute(scores, final):
    """Reference walk of one team's score stream: surviving points per row, and whether it stopped."""
    events, prev = [], 0
    for i, s in enumerate(scores):
        if s < prev:
            excess = prev - s
            for e in reversed(events):
                take = min(e[1], excess)
                e[1] -= take
                excess -= take
            prev = s
            continue
        if s - prev > 8:
            return events, i
        if s > prev:
            got = min(s, final) - prev
            events.append([i, got])
            prev += got
    return events, None


@pytest.mark.parametrize("seed", range(4))
def test_scoring_events_equal_walk(spark, seed):
    rng = random.Random(seed)
    plays, finals, want = [], [], {}
    for game in range(12):
        s, stream = 0, []
        for _ in range(40):
            s = max(0, s + rng.choice([0, 0, 0, 3, 6, 7, -2, -7, 1] + ([14] if rng.random() < 0.1 else [])))
            stream.append(s)
        final = max(stream) - rng.choice([0, 0, 4])
        finals += [(game, 1, float(final)), (game, 2, 0.0)]
        want[game] = attribute(stream, final)
        for i, score in enumerate(stream):
            plays.append((game, game * 100 + i, i, f"2024-01-{1 + i // 5:02d}", 1 + i // 20, 1, 2, "Rush", score, 0))
    df = spark.createDataFrame(plays, "game_id BIGINT, play_id BIGINT, pos INT, day STRING, quarter INT, offense BIGINT, defense BIGINT, play_type STRING, offense_score INT, defense_score INT")
    df = df.withColumn("drive_number", F.col("pos") % 4)
    poss = L.possession_ledger(df.withColumn("play_number", F.col("pos")), F.lit(True))
    ev = L.scoring_events(df, poss, spark.createDataFrame(finals, "game_id BIGINT, team BIGINT, final DOUBLE"), ["pos"], "to_date(day)").where("team = 1").collect()
    for game, (events, stop) in want.items():
        got = {r["play_id"] - game * 100: r for r in ev if r["game_id"] == game}
        assert {i: r["score_increment"] for i, r in got.items() if r["score_increment"] > 0} == {i: p for i, p in events if p > 0}
        stopped = [i for i, r in got.items() if r["quality_reason"] == "impossible_score_increment"]
        assert stopped == ([] if stop is None else [stop])


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_quantiles(spark, n):
    from priorline.operators.scan import exact_quantiles
    rng = random.Random(n)
    xs = [rng.choice([rng.gauss(0, 1), 0.5, -1.0]) for _ in range(n)]
    df = spark.createDataFrame([(1, x) for x in xs] + [(1, None)], "k INT, x DOUBLE")
    ps = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["k"], "x", ps, slices=8).first()["edges"]
    assert got == pytest.approx(np.quantile(xs, ps).tolist())


def test_at_least_wins(spark):
    ps = [0.2, 0.5, 0.9, 0.35]
    mass = [1.0]
    for p in ps:
        mass = [a * (1 - p) + b * p for a, b in zip(mass + [0.0], [0.0] + mass)]
    df = spark.createDataFrame([(ps, w) for w in range(6)], "ps ARRAY<DOUBLE>, w INT")
    got = [r[0] for r in df.select(S.at_least_wins(F.col("ps"), F.col("w"))).collect()]
    assert got == pytest.approx([sum(mass[w:]) for w in range(6)])


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(50, 3, (300, 4))
    x[:, 3] = 7.0  # a constant column gets no weight
    season = np.repeat([2019, 2020, 2021], 100)
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(0, 1, 300)
    names = [f"x{i}" for i in range(4)]
    df = spark.createDataFrame([("m", int(s), *map(float, r), float(v)) for s, r, v in zip(season, x, y)], f"target STRING, season INT, {', '.join(n + ' DOUBLE' for n in names)}, y DOUBLE")
    got = M.solve(M.earlier_moments(M.season_moments(df, names)), names, [10.0]).where("season = 2021").first()
    t = season < 2021
    mean, sd = x[t, :3].mean(0), x[t, :3].std(0)
    z = (x[t, :3] - mean) / sd
    beta = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y[t] - y[t].mean())) / sd
    assert got["beta"] == pytest.approx([*beta, 0.0], abs=1e-7)
    assert got["intercept"] == pytest.approx(y[t].mean() - beta @ mean, abs=1e-5)


def test_components(spark):
    nodes = spark.createDataFrame([(str(i),) for i in range(9)], "node STRING")
    edges = spark.createDataFrame([("0", "1"), ("2", "1"), ("2", "3"), ("5", "6"), ("7", "6")], "src STRING, dst STRING")
    got = {r["node"]: r["component"] for r in C.connected_components(nodes, edges).collect()}
    assert got == {"0": "0", "1": "0", "2": "0", "3": "0", "4": "4", "5": "5", "6": "5", "7": "5", "8": "8"}


def test_fail_closed(spark):
    dup = spark.createDataFrame([(1, "a"), (1, "b")], "k INT, v STRING")
    with pytest.raises(Exception, match="duplicate lookup key"):
        guards.left_lookup(dup.select("k"), dup, ["k"]).collect()
    with pytest.raises(guards.ContractError):
        guards.require_empty(dup, "rows left")


def test_event_match_ambiguity_fails(spark):
    sch = spark.createDataFrame([(1, "Tech", "State", "2024-01-01 12:00:00"), (2, "Tech", "State", "2024-01-01 12:02:00")], "game_id INT, home_name STRING, away_name STRING, k STRING").withColumn("kickoff", F.to_timestamp("k"))
    ev = spark.createDataFrame([(9, "Tech", "State", "2024-01-01 12:01:00")], "event_id INT, home_name STRING, away_name STRING, k STRING").withColumn("kickoff", F.to_timestamp("k"))
    with pytest.raises(Exception, match="ambiguous"):
        N.match_events(ev, sch, 5).collect()
    assert N.match_events(ev, sch.where("game_id = 1"), 5).collect()[0]["how"] == "exact"


def test_bootstrap_centres_on_the_mean(spark):
    rng = random.Random(1)
    rows = [(s, w, rng.gauss(1, 2)) for s in (1, 2, 3) for w in range(20) for _ in range(10)]
    df = spark.createDataFrame(rows, "season INT, week INT, x DOUBLE")
    out = M.interval_of(M.cluster_bootstrap(df, ["season", "week"], "x", 200)).first()
    mean = sum(r[2] for r in rows) / len(rows)
    assert out["lower"] < mean < out["upper"] and out["mean"] == pytest.approx(mean, abs=0.1)


def test_bootstrap_draws_rows_inside_drawn_clusters(spark):
    rng = random.Random(2)
    rows = [(s, w, round(rng.gauss(1, 2), 3)) for s in (1, 2) for w in range(4) for _ in range(1 + w)] + [(2, 9, None)]
    pick = lambda text, size: int(hashlib.sha256(text.encode()).hexdigest()[:15], 16) % size
    clusters = {}
    for s, w, x in rows:
        if x is not None:
            clusters.setdefault((s, w), []).append(x)
    ordered = [sorted(clusters[k]) for k in sorted(clusters)]
    want = {}
    for r in range(10):
        drawn = [(slot, ordered[pick(f"s:{r}:{slot}", len(ordered))]) for slot in range(len(ordered))]
        xs = [c[pick(f"s:{r}:{slot}:{j}", len(c))] for slot, c in drawn for j in range(len(c))]
        want[r] = sum(xs) / len(xs)
    df = spark.createDataFrame(rows, "season INT, week INT, x DOUBLE")
    got = {r["replicate"]: r["mean"] for r in M.cluster_bootstrap(df, ["season", "week"], "x", 10).collect()}
    assert got == pytest.approx(want)


def test_half_life_skips_unusable_rows(spark):
    rows = [("a", 1, 4.0, 2.0), ("a", 2, None, 9.0), ("a", 3, 5.0, 0.0), ("a", 4, 6.0, 1.0), ("a", 5, 7.0, None), ("b", 1, None, 1.0), (None, 1, 3.0, 2.0)]
    df = spark.createDataFrame(rows, "team STRING, t INT, num DOUBLE, den DOUBLE")
    got = {r["team"]: (r["value"], r["exposure"], r["games"]) for r in W.half_life_mean(df, ["team"], ["t"], "floor(t / 2)", "num", "den", 1.0).collect()}
    assert got["a"] == pytest.approx(((4 * 0.5 + 6) / (2 * 0.5 + 1), 2.0, 2))
    assert got["b"] == (None, 0.0, 0) and got[None] == pytest.approx((1.5, 2.0, 1))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    names = rng.sample(range(1000), 60)
    edges = [(names[i], names[i + 1]) for i in range(0, 39)] + [(names[40], names[k]) for k in range(41, 55)] + [(names[55], names[55])]
    nodes = spark.createDataFrame([(n,) for n in names], "node LONG")
    got = {r["node"]: r["component"] for r in C.connected_components(nodes, spark.createDataFrame(edges, "src LONG, dst LONG")).collect()}
    want = {n: min(names[:40]) for n in names[:40]} | {n: min(names[40:55]) for n in names[40:55]} | {n: n for n in names[55:]}
    assert got == want


def test_cutoffs_must_rise_with_the_week(spark):
    evidence = spark.createDataFrame([(1, 1, 5, 2.0)], "season int, week int, available int, x double")
    rising = spark.createDataFrame([(1, 2, 6), (1, 3, 9)], "season int, as_of_week int, cutoff int")
    got = joins.cutoff_totals(evidence, rising, [], {"x": F.col("x")}).collect()
    assert sorted((r["as_of_week"], r["x"]) for r in got) == [(2, 2.0), (3, 2.0)]
    falling = spark.createDataFrame([(1, 2, 6), (1, 3, 4)], "season int, as_of_week int, cutoff int")
    with pytest.raises(Exception, match="do not rise"):
        joins.cutoff_totals(evidence, falling, [], {"x": F.col("x")}).collect()


def test_availability_per_season_counts_all_targets(spark):
    targets = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "season int, game_id int")
    have = spark.createDataFrame([(10,), (10,), (12,)], "game_id int")
    got = {(r["season"], r["source"]): (r["found"], r["targets"], r["ready"], r["all_ready"])
           for r in population.availability_matrix(targets, {"a": have, "b": targets}, 1.0, ["season"]).collect()}
    assert got == {(1, "a"): (1, 2, False, False), (1, "b"): (2, 2, True, False), (2, "a"): (1, 1, True, True), (2, "b"): (1, 1, True, True)}
    empty = population.availability_matrix(targets.limit(0), {"a": have}).collect()
    assert [(r["source"], r["found"], r["targets"]) for r in empty] == [("a", 0, 0)]


def test_scoring_events_of_short_streams_are_not_sliced(spark, monkeypatch):
    """Streams set apart as long give the events they give as short ones, and a short one is shuffled by its key alone."""
    plays = [(g, i, 1, 1, 10, 20, "Rush", (i * (g + 2)) % 9, (i * 5) % 4, i, f"2024-01-{1 + i // 4:02d}") for g in range(4) for i in range(12 + 12 * (g == 2))]
    df = spark.createDataFrame(plays, "game_id BIGINT, play_id BIGINT, drive_number INT, quarter INT, offense BIGINT, defense BIGINT, play_type STRING, offense_score INT, defense_score INT, pos INT, day STRING")
    poss = spark.createDataFrame([(g, 1, 10, True, None) for g in range(4)], "game_id BIGINT, drive_number INT, offense BIGINT, possession_eligible BOOLEAN, quality_reason STRING")
    finals = spark.createDataFrame([(g, t, 8.0) for g in range(4) for t in (10, 20)], "game_id BIGINT, team BIGINT, final DOUBLE")
    got, sliced = [], []
    real = L.running
    monkeypatch.setattr(L, "running", lambda *a, **k: sliced.append(k["sliced"]) or real(*a, **k))
    for limit in (1 << 18, 20, 1):
        monkeypatch.setattr("priorline.operators.scan.LONG", limit)
        got.append(sorted(map(str, L.scoring_events(df, poss, finals, ["pos"], "to_date(day)").collect())))
    assert got[0] and got[0] == got[1] == got[2]
    assert sliced[:3] == [False] * 3 and True in sliced
    opened = {tuple(r) for r in L.opened_streams(L.score_stream(df), ["pos"]).collect()}
    rows = L.accepted_stream(L.score_stream(df), finals, ["pos"], "to_date(day)").where("malformed IS NULL").select("game_id", "team").distinct().collect()
    assert opened == {tuple(r) for r in rows}
