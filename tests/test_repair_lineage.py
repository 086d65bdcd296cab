"""Score repair against the fit written out row by row, and lineage against plain graph walks."""

import random

import pytest
from pyspark.sql import functions as F

from priorline.operators import components as C
from priorline.operators import repair as R

DAY = "date_add(DATE '2024-01-01', CAST(pos / {width} AS INT))"


def plain_fit(ys, final, lo=None, hi=None):
    """Least cost per level and row, the lowest level wherever several are as good."""
    levels = sorted({0, final} | {y for y in ys if 0 <= y <= final} | {v for v in (lo or []) + (hi or []) if 0 <= v <= final})
    cost = [[float("inf") if lo and not lo[r] <= v <= hi[r] else abs(min(y, final) - v) for v in levels] for r, y in enumerate(ys)]
    best, back = cost[0], []
    for row in cost[1:]:
        come = [min(range(k + 1), key=lambda j: (best[j], j)) for k in range(len(levels))]
        back.append(come)
        best = [best[come[k]] + row[k] for k in range(len(levels))]
    at = min(range(len(levels)), key=lambda k: (best[k], k))
    if best[at] == float("inf"):
        return None
    out = [levels[at]]
    for come in reversed(back):
        at = come[at]
        out.append(levels[at])
    return out[::-1]


def stream_rows(game, ys, scoring=None, quarters=None):
    return [(game, 1, i, 1 + i // 2, i, (quarters or [1] * len(ys))[i], 1, float(y) if y is not None else None, bool(scoring[i]) if scoring else False) for i, y in enumerate(ys)]


SCHEMA = "game_id BIGINT, team BIGINT, play_id BIGINT, drive_number INT, pos BIGINT, quarter INT, offense BIGINT, score DOUBLE, is_scoring BOOLEAN"


def repaired(spark, rows, finals, rule, width=4, lines=None):
    df = spark.createDataFrame(rows, SCHEMA)
    fin = spark.createDataFrame([(g, 1, float(f)) for g, f in finals.items()], "game_id BIGINT, team BIGINT, final DOUBLE")
    lin = spark.createDataFrame([(g, 1, x) for g, x in (lines or {}).items()], "game_id BIGINT, team BIGINT, line ARRAY<INT>")
    out = {}
    for r in R.rebuild(df, fin, ["pos"], DAY.format(width=width), rule, lin).orderBy("game_id", "pos").collect():
        out.setdefault(r["game_id"], []).append(r["repaired"])
    return out


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_fits(spark, width):
    rng = random.Random(width)
    games, finals, scoring = {1: [0, 7, 3, 3, 3, 10], 2: [5], 3: [9, 8, 7, 1], 4: [-2, 0, 30, 2]}, {1: 10, 2: 3, 3: 9, 4: 20}, {}
    for g in range(5, 60):
        games[g] = [max(-2, rng.randrange(0, 6) + i // 2 + rng.choice([0, 0, 0, 9, -9])) for i in range(rng.randrange(1, 25))]
        finals[g] = max(0, rng.randrange(0, 25))
    rows = []
    for g, ys in games.items():
        scoring[g] = [rng.random() < 0.4 for _ in ys]
        rows += stream_rows(g, ys, scoring[g])
    assert repaired(spark, rows, finals, "r2_isotonic", width) == {g: plain_fit(ys, finals[g]) for g, ys in games.items()}
    assert plain_fit(games[1], 10) == [0, 3, 3, 3, 3, 10]
    want = {}
    for g, ys in games.items():
        anchors = [i for i, s in enumerate(scoring[g]) if s]
        fit = dict(zip(anchors, plain_fit([ys[i] for i in anchors], finals[g]))) if anchors else {}
        last, want[g] = 0, []
        for i in range(len(ys)):
            last = fit.get(i, last)
            want[g].append(last)
    assert repaired(spark, rows, finals, "r4_scoring_rows", width) == want


def test_quarters(spark):
    rng = random.Random(7)
    games, finals, lines, quarters, want = {}, {}, {}, {}, {}
    for g in range(40):
        line = [rng.choice([0, 3, 7]) for _ in range(rng.choice([4, 4, 5, 3]))]
        n = rng.randrange(1, 20)
        quarters[g] = sorted(rng.randrange(1, len(line) + 1) for _ in range(n))
        if g % 5 == 0:
            rng.shuffle(quarters[g])  # bounds that may contradict each other
        games[g] = [max(0, sum(line[:q]) + rng.choice([0, 0, -3, 7, -7])) for q in quarters[g]]
        finals[g], lines[g] = sum(line) + (g % 9 == 4), line
        regulation = min(4, len(line))
        lo = [sum(line[:q - 1]) if q <= regulation else sum(line[:regulation]) for q in quarters[g]]
        hi = [sum(line[:q]) if q <= regulation else sum(line) for q in quarters[g]]
        fit = plain_fit(games[g], finals[g], lo, hi) if sum(line) == finals[g] else None
        want[g] = fit or [None] * n
    rows = [r for g, ys in games.items() for r in stream_rows(g, ys, None, quarters[g])]
    assert repaired(spark, rows, finals, "r3_quarter_anchored", 3, lines) == want
    assert any(w[0] is None for g, w in want.items() if g % 5 == 0) and sum(w[0] is not None for w in want.values()) > 20


def test_evaluation(spark):
    # a touchdown wiped out on ordinary rows, a clean game, one that stays short, one that a drive of 14 makes odd, a missing line score
    rows = (stream_rows(1, [0, 7, 0, 0, 0, 14], [0, 1, 0, 0, 0, 1], [1, 1, 1, 1, 2, 2]) + stream_rows(2, [7, 7, 14], [1, 0, 1], [1, 2, 3])
            + stream_rows(3, [6, 6, 12, 11], [1, 0, 1, 0], [1, 2, 3, 3]) + stream_rows(4, [0, 14], [0, 1], [1, 1]) + stream_rows(5, [3, 2, 3], [1, 0, 0], [1, 1, 2]))
    df = spark.createDataFrame(rows, SCHEMA)
    finals = spark.createDataFrame([(1, 1, 14.0), (2, 1, 14.0), (3, 1, 18.0), (4, 1, 14.0), (5, 1, 3.0)], "game_id BIGINT, team BIGINT, final DOUBLE")
    lines = spark.createDataFrame([(1, 1, [7, 7, 0, 0]), (2, 1, [7, 0, 7, 0]), (3, 1, [6, 0, 6, 6]), (4, 1, [14, 0, 0, 0])], "game_id BIGINT, team BIGINT, line ARRAY<INT>")
    got = {(r["rule"], r["game_id"]): r for r in R.evaluate_repairs(df, finals, ["pos"], DAY.format(width=2), lines).collect()}
    assert len(got) == 25
    assert got["r0_baseline", 1]["reason"] == "score_regression" and not got["r0_baseline", 1]["resolved"]
    assert got["r4_scoring_rows", 1]["resolved"] and got["r4_scoring_rows", 1]["changed"]
    assert got["r4_scoring_rows", 1]["quarter_match"] and (got["r4_scoring_rows", 1]["placed"], got["r4_scoring_rows", 1]["increments"]) == (2, 2)
    for rule in R.RULES:
        assert got[rule, 2]["resolved"] and not got[rule, 2]["changed"] and got[rule, 2]["reached"] == 14
        assert got[rule, 3]["reason"] in ("short_of_final", "score_regression", "quarter_bounds_infeasible") and not got[rule, 3]["resolved"]
    assert got["r1_envelope", 4]["reason"] == "drive_points_outside_0_8"
    assert got["r3_quarter_anchored", 5]["reason"] == "quarter_bounds_infeasible" and got["r3_quarter_anchored", 5]["quarter_match"] is None
    assert got["r2_isotonic", 5]["resolved"] and got["r2_isotonic", 5]["changed"]


def closure(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for start in {x for e in edges for x in e}:
        seen, todo = set(), list(after.get(start, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out[start] = seen
    return out


@pytest.mark.parametrize("max_pairs", [None, 30])
@pytest.mark.parametrize("seed", [1, 2])
def test_lineage(spark, seed, max_pairs):
    rng = random.Random(seed)
    n = 40
    edges = list({(rng.randrange(n), rng.randrange(n)) for _ in range(44)}) + [(100, 100), (100, 101), (101, 102), (102, 103), (103, 102)]
    reach = closure(edges)
    df = spark.createDataFrame(edges + edges[:3] + [(None, 1), (1, None)], "src BIGINT, dst BIGINT")
    got = {r["node"]: r["cycle"] for r in C.cycle_nodes(df, max_pairs).collect()}
    assert got == {v: min(w for w in reach[v] | {v} if v in reach[w]) for v in reach if v in reach[v]}
    roots = [3, 100, 999]
    down = {r["node"] for r in C.descendants(df, spark.createDataFrame([(r,) for r in roots], "node BIGINT"), max_pairs).collect()}
    assert down == set().union(*[reach.get(r, set()) for r in roots])
    own = {v: v % 2 for v in reach if v % 5} | {500: 1}
    worst = {v: max([own.get(v, 2)] + [own.get(u, 2) for u in reach if v in reach[u]]) for v in set(own) | {b for _, b in edges}}
    classes = spark.createDataFrame(list(own.items()), "node BIGINT, level BIGINT")
    assert {r["node"]: r["worst"] for r in C.worst_class(classes, df, 2, max_pairs).collect()} == worst
    with pytest.raises(ValueError):
        C.worst_class(classes.withColumn("level", F.lit(7)), df, 2)


def test_long_chain_and_empty_graph(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    tables, complete = C.hop_tables(chain)
    assert complete and len(tables) <= 18
    assert C.descendants(chain, spark.createDataFrame([(0,)], "node BIGINT")).count() == n
    assert C.cycle_nodes(chain).count() == 0
    assert C.cycle_nodes(chain.limit(0)).count() == 0 and C.descendants(chain.limit(0), spark.createDataFrame([(0,)], "node BIGINT")).count() == 0


def test_ranges_of_a_deep_graph(spark):
    """Short steps ahead over many ranges, and rings that cross the ends of ranges: the walks are long and the hop tables wide."""
    n = 9000
    edges = [(i, i + 1 + j) for i in range(n) for j in range(3)]
    df = spark.createDataFrame(edges, "src BIGINT, dst BIGINT")
    got = C.descendants(df, spark.createDataFrame([(n // 2,)], "node BIGINT"), nodes=1000)
    assert sorted(r["node"] for r in got.collect()) == list(range(n // 2 + 1, n + 3))
    rings = [(i, i + 1) for i in range(600)] + [(i, i - 5) for i in range(49, 600, 50)]
    got = {r["node"]: r["cycle"] for r in C.cycle_nodes(spark.createDataFrame(rings, "src BIGINT, dst BIGINT"), nodes=47).collect()}
    assert got == {k: i - 5 for i in range(49, 600, 50) for k in range(i - 5, i + 1)}


def test_many_slices_in_one_call():
    """Slices that share a call, a call cut into parts, and each slice alone give the same minima."""
    import pandas as pd
    rng, rows = random.Random(3), []
    for g in range(60):
        levels = sorted(rng.sample(range(0, 30), rng.randrange(1, 9)))
        for p in range(rng.randrange(1, 12)):
            rows.append((g % 20, g, 0, p, float(rng.randrange(30)), rng.random() < 0.8, float("-inf"), float(rng.choice([10, 99])), levels if p == 0 else None))
    pdf = pd.DataFrame(rows, columns=["game_id", "team", "_slice", "_pos", "_y", "_says", "_lower", "_upper", "_levels"])
    keys = ["game_id", "team"]
    tidy = lambda f: f.sort_values(["game_id", "team", "level"]).astype(float).values.tolist()
    alone = pd.concat([R._slice_minima(part, keys) for _, part in pdf.groupby(["game_id", "team"])])
    assert tidy(R._slice_minima(pdf.sample(frac=1, random_state=1), keys)) == tidy(alone) == tidy(R._slice_minima(pdf, keys, cells=25))
