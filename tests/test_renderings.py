"""Timestamps and literals in every rendering, means across long gaps, ranks of null values."""

import pytest
from pyspark.sql import functions as F

from priorline.operators import normalize as N
from priorline.operators import windows as W


def test_iso_renderings(spark):
    texts = ["2024-09-01 12:00:00+00:00", "2024-09-01T12:00:00.000000Z", "2024-09-01T12:00Z", "2024-09-01 12:00", "2024/09/01 12:00"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(N.parse_utc(F.col("t")).alias("t")).distinct().collect()
    assert [str(r["t"]) for r in got] == ["2024-09-01 12:00:00"]


def test_literals_keep_their_quoted_words(spark):
    rows = ["{'a': False, 'b': \"O'Brien\", 'c': None}", "{'a': True, 'b': 'Nonesuch is: True, None', 'c': 1}", '{"a": false, "b": "x", "c": 3}', None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = [r["s"] for r in df.select("k", N.decode_struct(F.col("t"), "a boolean, b string, c int").alias("s")).orderBy("k").collect()]
    assert [tuple(s) if s else s for s in got] == [(False, "O'Brien", None), (True, "Nonesuch is: True, None", 1), (False, "x", 3), None]
    with pytest.raises(Exception, match="MALFORMED|junk"):
        spark.createDataFrame([("junk",)], "t string").select(N.decode_struct(F.col("t"), "a boolean")).collect()


def test_mean_survives_a_long_gap(spark):
    values = [float(k) if k < 5 else None for k in range(2000)]
    df = spark.createDataFrame([("k", k, v) for k, v in enumerate(values)], "key string, t int, v double")
    got = {r["t"]: r["e"] for r in W.ewma_prior(df, ["key"], ["t"], "floor(t / 100)", "v", 0.3, "e").collect()}
    weights = [0.7 ** (4 - k) for k in range(5)]
    want = sum(w * k for k, w in enumerate(weights)) / sum(weights)
    assert got[0] is None and all(abs(got[k] - want) < 1e-9 for k in range(5, 2000))


def test_null_values_get_no_rank(spark):
    df = spark.createDataFrame([("k", n, v) for n, v in (("a", 2.0), ("b", None), ("c", 2.0), ("d", 5.0))], "key string, name string, v double")
    got = {r["name"]: r["rank"] for r in W.ordinal_rank(df, ["key"], F.col("v"), "name").collect()}
    assert got == {"d": 1, "a": 2, "c": 3, "b": None}
