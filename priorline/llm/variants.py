"""Spelling variants: words one edit apart, found by asymmetric chunks.

A word contributes two disjoint chunks, its halves; words of the same length and one longer contribute the grams that can
equal them.  One edit leaves one of the halves whole, at its place or shifted by one, so every near pair meets in a join
on a chunk.  A chunk that too many words share is joined on together with a chunk of the half that holds the edit, and so
on: the open part of the word is halved until it is one code point, where a bucket holds no more words than the alphabet
allows.  Every met pair is verified, and counted in the one bucket whose open part holds its first difference.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of
from .urlfilter import LOWER, UPPER

RUN = "[A-Za-zÀ-ÿ]+"
MAX_PAIRS = 128  # pairs of a bucket that are met without another chunk
BUCKET = ["len", "lo", "hi", "rest"]


def slipped_words(docs: DataFrame, text: str = "text", id_column: str = "doc_id", every: int = 31) -> DataFrame:
    """One row per run of letters, lower-cased (A-Z); a run whose hash with the id ``every`` divides lacks one code point.

    A null text has no runs; a null id counts as empty in the hash.
    """
    run = F.translate(F.col("run"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(text), F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.where(F.length("run") > 0).select(run.alias("run"), F.crc32(F.concat("id", F.lit(":"), run)).alias("h"))
    place = F.pmod(F.col("h"), F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, slipped).otherwise(F.col("run")).alias("word"))


def count_words(words: DataFrame, least_chars: int = 7, least_count: int = 2) -> DataFrame:
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _bucket(lo: Column, hi: Column) -> Column:
    """What stays equal outside the open part of a word ``len + d`` long, whose bounds count in the shorter word."""
    return F.concat(F.substring("word", F.lit(1), lo), F.substring("word", hi + F.col("d") + 1, F.length("word")))


def _halves(df: DataFrame) -> DataFrame:
    """Every row twice: the left half of its open part closed, the right half closed."""
    mid = F.expr("(lo + hi) div 2").cast("int")
    parts = df.select("word", "n", "len", "d", F.inline(F.array(F.struct(mid.alias("lo"), F.col("hi")), F.struct(F.col("lo"), mid.alias("hi")))))
    return parts.withColumn("rest", _bucket(F.col("lo"), F.col("hi")))


def near_pairs(words: DataFrame, scratch: Scratch, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of distinct words exactly one inserted, deleted or replaced code point apart, each once.

    ``words`` are distinct (word, n) of at least two code points.
    """
    own = words.select("word", "n", F.length("word").alias("len"), F.lit(0).alias("d"))
    longer = words.select("word", "n", (F.length("word") - 1).alias("len"), F.lit(1).alias("d"))
    open_rows = _halves(own.unionByName(longer).withColumns({"lo": F.lit(0), "hi": F.col("len")}))
    found = None
    while True:
        dealt = scratch.stage(open_rows)
        sizes = dealt.groupBy(*BUCKET).agg(F.count_if(F.col("d") == 0).alias("_own"), F.count_if(F.col("d") == 1).alias("_long"))
        pairs = F.expr("_own * (_own - 1) div 2 + _own * _long")
        sizes = sizes.withColumn("_pairs", pairs).where("_pairs > 0").select(*BUCKET, ((F.col("_pairs") > max_pairs) & (F.col("hi") - F.col("lo") > 1)).alias("_hot"))
        rows = scratch.stage(dealt.join(sizes, BUCKET))
        scratch.release(dealt)
        cold = rows.where("NOT _hot")
        a = cold.where("d = 0").select(*BUCKET, F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = cold.select(*BUCKET, "d", F.col("word").alias("b"), F.col("n").alias("n_b"))
        first_here = (F.col("hi") == F.col("len")) | (F.substring("a", F.lit(1), F.col("hi")) != F.substring("b", F.lit(1), F.col("hi")))
        # outside the open part the two are equal, so only the open parts are compared
        a_open, b_open = F.substring("a", F.col("lo") + 1, F.col("hi") - F.col("lo")), F.substring("b", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("d"))
        met = a.join(b, BUCKET).where(((F.col("d") == 1) | (F.col("a") < F.col("b"))) & first_here & (F.levenshtein(a_open, b_open, 1) == 1))
        part = scratch.stage(met.select("a", "n_a", "b", "n_b"))
        found = part if found is None else found.unionByName(part)
        hot = rows.where("_hot")
        if not hot.limit(1).count():
            return found
        open_rows = _halves(hot)


def group_variants(words: DataFrame, ratio: int = 10, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Of distinct (word, n): ``form``, ``root``, ``n``, ``n_near``, ``form_n``, one row per word.

    A word's form is its near word of the largest n (ties: the smallest in code-point order) if that is at least
    ``ratio`` times its own n.  Following forms, n grows by the ratio each time, so a chain is short and has no cycle.
    An empty table gives no rows; a null word is left out.
    """
    if ratio < 2:
        raise ValueError("a ratio of at least 2 keeps forms free of cycles")
    scratch = Scratch(words.sparkSession)
    words = scratch.stage(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    pairs = near_pairs(words, scratch, max_pairs)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    formed = -F.col("best.m") >= ratio * F.col("n")
    out = scratch.stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")))
    roots = scratch.stage(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    top = out.agg(F.max("n")).first()[0] or 1
    for _ in range(ceil(log2(log2(max(2, top)) / log2(ratio) + 1))):  # a chain has at most log_ratio(top) links, and a round doubles what is followed
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        after = scratch.stage(roots.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root")))
        scratch.release(roots)
        roots = after
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
