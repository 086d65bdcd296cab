"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, rank_rows, text_of

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
FAN = 64


def _row_key(id_col: str, source_col: str) -> Column:
    """A hash of id and source that tells nulls apart; with the hash of the text it names a row up to repetition."""
    return F.xxhash64(*[x for c in (id_col, source_col) for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))])


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, row_key, text_hash, k): words of the whole text, a null text has size 0; ``k`` counts repeated rows from 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
                       _row_key(id_col, source_col).alias("row_key"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    same = rows.groupBy("doc_id", "source", "size", "row_key", "text_hash").agg(F.count("*").alias("_m"))
    return same.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))).drop("_m")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target): one row per source.

    Sources by code point, null last, take ``weights`` in turn and share the words of all sources; a target stops at
    ``max_copies`` times its source and what is over goes to the others by weight.  In the order of cap/weight a source
    stops exactly if its share of what the earlier stopped ones left is at least its cap, so one running sum over the
    sources (one row each) settles all rounds of resharing at once.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_w", weight)
    per = per.withColumn("_cap", (F.col("source_size") * max_copies).cast("double"))
    ordered = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before, whole = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    per = per.withColumn("_stops", F.col("_cap") * open_weight <= left * F.col("_w"))
    kept = F.sum("source_size").over(whole) - F.sum(F.when(F.col("_stops"), F.col("_cap")).otherwise(0.0)).over(whole)
    rest = F.sum(F.when(F.col("_stops"), 0.0).otherwise(F.col("_w"))).over(whole)
    return per.withColumn("target", F.when(F.col("_stops"), F.col("_cap")).otherwise(kept * F.col("_w") / rest)).select(
        "source", "source_size", "target")


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) from a hash, the same in every run."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _fold(items: Column, level: int, seed: int) -> Column:
    """One pass of the pivotal method over a sorted group: a struct of the settled rows and the one still fractional.

    A pair hands words from one to the other until a probability is 0 or 1: b gives to a what a lacks or b has, or a gives
    to b likewise, each with the odds that keep both expected values.  Words are handed over, not documents, so
    the expected words of the group stay what they are at every step.
    """
    settled = lambda row, take: F.array(F.struct(row["row"].alias("row"), F.lit(take).alias("take")))

    def step(acc: Column, b: Column) -> Column:
        a = acc["rest"]
        size_a, size_b = a["row"]["size"].cast("double"), b["row"]["size"].cast("double")
        lacks_a, has_a = size_a * (1 - a["p"]), size_a * a["p"]
        lacks_b, has_b = size_b * (1 - b["p"]), size_b * b["p"]
        to_a, to_b = F.least(lacks_a, has_b), F.least(has_a, lacks_b)
        draw = _uniform(*[x["row"][c] for x in (a, b) for c in ("row_key", "text_hash", "k")], F.lit(level), F.lit(seed))
        gives_a = draw * (to_a + to_b) < to_b
        with_p = lambda row, p: F.struct(row["row"].alias("row"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))
        pack = lambda done, rest: F.struct(F.concat(acc["done"], done).alias("done"), rest.alias("rest"))
        return F.when(gives_a & (lacks_a <= has_b), pack(settled(a, 1), with_p(b, b["p"] - to_a / size_b))) \
            .when(gives_a, pack(settled(b, 0), with_p(a, a["p"] + to_a / size_a))) \
            .when(has_a <= lacks_b, pack(settled(a, 0), with_p(b, b["p"] + to_b / size_b))) \
            .otherwise(pack(settled(b, 1), with_p(a, a["p"] - to_b / size_a)))

    first = F.element_at(items, 1)
    start = F.struct(F.filter(settled(first, 0), lambda _: F.lit(False)).alias("done"), F.struct(first["row"].alias("row"), first["p"].alias("p")).alias("rest"))
    return F.aggregate(F.slice(items, 2, F.size(items)), start, step)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, fan: int = FAN, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, row_key, text_hash, k): one row per row of ``docs``.

    A document of a source with target / size = 1.4 has one whole copy and a fractional one of 0.4.  The fractional
    copies of a source are rounded in a reduction tree: groups of about ``fan`` rows, dealt by a hash, are settled
    but for one row each, and those rows form the groups of the next level, until one row of a source is left and goes to the
    nearer side.  So a source's words differ from its target by at most half of one document, a hot source is spread
    over many groups, and a group is bounded.  Rows without words and null texts have size 0 and take 0 words; a null source is a source;
    rows with the same id, and repeated rows, are dealt and rounded apart from each other; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.stage(document_sizes(docs, id_col, text_col, source_col))
    targets = source_targets(sizes, weights, max_copies)
    rate = F.col("target") / F.col("source_size")
    rows = sizes.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left") \
        .select("s.*", "t.source_size", "t.target")
    rows = rows.withColumn("base", F.when(F.col("source_size") > 0, F.floor(rate + 1e-12)).otherwise(0).cast("int"))
    rows = rows.withColumn("p", F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.greatest(rate - F.col("base"), F.lit(0.0))).otherwise(0.0))
    rows = scratch.stage(rows)
    scratch.release(sizes)
    split = (F.col("p") > 1e-12) & (F.col("p") < 1 - 1e-12)
    plain = rows.where(~split).withColumn("take", F.when(F.col("p") > 0.5, 1).otherwise(0))
    columns = ["doc_id", "source", "size", "source_size", "target", "base", "row_key", "text_hash", "k"]
    out = [plain.select(*columns, "take")]
    left = rows.where(split).select("source", "p", F.struct(*columns).alias("row"))
    counts = left.groupBy("source").agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n")).first()[0] or 0
    left = left.alias("l").join(counts.alias("c"), F.col("l.source").eqNullSafe(F.col("c.source"))).select("l.*", "c._n")
    level, some = 0, most > 0
    while most > 1:
        groups = F.ceil(F.col("_n") / F.lit(float(fan))).cast("long")
        bucket = F.pmod(F.xxhash64("row.row_key", "row.text_hash", "row.k", F.lit(level), F.lit(seed)), groups)
        item = F.struct((-F.col("row.size")).alias("order"), F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("text"), F.col("row.k").alias("k"), F.col("row").alias("row"), F.col("p").alias("p"))
        folded = left.withColumn("_g", groups).withColumn("_b", bucket).groupBy("source", "_g", "_b").agg(
            F.sort_array(F.collect_list(item)).alias("items")).select("source", F.col("_g").alias("_n"), _fold(F.col("items"), level, seed).alias("f"))
        folded = scratch.stage(folded)
        out.append(folded.select(F.explode("f.done").alias("d")).select("d.row.*", F.col("d.take").cast("int").alias("take")))
        left = folded.select("source", "_n", F.col("f.rest.p").alias("p"), F.col("f.rest.row").alias("row"))
        most = -(-most // fan)
        level += 1
    if some:  # one row of each source, also where no source had two
        out.append(left.select("row.*", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("take")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    copies = F.least(F.col("base") + F.col("take"), F.lit(max_copies)).cast("int")
    return whole.select("doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
                        F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "row_key", "text_hash", "k")


def take_copies(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as mixed: each row as often as the mix has copies of it. All columns kept.

    Rows are found by id, source and text, so rows with one id, or with none, have their own copies; repeated rows are numbered
    as the mix numbers them.  A row that the mix does not know is left out; an empty table gives no rows.
    """
    keyed = docs.withColumns({"_row_key": _row_key(id_col, source_col), "_text_hash": F.xxhash64(F.col(text_col).cast("string"))})
    names = ["_row_key", "_text_hash", "_k"]
    copies = mix.where("copies > 0").select(F.col("row_key").alias("_row_key"), F.col("text_hash").alias("_text_hash"), F.col("k").alias("_k"), F.col("copies").alias("_copies"))
    repeated = mix.where("k > 0").select(F.col("row_key").alias("_row_key"), F.col("text_hash").alias("_text_hash")).distinct()
    if repeated.limit(1).count():
        again = keyed.join(repeated, names[:2], "left_semi").withColumn("_all", F.xxhash64(*docs.columns))
        again = rank_rows(again, names[:2], ["_all"]).withColumn("_k", F.col("_rank").cast("long")).drop("_rank", "_all")
        keyed = keyed.join(repeated, names[:2], "left_anti").withColumn("_k", F.lit(0).cast("long")).unionByName(again)
    else:
        keyed = keyed.withColumn("_k", F.lit(0).cast("long"))
    rows = keyed.join(copies, names)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
