"""Raw rows to contracted tables: renames, parses, identity, population and correction rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import content_id, fold_name, snake_case
from .guards import left_lookup, unique_lookup, unless

# Timestamp renderings seen in provider rows.
UTC_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy-MM-dd HH:mm:ss[.SSS]",
    "yyyy-MM-dd'T'HH:mm[XXX]", "yyyy-MM-dd HH:mm[XXX]", "yyyy/MM/dd HH:mm", "yyyy-MM-dd",
]


def coalesce_camel(df: DataFrame) -> DataFrame:
    """NRM-1: snake_case names; where both spellings exist the snake one wins if not null."""
    targets: dict[str, list[str]] = {}
    for c in df.columns:
        targets.setdefault(snake_case(c), []).append(c)
    pick = lambda name, sources: F.coalesce(*sorted(map(F.col, sources), key=lambda c: str(c) != f"Column<'{name}'>"))
    return df.select(*[pick(name, sources).alias(name) for name, sources in targets.items()])


def parse_utc(text: Column) -> Column:
    """NRM-2: any ISO or other known rendering as a UTC timestamp; text in no known form fails the job."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    parsed = F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in UTC_FORMATS])
    return unless(parsed.isNull() & text.isNotNull(), parsed, "timestamp in no known format")


def to_local(ts: Column, zone: str = "America/New_York") -> Column:
    return F.from_utc_timestamp(ts, zone)


def decode_struct(text: Column, schema: str) -> Column:
    """NRM-3: JSON, or the literal form with single quotes, True, False and None, to a struct; junk fails the job.

    The words are replaced outside of quotes only.
    """
    quoted = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^'\"]+|['\"]"
    words = {"True": "true", "False": "false", "None": "null"}
    plain = lambda t: reduce(lambda c, w: F.regexp_replace(c, rf"\b{w}\b", words[w]), words, t)
    parts = F.transform(F.regexp_extract_all(text, F.lit(quoted), F.lit(0)), lambda t: F.when(t.rlike("^['\"]"), t).otherwise(plain(t)))
    return F.from_json(F.array_join(parts, ""), schema, {"mode": "FAILFAST", "allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})


def both_in_class(home: str, away: str, label: str) -> Column:
    return (F.lower(home) == label) & (F.lower(away) == label)


def normalize_games(games: DataFrame, policy: DataFrame | None = None, label: str = "fbs") -> DataFrame:
    """NRM-4: games between two members of a class; a policy must cover and agree with each game."""
    out = games.where(both_in_class("home_class", "away_class", label)).withColumn("provider_week", F.col("week"))
    if policy is None:
        return out
    rules = policy.select("season", "game_id", F.col("provider_week").alias("_policy_week"), "canonical_week")
    joined = left_lookup(out, rules, ["season", "game_id"])
    week = unless(F.col("canonical_week").isNull(), F.col("canonical_week"), "week policy does not cover a game")
    week = unless(F.col("_policy_week") != F.col("provider_week"), week, "week policy disagrees with the provider week")
    return joined.withColumn("week", week).drop("canonical_week", "_policy_week")


def classify_population(home: Column, away: Column, label: str = "fbs", other: str = "fcs") -> Column:
    """NRM-5: which classes meet; a missing class stays unresolved."""
    h, a = F.lower(home), F.lower(away)
    return (F.when(h.isNull() | a.isNull(), "unresolved")
            .when((h == label) & (a == label), f"{label}_{label}")
            .when((h == label) & (a == other) | (h == other) & (a == label), f"{label}_{other}")
            .when((h == label) | (a == label), "unresolved").otherwise("excluded"))


def constrain_to_context(df: DataFrame, games: DataFrame, columns: tuple[str, ...] = ("season", "week")) -> DataFrame:
    """NRM-7: known games only; nulls filled from the game, disagreement fails the job."""
    known = games.select("game_id", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(unique_lookup(known, ["game_id"]), "game_id", "inner")
    fixed = {c: unless(F.col(c) != F.col(f"_{c}"), F.coalesce(c, f"_{c}"), f"{c} disagrees with the game")
             for c in columns}
    return joined.withColumns(fixed).drop(*[f"_{c}" for c in columns])


def normalize_plays(raw: DataFrame, games: DataFrame) -> DataFrame:
    """NRM-6: unwrap the record, prefer wrapper fields, take season and week from the game."""
    rec = raw.select(F.coalesce("game_id", "rec.game_id").alias("game_id"),
                     F.coalesce("play_id", "rec.play_id").alias("play_id"),
                     F.lit(None).cast("int").alias("season"), F.lit(None).cast("int").alias("week"), "rec.play_type")
    return unique_lookup(constrain_to_context(rec, games), ["game_id", "play_id"], "duplicate play")


def flatten_quotes(records: DataFrame) -> DataFrame:
    """NRM-8: one row per nested line with a stable identity; a line without any number fails the job."""
    flat = records.select("game_id", "captured_at", F.explode("lines").alias("line")).select(
        "game_id", "captured_at", "line.provider", "line.spread",
        F.coalesce("line.total", "line.over_under").alias("total"))
    ids = content_id(["game_id", "captured_at", "provider", "spread", "total"], 32)
    return flat.withColumn("quote_id", unless(F.col("spread").isNull() & F.col("total").isNull(), ids,
                                              "quote with neither spread nor total"))


def quarantine_uncaptured(lines: DataFrame, captured: str = "captured_at") -> DataFrame:
    """NRM-10: rows without an authentic capture time become inert references."""
    return lines.where(F.col(captured).isNull()).drop(captured).withColumns({
        "usable_for_selection": F.lit(False), "usable_for_grading": F.lit(False),
        "quarantine_reason": F.lit("no_authentic_capture_time")})


def week_policy(games: DataFrame, overrides: DataFrame) -> DataFrame:
    """NRM-11: one canonical week per game, the override if there is one, and what was found."""
    o = unique_lookup(overrides.select("game_id", "canonical_week"), ["game_id"]).withColumn("_o", F.lit(1))
    both = games.select("season", "game_id", F.col("week").alias("provider_week"), F.lit(1).alias("_g")).join(
        o, "game_id", "full_outer")
    return both.select(
        "season", "game_id", "provider_week", F.coalesce("canonical_week", "provider_week").alias("canonical_week"),
        F.when(F.col("_g").isNull(), "unknown_game").when(F.col("_o").isNull(), "provider")
        .when(F.col("canonical_week") == F.col("provider_week"), "override_same").otherwise("override").alias("source"))


def canonical_name(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """NRM-12: provider name to canonical name, itself if there is no alias."""
    table = unique_lookup(aliases.select(F.col("alias").alias(column), F.col("team").alias("_team")), [column])
    return df.join(table, column, "left").withColumn("canonical", F.coalesce("_team", column)).drop("_team")


def resolve_names(artifact: DataFrame, game_names: DataFrame, aliases: DataFrame) -> DataFrame:
    """NRM-14: artifact names onto game names, exact first, then alias; two names on one target fail."""
    known = game_names.select(F.col("name").alias("_exact")).distinct()
    via = unique_lookup(aliases.select(F.col("alias").alias("name"), F.col("team").alias("_alias")), ["name"])
    out = (artifact.select("name").distinct().join(known, F.col("name") == F.col("_exact"), "left")
           .join(via, "name", "left"))
    target = known.withColumnRenamed("_exact", "_aliased")
    out = out.join(target, F.col("_alias") == F.col("_aliased"), "left")
    return out.select("name", F.coalesce("_exact", "_aliased").alias("game_name"),
                      F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_aliased").isNotNull(), "alias")
                      .otherwise("unresolved").alias("how"))


def match_events(events: DataFrame, schedule: DataFrame, tolerance_minutes: int, allow_prefix: bool = True) -> DataFrame:
    """NRM-15: events to games on folded names within a time tolerance.

    The exact pass is an equi join on both names.  The prefix pass turns "schedule name starts the
    event name" into an equi join as well, on each prefix of the event's home name and a time slot,
    so no pair of rows that cannot match is formed.  More than one match for an event fails the job.
    """
    tol = tolerance_minutes * 60
    s = schedule.select("game_id", fold_name(F.col("home_name")).alias("s_home"),
                        fold_name(F.col("away_name")).alias("s_away"), F.unix_timestamp("kickoff").alias("s_at"))
    e = events.select("event_id", fold_name(F.col("home_name")).alias("e_home"),
                      fold_name(F.col("away_name")).alias("e_away"), F.unix_timestamp("kickoff").alias("e_at"))
    near = F.abs(F.col("s_at") - F.col("e_at")) <= tol
    exact = e.join(s, (F.col("e_home") == F.col("s_home")) & (F.col("e_away") == F.col("s_away")) & near)
    exact = exact.groupBy("event_id").agg(F.count("*").alias("n"), F.max("game_id").alias("game_id"))
    found = exact.where("n = 1").select("event_id", "game_id", F.lit("exact").alias("how"), "n")
    if not allow_prefix:
        found = exact.select("event_id", "game_id", F.lit("exact").alias("how"), "n")
    else:
        rest = e.join(found.select("event_id"), "event_id", "left_anti")
        width = max(tol, 1)
        slot = lambda c: F.floor(F.col(c) / width)
        rest = rest.withColumn("p_home", F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("e_home"))), lambda n: F.substring(F.col("e_home"), F.lit(1), n))))
        rest = rest.withColumn("slot", F.explode(F.array(slot("e_at") - 1, slot("e_at"), slot("e_at") + 1)))
        s2 = s.where("s_home <> '' AND s_away <> ''").withColumn("slot", slot("s_at"))
        pre = rest.join(s2, (F.col("p_home") == F.col("s_home")) & (rest.slot == s2.slot)
                        & F.col("e_away").startswith(F.col("s_away")) & near)
        pre = pre.groupBy("event_id").agg(F.count("*").alias("n"), F.max("game_id").alias("game_id"))
        found = found.unionByName(pre.select("event_id", "game_id", F.lit("prefix").alias("how"), "n"))
    return found.withColumn("game_id", unless(F.col("n") > 1, F.col("game_id"), "ambiguous event match")).drop("n")


def dedup_source_rows(df: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """NRM-17: identical repeats collapse; one id with two payloads fails the job."""
    row = F.struct(*payload)
    out = df.groupBy(key).agg(F.min(row).alias("_lo"), F.max(row).alias("_hi"), F.count("*").alias("copies"))
    out = out.withColumn("_lo", unless(~F.col("_lo").eqNullSafe(F.col("_hi")), F.col("_lo"), "divergent source versions"))
    return out.select(key, *[F.col(f"_lo.{c}").alias(c) for c in payload], "copies")


def sequence_collisions(df: DataFrame, sequence: list[str], payload: list[str], allowed: DataFrame) -> DataFrame:
    """NRM-18: sequences that hold different rows and are not listed, and listed ones not used."""
    row = F.struct(*payload)
    clash = df.groupBy(*sequence).agg(F.min(row).alias("lo"), F.max(row).alias("hi")).where(
        ~F.col("lo").eqNullSafe(F.col("hi"))).select(*sequence)
    listed = allowed.select(*sequence).distinct()
    return clash.join(listed, sequence, "left_anti").withColumn("problem", F.lit("unlisted_collision")).unionByName(
        listed.join(clash, sequence, "left_anti").withColumn("problem", F.lit("unused_exception")))


def apply_corrections(df: DataFrame, corrections: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """NRM-19: long-form (key, field, old, new) patches; the old value must be the one found."""
    wide = corrections.groupBy(*keys).pivot("changed_field", fields).agg(
        F.max(F.struct("old_value", "new_value"))).withColumnRenamed("null", "_null")
    kinds = dict(df.dtypes)
    joined = df.join(wide.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields]), keys, "left")
    out = {}
    for f in fields:
        old, new = F.col(f"_{f}.old_value"), F.col(f"_{f}.new_value")
        differs = F.col(f"_{f}").isNotNull() & ~F.col(f).cast("string").eqNullSafe(old)
        out[f] = unless(differs, F.when(F.col(f"_{f}").isNotNull(), new.cast(kinds[f])).otherwise(F.col(f)),
                        f"correction of {f} expects another value")
    return joined.withColumns(out).drop(*[f"_{f}" for f in fields])


def unmatched_corrections(df: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """NRM-19: corrections whose key hits no row or several rows."""
    hits = df.select(*keys).join(corrections.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(
        F.count("*").alias("n"))
    return corrections.select(*keys).distinct().join(hits, keys, "left").where("coalesce(n, 0) <> 1").select(
        *keys, F.coalesce("n", F.lit(0)).alias("n"))


def drive_identity(df: DataFrame) -> DataFrame:
    """NRM-20: provider drive id or one derived from the number, and whether a derived one can be trusted."""
    out = df.withColumns({
        "drive_id_source": F.when(F.col("provider_drive_id").isNull(), "derived").otherwise("provider"),
        "drive_id": F.coalesce("provider_drive_id", F.concat_ws("-", "game_id", "drive_number"))})
    sides = out.groupBy("game_id", "drive_id").agg(
        F.count_distinct("offense", "defense").alias("orientations"),
        (F.max("quarter") - F.min("quarter")).alias("span"),
        F.max("drive_id_source").alias("src"), F.count("*").alias("plays"))
    return sides.withColumn("drive_ambiguous", (F.col("src") == "derived") & (
        (F.col("orientations") > 2) | (F.col("span") > 1))).withColumnRenamed("src", "drive_id_source")


def split_conflicts(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """NRM-23: identical duplicates collapse to one kept row; conflicting keys go to quarantine."""
    row = F.struct(*payload)
    g = df.groupBy(*keys).agg(F.min(row).alias("lo"), F.max(row).alias("hi"), F.count("*").alias("copies"))
    same = F.col("lo").eqNullSafe(F.col("hi"))
    return g.select(*keys, *[F.when(same, F.col(f"lo.{c}")).alias(c) for c in payload], "copies",
                    F.when(same, "kept").otherwise("quarantined").alias("disposition"))


def merge_observations(base: DataFrame, extra: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """NRM-24: union of schedule observations; a key with two identities fails the job."""
    row = F.struct(*identity)
    g = base.unionByName(extra, allowMissingColumns=True).groupBy(*keys).agg(
        F.min(row).alias("lo"), F.max(row).alias("hi"), F.count("*").alias("observations"))
    return g.select(*keys, unless(~F.col("lo").eqNullSafe(F.col("hi")), F.col("lo"), "schedule identity conflict").alias("r"),
                    "observations").select(*keys, "r.*", "observations")


def mask_after_cutoff(games: DataFrame, cutoff: Column, hours: int = 6) -> DataFrame:
    """NRM-25: games whose evidence is not yet available count as not completed; no row is dropped."""
    late = F.col("kickoff") + F.expr(f"INTERVAL {hours} HOURS") > cutoff
    return games.withColumn("completed", F.when(late, F.lit(False)).otherwise(F.col("completed")))


def attach_venues(games: DataFrame, venues: DataFrame, supplement: DataFrame) -> DataFrame:
    """NRM-26: venue, else supplement, with a coverage label; every game stays one row."""
    main = unique_lookup(venues.select("venue_id", "city", "state"), ["venue_id"])
    more = unique_lookup(supplement.select("venue_id", F.col("city").alias("s_city"), F.col("state").alias("s_state")), ["venue_id"])
    out = games.join(main, "venue_id", "left").join(more, "venue_id", "left")
    return out.select("game_id", "venue_id", F.coalesce("city", "s_city").alias("city"),
                      F.coalesce("state", "s_state").alias("state"),
                      F.when(F.col("city").isNotNull(), "venue").when(F.col("s_city").isNotNull(), "supplement")
                      .otherwise("missing").alias("coverage"))
