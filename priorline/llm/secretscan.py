"""Secret scan: candidates by pattern, false positives removed by a random forest; DataFrame functions and MLlib only."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

# a run of key characters that holds a digit; a run is never cut, so long keys and PEM lines stay whole
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
# a value that is assigned to a name that says secret, of any make; the name may go on (SECRET_KEY_BASE, token2)
ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api_?key|access_?key|private_?key|credentials?|auth)(?:[_.\-][\w.\-]{0,40}|\d{1,4})?[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>|,;]{8,})"
SECRET_WORD = r"(?i)(token|secret|passw|pwd|api_?key|access_?key|private_?key|credential|auth|bearer)"
HARMLESS_WORD = r"(?i)(sha-?1|sha-?256|md5|checksum|digest|commit|revision|uuid|guid|etag|integrity|hash|build|order|invoice|isbn|phone|tel|version|image|href|http|www)"
PLACEHOLDER = r"(?i)(example|sample|placeholder|changeme|your[_-]|dummy|test|redacted|xxxx|0123456789|1234567|abcdef|(.)\2{5})"
TEST_PATH = r"(?i)(test|example|sample|fixture|mock|spec|docs?/)"
# fixed values: English and programming words that make up identifiers
DICTIONARY = ["about", "access", "account", "address", "after", "application", "array", "before", "between", "build", "button", "cache", "class", "client",
              "code", "column", "commit", "component", "config", "content", "count", "create", "data", "database", "default", "delete", "document", "element",
              "error", "event", "example", "false", "field", "file", "filter", "first", "function", "group", "handler", "header", "height", "image", "index",
              "input", "instance", "integer", "internal", "item", "label", "last", "length", "list", "local", "main", "manager", "message", "method", "model",
              "module", "name", "node", "number", "object", "option", "order", "output", "package", "page", "parameter", "parent", "path", "process", "property",
              "public", "query", "record", "release", "request", "resource", "response", "result", "return", "sample", "schema", "server", "service", "session",
              "source", "state", "status", "string", "style", "system", "table", "target", "template", "test", "text", "time", "title", "true", "type", "update",
              "user", "value", "version", "view", "width", "world", "your"]
FEATURES = ["length", "transitions", "upper", "digits", "marks", "hexadecimal", "distinct", "dictionary", "secret_word", "harmless_word", "placeholder", "test_path"]
BEFORE, AFTER = 40, 20
MASK = "<SECRET>"
FINDINGS = 4800  # rows of the default labelled findings
SEED = 11


def with_features(found: DataFrame) -> DataFrame:
    """Adds the features to (candidate, before, after, path): length, character transitions, dictionary coverage, path and neighbouring words."""
    word, size = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1)).cast("double")
    upper, lower, digit = (r"[A-Z]", r"[a-z]", r"[0-9]")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(word, r"[^A-Za-z0-9]", "-"), upper, "A"), lower, "a"), digit, "9")
    share = lambda pattern: F.length(F.regexp_replace(word, f"[^{pattern}]", "")) / size
    covered = F.length(F.regexp_replace(F.lower(word), "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")", ""))
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    return found.withColumns({
        "length": F.least(size, F.lit(200.0)),
        "transitions": (F.length(F.regexp_replace(shape, r"(.)\1*", "x")) - 1) / size,
        "upper": share("A-Z"), "digits": share("0-9"), "marks": 1 - share("A-Za-z0-9"),
        "hexadecimal": flag(word.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "distinct": F.size(F.array_distinct(F.split(word, ""))) / F.least(size, F.lit(40.0)),
        "dictionary": 1 - covered / size,
        "secret_word": flag(F.col("before").rlike(SECRET_WORD)), "harmless_word": flag(F.concat_ws(" ", "before", "after").rlike(HARMLESS_WORD)),
        "placeholder": flag(word.rlike(PLACEHOLDER)), "test_path": flag(F.col("path").rlike(TEST_PATH)),
    })


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """(candidate, before, after, path, label): the default findings to learn from, written by rule from hashes.

    True findings are keys of common makes beside a word that says secret; false ones are checksums, identifiers, placeholders, numbers,
    addresses and file names in their usual surroundings, some of them beside such a word too.
    """
    i = F.col("id")
    key = lambda salt: F.sha1(F.concat_ws("-", F.lit(salt), i).cast("binary"))
    mixed = lambda salt: F.translate(F.base64(F.unhex(F.sha2(F.concat_ws("-", F.lit(salt), i).cast("binary"), 256))), "+/=", "AbC")
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id"), F.lit(len(words))) + 1).cast("int"))
    name = pick("token", "secret", "api_key", "password", "access_key", "auth", "TOKEN", "API_KEY", "Secret")
    lead = F.concat(pick("the word and ", "let me see ", "| ", "de la ", "x\n", "und der "), name, pick(" = \"", "=", ": ", " = '", ": \""))
    none = F.concat(pick("see the ", "from that ", "und die ", "que de ", "*** ", "| ", ""), pick("", "there ", "of ", "line "))
    harmless = pick("sha256:", "commit ", "checksum ", "md5 ", "revision ", "etag: ", "uuid ", "build ")
    words = F.concat(F.concat_ws("_", pick("request", "response", "template", "document"), pick("handler", "manager", "version", "session"),
                                    pick("index", "value", "table"), F.pmod(i, F.lit(1000))), pick("", "_", "/"))
    kinds = [  # (candidate, before, label)
        (key("a"), lead, 1), (F.upper(key("b")), lead, 1), (F.sha2(key("c"), 256), lead, 1), (F.concat(F.lit("AKIA"), F.upper(F.substring(mixed("d"), 1, 16))), lead, 1),
        (F.concat(F.lit("ghp_"), F.substring(mixed("e"), 1, 36)), none, 1), (F.concat(F.lit("sk-"), F.substring(mixed("f"), 1, 40)), lead, 1),
        (mixed("g"), lead, 1), (F.substring(mixed("h"), 1, 20), lead, 1), (F.concat(F.lit("eyJhbGciOi"), mixed("k"), mixed("l")), none, 1), (F.substring(key("m"), 1, 32), lead, 1),
        (key("n"), harmless, 0), (F.sha2(key("o"), 256), harmless, 0), (F.substring(key("p"), 1, 32), harmless, 0), (words, none, 0), (words, lead, 0),
        (F.concat(pick("your_", "example_", "sample-", "dummy-"), words), lead, 0), (F.concat(F.lit("xxxxxxxxxxxxxxxx"), F.pmod(i, F.lit(100))), lead, 0),
        (F.lpad(F.abs(F.xxhash64("id")).cast("string"), 16, "4"), none, 0), (F.substring(F.lpad(F.abs(F.xxhash64("id")).cast("string"), 16, "4"), 1, 16), none, 0),
        (F.concat(pick("thereandback", "withoutregard", "erheandnation"), F.pmod(i, F.lit(100)), pick("overthenation", "ungenheit")), none, 0),
        (F.concat_ws("-", F.substring(key("q"), 1, 8), F.substring(key("q"), 9, 4), F.substring(key("q"), 13, 4), F.substring(key("q"), 17, 12)), none, 0),
        (F.concat_ws("-", F.lit("2024-01-17-report"), pick("final", "draft"), F.pmod(i, F.lit(100))), none, 0), (key("r"), none, 0), (mixed("s"), F.lit("image base64 href "), 0),
    ]
    which = F.pmod(i, F.lit(len(kinds)))
    chosen = lambda k: F.coalesce(*[F.when(which == n, kind[k] if isinstance(kind[k], Column) else F.lit(kind[k])) for n, kind in enumerate(kinds)])
    return spark.range(0, rows, 1, 1).select(chosen(0).alias("candidate"), chosen(1).alias("before"), F.lit("\" and").alias("after"),
                                             pick("web", "src/main", "src7", "books").alias("path"), chosen(2).cast("double").alias("label"))


def fit_forest(findings: DataFrame, trees: int = 30, depth: int = 7, seed: int = SEED) -> PipelineModel:
    """A random forest on the features of labelled findings."""
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(with_features(findings))


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """(_row, doc_id, candidate, start, occurrences, before, after, path): one row per occurrence of each distinct candidate of a text, with what
    surrounds it; ``start`` is the first one's and ``_row`` tells rows of ``docs`` apart."""
    text = text_of(text_col)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), path.alias("path")).where(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(ASSIGNED))
    words = F.array_union(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), F.regexp_extract_all("text", F.lit(ASSIGNED), F.lit(1)))
    out = base.withColumn("_row", F.monotonically_increasing_id()).withColumn("candidate", F.explode(F.array_distinct(words)))
    quoted = F.concat(F.lit(r"\Q"), F.replace("candidate", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    out = out.withColumn("_pieces", F.split("text", quoted))
    out = out.select("_row", "doc_id", "path", "candidate", F.length(F.element_at("_pieces", 1)).cast("long").alias("start"),
                     (F.size("_pieces") - 1).cast("long").alias("occurrences"),
                     F.transform("_pieces", lambda p: F.substring(p, 1, AFTER)).alias("_heads"), F.transform("_pieces", lambda p: F.right(p, F.lit(BEFORE))).alias("_tails"))
    # a candidate has 8 characters or more, so BEFORE and AFTER reach over BEFORE / 8 and AFTER / 8 other occurrences at most
    joined = lambda pieces, first, last: F.call_function("array_join", F.slice(pieces, first, last - first + 1), F.col("candidate"))
    place = lambda i: F.struct(
        F.right(joined(F.col("_tails"), F.greatest(F.lit(1), i - BEFORE // 8), i), F.lit(BEFORE)).alias("before"),
        F.left(joined(F.col("_heads"), i + 1, i + 1 + AFTER // 8), F.lit(AFTER)).alias("after"))
    out = out.withColumn("_place", F.explode(F.transform(F.sequence(F.lit(1), F.size("_tails") - 1), place)))
    return out.select("_row", "doc_id", "candidate", "start", "occurrences", "_place.before", "_place.after", "path")


def scan_secrets(docs: DataFrame, model: PipelineModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
                 threshold: float = 0.5) -> DataFrame:
    """(doc_id, candidate, start, length, occurrences, score): one row per distinct secret of a document.

    Every occurrence is judged by its own surroundings, and the best ``score`` of them decides.  ``start`` counts code points before
    the first occurrence.  Null, empty and clean texts give no rows, an empty table none either; repeated rows give repeated findings; a null path is an empty one.
    """
    scored = model.transform(with_features(candidates(docs, id_col, text_col, path_col)))
    best = scored.withColumn("score", vector_to_array("probability")[1]).where(F.col("score") >= threshold).groupBy(
        "_row", "doc_id", "candidate", "start", "occurrences").agg(F.max("score").alias("score"))
    return best.select(
        "doc_id", "candidate", "start", F.length("candidate").cast("long").alias("length"), "occurrences", F.round("score", 6).alias("score"))


def mask_secrets(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every occurrence of a found secret replaced; longer secrets first, all columns kept."""
    per = findings.groupBy(F.col("doc_id").alias("_secret_doc")).agg(F.sort_array(F.collect_set(F.struct((-F.length("candidate")).alias("n"), F.col("candidate").alias("c")))).alias("_secrets"))
    joined = docs.join(per, F.col(id_col).eqNullSafe(F.col("_secret_doc")), "left")
    masked = F.aggregate("_secrets", F.col(text_col), lambda text, s: F.replace(text, s["c"], F.lit(mask)))
    return joined.withColumn(text_col, F.when(F.col("_secrets").isNull(), F.col(text_col)).otherwise(masked)).drop("_secret_doc", "_secrets")
