"""The queries of this folder, each over its whole table, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables
from . import flatgraph, htmltext, licenses, linecrf, lzprint, merkle, mixing, packing, secretscan, shinglejoin, triecount, urlfilter, variants
from .common import pin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin(spark)
            return fn(spark, Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


COMPONENTS = """
, reach(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a)
, least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
"""


@query("op1_flat_graph_neardup", """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS size FROM embeddings),
linked(a, b) AS (
  SELECT a.vec_id, b.vec_id FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.size > 0 AND b.size > 0 AND isfinite(a.size) AND isfinite(b.size) AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9)""" + COMPONENTS + """,
n AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(l.b, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(l.b, v.vec_id)) AS kept
FROM v LEFT JOIN least l ON l.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
""")
def _neardup(spark: SparkSession, t: Tables) -> DataFrame:
    return flatgraph.near_vectors(t.embeddings)


@query("op2_lempel_ziv_fingerprint")
def _fingerprint(spark: SparkSession, t: Tables) -> DataFrame:
    return lzprint.compare_edits(t.documents)


@query("op3_cutting_stock_packing")
def _packing(spark: SparkSession, t: Tables) -> DataFrame:
    return packing.pack(t.documents, public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_ngram_jaccard_join", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
linked(a, b) AS (SELECT a, b FROM pairs)""" + COMPONENTS + """
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id
FROM sets s LEFT JOIN least l ON l.a = s.doc_id
""")
def _join(spark: SparkSession, t: Tables) -> DataFrame:
    return shinglejoin.near_groups(t.documents, n=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query("op5_text_to_tag_extraction")
def _extraction(spark: SparkSession, t: Tables) -> DataFrame:
    return htmltext.extract_pages(t.pages)


@query("op6_line_crf_quality")
def _quality(spark: SparkSession, t: Tables) -> DataFrame:
    return linecrf.score_quality(t.documents, linecrf.fit_quality(t.documents, t.labels))


def _license_sql() -> str:
    rows = [(name, key, len(grams), int(1.5 * len(grams) + 1e-9) + len(licenses.normal_words(licenses.TEMPLATES[name][int(key.split("#")[1])])) - 1 - len(grams), grams)
            for name, key, grams in licenses.template_rows(licenses.TEMPLATES)]
    values = ", ".join(f"('{name}', '{key}', {m}, {reach}, '{gram}')" for name, key, m, reach, grams in rows for gram in grams)
    return rf"""
WITH RECURSIVE templates(license, template, m, reach, gram) AS (VALUES {values}),
texts AS (SELECT doc_id, text, row_number() OVER () AS r FROM (SELECT DISTINCT doc_id, text FROM documents)),
words AS (SELECT doc_id, r, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM texts),
places AS (SELECT doc_id, r, w, unnest(range(1, len(w))) AS pos FROM words),
hits AS (SELECT doc_id, r, license, template, m, reach, pos, gram FROM (SELECT doc_id, r, pos, w[pos] || ' ' || w[pos + 1] AS gram FROM places) JOIN templates USING (gram)),
windows AS (
  SELECT a.doc_id, a.r, a.license, a.template, a.pos AS first, b.pos AS last,
    2.0 * count(DISTINCT c.gram) / (b.pos - a.pos + 1 - (count(*) - count(DISTINCT c.gram)) + a.m) AS dice
  FROM hits a JOIN hits b ON b.r = a.r AND b.template = a.template AND b.pos >= a.pos AND b.pos < a.pos + a.reach
  JOIN hits c ON c.r = a.r AND c.template = a.template AND c.pos >= a.pos AND c.pos <= b.pos
  GROUP BY a.doc_id, a.r, a.license, a.template, a.m, a.pos, b.pos),
best AS (SELECT *, row_number() OVER (PARTITION BY r, template, first ORDER BY dice DESC, last DESC) AS k FROM windows),
spans AS (
  SELECT doc_id, r, list({{'dice': dice, 'first': first, 'last': last, 'license': license}} ORDER BY dice DESC, first - last, first, last, license, template) AS s
  FROM best WHERE k = 1 AND dice >= 0.8 - 1e-9 GROUP BY doc_id, r),
picks AS (
  SELECT doc_id, r, s[1] AS one, list_filter(s, lambda x: x.first > s[1].last OR x.last < s[1].first) AS rest FROM spans
  UNION ALL
  SELECT doc_id, r, rest[1], list_filter(rest, lambda x: x.first > rest[1].last OR x.last < rest[1].first) FROM picks WHERE len(rest) > 0)
SELECT doc_id, one.license AS license, round(max(one.dice), 6) AS dice, count(*) AS n_matches FROM picks GROUP BY doc_id, one.license
"""


@query("op7_license_dice_scan", _license_sql())
def _licenses(spark: SparkSession, t: Tables) -> DataFrame:
    return licenses.scan_licenses(t.documents)


@query("op8_trie_token_counts")
def _tokens(spark: SparkSession, t: Tables) -> DataFrame:
    return triecount.count_tokens(t.documents, public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_secret_forest_scan")
def _secrets(spark: SparkSession, t: Tables) -> DataFrame:
    return secretscan.scan_secrets(t.documents, secretscan.fit_forest(secretscan.labelled_findings(spark)))


@query("op10_pivotal_mixing")
def _mixing(spark: SparkSession, t: Tables) -> DataFrame:
    return mixing.mix_sources(t.documents).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _url_sql() -> str:
    rules = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in urlfilter.RULES)
    listed = ", ".join(f"('{host}')" for host in urlfilter.LISTED)
    return rf"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}), listed(listed_host) AS (VALUES {listed}),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT DISTINCT host, path FROM parts),
fits AS (
  SELECT host, path, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC) AS k
  FROM hosts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
flagged AS (SELECT DISTINCT host FROM hosts JOIN listed ON host = listed_host OR ends_with(host, '.' || listed_host))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rule_verdict, CASE WHEN g.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path AND f.k = 1 LEFT JOIN flagged g ON g.host = p.host
"""


@query("op11_bloom_cascade_urls", _url_sql())
def _urls(spark: SparkSession, t: Tables) -> DataFrame:
    return urlfilter.judge_urls(t.pages).select("page_id", "host", "path", "rule", "verdict")


CRC_TABLE = """crc(tab) AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)))"""


def _crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, where ``tab`` is the table above."""
    octets = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: CAST('0x' || substring(hex(encode({text})), i, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295)"


@query("op12_asymmetric_chunk_variants", rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{variants.RUN}')), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc_sql("doc_id || ':' || run")} AS h FROM each, crc WHERE length(run) >= 7),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM words a JOIN cuts b ON a.word = b.cut),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM near),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.k = 1),
chain(word, root, hop) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT c.word, f.form, c.hop + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
tops AS (SELECT word, max_by(root, hop) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, t.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN tops t ON t.word = f.word
""")
def _variants(spark: SparkSession, t: Tables) -> DataFrame:
    return variants.group_variants(variants.count_words(variants.slipped_words(t.documents)))


def _tampered(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string")) % 5 == 0


def _merkle_sql(depth: int = 5) -> str:
    """Trees of up to 16 ** depth nodes, one common table a level; a finished tree passes its node on."""

    def enc(c: str) -> str:
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"

    lowered = f"translate(text, '{urlfilter.UPPER}', '{urlfilter.LOWER}')"
    head = " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars"))
    out = [f"""WITH {CRC_TABLE},
leaves AS (SELECT doc_id, source, sha256({head} || {enc('text')}) AS leaf, CASE WHEN {_crc_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN sha256({head} || {enc(lowered)}) END AS other FROM documents, crc),
s0 AS (SELECT *, source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS size, leaf AS h FROM leaves)"""]
    for name in ("s", "t"):
        if name == "t":
            out.append(f"""t0 AS (SELECT tree AS source, h AS subroot, 0 AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS idx, count(*) OVER () AS size, h FROM s{depth})""")
        for k in range(depth):
            out.append(f"""{name}r{k} AS (SELECT tree, idx // 16 AS run, string_agg(h, '' ORDER BY idx) AS txt, max(size) AS size FROM {name}{k} GROUP BY tree, idx // 16)""")
            out.append(f"""{name}{k + 1} AS (SELECT tree, run AS idx, (size + 15) // 16 AS size, CASE WHEN size = 1 THEN txt ELSE sha256(txt) END AS h FROM {name}r{k})""")
        left, right = "substring(r.txt, 1, 64 * CAST(f.idx % 16 AS INT))", "substring(r.txt, 64 * CAST(f.idx % 16 AS INT) + 65)"
        start = ("SELECT doc_id, source, leaf, idx, tree, coalesce(other, leaf) AS fold, '' AS proof FROM s0" if name == "s" else
                 f"SELECT f.doc_id, f.source, f.leaf, t.idx, t.tree, f.fold, f.proof, t.subroot FROM sf{depth} f JOIN t0 t ON t.source IS NOT DISTINCT FROM f.source")
        out.append(f"{name}f0 AS ({start})")
        keep = "f.doc_id, f.source, f.leaf" + (", f.subroot" if name == "t" else "")
        for k in range(depth):
            out.append(f"""{name}f{k + 1} AS (SELECT {keep}, f.idx // 16 AS idx, f.tree, CASE WHEN r.size = 1 THEN f.fold ELSE sha256({left} || f.fold || {right}) END AS fold, f.proof || {left} || {right} AS proof
  FROM {name}f{k} f JOIN {name}r{k} r ON r.tree IS NOT DISTINCT FROM f.tree AND r.run = f.idx // 16)""")
    return ",\n".join(out) + f"""
SELECT f.doc_id, f.leaf, f.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.fold AS folded_root, f.fold = r.h AS verified FROM tf{depth} f, t{depth} r
"""


@query("op13_sibling_shift_merkle", _merkle_sql())
def _merkle(spark: SparkSession, t: Tables) -> DataFrame:
    return merkle.manifest(t.documents, _tampered())
