"""URL cascades, spelling variants and Merkle manifests against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from priorline.llm import common, merkle, urlfilter, variants
from priorline.llm.common import Scratch


@pytest.fixture(scope="module", autouse=True)
def pinned(spark):
    common.pin(spark)


def rows(df):
    return [r.asDict() for r in df.collect()]


def plain_verdict(url, rules, listed):
    url = url or ""
    host, path = "", ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER)), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, _, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in listed) else "allow"


ODD_URLS = [None, "", "no scheme/here", "http://", "HTTP://EXAMPLE.ORG/ES/x", "http://example.org/es/x?y=://z", "ftp://user@a.example.org:8/en/12#q", "http://example.org?x", "https://org/", "https://xorg/",
            "a://b://c.com/fr/", "http://é.COM/de/ö", "http://cheap-pills.example.com", "http://www.spam-farm.example.net/a", "x\n://a.org/b\nc", "http://" + "a." * 5000 + "com/fr/" + "x" * 5000]


@pytest.mark.parametrize("max_bits", [urlfilter.MAX_BITS, 0])
def test_odd_urls(spark, max_bits):
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(ODD_URLS + ODD_URLS)], "page_id long, url string, host string, key int")
    got = {r["page_id"]: r for r in rows(urlfilter.judge_urls(df, max_bits=max_bits))}
    assert len(got) == 2 * len(ODD_URLS)
    for i, url in enumerate(ODD_URLS + ODD_URLS):
        want = plain_verdict(url, urlfilter.RULES, urlfilter.LISTED)
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == want, url
    assert rows(urlfilter.judge_urls(df.limit(0), max_bits=max_bits)) == []


@pytest.mark.parametrize("max_bits", [urlfilter.MAX_BITS, 0])
def test_long_lists(spark, max_bits):
    rng = random.Random(4)
    label = lambda: rng.choice("abcdefgh") + str(rng.randrange(12))
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    rules = {(host(), rng.choice(["", "/", "/a", "/a/", "/b/c"])): rng.choice(["allow", "block"]) for _ in range(700)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    listed = {host() for _ in range(300)}
    urls = [f"http://{host()}{rng.choice(['', '/', '/a', '/a/x', '/b/c/d', '/q'])}" for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(urlfilter.judge_urls(df, rules, listed, max_bits=max_bits))}
    assert got == {i: plain_verdict(u, rules, listed) for i, u in enumerate(urls)}


def test_cascade_is_exact_and_small(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where(F.crc32("key") % 10 == 0)
    cascade = urlfilter.Cascade(listed, keys, 20_000, Scratch(spark))
    wrong = keys.where(cascade.holds(F.col("key")) != (F.crc32("key") % 10 == 0))
    assert len(cascade.levels) >= 3 and wrong.count() == 0
    assert sum(level.bits for level in cascade.levels) <= urlfilter.bits_needed(listed.count(), 20_000)


def test_rules_with_two_verdicts_and_empty_lists(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    with pytest.raises(ValueError):
        urlfilter.judge_urls(df, [("org", "/", "allow"), ("org", "/", "block")])
    assert rows(urlfilter.judge_urls(df, [], []))[0]["verdict"] == "allow"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, ratio=10):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("max_pairs", [0, 3, 128])
def test_variants(spark, max_pairs):
    rng = random.Random(9)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 10))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "ab" * 40]
    words = set(stems)
    for w in stems:
        for _ in range(6):
            i = rng.randrange(len(w) + 1)
            words |= {w[:i] + rng.choice("abéz") + w[i:], w[:i] + rng.choice("abz") + w[i + 1:], w[:i] + w[i + 1:]}
    counts = {w: int(10 ** rng.uniform(0.3, 6)) for w in words if len(w) >= 7}
    df = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows(variants.group_variants(df, max_pairs=max_pairs))}
    assert got == plain_variants(counts)


def plain_runs(text):
    return [run.translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER)) for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text)]


def test_slipped_words(spark):
    texts = [(1, "Straße ÉCOLE Ünit-abcdefgh ABCDEFGH×y", 0), (None, "abcdefgh abcdefgh", 0), (2, None, 1), (3, "", 1), (3, "x" * 100_000, 2), (3, "x" * 100_000, 2)]
    texts += [(i, f"abcdefgh{chr(97 + i % 26)} longerword", 3) for i in range(200)]
    want = Counter()
    for doc, text, _ in texts:
        for run in plain_runs(text or ""):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    df = spark.createDataFrame(texts, "doc_id long, text string, n int")
    got = {r["word"]: r["count"] for r in rows(variants.slipped_words(df).groupBy("word").count())}
    assert got == dict(want)
    counted = {r["word"]: r["n"] for r in rows(variants.count_words(variants.slipped_words(df)))}
    assert counted == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert rows(variants.group_variants(variants.count_words(variants.slipped_words(df.limit(0))))) == []
    with pytest.raises(ValueError):
        variants.group_variants(variants.count_words(variants.slipped_words(df)), ratio=1)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes, arity):
    """Root, and per leaf the list of (left, right) siblings."""
    at, sides = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // arity * arity:i // arity * arity + arity]
            sides[k].append(("".join(run[:i % arity]), "".join(run[i % arity + 1:])))
        nodes = [h(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
        at = [i // arity for i in at]
    return nodes[0], sides


def plain_manifest(docs, arity):
    def leaf(row):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    by_source = {}
    for row in docs:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source, members in by_source.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = plain_tree([leaf(r) for r in members], arity)
    root, tops = plain_tree([trees[s][0] for s in order], arity)
    out = []
    for source, members in by_source.items():
        subroot, sides = trees[source]
        for row, own in zip(members, sides):
            way = own + tops[order.index(source)]
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                changed = (*row[:4], row[4].translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER)))
            folded = leaf(changed)
            for left, right in way:
                folded = h(left, folded, right)
            out.append((row[0], leaf(row), subroot, root, h(*[left + right for left, right in way]), folded, folded == root))
    return out


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest(spark, arity, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_PER_PART", 50)
    rng = random.Random(2)
    docs = [(i, rng.choice(["hot", "hot", "a", "é", "", None]), None if i % 7 == 0 else "en", i % 5 or None, rng.choice([None, "", "Ab C", "é", "lower", "X" * 20_000 if i < 3 else "T"])) for i in range(300)]
    docs += [(5, "hot", "en", 1, "same"), (5, "hot", "en", 1, "same"), (5, "hot", "en", 1, "Other"), (None, "hot", "en", 1, "No id"), (None, None, None, None, None), (None, None, None, None, None), (1, "alone", "en", 1, "A")]
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int")
    got = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, arity=arity)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted([tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=key) == sorted(plain_manifest(docs, arity), key=key)
    assert rows(merkle.manifest(df.limit(0), arity=arity)) == []
    assert all(r["verified"] for r in rows(merkle.manifest(df, arity=arity)))
    one = rows(merkle.manifest(df.where("source = 'alone'"), arity=arity))[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == h("")
