"""op2 against a plain version: phrases by their definition, sets of hashes, and texts edited one by one."""

import hashlib
import random

from priorline.llm import lzprint


def plain_print(text):
    known, phrases, at = set(), set(), 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at:end] in known:
            end += 1
        known.add(text[at:end])
        phrases.add(text[at:end])
        at = end
    return sorted({int(lzprint.sketch(p, [len(p)])[0]) for p in phrases})[:lzprint.KEEP]


def plain_likeness(a, b):
    union = sorted(set(a) | set(b))[:lzprint.KEEP]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def test_compare_edits_against_plain(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab é\U0001f600") for _ in range(rng.choice([0, 1, 3, 4, 5, 30, 400, 3000]))) for _ in range(60)] + [None, "", "aaaaaaaaaaaa" * 40]
    ids = rng.sample(range(1000), len(texts))
    want, order = {}, sorted(range(len(ids)), key=ids.__getitem__)
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        a, b, c = plain_print(text), plain_print(edited), plain_print(after)
        want[ids[i]] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:08x}" for x in a), "".join(f"{x:08x}" for x in b), plain_likeness(a, b), plain_likeness(a, c))
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, part string").repartition(5)
    for chars in (lzprint.BLOCK_CHARS, 500):
        got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in lzprint.compare_edits(df, block_chars=chars).collect()}
        assert got == want


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lzprint, "BLOCKS", 3)
    df = spark.createDataFrame([(k, "some words " * (k % 7)) for k in range(200)], "doc_id long, text string")
    assert lzprint.followed(df, block_chars=1).rdd.getNumPartitions() <= 3
    assert sorted(map(tuple, lzprint.compare_edits(df, block_chars=1).collect())) == sorted(map(tuple, lzprint.compare_edits(df).collect()))
