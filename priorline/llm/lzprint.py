"""Document fingerprints: Lempel-Ziv phrases, hashed, and compared by their smallest hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

KEEP = 128  # smallest hashes in a fingerprint
BLOCK_CHARS = 4_000_000  # code points of a block of consecutive documents
BLOCKS = 16_384  # most blocks; beyond 64 GB of text they grow, and are still read as sorted streams
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def parse(text: str, start: int, cut: int, known: set[str], guess: int, added: list[str] | None = None) -> tuple[list[int], int]:
    """Ends of the phrases from ``start`` on that end at ``cut`` at most, and the length of the last one.

    A phrase is the longest known one plus the next character.  Every beginning of a known phrase is known, so the longest match is
    found by stepping up or down from the length of the last phrase.  New phrases go to ``known`` and ``added``.
    A text that ends inside a known phrase has that rest as its last phrase.
    """
    ends, at, stop = [], start, len(text)
    while at < cut:
        size = min(guess, stop - at)
        if text[at:at + size] in known:
            size += 1
            while at + size <= stop and text[at:at + size] in known:
                size += 1
        else:
            while size > 1 and text[at:at + size - 1] not in known:
                size -= 1
        end = at + size
        if end > stop and cut == stop:  # all that is left is known
            ends.append(stop)
            break
        if end > cut:
            break
        phrase = text[at:end]
        known.add(phrase)
        if added is not None:
            added.append(phrase)
        ends.append(end)
        at, guess = end, size
    return ends, guess


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** 1, 2, ... and their inverses modulo 2**64, kept for texts up to a million characters."""
    if len(_POWERS[0]) < n:
        size = max(n, 4096)
        made = tuple(np.cumprod(np.full(size, b, np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64)))
        if size > 1_000_000:
            return made
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def sketch(text: str, ends: list[int], keep: int = KEEP) -> np.ndarray:
    """The ``keep`` smallest distinct 32-bit hashes of the phrases; a hash depends on a phrase's characters alone."""
    if not ends:
        return np.empty(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    power, inverse = powers(len(points))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(points + np.uint64(1)) * power[:len(points)])])
    stop = np.asarray(ends)
    start = np.concatenate([[0], stop[:-1]])
    value = (mix64((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return np.unique(value)[:keep]


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Estimated share of common phrases: of the smallest hashes of both, how many are in both; 1 for two empty texts."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:keep]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def to_text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def fingerprints(text: str, edited: str, shared: int, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two texts whose first ``shared`` characters are equal.

    Their phrases that end there are parsed once; the phrases of one end are taken back before the other is parsed.
    """
    known: set[str] = set()
    head, guess = parse(text, 0, min(shared, len(text)), known, 1)
    if text == edited:
        begin = head[-1] if head else 0
        both = sketch(text, head + parse(text, begin, len(text), known, guess)[0] if begin < len(text) else head, keep)
        return both, both
    begin, out = (head[-1] if head else 0), []
    for one in (edited, text):
        added: list[str] = []
        out.append(sketch(one, head + parse(one, begin, len(one), known, guess, added)[0], keep))
        known.difference_update(added)
    return out[1], out[0]


def fingerprint(text: str, keep: int = KEEP) -> np.ndarray:
    return sketch(text, parse(text, 0, len(text), set(), 1)[0], keep)


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, text, lent): one partition for each block of consecutive ids, in order, then a copy of the row that follows the block.

    Blocks are cut at quantiles of the ids, one for ``block_chars`` code points up to ``BLOCKS``; the driver knows the cuts and each block's first id.
    Texts are shuffled once.  Null ids come first, rows with equal ids go by a hash of their text; the row after the last is the first.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = min(BLOCKS, max(1, -(-chars // block_chars)))
    cuts = sorted(set(base.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    dealt = base.withColumn("block", F.lit(0))
    if cuts:
        bins = Bucketizer(splits=[-np.inf, *cuts, np.inf], inputCol="_id", outputCol="_bin", handleInvalid="keep")
        dealt = bins.transform(base.withColumn("_id", F.col("doc_id").cast("double"))).select(
            "doc_id", "text", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("_bin")).cast("int").alias("block"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("hash"))
    firsts = sorted((r["block"], r["first"]) for r in dealt.groupBy("block").agg(F.min(order).alias("first")).collect())  # a row for each block
    number = {block: n for n, (block, _) in enumerate(firsts)}
    lent = spark.createDataFrame([(first["doc_id"], first["hash"], block, (number[block] - 1) % len(firsts), number[block]) for block, first in firsts],
                                 "first_id long, hash long, first_block int, to int, own int")
    own = lent.select("first_block", "own")
    copies = dealt.join(F.broadcast(lent), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("hash"))).select(
        "doc_id", "text", F.col("to").alias("part"), F.lit(True).alias("lent"))  # a few numbers for each of at most BLOCKS blocks
    rows = dealt.join(F.broadcast(own), F.col("block") == F.col("first_block")).select("doc_id", "text", F.col("own").alias("part"), F.lit(False).alias("lent"))
    return rows.unionByName(copies).repartitionById(max(1, len(firsts)), F.col("part")).sortWithinPartitions("lent", F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).select("doc_id", "text", "lent")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row per row of ``docs``.

    The edited text has its last quarter replaced by the beginning of the next document.  A null text is empty; empty texts have the empty
    fingerprint, which is like itself (1) and unlike any other (0); equal texts have equal fingerprints; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # a row whose next row is not here yet
        unread = None  # a finished row but for its likeness to the next
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, lent in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if waiting is not None:
                    own_id, own = waiting
                    shared = len(own) - len(own) // 4
                    edited = own[:shared] + text[:len(own) - shared]
                    mine, other = fingerprints(own, edited, shared, keep)
                    if unread is not None:
                        out.append((*unread[0], likeness(unread[1], mine, keep)))
                    unread = (own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(mine), to_text(other), likeness(mine, other, keep)), mine
                waiting = (doc_id, text)
                if lent:
                    if unread is not None:
                        out.append((*unread[0], likeness(unread[1], fingerprint(text, keep), keep)))
                    waiting = unread = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return followed(docs, id_col, text_col, block_chars).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
