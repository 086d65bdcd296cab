"""Packing by cutting stock: column generation over the histogram of piece lengths."""

from __future__ import annotations

import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_texts, map_batches, rank_rows, type_of

CAPACITY = 2048
GRAIN = 32
END_ID = 1
_ENCODERS: dict[str, tiktoken.Encoding] = {}
# fixed value: the pre-tokenisation pattern of the byte-level vocabulary file
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte: itself if visible, else the next one from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary of a tokenizer file; it gives the same ids as the tokenizers library, three times as fast.

    ``path`` names a tokenizer file that every executor has, such as an installed package's.
    """
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, special = byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _ENCODERS[path] = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def cut(n: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then the largest multiple of ``grain``, then the tail."""
    whole, rest = divmod(n, capacity)
    body = rest - rest % grain
    return [capacity] * whole + [x for x in (body, rest - body) if x]


def pieces_of(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
              grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece; a null text has only the end id."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path)
        rows, starts, lengths, sums, totals = [], [], [], [], []
        for row, text in enumerate(arrow_texts(batch.column(1))):
            ids = np.append(encode.encode_to_numpy(text, allowed_special="all"), np.uint32(end_id)).astype("<u4")
            at = 0
            for size in cut(len(ids), capacity, grain):
                rows.append(row)
                starts.append(at)
                lengths.append(size)
                sums.append(zlib.crc32(ids[at:at + size].tobytes()))
                totals.append(len(ids))
                at += size
        longs = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *longs],
                                          ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), run,
                       f"doc_id {type_of(docs, id_col)}, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack of the pricing step: how often to take each length so that the prices add up to most."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        fits = np.flatnonzero(lengths <= room)
        if len(fits):
            gain = value[room - lengths[fits]] + prices[fits]
            top = int(np.argmax(gain))
            if gain[top] > value[room] + 1e-12:
                value[room], choice[room] = gain[top], fits[top]
    pattern, room = np.zeros(len(lengths), int), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= lengths[choice[room]]
    return value[capacity], pattern


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Linear program: fewest sequences that cut exactly ``demand`` pieces; patterns as columns, and how often each is used.

    Simplex on the pattern columns.  Each round prices the lengths by the basis and asks the knapsack for a pattern worth more
    than one sequence; without one the basis is optimal.
    """
    basis = np.diag((capacity // lengths).astype(float))
    use = demand / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(lengths)))
        worth, pattern = best_pattern(prices, lengths, capacity)
        if worth <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = pattern
        use = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
    return np.rint(basis).astype(int), use


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) so that every piece of the histogram is cut exactly once.

    The linear program's uses are rounded down; the pieces left over (fewer than patterns times pieces of a pattern)
    go largest first into the fullest sequence that still has room.
    """
    lengths = np.array(sorted((x for x in histogram if x < capacity), reverse=True), int)
    plan = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    if not len(lengths):
        return plan
    demand = np.array([histogram[x] for x in lengths], int)
    patterns, use = solve_patterns(lengths, demand, capacity)
    left = demand.copy()
    for j in np.argsort(-use, kind="stable"):
        column = patterns[:, j]
        times = min(int(use[j] + 1e-9), *(int(left[i] // column[i]) for i in np.flatnonzero(column)))
        if times > 0:
            plan.append(({int(x): int(k) for x, k in zip(lengths, column) if k}, times))
            left -= times * column
    bins: list[tuple[int, Counter]] = []
    for x, n in zip(lengths, left):
        for _ in range(n):
            fit = min((b for b in range(len(bins)) if bins[b][0] >= x), key=lambda b: bins[b][0], default=None)
            if fit is None:
                bins.append((capacity, Counter()))
                fit = len(bins) - 1
            bins[fit][1][int(x)] += 1
            bins[fit] = (bins[fit][0] - x, bins[fit][1])
    return plan + [(dict(count), 1) for _, count in bins]


def layout(plan: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Per length: (first rank, rank after the last, pieces in a sequence, first sequence, offset) of each pattern."""
    places: dict[int, list] = {}
    given: Counter = Counter()
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for size, k in sorted(pattern.items(), reverse=True):
            places.setdefault(size, []).append((given[size], given[size] + times * k, k, sequence, offset))
            given[size] += times * k
            offset += size * k
        sequence += times
    return places


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, grain: int = GRAIN,
         end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece of a document.

    Every text is tokenised whole, once; pieces are a few numbers each.  Their histogram has at most ``capacity / grain + grain``
    lengths, so the linear program on the driver has a fixed size whatever the input.  Pieces of a length are ranked
    and a rank tells its pattern, its sequence and its offset by arithmetic.  Empty and null texts have one piece, the end id;
    repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = Scratch(spark).stage(pieces_of(docs, path, id_col, text_col, capacity, grain, end_id))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity / grain + grain rows at most
    places = [(size, [list(p) for p in rows]) for size, rows in layout(plan_sequences(histogram, capacity)).items()]
    table = spark.createDataFrame(places, "length long, places array<array<long>>")  # fixed size, see above
    ranked = rank_rows(pieces, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"]).join(F.broadcast(table), "length")
    place = F.filter("places", lambda p: (p[0] <= F.col("_rank")) & (F.col("_rank") < p[1]))[0]
    ranked = ranked.withColumn("_p", place).withColumn("_k", F.col("_rank") - F.col("_p")[0])
    turn = F.floor(F.col("_k") / F.col("_p")[2])
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_p")[3] + turn).cast("long").alias("sequence_id"),
                         (F.col("_p")[4] + F.pmod("_k", F.col("_p")[2]) * F.col("length")).cast("long").alias("offset"))
