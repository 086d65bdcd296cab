"""N-gram Jaccard join by prefix filters under several global token orders at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Scratch, arrow_texts, map_batches, mix64, type_of

SKETCH_BITS = 20, 27  # least and most slots of the document-frequency sketch, 2 bits each: 32 MB at most
LIVE_BITS = 27  # bits of the filter of rows whose sets are compared: 16 MB whatever the input
SLICES = 64
FLUSH = 4_000_000  # tokens that a counting task holds before it sends them
GROUP = 2_000_000  # tokens of a group of documents, and of a slice of the tokens, about
GROUPS, SLICE_BITS = 32, (6, 14)  # least groups; least and most slices of the tokens, as powers of two
COUNTED, MET = 3, 5  # bytes of a token that are sent besides its slice: to count its documents, and to meet other classes
ORDERS = 3
BLOCK = 512  # documents on one side of a verification task


class WordIds(dict):
    """64-bit ids of words; emptied when it holds a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordIds()


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit ids of the ``n``-word shingles; with fewer words the whole sequence is one; empty without words.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at 0x20 and 0x09-0x0D only.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(n, len(ids))
    value = np.full(len(ids) - size + 1, size, np.uint64)
    for j in range(size):
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + ids[j:len(ids) - size + 1 + j])
    return np.unique(value)


def class_of(tokens: np.ndarray) -> int:
    """The name of a set of shingles: equal sets have equal names."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def needed(size: int, percent: int) -> int:
    """Shingles that a partner must share at least: the smallest whole number of at least percent of ``size``."""
    return -(-percent * size // 100)


def classes_of(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The classes of the tokens' slots in the sketch."""
    slot = slots_of(tokens, (len(sketch) * 4).bit_length() - 1)
    return (sketch[slot >> 2] >> ((slot & 3) * 2).astype(np.uint8)) & np.uint8(3)


def prefix(tokens: np.ndarray, common: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens of a set under one global order; two sets that are alike enough share one of them under any order.

    Orders 0 and 1 put tokens of few documents first (by their classes ``common``) and differ in the hash that breaks ties;
    order 2 goes by a hash alone.  Class 0 is one document, so its token is shared with none and is left out.
    Otherwise the classes set how many candidates there are, never which links are found.
    """
    keep = len(tokens) - needed(len(tokens), percent) + 1
    tie = mix64(tokens + np.uint64((order + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
    if order < 2:
        tie = (common.astype(np.uint64) << np.uint64(62)) | (tie >> np.uint64(2))
    if keep < len(tokens):
        first = np.argpartition(tie, keep - 1)[:keep]
        tokens, common = tokens[first], common[first]
    return np.sort(tokens[common > 0])


def slots_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def pack_slots(slots: np.ndarray) -> bytes:
    """Sorted slot numbers as steps of one byte each; 255 is a step that names no slot."""
    step = np.diff(slots, prepend=0)
    far = step // 255
    out = np.full(len(slots) + int(far.sum()), 255, np.uint8)
    out[np.cumsum(far + 1) - 1] = step % 255
    return out.tobytes()


def count_slots(raw: bytes, sums: np.ndarray) -> None:
    """Add the slots of a row to ``sums``."""
    steps = np.frombuffer(raw, np.uint8)
    slots = np.cumsum(steps, dtype=np.int64)[steps != 255]
    last = np.flatnonzero(np.append(slots[1:] != slots[:-1], True))
    sums[slots[last]] += np.diff(last, prepend=-1).astype(np.uint32)


def _row(k: int, raw: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "raw": pa.array([raw], pa.binary())})


SLICED = "slice int, raw binary"


def _collected(df: DataFrame, width: int) -> np.ndarray:
    """The slices, ``width`` bytes each, in one array; their number and size are fixed."""
    out = np.zeros(SLICES * width, np.uint8)
    for r in df.collect():
        out[r["slice"] * width:(r["slice"] + 1) * width] = np.frombuffer(bytes(r["raw"]), np.uint8)
    return out


def frequency_classes(live: DataFrame) -> np.ndarray:
    """A class of 2 bits for each hash slot, four in a byte: how many of the sets ``live`` hold tokens of the slot.

    Class 0 is one set; 2 and 3 lie far above what the slots hold on average.  There are about twice as many slots as tokens,
    up to a fixed bound.  Tasks send each token as about one byte and a slice of the slots is added up as a stream.
    """
    many = (live.agg(F.sum(F.length("tokens"))).first()[0] or 0) // 8
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], round(float(np.log2(max(1, 2 * many))))))
    width = (1 << bits) // SLICES

    def send(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slots = np.sort(slots_of(np.concatenate(sets), bits))
        ends = np.searchsorted(slots, np.arange(SLICES + 1) * width)
        for k in range(SLICES):
            if ends[k] < ends[k + 1]:
                yield _row(k, pack_slots(slots[ends[k]:ends[k + 1]] - k * width))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0
        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                sets.append(np.frombuffer(tokens, np.uint64))
                held += len(sets[-1])
                if held > FLUSH:
                    yield from send(sets)
                    sets, held = [], 0
        if held:
            yield from send(sets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k not in sums:
                    sums[k] = np.zeros(width, np.uint32)
                count_slots(raw, sums[k])
        for k, total in sums.items():
            usual = max(1.0, float(total.mean()))
            classes = (total >= 2).astype(np.uint8) + (total > 2 + 4 * usual) + (total > 32 + 64 * usual)
            yield _row(k, (classes[::4] | classes[1::4] << 2 | classes[2::4] << 4 | classes[3::4] << 6).astype(np.uint8).tobytes())

    return _collected(live.select("tokens").mapInArrow(count, SLICED).repartition(SLICES, "slice").mapInArrow(add, SLICED), width // 4)


def _live_slots(hashes: np.ndarray) -> np.ndarray:
    """Two bits of the filter for each row hash."""
    h = hashes.view(np.uint64)
    return np.concatenate([h >> np.uint64(64 - LIVE_BITS), mix64(h) >> np.uint64(64 - LIVE_BITS)]).astype(np.int64)


def live_filter(rows: DataFrame) -> np.ndarray:
    """A Bloom filter of the row hashes in ``rows``, of a fixed size; far beyond 10^8 rows it lets more rows through."""
    width = (1 << LIVE_BITS) // SLICES

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.sort(_live_slots(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
            ends = np.searchsorted(slots, np.arange(SLICES + 1) * width)
            for k in range(SLICES):
                if ends[k] < ends[k + 1]:
                    yield _row(k, (slots[ends[k]:ends[k + 1]] - k * width).astype(np.int32).tobytes())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits.setdefault(k, np.zeros(width, bool))[np.frombuffer(raw, np.int32)] = True
        for k, found in bits.items():
            yield _row(k, np.packbits(found).tobytes())

    return _collected(rows.mapInArrow(send, SLICED).repartition(SLICES, "slice").mapInArrow(add, SLICED), width // 8)


def is_live(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slots = _live_slots(hashes)
    return ((bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1).reshape(2, -1).all(axis=0)


def _components(scratch: Scratch, edges: DataFrame, node: str, component: str) -> DataFrame:
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    out = scratch.stage(connected_components(nodes, edges).select(F.col("node").alias(node), F.col("component").alias(component)))
    scratch.release(edges)
    return out


def _pair_rows(first: np.ndarray, part: np.ndarray, tok: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
    """One row per (part, token) with its first class, and one per further class as an edge to that."""
    other = ~first
    row = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([part[first], part[other]])), pa.array(np.concatenate([tok[first], tok[other]]), mask=np.repeat([False, True], [first.sum(), other.sum()])),
         pa.array(np.concatenate([cls[first], cls[other]])), pa.array(np.concatenate([cls[first], cls[row][other]]))], ["part", "tok", "cls", "near"])


PAIRS = "part long, tok long, cls long, near long"


def _combine(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Tokens (part, cls, tok) of a batch, each (part, token) sent once with its smallest class and the others linked to that on the spot."""
    part, cls, tok = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    by = np.lexsort((cls, tok, part))
    part, cls, tok = part[by], cls[by], tok[by]
    kept = np.append(True, (part[1:] != part[:-1]) | (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1]))
    part, cls, tok = part[kept], cls[kept], tok[kept]
    return _pair_rows(np.append(True, (part[1:] != part[:-1]) | (tok[1:] != tok[:-1])), part, tok, cls)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from rows sorted by (part, token, class): every class to the smallest of its token, so that tokens of one group give the same edges.  Holds one batch; a token may go on over many."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part, tok, cls = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        first = np.append(last is None or (part[0], tok[0]) != last[:2], (part[1:] != part[:-1]) | (tok[1:] != tok[:-1]))
        row = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
        near = np.where(row >= 0, cls[row], last[2] if last else 0)
        edge = near != cls
        last = (part[-1], tok[-1], near[-1])
        if edge.any():
            yield pa.RecordBatch.from_arrays([pa.array(near[edge]), pa.array(cls[edge])], ["src", "dst"])


def _refine(scratch: Scratch, tokens: DataFrame) -> DataFrame:
    """(cls, part) from Arrow rows (part, cls, tok): rows of a part that share a token, directly or through others, stay together.

    Tokens are combined batch by batch before the one shuffle that brings equal tokens together, so a token of very many
    documents is sent about once a batch, and what meets is read as a sorted stream.
    """
    sent = scratch.stage(map_batches(tokens, _combine, PAIRS))
    met = sent.where("tok IS NOT NULL").select("part", "tok", "cls").repartition("part", "tok").sortWithinPartitions("part", "tok", "cls").mapInArrow(_meet, "src long, dst long")
    edges = scratch.stage(met.unionByName(sent.where("tok IS NULL").select(F.col("near").alias("src"), F.col("cls").alias("dst"))).distinct())
    scratch.release(sent)
    return _components(scratch, edges, "cls", "part")


def _planes(values: np.ndarray, width: int) -> bytes:
    """Sorted numbers of ``width`` bytes, byte by byte: the first bytes of all numbers, which have long runs, then the second ones."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width:].T.tobytes()


def _from_planes(raw: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - width:] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.view(">u8").ravel().astype(np.uint64)


def slice_bits(tokens: int) -> int:
    """So many slices, as a power of two, that about ``GROUP`` of the tokens meet in each."""
    return min(SLICE_BITS[1], max(SLICE_BITS[0], round(float(np.log2(max(1, tokens / GROUP))))))


def _cut(tok: np.ndarray, width: int, bits: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(slice, start, end, numbers inside the slice) of sorted tokens of ``bits`` and ``width`` bytes."""
    ends = np.searchsorted(tok, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(8 * width))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield k, ends[k], ends[k + 1], tok[ends[k]:ends[k + 1]] & np.uint64((1 << 8 * width) - 1)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """The rows of each group, piece by piece, of rows sorted by their first column."""
    def pieces():
        for batch in batches:
            if batch.num_rows:
                at = batch.column(0).to_numpy()
                for a, b in pairwise([0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]):
                    yield int(at[a]), batch.slice(a, b - a)

    for group, found in groupby(pieces(), itemgetter(0)):
        yield group, (piece for _, piece in found)


def document_classes(grouped: DataFrame, n: int, bits: int) -> DataFrame:
    """(group, slice, raw): for the sorted distinct tokens of a group of documents, slice by slice, one byte that tells how many documents
    of the whole table hold them: 0 for one, 3 for very many.

    ``grouped``: group, row, text.  A group's tokens go to the slices as about two bytes each, and the answers come back as a byte
    that is nearly always 0; a slice counts its tokens in an array of fixed size.  Some tokens of one document share a place
    there, an eighth at most however large the table, and count as shared.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, pieces in _segments(batches):
            sets, last = [np.empty(0, np.uint64)], None
            for piece in pieces:
                for text in arrow_texts(piece.column(1)):
                    if text != last:  # repeated rows are neighbours
                        sets.append(shingles(text, n))
                        last = text
            tok, many = np.unique(np.concatenate(sets) >> np.uint64(64 - bits - 8 * COUNTED), return_counts=True)
            many = np.minimum(many, 255).astype(np.uint8)
            for k, a, b, fine in _cut(tok, COUNTED, bits):
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([k], pa.int32()), pa.array([_planes(fine, COUNTED) + many[a:b].tobytes()], pa.binary())], names)

    def judge(table: pa.Table) -> pa.Table:
        total, out = np.zeros(1 << 8 * COUNTED, np.uint16), []
        rows = [(_from_planes(raw, COUNTED, m).astype(np.int64), np.frombuffer(raw, np.uint8, m, m * COUNTED)) for raw in table.column("raw").to_pylist() for m in (len(raw) // (COUNTED + 1),)]
        for fine, many in rows:
            total[fine] = np.minimum(total[fine].astype(np.uint32) + many, 65535)
        for fine, _ in rows:
            t = total[fine]
            out.append(((t >= 2).astype(np.uint8) + (t > 4) + (t > 64)).astype(np.uint8).tobytes())
        return pa.table({"group": table.column("group"), "slice": table.column("slice"), "raw": pa.array(out, pa.binary())})

    names, schema = ["group", "slice", "raw"], "group int, slice int, raw binary"
    counted = grouped.select("group", "text", "row").repartition("group").sortWithinPartitions("group", "row").mapInArrow(count, schema)
    return counted.groupBy("slice").applyInArrow(judge, schema)


def _once(tok: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each token once with its smallest name, and the distinct edges (src, dst) from that to its other names."""
    by = np.lexsort((name, tok))
    tok, name = tok[by], name[by]
    first = np.append(True, tok[1:] != tok[:-1])
    src = name[np.maximum.accumulate(np.where(first, np.arange(len(tok)), 0))]
    far = src != name
    edges = np.unique(src[far].astype(np.uint64) << np.uint64(32) | name[far].astype(np.uint64))
    return tok[first], name[first], edges >> np.uint64(32), edges & np.uint64(0xFFFFFFFF)


def _send_prefixes(tokens: list[np.ndarray], names: list[int], bits: int) -> Iterator[pa.RecordBatch]:
    """The tokens of a group's documents as one row a slice, and what meets in the group itself as edges in a row of slice -1."""
    name = np.repeat(np.array(names, np.int64).astype(np.uint32), [len(t) for t in tokens])
    tok, name, src, dst = _once(np.concatenate(tokens) >> np.uint64(64 - bits - 8 * MET), name)
    for k, a, b, fine in _cut(tok, MET, bits):
        yield _row(k, _planes(fine, MET) + name[a:b].astype("<u4").tobytes())
    if len(src):
        yield _row(-1, np.stack([src, dst]).astype("<u4").tobytes())


def _prefix_edges(sent: DataFrame) -> DataFrame:
    """Edges between the names of classes that share a prefix token, from the rows of :func:`_send_prefixes`."""

    def meet(table: pa.Table) -> pa.Table:
        tok, name = [], []
        for raw in table.column("raw").to_pylist():
            m = len(raw) // (MET + 4)
            tok.append(_from_planes(raw, MET, m))
            name.append(np.frombuffer(raw, "<u4", m, m * MET))
        _, _, src, dst = _once(np.concatenate(tok), np.concatenate(name))
        return pa.table({"src": pa.array(src.astype(np.int64)), "dst": pa.array(dst.astype(np.int64))})

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = np.concatenate([np.frombuffer(raw, "<u4").reshape(2, -1) for raw in batch.column(0).to_pylist()], axis=1).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["src", "dst"])

    far = sent.where("slice >= 0").select("slice", "raw").groupBy("slice").applyInArrow(meet, "src long, dst long")
    return far.unionByName(map_batches(sent.where("slice = -1").select("raw"), near, "src long, dst long")).distinct()


def _verify(percent: int, sketch):
    """Links inside one block pair, as a spanning forest: pairs that pass all filters are checked unless they are joined already."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column("cls").to_pylist()
        sides = np.array(table.column("side").to_pylist())
        sets = [np.frombuffer(b, np.uint64) for b in table.column("tokens").to_pylist()]
        m, sizes = len(names), np.array([len(s) for s in sets])
        # sizes that can reach the threshold at all, and each pair once
        ok = np.triu(100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes), 1)
        if sides.max() > sides.min():
            ok &= sides[:, None] != sides[None, :]
        for order in range(ORDERS):
            parts = [prefix(s, classes_of(s, sketch.value), order, percent) for s in sets]
            flat = np.concatenate(parts)
            owner = np.repeat(np.arange(m), [len(p) for p in parts])
            by = np.argsort(flat, kind="stable")
            flat, owner = flat[by], owner[by]
            ends = np.append(np.flatnonzero(np.diff(flat)) + 1, len(flat))
            share, start = np.zeros((m, m), bool), 0
            for end in ends:
                if end - start > 1:
                    share[np.ix_(owner[start:end], owner[start:end])] = True
                start = end
            ok &= share
        root = np.arange(m)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        src, dst = [], []
        for i in range(m):
            near = np.flatnonzero(ok[i])
            near = near[[find(j) != find(i) for j in near]] if len(near) else near
            if not len(near):
                continue
            flat = np.concatenate([sets[j] for j in near])
            at = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
            starts = np.concatenate([[0], np.cumsum(sizes[near])[:-1]])
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), starts)
            for j in near[100 * both >= percent * (sizes[i] + sizes[near] - both)]:
                if find(i) != find(j):
                    root[find(j)] = find(i)
                    src.append(names[i])
                    dst.append(names[j])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, component): one row per row of ``docs``; documents whose shingle sets have a Jaccard
    similarity of at least ``percent`` are linked, and a component is named by its smallest doc_id.  ``component`` tells components apart where
    ids are null or repeated (null without shingles), and ``text_hash`` the rows of one id.

    Equal sets form one class.  Classes that share a prefix token under order 0, directly or through others, form a part (tokens and
    classes go there under short names, about nine bytes a token; names that happen to be equal only make a part larger); parts larger
    than a block are split by the tokens of order 1 and then of order 2, each split a linear job.  Two linked documents share a
    token under each order, so they stay in the same part, and no list of pairs is written.  What is left is verified in tasks
    of at most two blocks of documents, where a pair must share a token under all orders before its sets are compared.
    Sets are 64-bit hashes.  Null, empty and blank texts have no shingles and link with nothing; repeated rows link as equal
    texts; an empty table gives no rows.
    """
    spark = docs.sparkSession
    id_type = type_of(docs, id_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = slice_bits(chars // 6)
    grouped = base.withColumn("row", F.xxhash64("doc_id", "text_hash")).withColumn("group", F.pmod("row", F.lit(max(GROUPS, -(-chars // (6 * GROUP))))).cast("int"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = ["doc_id", "text_hash", "n_shingles", "cls", "slice", "raw"]
        for _, pieces in _segments(batches):
            answers, sets, last, rows = [np.empty(0, np.uint8)], [np.empty(0, np.uint64)], None, []
            for piece in pieces:
                told = piece.column(1).is_valid().to_numpy(zero_copy_only=False)
                answers += [np.frombuffer(raw, np.uint8) for raw in piece.column(2).filter(pa.array(told)).to_pylist()]
                if told.all():
                    continue
                piece, own = piece.slice(int(told.sum())), []
                for text in arrow_texts(piece.column(5)):
                    if text != last:
                        sets.append(shingles(text, n))
                        last = text
                    own.append(len(sets) - 1)
                rows.append((piece.column(3), piece.column(4), own))
            ends = np.cumsum([len(t) for t in sets])
            flat, answer = np.concatenate(sets), np.concatenate(answers)
            tok, at = np.unique(flat >> np.uint64(64 - bits - 8 * COUNTED), return_inverse=True)
            if len(tok) != len(answer):
                raise ValueError(f"{len(tok)} tokens were counted as {len(answer)}: the documents changed while they were read")
            common = answer[at]
            names = [class_of(t) if len(t) else None for t in sets]
            for ids, hashes, own in rows:
                yield pa.RecordBatch.from_arrays([ids, hashes, pa.array([len(sets[k]) for k in own], pa.int64()), pa.array([names[k] for k in own], pa.int64()),
                                                  pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.binary())], whole)
            firsts = {k: prefix(sets[k], common[ends[k - 1]:ends[k]], 0, percent) for k in range(1, len(sets)) if len(sets[k])}
            firsts = {k: t for k, t in firsts.items() if len(t)}
            if firsts:
                for row in _send_prefixes([*firsts.values()], [names[k] for k in firsts], bits):
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, rows[0][0].type), *[pa.nulls(1, pa.int64())] * 3, *row.columns], whole)

    scratch = Scratch(spark)
    answers = scratch.stage(document_classes(grouped, n, bits))
    both = answers.unionByName(grouped, allowMissingColumns=True).select("group", "slice", "raw", "doc_id", "text_hash", "text", "row")
    both = both.repartition("group").sortWithinPartitions("group", F.asc_nulls_last("slice"), "row")
    sent = scratch.stage(both.mapInArrow(keys, f"doc_id {id_type}, text_hash long, n_shingles long, cls long, slice int, raw binary"))
    keyed = scratch.stage(sent.where("slice IS NULL").select("doc_id", "text_hash", "n_shingles", "cls"))
    edges = scratch.stage(_prefix_edges(sent))
    scratch.release(answers, sent)
    named = _components(scratch, edges, "name", "part")
    # one row of each class that shares a token; a filter of fixed size finds these rows again, so no text is shuffled
    picks = keyed.where("cls is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    picks = scratch.stage(picks.withColumn("name", F.col("cls").bitwiseAND(0xFFFFFFFF)).join(named, "name").select("cls", "part", F.xxhash64("one.doc_id", "one.text_hash").alias("row")))
    live_rows = spark.sparkContext.broadcast(live_filter(picks.select("row")))
    parts = scratch.stage(picks.select("cls", "part"))
    scratch.release(named, picks)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes of this partition, so that a row that is repeated is sent once by each
        for batch in batches:
            texts = batch.column(0).filter(pa.array(is_live(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), live_rows.value)))
            names, whole = [], []
            for text in arrow_texts(texts):
                tokens = shingles(text, n)
                name = class_of(tokens) if len(tokens) else None
                if name is not None and name not in seen:
                    seen.add(name)
                    names.append(name)
                    whole.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(whole, pa.binary())], ["cls", "tokens"])

    def tokens_of(order: int):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            whole = [np.frombuffer(b, np.uint64) for b in batch.column(2).to_pylist()]
            first = [prefix(s, classes_of(s, shared.value), order, percent) for s in whole]
            take = pa.array(np.repeat(np.arange(len(first)), [len(f) for f in first]), pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(first).view(np.int64), pa.int64())], ["part", "cls", "tok"])

        return run

    # written where it is read: the first shuffle of these sets is that to their parts
    live = scratch.stage(base.select("text", F.xxhash64("doc_id", "text_hash").alias("row")).mapInArrow(sets, "cls long, tokens binary"))
    live_rows.destroy()
    shared = spark.sparkContext.broadcast(frequency_classes(live))  # fixed size
    for order in range(1, ORDERS):
        # the filters of small parts are intersected where they are verified; only larger ones are split first
        large = scratch.stage(parts.join(parts.groupBy("part").agg(F.count("*").alias("_m")).where(F.col("_m") > BLOCK).select("part"), "part"))
        if not large.limit(1).count():
            scratch.release(large)
            break
        finer = _refine(scratch, map_batches(live.join(large, "cls").select("part", "cls", "tokens"), tokens_of(order), "part long, cls long, tok long"))
        rest = scratch.stage(parts.join(large.select("cls"), "cls", "left_anti").unionByName(finer))
        scratch.release(parts, large, finer)
        parts = rest
    blocks = F.ceil(F.col("_m") / BLOCK).cast("int")
    sized = parts.join(parts.groupBy("part").agg(F.count("*").alias("_m")), "part")
    counted = live.join(sized, "cls").groupBy("cls").agg(*(F.first(c).alias(c) for c in ("part", "_m", "tokens")))  # repeated rows are one; partitioned by cls already
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(b, own).alias("lo"), F.greatest(b, own).alias("hi")))
    dealt = counted.withColumn("_own", own).withColumn("_pair", F.explode(pairs)).select(
        "part", F.col("_pair.lo").alias("lo"), F.col("_pair.hi").alias("hi"), F.when(F.col("_own") == F.col("_pair.lo"), 0).otherwise(1).alias("side"), "cls", "tokens")
    links = scratch.stage(dealt.groupBy("part", "lo", "hi").applyInArrow(_verify(percent, shared), "src long, dst long"))
    scratch.release(live, parts)
    shared.destroy()  # all that needs it is written
    joined = _components(scratch, links, "cls", "component")
    member = keyed.drop("p0").join(joined, "cls", "left").withColumn("_c", F.coalesce("component", "cls"))
    member = scratch.stage(member.select("doc_id", "text_hash", "n_shingles", "_c"))
    scratch.release(keyed, joined)
    smallest = member.where("_c is not null").groupBy("_c").agg(F.min("doc_id").alias("_least"))
    return member.join(smallest, "_c", "left").select(
        "doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"), "text_hash", F.col("_c").alias("component"))


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component of ``groups`` (:func:`near_groups` of ``docs``): that of the smallest id, all columns kept.

    Rows go by id and text, so of rows with one id, or with none, each is judged by its own text; a null id comes last.  Of
    repeated rows one stays.  Documents without shingles link with nothing: each stays, repeated rows once.  An empty table gives no rows.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("text_hash"))
    best = groups.where("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("b")).select(F.col("b.id").alias("_kept"), F.col("b.text_hash").alias("_kept_text"))
    bare = groups.where("component IS NULL").select(F.col("doc_id").alias("_kept"), F.col("text_hash").alias("_kept_text"))
    kept = best.unionByName(bare).distinct()
    rows = docs.withColumn("_text_hash", F.xxhash64(F.col(text_col).cast("string")))
    rows = rows.join(kept, F.col(id_col).eqNullSafe(F.col("_kept")) & (F.col("_text_hash") == F.col("_kept_text")), "left_semi")
    return rows.dropDuplicates([id_col, "_text_hash"]).drop("_text_hash")
