"""Near-duplicate vectors by a flat, robust-pruned graph built on overlapping shards and searched by range."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.guards import ContractError
from .common import Scratch, map_batches, type_of

SHARD = 512  # vectors for which a shard is made
OVERLAP = 3  # shards that a vector is a member of
BLOCK = 2048  # members of a shard in one block; a larger shard is searched by pairs of blocks
FIT_ROWS = 16_384  # vectors the shard centres are fitted on at most, and a quarter as many centres at most
AUDIT_ROWS = 512  # vectors whose links are counted by brute force as well
DEGREE = 16
CANDIDATES = 48
ALPHA = 1.2
BEAM = 16
SLACK = 1e-4  # of the single-precision search; links are decided in double precision
RECALL = 0.9


def unit_vectors(column: pa.Array) -> list[bytes | None]:
    """Each vector divided by its length, in double precision; None for null, zero and empty ones and those with null or non-finite components."""
    out = []
    for value in column.to_pylist():
        unit = None
        if value and None not in value:
            x = np.asarray(value, np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top
                unit = (x / np.sqrt(x @ x) + 0.0).tobytes()
        out.append(unit)
    return out


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the first ``k`` rows of a sample in hash order."""
    centre = sample[:k].copy()
    for _ in range(rounds if k > 1 else 0):
        near = np.argmax(sample @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centre)
    return centre


def apart(centre: np.ndarray, cosine: float) -> np.ndarray:
    """Centres without those whose cosine to an earlier one kept is ``cosine`` or more, so a dense group stays in one shard."""
    free, kept = np.ones(len(centre), bool), []
    unit = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    while free.any():
        k = int(np.argmax(free))
        kept.append(k)
        free &= unit @ unit[k] < cosine
        free[k] = False
    return centre[kept]


def attach(edges: np.ndarray, child: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Two more edges a node, so that each child can be reached from its parent: to the first child, and to the next child of one's parent."""
    extra = np.full((len(edges), 2), -1, np.int32)
    order = np.argsort(parent, kind="stable")
    child, parent = child[order], parent[order]
    first = np.ones(len(child), bool)
    first[1:] = parent[1:] != parent[:-1]
    extra[parent[first], 0] = child[first]
    later = np.flatnonzero(~first)
    extra[child[later - 1], 1] = child[later]
    return np.concatenate([edges, extra], axis=1)


def connect(x: np.ndarray, edges: np.ndarray, start: int) -> np.ndarray:
    """Pruned edges may leave nodes that no walk from ``start`` meets; each is attached to the closest node that one does meet."""
    reached, front = np.zeros(len(x), bool), np.array([start])
    while len(front):
        reached[front] = True
        ahead = edges[front].ravel()
        ahead = np.unique(ahead[ahead >= 0])
        front = ahead[~reached[ahead]]
    lost, met = np.flatnonzero(~reached), np.flatnonzero(reached)
    if not len(lost):
        return edges
    return attach(edges, lost, np.concatenate([met[np.argmax(x[lost[k:k + 1024]] @ x[met].T, axis=1)] for k in range(0, len(lost), 1024)]))


def robust_prune(x: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of every node out of its candidates (-1: none): the closest left, then without those that it is closer to by ``alpha``."""
    m, width = near.shape
    there = near >= 0
    other = x[np.maximum(near, 0)]
    away = np.where(there, 2 - 2 * np.einsum("mcd,md->mc", other, x), np.inf)
    out = np.full((m, degree), -1, np.int32)
    rows = np.arange(m)
    for r in range(degree):
        pick = np.argmin(away, axis=1)
        ok = np.isfinite(away[rows, pick])
        if not ok.any():
            break
        out[ok, r] = near[rows, pick][ok]
        between = 2 - 2 * np.einsum("mcd,md->mc", other, other[rows, pick])
        away[ok] = np.where(alpha * alpha * between[ok] <= away[ok], np.inf, away[ok])
        away[rows[ok], pick[ok]] = np.inf
    return out


def build_graph(x: np.ndarray, seed: int = 1) -> np.ndarray:
    """Out-neighbours of the vectors of a block; candidates are the closest ones and a few at random, edges run both ways before the last pruning.

    Pruning takes all edges to some nodes of a dense region away, so afterwards each node is attached to its closest one, and what no walk meets is connected.
    """
    m = len(x)
    if m < 2:
        return np.full((m, 1), -1, np.int32)
    width, rng = min(CANDIDATES, m - 1), np.random.default_rng(seed)
    near, closest = np.empty((m, width + 8), np.int32), np.empty(m, np.int64)
    for a in range(0, m, 1024):
        like = x[a:a + 1024] @ x.T
        like[np.arange(len(like)), np.arange(a, a + len(like))] = -np.inf
        closest[a:a + 1024] = np.argmax(like, axis=1)
        near[a:a + 1024, :width] = np.argpartition(-like, width - 1, axis=1)[:, :width]
    near[:, width:] = rng.integers(0, m, (m, 8))
    near[near == np.arange(m)[:, None]] = -1
    first = robust_prune(x, near)
    src, dst = np.repeat(np.arange(m), first.shape[1]), first.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    both = np.unique(np.concatenate([src * m + dst, dst.astype(np.int64) * m + src]))
    src, dst = both // m, both % m
    like = np.einsum("ed,ed->e", x[src], x[dst])
    order = np.lexsort((-like, src))
    src, dst = src[order], dst[order]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    wide = np.full((m, 3 * DEGREE), -1, np.int32)
    fits = place < 3 * DEGREE
    wide[src[fits], place[fits]] = dst[fits]
    edges = robust_prune(x, wide)
    bare = np.flatnonzero(~(edges[closest] == np.arange(m)[:, None]).any(1))
    return connect(x, attach(edges, bare, closest[bare]), int(medoids(x)[0]))


def medoids(x: np.ndarray, k: int = 8) -> np.ndarray:
    """The vectors closest to the means of a few parts of the shard."""
    centre = centres(x, min(k, len(x)), 3)
    return np.unique(np.argmax(centre @ x.T, axis=1))


def range_search(x: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, radius: float, beam: int = BEAM, expand: int = 2) -> np.ndarray:
    """For each query node, which nodes were found with a cosine of ``radius`` or more (a matrix of flags).

    Greedy search from the entries and the query's own node: the closest unvisited nodes among the best ``beam`` ones are opened until none is
    left.  A query with half of its beam in range gets a beam twice as wide and goes on, without a limit, so dense regions are covered; half
    of a widened beam is opened at a time, and what it meets is compared in one product.
    """
    m, q = len(x), len(queries)
    like = np.full((q, m), -np.inf, np.float32)
    opened = np.zeros((q, m), bool)
    like[:, entry] = x[queries] @ x[entry].T
    like[np.arange(q), queries] = 1.0
    width = np.full(q, min(beam, m))
    active = np.ones(q, bool)
    while active.any():
        wide = int(width[active].min())
        at = np.flatnonzero(active & (width == wide))
        part = like[at]
        bar = np.partition(part, m - wide, axis=1)[:, m - wide, None]
        closed = np.where(opened[at] | (part < bar), -np.inf, part)
        step = min(expand if wide <= beam else wide // 2, m)
        pick = np.argpartition(-closed, step - 1, axis=1)[:, :step]
        usable = np.take_along_axis(closed, pick, 1) > -np.inf
        done = at[~usable.any(1)]
        wider = (2 * (like[done] >= radius).sum(1) >= wide) & (wide < m)
        width[done[wider]] = min(2 * wide, m)
        active[done[~wider]] = False
        row, col = np.nonzero(usable)
        node = pick[row, col]
        opened[at[row], node] = True
        nodes = edges[node]
        row, nodes = np.repeat(row, nodes.shape[1]), nodes.ravel()
        row, nodes = row[nodes >= 0], nodes[nodes >= 0]
        if wide <= beam:
            new = part[row, nodes] == -np.inf
            row, nodes = row[new], nodes[new]
            like[at[row], nodes] = np.einsum("ed,ed->e", x[queries[at[row]]], x[nodes])
        elif len(row):
            met = np.zeros(part.shape, bool)
            met[row, nodes] = True
            seen = np.flatnonzero(met.any(0))
            like[np.ix_(at, seen)] = np.where(met[:, seen], x[queries[at]] @ x[seen].T, part[:, seen])
    return like >= radius


def _matrix(column, dtype=np.float64) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1).astype(dtype)


def _local_roots(m: int, a: np.ndarray, b: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Smallest name reachable by the links inside one shard."""
    label = names.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (before == label).all():
            break
    return label


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``.

    Equal directions form one class, whose copies are counted and not expanded.  Classes are members of the ``OVERLAP`` shards with the closest centres, less those
    too far to be a linked vector's closest; centres that could be linked themselves are one, so a dense group is one shard however large it is.  A shard is cut into blocks of about ``BLOCK``
    members.  Each block builds a robust-pruned graph; a class's neighbour lists from its shards are united; each pair of blocks of a shard then walks
    the united lists, a range search in the one block for every member of the other.  A link counts in the first shard that holds both ends, so pairs are not
    written, only a count and the smallest class reached per member.  A fixed number of vectors is compared with all others by
    brute force as well; if less than ``RECALL`` of their links to other classes were found the job fails.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different
    lengths; repeated rows link as equal vectors; an empty table gives no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    kind = type_of(vectors, id_col)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = unit_vectors(batch.column(1))
        names = [None if u is None else xxhash.xxh3_64_intdigest(u) - (1 << 63) for u in units]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(units, pa.binary())], ["vec_id", "cls", "unit"])

    base = scratch.stage(map_batches(vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")), clean, f"vec_id {kind}, cls long, unit binary"))
    classes = scratch.stage(base.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("unit").alias("unit")))
    total = classes.count()
    sample = [bytes(r["unit"]) for r in classes.orderBy(F.xxhash64("cls"), "cls").limit(FIT_ROWS).select("unit").collect()]  # FIT_ROWS rows at most
    by_length: dict[int, list[bytes]] = {}
    for raw in sample:
        by_length.setdefault(len(raw), []).append(raw)
    model = {}
    for length, raws in by_length.items():
        points = np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1)
        k = max(1, min(round(total * len(raws) / len(sample) / SHARD), len(raws) // 4))
        model[length] = (len(model) << 32, apart(centres(points, k), cosine).astype(np.float32))

    margin = 2 * float(np.arccos(cosine)) + SLACK  # a centre farther than this beyond the closest one is no linked vector's closest

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = batch.column(2).to_pylist()
        shards: list = []
        for raw in raws:
            first, centre = model.get(len(raw), (len(raw) << 40, None))
            if centre is None:  # a length that the sample does not hold is one shard
                shards.append([first])
            else:
                like = centre @ np.frombuffer(raw, np.float64).astype(np.float32)
                k = min(OVERLAP, len(like))
                close = np.argpartition(-like, k - 1)[:k]
                angle = np.arccos(np.clip(like[close], -1, 1))
                shards.append(sorted(first + int(c) for c in close[angle <= angle.min() + margin]))
        take = pa.array(np.repeat(np.arange(len(raws)), [len(s) for s in shards]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([s for own in shards for s in own], pa.int64()), *[batch.column(k).take(take) for k in (0, 1, 2)],
                                           pa.array([own for own in shards for _ in own], pa.list_(pa.int64()))], ["shard", "cls", "copies", "unit", "shards"])

    dealt = scratch.stage(map_batches(classes.select("cls", "copies", "unit"), deal, "shard long, cls long, copies long, unit binary, shards array<long>"))

    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row per shard
    members = dealt.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(2)), "blocks").cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        names = np.array(table.column("cls").to_pylist(), np.int64)
        edges = build_graph(_matrix(table.column("unit"), np.float32))
        lists = [names[e[e >= 0]].tolist() for e in edges]
        return pa.table({"cls": pa.array(names), "near": pa.array(lists, pa.list_(pa.int64()))})

    lists = members.select("shard", "block", "cls", "unit").groupBy("shard", "block").applyInArrow(build, "cls long, near array<long>")
    united = scratch.stage(lists.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))  # OVERLAP lists of DEGREE each

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        names = np.array(table.column("cls").to_pylist(), np.int64)
        shard, copies = table.column("shard")[0].as_py(), np.array(table.column("copies").to_pylist(), np.int64)
        exact = _matrix(table.column("unit"))
        x, m = exact.astype(np.float32), len(names)
        near = table.column("near").to_pylist()
        edges = np.full((m, max(1, max(map(len, near)))), -1, np.int32)
        for i, other in enumerate(near):
            at = np.minimum(np.searchsorted(names, other), m - 1) if other else np.empty(0, int)
            at = at[names[at] == np.asarray(other, np.int64)] if len(at) else at
            edges[i, :len(at)] = at
        lower = np.full((m, OVERLAP), -1, np.int64)
        for i, own in enumerate(table.column("shards").to_pylist()):
            before = [s for s in own if s < shard]
            lower[i, :len(before)] = before
        block = np.array(table.column("block").to_pylist())
        low, high = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        pairs = []
        for own, side in {(low, high), (high, low)}:
            inside = np.flatnonzero(block == side)
            queries = np.flatnonzero(block == own)
            if not len(inside) or not len(queries):
                continue
            walk = np.where((edges >= 0) & (block[edges] == side), edges, -1)
            entry = inside[medoids(x[inside])]
            for start in range(0, len(queries), 256):
                part = queries[start:start + 256]
                r, c = np.nonzero(range_search(x, walk, entry, part, cosine - SLACK))
                r = part[r]
                r, c = r[block[c] == side], c[block[c] == side]
                pairs.append(np.unique(np.minimum(r, c) * m + np.maximum(r, c)))
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        pairs = pairs[pairs // m != pairs % m]
        links, sure = np.zeros(m, np.int64), np.zeros(len(pairs), bool)
        for k in range(0, len(pairs), 65536):
            a, b = pairs[k:k + 65536] // m, pairs[k:k + 65536] % m
            sure[k:k + 65536] = np.einsum("ed,ed->e", exact[a], exact[b]) >= cosine
            earlier = ((lower[a][:, :, None] == lower[b][:, None, :]) & (lower[a][:, :, None] >= 0)).any((1, 2))
            here = sure[k:k + 65536] & ~earlier
            np.add.at(links, a[here], copies[b[here]])
            np.add.at(links, b[here], copies[a[here]])
        pairs = pairs[sure]
        return pa.table({"cls": pa.array(names), "links": pa.array(links), "root": pa.array(_local_roots(m, pairs // m, pairs % m, names))})

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meet = members.join(united, "cls").withColumn("_other", other).withColumns({"lo": F.least("block", "_other"), "hi": F.greatest("block", "_other")}).drop("_other", "blocks")
    found = scratch.stage(meet.groupBy("shard", "lo", "hi").applyInArrow(search, "cls long, links long, root long"))
    scratch.release(dealt, united)
    linked = scratch.stage(found.where("cls <> root").select(F.col("root").alias("src"), F.col("cls").alias("dst")).distinct())
    nodes = linked.select(F.col("src").alias("node")).union(linked.select("dst")).distinct()
    parts = connected_components(nodes, linked).select(F.col("node").alias("cls"), "component")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links")).join(classes.select("cls", "copies", "least"), "cls").join(parts, "cls", "left")
    counts = scratch.stage(counts.select("cls", (F.col("links") + F.col("copies") - 1).alias("n_links"), "least", F.coalesce("component", "cls").alias("component")))
    scratch.release(found, linked)
    _audit(base, classes, counts, cosine)
    smallest = counts.groupBy("component").agg(F.min("least").alias("component_id"))
    named = counts.join(smallest, "component").select(F.col("cls").alias("_cls"), "n_links", "component_id")
    out = base.select("vec_id", "cls").join(named, F.col("cls") == F.col("_cls"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))


def _audit(base: DataFrame, classes: DataFrame, counts: DataFrame, cosine: float) -> float:
    """Share of the links of ``AUDIT_ROWS`` hash-chosen classes to other classes that the graph found; fails below ``RECALL``."""
    chosen = classes.orderBy(F.xxhash64("cls", F.lit(1)), "cls").limit(AUDIT_ROWS).select("cls", "unit")
    rows = [(r["cls"], bytes(r["unit"])) for r in chosen.collect()]  # AUDIT_ROWS rows at most

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, many = batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), np.int64)
        total = np.zeros(len(rows), np.int64)
        for length in {len(u) for u in own}:
            at = [k for k, u in enumerate(own) if len(u) == length]
            q = [k for k, (_, u) in enumerate(rows) if len(u) == length]
            if q:
                x = np.frombuffer(b"".join(own[k] for k in at), np.float64).reshape(len(at), -1)
                y = np.frombuffer(b"".join(rows[k][1] for k in q), np.float64).reshape(len(q), -1)
                total[q] += ((y @ x.T) >= cosine) @ many[at]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array(total)], ["cls", "n"])

    true = map_batches(classes.select("cls", "unit", "copies"), count, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n"))
    others = true.join(classes.select("cls", "copies"), "cls").join(counts.select("cls", "n_links"), "cls").select(
        (F.col("n") - F.col("copies")).alias("true"), (F.col("n_links") - F.col("copies") + 1).alias("n_links"))
    pair = others.agg(F.sum("true").alias("true"), F.sum(F.least("true", "n_links")).alias("found")).first()
    recall = 1.0 if not pair["true"] else pair["found"] / pair["true"]
    if recall < RECALL:
        raise ContractError(f"the graph found {recall:.3f} of the audited links")
    return recall
