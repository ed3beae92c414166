"""Hard negatives of embeddings, by partial products after an orthogonal PCA rotation (operator 13).

Components are made integers (the floor of ``SCALE`` times each), so that scores,
inner products, are exact. An anchor's positives are its nearest rows of the same
label; of each positive the hardest negatives are the nearest rows of other labels
whose score lies between two shares of the positive's score.

1. The second moments of all rows are summed by Spark; their eigenvectors rotate
   every row, so that the leading components carry most of a product. With each row
   go the norms of what is left after the first 4, 8, 16, ... components.
2. Rows are packed into blocks of ``BLOCK``, anchors into blocks of ``ANCHORS``, and
   both are written. A task takes one
   block of anchors and one of rows. It adds up the products of leading components
   of all pairs at once; the rest of a product is at most the product of the two
   norms that are left, plus slack for rounding. A pair whose bound cannot reach what
   its anchor has already found, or the shares asked for, is dropped; what stays is
   looked at with more components, and the last survivors by their integer product.
3. A task returns the few best of each anchor; Spark merges them (its windows drop
   all but the first few of a group before the shuffle). Positives come
   from one such pass, negatives from a second, which knows the shares.

Every anchor meets every row in some task, as the operator's rows are a stated
query set against all rows; no task holds more than two blocks.

Cases: rows with a null label, a null vector or a null or non-finite component take
no part, nor do rows without an id, which no result could name; vectors of unequal
length are filled with zeros; repeated rows are rows of their own, and repeated
anchors give repeated results; equal scores are ordered by id; other columns are
not read; an empty table, or one without anchors, gives an empty result. A score
that a long cannot hold is an error.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import Scratch, written

SCALE, BLOCK, ANCHORS, CHUNK = 256, 4096, 1024, 512
#: Components after which bounds are looked at again.
STEPS = (4, 8, 16, 32)
#: Tasks that the rows for one part of the anchors are dealt to.
DEALS = 16
#: Without bounds.
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Pairs that one array of survivors may hold.
PAIRS = 1 << 18


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, noise: int | None, classes: int) -> DataFrame:
    """(id, label, q) of the rows that take part. noise: labels of ids divisible by it move to the next class."""
    v = F.col("v")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v")).where(fine)
    if noise:
        rows = rows.withColumn("label", F.when(F.col("id") % noise == 0, (F.col("label") + 1) % classes).otherwise(F.col("label")))
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(SCALE * x).cast("long")).alias("q"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Integer rows of d components, short ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Orthogonal matrix whose first columns are the directions along which rows are longest. Only d * d sums reach the driver."""

    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            x = _matrix(b.column(0), d).astype(np.float64)
            size = np.abs(x).max(initial=1.0)
            total += (x / size).T @ (x / size)  # directions matter, not scale, and nothing overflows
        i, j = np.indices((d, d))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    total = np.zeros((d, d))
    for r in rows.select("q").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.i, r.j] = r.s
    return np.linalg.eigh(total)[1][:, ::-1]


#: Of a block: the part it is dealt by, its number and rows, and as bytes uids, ids, labels, integer and rotated vectors, and the norms left after each step.
PACKED = {"part": pa.int64(), "b": pa.int64(), "n": pa.int32(), **{c: pa.binary() for c in ("uid", "id", "label", "vec", "rot", "rest")}}


def _packed(rows: DataFrame, parts: int, turn: np.ndarray, size: int) -> DataFrame:
    """rows (uid, id, label, q) in blocks of `size`, of parts 0..parts - 1."""
    d = len(turn)
    steps = [s for s in STEPS if s < d]

    def pack(part, number, uid, ids, labels, q):
        with np.errstate(over="ignore", invalid="ignore"):
            y = q.astype(np.float64) @ turn
            left = np.stack([np.sqrt((y[:, s:] ** 2).sum(1)) for s in (0, *steps)], 1)
            data = (x.tobytes() for x in (uid, ids, labels, q, y.astype(np.float32), left))
        row = (part, part << 24 | number, len(uid), *data)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, PACKED.values())], names=list(PACKED))

    def run(batches):
        part, number, held = TaskContext.get().partitionId(), 0, None
        for b in batches:
            new = [*(b.column(k).to_numpy() for k in range(3)), _matrix(b.column(3), d)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            while len(held[0]) >= size:
                yield pack(part, number, *(x[:size] for x in held))
                held, number = [x[size:] for x in held], number + 1
        if held is not None and len(held[0]):
            yield pack(part, number, *held)

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return rows.select("uid", "id", "label", "q").repartition(parts).mapInArrow(run, ", ".join(f"{c} {kinds[k]}" for c, k in PACKED.items()))


class Block:
    """One block of rows."""

    def __init__(self, row, d: int):
        self.b, self.n, self.d = row["b"], row["n"], d
        self.uid, self.id, self.label = (np.frombuffer(row[k], np.int64) for k in ("uid", "id", "label"))
        self.vec, self.rot = (np.frombuffer(row[k], kind).reshape(self.n, d) for k, kind in (("vec", np.int64), ("rot", np.float32)))
        self.rest = np.frombuffer(row["rest"], np.float64).reshape(self.n, -1)
        self.most = max(abs(int(self.vec.max(initial=0))), abs(int(self.vec.min(initial=0))))


def exact(x: Block, i: np.ndarray, y: Block, j: np.ndarray) -> np.ndarray:
    """Integer products of rows i of x and j of y."""
    if x.most * y.most * x.d < 2**63:
        return np.einsum("ij,ij->i", x.vec[i], y.vec[j])
    out = [sum(a * b for a, b in zip(x.vec[p].tolist(), y.vec[q].tolist())) for p, q in zip(i, j)]
    if any(abs(s) >= 2**63 for s in out):
        raise OverflowError("a score does not fit into 64 bits")
    return np.array(out, np.int64)


def survivors(x: Block, y: Block, low: int, high: int, floor: np.ndarray, ceil: np.ndarray, same: bool):
    """Pairs (row of x, row of y, integer product) of rows low..high-1 of y, of equal or of unequal labels, with floor <= product <= ceil of x's row.

    Only pairs that provably miss that range are dropped before their product is exact.
    """
    steps = [0, *(s for s in STEPS if s < x.d), x.d]
    size = (x.rest[:, :1] * y.rest[None, low:high, 0]).astype(np.float64)
    # rounding of the rotation (64 bits) and of the products (32 bits), with room
    slack = (16 * x.d + 64) * np.finfo(np.float32).eps
    m = steps[1]
    part = (x.rot[:, :m] @ y.rot[low:high, :m].T).astype(np.float64)
    rest = (x.rest[:, 1:2] * y.rest[None, low:high, 1] if m < x.d else 0.0) + slack * size + 1
    floor_at, ceil_at = np.where(floor == LEAST, -np.inf, floor), np.where(ceil == MOST, np.inf, ceil)
    match = (x.label[:, None] == y.label[None, low:high]) == same
    with np.errstate(invalid="ignore", over="ignore"):
        # a bound that is not a number drops nothing
        match &= ~((part + rest < floor_at[:, None]) | (part - rest > ceil_at[:, None]))
    i, j = np.nonzero(match)
    for a in range(0, len(i), PAIRS):
        p, q = i[a : a + PAIRS], j[a : a + PAIRS]
        sums = part[p, q]
        for k in range(1, len(steps) - 1):
            if not len(p):
                break
            s, e = steps[k], steps[k + 1]
            sums = sums + np.einsum("ij,ij->i", x.rot[p, s:e], y.rot[low + q, s:e])
            left = (x.rest[p, k + 1] * y.rest[low + q, k + 1] if e < x.d else 0.0) + slack * size[p, q] + 1
            with np.errstate(invalid="ignore", over="ignore"):
                stay = ~((sums + left < floor_at[p]) | (sums - left > ceil_at[p]))
            p, q, sums = p[stay], q[stay], sums[stay]
        if len(p):
            score = exact(x, p, y, low + q)
            fits = (score >= floor[p]) & (score <= ceil[p])
            yield p[fits], low + q[fits], score[fits]


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """The first k rows of each group by falling score and rising id."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    first = np.arange(len(group)) - np.searchsorted(group, group) < k
    return [group[first], score[order][first], ids[order][first]]


def nearest(x: Block, y: Block, k: int):
    """Of each anchor in x the first k other rows of its label in y: (row of x, score, id)."""
    group, score, ids = (np.zeros(0, np.int64) for _ in range(3))
    floor = np.full(x.n, LEAST)
    for low in range(0, y.n, CHUNK):
        parts = [(group, score, ids)]
        for p, q, s in survivors(x, y, low, min(low + CHUNK, y.n), floor, np.full(x.n, MOST), True):
            other = x.uid[p] != y.uid[q]
            parts.append((p[other], s[other], y.id[q[other]]))
        group, score, ids = _best(*(np.concatenate(c) for c in zip(*parts)), k)
        full = np.bincount(group, minlength=x.n) >= k
        worst = np.full(x.n, MOST)
        np.minimum.at(worst, group, score)
        floor = np.where(full, worst, LEAST)
    return group, score, ids


def within(x: Block, y: Block, low_share: np.ndarray, high_share: np.ndarray, k: int):
    """Of each anchor in x and each of its ranges (row of x, range) the first k rows of other labels in y whose score lies in it: (row of x * ranges + range, score, id)."""
    ranges = low_share.shape[1]
    group, score, ids = (np.zeros(0, np.int64) for _ in range(3))
    reach = low_share.copy()
    ceil = high_share.max(1, initial=LEAST)
    for low in range(0, y.n, CHUNK):
        parts = [(group, score, ids)]
        for p, q, s in survivors(x, y, low, min(low + CHUNK, y.n), reach.min(1, initial=MOST), ceil, False):
            for r in range(ranges):
                fits = (s >= reach[p, r]) & (s <= high_share[p, r])
                parts.append((p[fits] * ranges + r, s[fits], y.id[q[fits]]))
        group, score, ids = _best(*(np.concatenate(c) for c in zip(*parts)), k)
        full = (np.bincount(group, minlength=x.n * ranges) >= k).reshape(x.n, ranges)
        worst = np.full(x.n * ranges, MOST)
        np.minimum.at(worst, group, score)
        reach = np.where(full, worst.reshape(x.n, ranges), low_share)
    return group, score, ids


def _pairs(blocks: DataFrame, anchors: DataFrame, parts: int, *more: str) -> DataFrame:
    """Each block of rows (y) with each block of anchors (x), dealt out by the pair."""
    x = anchors.select("part", F.struct(*(c for c in PACKED if c != "part")).alias("x"), *more)
    y = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.struct(*(c for c in PACKED if c != "part")).alias("y"))
    # dealt before the join, so that a part of anchors is not one task
    deal = lambda side: side.withColumn("deal", F.pmod(F.xxhash64("y.b"), F.lit(DEALS)))
    x = x.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    return deal(y).join(x.hint("shuffle_hash"), ["part", "deal"]).select("x", "y", *more)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _blocks(batches, d: int):
    """The pairs of blocks of Arrow batches one by one."""
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            yield Block(row["x"], d), Block(row["y"], d), row.get("ranges")


def mine(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", anchor_every: int = 50, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, noise: int | None = 7, classes: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of each anchor, a row whose id is divisible by anchor_every, the hardest negatives of each positive."""
    spark = vectors.sparkSession
    with Scratch(spark) as keep:
        # the numbers of rows and blocks hold because their tables are written once
        rows = keep(usable(vectors, id_col, vec_col, label_col, noise, classes).withColumn("uid", F.monotonically_increasing_id()))
        asked = F.col("id") % anchor_every == 0
        n, queries, d = rows.agg(F.count("*"), F.count_if(asked), F.max(F.size("q"))).first()
        if not queries:
            return spark.createDataFrame([], RESULT)
        d, parts = max(d, 1), -(-queries // ANCHORS)
        turn = rotation(rows, d)
        blocks = keep(_packed(rows, -(-n // BLOCK), turn, BLOCK))
        anchors = keep(_packed(rows.where(asked), parts, turn, ANCHORS))

        def first_pass(batches):
            for x, y, _ in _blocks(batches, d):
                p, s, ids = nearest(x, y, positives)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), x.b)), pa.array(p), pa.array(x.id[p]), pa.array(s), pa.array(ids)], names=["xb", "row", "anchor_id", "score", "id"])

        near = _pairs(blocks, anchors, parts).mapInArrow(first_pass, "xb long, row long, anchor_id long, score long, id long")
        place = F.row_number().over(W.partitionBy("xb", "row").orderBy(F.desc("score"), "id"))
        near = keep(near.withColumn("place", place).where(F.col("place") <= positives))
        ranges = near.groupBy(F.col("xb").alias("b")).agg(F.collect_list(F.struct("row", "place", "score")).alias("ranges"))

        def second_pass(batches):
            for x, y, asked_for in _blocks(batches, d):
                low, high = np.full((x.n, positives), MOST), np.full((x.n, positives), LEAST)
                for r in asked_for:
                    # the whole numbers s with low_percent * score <= 100 * s <= high_percent * score
                    low[r["row"], r["place"] - 1] = -(-low_percent * r["score"] // 100)
                    high[r["row"], r["place"] - 1] = high_percent * r["score"] // 100
                g, s, ids = within(x, y, low, high, negatives)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), x.b)), pa.array(g // positives), pa.array((g % positives + 1).astype(np.int32)), pa.array(s), pa.array(ids)], names=["xb", "row", "place", "score", "id"])

        far = _pairs(blocks, anchors.join(ranges, "b"), parts, "ranges").mapInArrow(second_pass, "xb long, row long, place int, score long, id long")
        rank = F.row_number().over(W.partitionBy("xb", "row", "place").orderBy(F.desc("score"), "id"))
        far = far.withColumn("rank", rank).where(F.col("rank") <= negatives).withColumnsRenamed({"score": "negative_score", "id": "negative_id"})
        out = near.withColumnsRenamed({"score": "positive_score", "id": "positive_id"}).join(far, ["xb", "row", "place"])
        return written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
