"""Near-duplicate groups by SuperMinHash, banding, verification and union-find (operator 8).

1. A document is the set of its distinct word shingles. Its SuperMinHash
   signature gives every element one permutation of the slots and the ranks 0,
   1, ... along it, so the ranks of one element in different slots are
   correlated and the variance is lower than with independent hashes; once every
   slot has a value below rank j no element can lower it at rank j, and the rest
   is skipped.
2. Rows with equal sets are one node, whatever their ids. Nodes that agree in
   one band of ``ROWS`` slots share a bucket; there are as many bands as it takes
   for a pair at the threshold to miss every one with probability below ``MISS``,
   and buckets that share nodes share a cluster.
3. In a cluster all nodes are verified against each other on their full sets.
   A large cluster is cut into blocks and every two blocks meet in one task, so
   no task holds more than two blocks; a task returns only the links of a
   spanning forest of what it has found.
4. Components of the links, by stars.

Cases: a null or empty text, or one without words, has no shingles and is linked
with nothing; a row is its id and its text, so rows that share an id or have none
are linked by their texts alone; other columns are not read; an empty table gives
an empty result.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import UnionFind, components
from .tables import written
from .textbytes import GOLD, LOWER, distinct, mix, shingles, slabs, span_hash, text_column, words

ROWS, MISS = 6, 1e-6
#: Of a block of a cluster: documents, and shingles together.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
EMPTY = np.uint64(2**64 - 1)


def shingle_sets(column, k: int):
    """Yields (first row, row after the last, sorted distinct shingle hashes, offsets of each text's) of an Arrow column."""
    for i, j, data, at in slabs(column):
        low = LOWER[data]
        starts, ends, first = words(low, at)
        yield i, j, *distinct(*shingles(span_hash(low, starts, ends), first, k))


def band_count(percent: int) -> int:
    """Bands for a threshold: 30 at 85 percent, 46 at 80."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 1


def signatures(sets: np.ndarray, at: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of each set: `slots` values, the rank in the upper half and the random number in the lower."""
    n = len(at) - 1
    out = np.full(n * slots, EMPTY, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(at))
    element, row, order = sets, None, None
    for j in range(slots):
        r = mix(element + np.uint64((j + 1) * int(GOLD) & (2**64 - 1)))
        k = j + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot = k
        else:
            slot = order[row, k].astype(np.int64)
            order[row, k] = order[row, j]
        np.minimum.at(out, doc * slots + slot, np.uint64(j) << np.uint64(32) | r >> np.uint64(32))
        going = (out.reshape(n, slots).max(1) >= np.uint64(j + 1) << np.uint64(32)) & (np.diff(at) > 0)
        take = going[doc]
        if not take.any():
            break
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint16), (int(take.sum()), 1))
            row = np.arange(len(order))
            order[row, k[take]] = 0
        elif not take.all():
            row = row[take]
        element, doc = element[take], doc[take]
    return out.reshape(n, slots)


def bands(signature: np.ndarray) -> np.ndarray:
    """Keys of each signature, each of its own range of ROWS slots."""
    n = signature.shape[1] // ROWS
    parts, key = signature.reshape(-1, n, ROWS), np.arange(n, dtype=np.uint64) * GOLD
    for i in range(ROWS):
        key = mix(key + parts[:, :, i])
    return key.view(np.int64)


#: What names a row: whether its id is null, the id and a hash of the text; smaller ids come first, rows without one last.
ROW = ("no_id", "row_id", "row_text")


def _row(docs: DataFrame, id_col: str, text_col: str) -> list:
    i = F.col(id_col)
    return [c.alias(n) for c, n in zip((i.isNull(), F.coalesce(i, F.lit(0).cast(docs.schema[id_col].dataType)), F.xxhash64(text_col)), ROW)]


def sketch(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_text, n_shingles, set_a, set_b, bands) of each row; set_a and set_b name the set."""
    n_bands = band_count(percent)

    def run(batches):
        for b in batches:
            ids, texts, marks = b.column(0), text_column(b.column(1)), b.column(2)
            for i, j, sets, at in shingle_sets(texts, k):
                size = np.diff(at)
                total = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum([mix(sets), mix(sets ^ GOLD)], axis=1, dtype=np.uint64)], axis=1)
                a, c = (total[:, at[1:]] - total[:, at[:-1]]).view(np.int64)
                key = bands(signatures(sets, at, n_bands * ROWS))
                full = np.flatnonzero(size > 0)
                edges = np.concatenate([[0], np.cumsum((size > 0) * n_bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), marks.slice(i, j - i), pa.array(size), pa.array(a), pa.array(c), pa.ListArray.from_arrays(pa.array(edges), pa.array(key[full].ravel()))], names=["id", "row_text", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, row_text long, n_shingles long, set_a long, set_b long, bands array<long>")


def verify(sets: list, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs with 100 * intersection >= percent * union.

    side: 0 or 1 of each set where only pairs across are asked for.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    doc = np.repeat(np.arange(n), size)
    value, index, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[index]
    doc, column = doc[use], place[index[use]]
    common, step = np.zeros((n, n), np.float32), 4096
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [low, low + step])
        grid = np.zeros((n, min(step, int(shared.sum()) - low)), np.float32)
        grid[doc[a:b], column[a:b] - low] = 1
        common += grid @ grid.T
    both = common.astype(np.int64)
    linked = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    forest = UnionFind()
    return [(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(linked))) if forest.join(i, j)]


def _verified(frames, k: int, percent: int):
    """Links of each group of equal (cluster, lo, hi); groups come one after the other and may span frames."""

    def links(group: pd.DataFrame) -> pd.DataFrame:
        ids, sets = group["node"].to_numpy(), []
        for _, _, s, at in shingle_sets(pa.array(group["t"], pa.string()), k):
            sets += [s[at[i] : at[i + 1]] for i in range(len(at) - 1)]
        lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
        found = verify(sets, None if lo == hi else (group["block"].to_numpy() == hi).astype(int), percent)
        return pd.DataFrame({"a": [ids[i] for i, _ in found], "b": [ids[j] for _, j in found]})

    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        key = frame[["cluster", "lo", "hi"]].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        edges = [0, *cuts.tolist()]
        out = [links(frame.iloc[a:b]) for a, b in zip(edges, edges[1:])]
        rest = frame.iloc[edges[-1] :]
        if out:
            yield pd.concat(out, ignore_index=True).astype({"a": "int64", "b": "int64"})
    if rest is not None and len(rest):
        yield links(rest).astype({"a": "int64", "b": "int64"})


def _found(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and (node, n_shingles, set_a, set_b, first, component, lowest) of each set: its first row, and of the sets linked with it the name and the first row."""
    sketched = written(sketch(docs, k, percent, id_col, text_col))
    none = F.col("id").isNull()
    row = F.struct(none.alias("no_id"), F.coalesce("id", F.lit(0).cast(sketched.schema["id"].dataType)).alias("row_id"), "row_text")
    sets = sketched.where("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min(row).alias("first"), F.first("bands").alias("bands"))
    # the numbers hold because the table is written once
    nodes = written(sets.withColumn("node", F.monotonically_increasing_id()))
    member = nodes.select("node", F.explode("bands").alias("band"))
    centre = member.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("band", "b")
    shared = member.join(centre, "band").select(F.col("node").alias("a"), "b")
    cluster = components(shared)
    part = written(cluster.join(nodes.select("node", "n_shingles", "first.*"), "node"))
    count = part.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    part = part.join(count, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    part = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = part.select(*ROW, "node", F.col("component").alias("cluster"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")
    # rows that repeat both id and text give their text once
    text = docs.select(*_row(docs, id_col, text_col), F.col(text_col).alias("t")).groupBy(*ROW).agg(F.first("t").alias("t"))
    # at every size the texts are dealt by their row and not joined to a broadcast table, which grows
    meet = text.join(part.hint("merge"), list(ROW)).select("cluster", "lo", "hi", "block", "node", "t")
    meet = meet.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    links = written(meet.mapInPandas(lambda it: _verified(it, k, percent), "a long, b long"))
    linked = written(components(links).join(nodes.select("node", "first"), "node"))
    lowest = linked.groupBy("component").agg(F.min("first").alias("lowest"))
    linked = linked.select("node", "component").join(lowest, "component")
    named = nodes.drop("bands").join(linked, "node", "left")
    return sketched, named.withColumn("component", F.coalesce("component", "node")).withColumn("lowest", F.coalesce("lowest", "first"))


def groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row: linked are texts with 100 * intersection >= percent * union of their k-word shingles.

    component_id is the smallest id of the group, null where no row of it has one.
    kept are the rows with that id, several where it is repeated: these rows cannot
    be told apart here, and keep_one takes one of them.
    """
    sketched, named = _found(docs, k, percent, id_col, text_col)
    named = named.select("n_shingles", "set_a", "set_b", F.when(~F.col("lowest.no_id"), F.col("lowest.row_id")).alias("root"))
    out = sketched.select("id", "n_shingles", "set_a", "set_b").join(named, ["n_shingles", "set_a", "set_b"], "left")
    root = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", root.alias("component_id"), F.col("id").eqNullSafe(root).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, all columns as they were: of its smallest id, or of none where no row has one; rows without shingles stay.

    Of rows that repeat both id and text the first by the other columns stays.
    """
    sketched, named = _found(docs, k, percent, id_col, text_col)
    one = named.groupBy("component").agg(F.min("first").alias("row")).select("row.*", F.lit(True).alias("one"))
    every = sketched.where("n_shingles = 0").select(*_row(sketched, "id", "id")[:2], "row_text").distinct().withColumn("one", F.lit(False))
    stay = one.unionByName(every).select(*ROW, "one")
    # own names for all columns, so that none of the table's can clash
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = plain.select("*", *_row(plain, key, text))
    others = [n for n, f in zip(names, docs.schema.fields) if n not in (key, text) and f.dataType.typeName() not in ("map", "variant")]
    place = F.row_number().over(W.partitionBy(*ROW).orderBy(*(others or ROW[:1])))
    out = rows.join(stay.hint("merge"), list(ROW)).withColumn("place", place).where("not one or place = 1")
    return out.select(*names).toDF(*docs.columns)
