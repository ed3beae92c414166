"""Repeated byte strings by distributed prefix doubling (operator 10).

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else
too. Positions get names for the text that follows them; Spark brings equal names
together at growing lengths; positions whose name is unique leave, and the rest
is named anew from pairs of names, until a position is unique or its text is past
the threshold.

Sorting every position of a corpus would move many times its size, so the first
rounds run on anchors. For the start p of each string of ``length`` bytes the
anchor is the position in the next ``w`` bytes whose following 16 bytes hash
lowest: it depends on the string's bytes alone, so equal strings have equal
anchors at equal distance, and the starts with one anchor are a range s..e.

* A range gets the pair of names of the two halves of the text that all its
  strings share (half of ``length`` at least). A unique pair means that no string
  of the range is repeated: it leaves.
* It also gets the name of its whole text, s to e + length, which is past the
  threshold: if that is repeated, all strings of the range are, and it is settled.
* What is left are ranges at the edges of repeated passages. They are cut at fixed
  distances from their anchors and named anew, twice: into eighths, then into
  single strings, whose name is that of their ``length`` bytes. A settled range
  can hold the other copy of a string at an edge, so of each distinct one that
  shares its pair with an edge, one occurrence is named again too.

``digest`` asks at two lengths, again by doubling: first the repeated strings of
``passage`` bytes, then those of ``length`` bytes, which can only start where
every start of the first kind up to the second's end is repeated.

Names are counted with partial sums before each shuffle. Names that hold more
than a ``HOT``-th of all rows (fewer than ``HOT``, so they may be broadcast) are
dealt to ``SALTS`` tasks each when the counts are joined back.

Cases: a null or empty text has no bytes and nothing to remove; texts shorter
than ``length`` stay whole; a null id is kept; rows with equal ids (or none) are told
apart by the length and a 64-bit hash of their text, and equal rows are repeats of
each other: each copy counts, and the spans of all of them are held once; other
columns are not read; an empty table gives an empty result.
"""

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import gather
from .tables import Scratch, written
from .textbytes import mix, slabs, span_hash, sums, text_column

GRAM = 16
HOT, SALTS = 1000, 64


def width(length: int) -> int:
    """Bytes in which an anchor is chosen: at most 96 and half of length."""
    if length < 32:
        raise ValueError("length has to be 32 bytes at least")
    return min(96, length // 2)


def _anchors(data: np.ndarray, w: int) -> np.ndarray:
    """For each p the first position of p..p+w-1 whose next GRAM bytes hash lowest (as far as they go)."""
    n = len(data) - GRAM + 1
    if n < w:
        return np.zeros(0, np.int64)
    raw = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=raw, strides=(1,))
    h = mix(eight[:n] * np.uint64(0x9E3779B97F4A7C15) + eight[8 : n + 8])
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    size = 1
    while size < w:
        step = min(size, w - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def ranges(data: np.ndarray, at: np.ndarray, length: int, p: np.ndarray | None = None):
    """Ranges of starts with one anchor: text, first start, last start, anchor (positions in data). p: the starts asked for, if not all."""
    w = width(length)
    if p is None:
        p = gather(at[:-1], np.maximum(np.diff(at) - length + 1, 0))
    if not len(p):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    text = np.searchsorted(at, p, "right") - 1
    a = _anchors(data, w)[p]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1]) | (p[1:] != p[:-1] + 1)]))
    last = np.concatenate([first[1:] - 1, [len(p) - 1]])
    return text[first], p[first], p[last], a[first]


def _positions(docs: DataFrame, length: int, cell: int, less: int | None = None) -> DataFrame:
    """(id, row, size, s, e, pair, whole) of each range of docs (id, row, size, t), of starts at most cell bytes apart.

    less: docs has spans of starts, and of each run of them all but the last
    `less` are asked for; otherwise every start is.
    """
    half = (length - cell + 1) // 2
    top = np.uint64(0xFFFFFFFF00000000)

    def run(batches):
        for b in batches:
            texts = text_column(b.column(3))
            for i, j, data, at in slabs(texts):
                p = None
                if less is not None:
                    low, high = covered(*_places(b.column(4), i, j, at))
                    p = gather(low, np.maximum(high - low - less, 0))
                text, s, e, a = ranges(data, at, length, p)
                n = (a - s) // cell - (a - e) // cell + 1
                part = np.repeat(np.arange(len(n)), n)
                text, a, c = text[part], a[part], gather((a - e) // cell, n)
                first, last = a - (c + 1) * cell + 1, a - c * cell
                s, e = np.maximum(s[part], first), np.minimum(e[part], last)
                whole = span_hash(data, s, e + length)
                pair = whole if cell == 1 else (span_hash(data, last, last + half) & top) | (span_hash(data, last + half, first + length) >> np.uint64(32))
                ids = pa.array(text + i)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(ids) for k in range(3)), pa.array((s - at[text]).astype(np.int32)), pa.array((e - at[text]).astype(np.int32)), pa.array(pair.view(np.int64)), pa.array(whole.view(np.int64))], names=["id", "row", "size", "s", "e", "pair", "whole"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, row long, size int, s int, e int, pair long, whole long")


def _places(spans: pa.Array, i: int, j: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the spans of texts i..j-1 as positions in their slab."""
    edge = spans.offsets.to_numpy()
    low, high = edge[i], edge[j]
    s, e = (spans.values.field(k).to_numpy(zero_copy_only=False)[low:high].astype(np.int64) for k in range(2))
    shift = np.repeat(at[: j - i], np.diff(edge[i : j + 1]))
    return s + shift, e + shift + 1


#: What names a row: its id, and of its text a hash and the bytes.
KEY = ("id", "row", "size")


def _spans_of(df: DataFrame) -> DataFrame:
    # the copies of a row have the same spans: each is held once, so an array is bounded by one text
    return df.groupBy(*KEY).agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _with_text(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    # at every size the texts are dealt by their key and not joined to a broadcast table, which grows; spans, the smaller side of a partition, is hashed, so texts are not sorted
    spans = spans.withColumnsRenamed({k: f"_{k}" for k in KEY}).hint("shuffle_hash")
    return docs.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")) & (F.col("size") == F.col("_size")), how).drop(*(f"_{k}" for k in KEY))


def _matching(rows: DataFrame, counted: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows whose keys are in counted (keys, n), or (left) all, with `there` where they are; keys with many rows are dealt to SALTS tasks."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counted.where(F.col("n") * HOT > total).select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    there = [F.lit(True).alias("there")] if how == "left" else []
    right = counted.select(*keys).join(hot, keys, "left").select(*keys, F.explode(each).alias("_salt"), *there)
    return left.join(right.hint("shuffle_hash"), [*keys, "_salt"], how).drop("_salt")


def repeated(docs: DataFrame, length: int, keep: Scratch, less: int | None = None) -> DataFrame:
    """(id, row, size, spans) of the texts of docs (id, row, size, t) that hold a repeated string: the starts s..e of such strings.

    less: see _positions; docs then has spans too.
    """
    w, found, text = width(length), [], docs
    place = (*KEY, "s", "e")
    for cell in dict.fromkeys((w, w // 8, 1)):
        named = _positions(text, length, cell, less)
        named = named.select(*place, "pair") if cell == 1 else named
        # the names of all starts are made twice rather than kept: they are larger than the texts' own share of the disk
        named = named if less is None else keep(named)
        twice = keep(named.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1"))
        alive = _matching(named, twice, ["pair"], "left_semi")
        if cell == 1:
            found.append(alive.select(*place))
            break
        alive = keep(alive)
        settled = keep(alive.groupBy("pair", "whole").agg(F.count("*").alias("n")).where("n > 1"))
        marked = keep(_matching(alive, settled, ["pair", "whole"], "left"))
        past, edges = marked.where("there"), marked.where("there is null")
        found.append(past.select(*place))
        still_open = keep(twice.join(edges.select("pair").distinct().hint("shuffle_hash"), "pair", "left_semi"))
        keep.drop(named, twice, alive, settled)
        other = _matching(past, still_open, ["pair"], "left_semi").groupBy("pair", "whole").agg(F.min(F.struct(*place)).alias("x")).select("x.*")
        ask = _spans_of(edges.select(*place).unionByName(other))
        text, less = keep(_with_text(docs.select(*KEY, "t"), ask, "inner").select(*KEY, "t", "spans")), 0
        docs = text
    return keep(_spans_of(reduce(DataFrame.unionByName, found)))


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes that the spans [start, end) cover together."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([new[1:], [True]])]


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _row_of(text_col: str) -> list:
    """Tells rows with one id apart by their text: (row, size)."""
    return [_text_hash(text_col).alias("row"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("size")]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), *_row_of(text_col), F.col(text_col).alias("t"))


def _runs(spans: pa.Array, i: int, j: int, at: np.ndarray, length: int):
    """Runs of bytes that the spans of texts i..j-1 cover, as positions in their slab, and the first run of each text."""
    apart = at + np.arange(len(at))  # texts one byte apart, so that runs of two texts never touch
    low, high = _places(spans, i, j, apart)
    low, high = covered(low, high + length - 1)
    text = np.searchsorted(apart, low, "right") - 1
    return low - text, high - text, np.searchsorted(low, apart)


def _each(texts: pa.Array, spans: pa.Array, length: int):
    """Of each row the bytes, what is left of them and the number of runs removed."""
    for i, j, data, at in slabs(texts):
        raw = data.tobytes()
        low, high, first = _runs(spans, i, j, at, length)
        low, high = low.tolist(), high.tolist()
        for k in range(j - i):
            keep, last = [], int(at[k])
            for x in range(first[k], first[k + 1]):
                keep.append(raw[last : low[x]])
                last = high[x]
            keep.append(raw[last : at[k + 1]])
            yield int(at[k + 1] - at[k]), b"".join(keep), int(first[k + 1] - first[k])


def digest(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", passage: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes, n_passages) of each row of docs.

    The last two are the bytes in repeated strings of `passage` bytes (200, or length
    where that is less) and their runs: passages that are shorter than `length`,
    which stay in the text.
    """
    passage = passage or min(200, length)
    if not 32 <= passage <= length:
        raise ValueError("passage has to be between 32 bytes and length")
    rows = _rows(docs, id_col, text_col)
    with Scratch(docs.sparkSession) as keep:
        short = repeated(rows, passage, keep)
        starts = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"] + 1)
        inside = keep(_with_text(rows, short.where(starts > length - passage), "inner").select(*KEY, "t", "spans"))
        far = repeated(inside, length, keep, length - passage)
        none = F.lit(None).cast(short.schema["spans"].dataType)
        both = short.select(*KEY, none.alias("spans"), F.col("spans").alias("passages")).unionByName(far.select(*KEY, "spans", none.alias("passages")))
        found = written(both.groupBy(*KEY).agg(F.first("spans", True).alias("spans"), F.first("passages", True).alias("passages")))

    def run(batches):
        for b in batches:
            texts = text_column(b.column(1))
            out = list(_each(texts, b.column(2), length))
            covers, counts = [], []
            for i, j, _, at in slabs(texts):
                low, high, first = _runs(b.column(3), i, j, at, passage)
                covers.append(sums(high - low, first))
                counts.append(np.diff(first))
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _, _ in out], pa.int64()), pa.array([n - len(t) for n, t, _ in out], pa.int64()), pa.array([k for _, _, k in out], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for _, t, _ in out], pa.string()), cat(covers), cat(counts)], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages"])

    joined = _with_text(rows, found, "left").select("id", "t", "spans", "passages")
    return joined.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, n_passages long")


def remove(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes taken out of the text, all other columns as they were.

    Bytes of a character that was cut in two go with it. A null text stays null.
    Column names may be any: the joined ones are told apart by their place.
    """
    rows = _rows(docs, id_col, text_col)
    with Scratch(docs.sparkSession) as keep:
        found = written(repeated(rows, length, keep))
    place, n = docs.columns.index(text_col), len(docs.columns)
    # own names for all columns, so that none of the table's can clash
    names = [f"c{k}" for k in range(n)]
    plain = docs.toDF(*names)
    key = names[docs.columns.index(id_col)]
    found = found.select(F.col("id").alias("found_id"), F.col("row").alias("found_row"), F.col("size").alias("found_size"), F.col("spans").alias("found_spans"))
    row, size = _row_of(names[place])
    same = F.col(key).eqNullSafe(F.col("found_id")) & (row == F.col("found_row")) & (size == F.col("found_size"))
    joined = plain.join(found.hint("shuffle_hash"), same, "left").select(*names, "found_spans")
    schema = docs.schema

    def run(batches):
        for b in batches:
            column = b.column(place)
            out = [t.decode("utf-8", "ignore") for _, t, _ in _each(text_column(column), b.column(n), length)]
            cut = pa.array([None if gone else t for gone, t in zip(column.is_null().to_pylist(), out)], pa.string())
            columns = list(b.columns)[:n]
            columns[place] = cut
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)
