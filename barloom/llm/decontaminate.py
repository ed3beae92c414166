"""Benchmark decontamination by greedy string tiling (operator 1).

Texts are token sequences (lower-cased, cut at ASCII white space and
punctuation). Seeds, the runs of ``MIN_TILE`` tokens that a document shares with
a benchmark item, pick the pairs to look at. Of each pair the longest common run
that no tile has used yet is marked, again and again, until none of ``MIN_TILE``
tokens is left; each search is a Karp-Rabin pass over the unmarked tokens. Tiles
may lie in any order, so a passage with its sentences moved is covered too. An
item has leaked into a document if its tiles cover ``threshold`` of its tokens.

The benchmark goes to the tasks in blocks of ``BLOCK_BYTES`` of text at most, one
pass over the documents and one block in memory at a time; its size is counted
first.

Cases: null or empty texts, and those without tokens, match nothing, on either
side; an item shorter than ``MIN_TILE`` tokens has to occur whole; a null
document id is reported as null; rows with equal ids are judged one by one and
reported once for each; a null item id is one item; other columns are not read;
an empty table on either side gives an empty result.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tables import written
from .textbytes import LOWER, WHITE, run_hash, running, shingles, slabs, span_hash, text_column, words

MIN_TILE, THRESHOLD = 5, 0.6
BLOCK_BYTES = 8 << 20
_SIEVE = np.uint64((1 << 20) - 1)
_TOKEN = LOWER.copy()
_TOKEN[WHITE] = 32
_TOKEN[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = 32


def token_hashes(column):
    """Yields (first row, row after the last, token hashes, offsets of each text's)."""
    for i, j, data, at in slabs(column):
        clean = _TOKEN[data]
        starts, ends, first = words(clean, at)
        yield i, j, span_hash(clean, starts, ends), first


def _runs(free: np.ndarray) -> np.ndarray:
    """For each position the unmarked tokens from it on without a break."""
    n = len(free)
    stop = np.where(free, n, np.arange(n))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


def tiles(item: np.ndarray, text: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy tiling of two token sequences: (place in item, place in text, length) of each tile, longest first.

    Each round finds the longest common unmarked run and marks all of its length,
    in the order of the item and then of the text. Lengths fall from round to
    round and tiles do not overlap, so rounds grow with the root of the item.
    """
    free_a, free_b = np.ones(len(item), bool), np.ones(len(text), bool)
    sum_a, sum_b = running(item), running(text)
    a, b, out = np.arange(len(item)), np.arange(len(text)), []
    while True:
        room_a, room_b = _runs(free_a), _runs(free_b)

        def common(size, a, b):
            a, b = a[room_a[a] >= size], b[room_b[b] >= size]
            x, y = run_hash(sum_a, a, a + size), run_hash(sum_b, b, b + size)
            in_a, in_b = np.isin(x, y), np.isin(y, x)
            return a[in_a], b[in_b], x[in_a], y[in_b]

        found = common(least, a, b)
        if not len(found[0]):
            return out
        # a place that starts no common run of some length never starts one again, as marks only grow
        a, b = found[:2]
        size, most = least, int(min(room_a[a].max(), room_b[b].max()))
        look = most
        while size < most:
            got = common(look, *found[:2])
            if len(got[0]):
                size, found = look, got
            else:
                most = look - 1
            look = (size + most + 1) // 2
        marked = _mark(item, text, free_a, free_b, size, *found)
        if not marked:  # hashes collided
            return out
        out += marked


def _mark(item, text, free_a, free_b, size, a, b, x, y) -> list:
    """Marks runs of one size at places a and b with hashes x and y.

    All runs are of one size and were free before, so a run is free if both its ends
    are; a place in the text that is taken stays so, so each list is read once.
    """
    places, out = {}, []
    for place, value in zip(b[::-1].tolist(), y[::-1].tolist()):
        places.setdefault(value, []).append(place)
    for i, value in zip(a.tolist(), x.tolist()):
        left = places[value]
        if not (free_a[i] and free_a[i + size - 1]):
            continue
        while left:
            j = left.pop()
            if free_b[j] and free_b[j + size - 1] and (item[i : i + size] == text[j : j + size]).all():
                free_a[i : i + size] = free_b[j : j + size] = False
                out.append((i, j, size))
                break
    return out


class Items:
    """A block of the benchmark: token hashes of each item and, for each seed length, the sorted seeds with their items and places."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.tokens, self.index, by_size = ids, [], {}, {}
        for _, _, h, at in token_hashes(pa.array(texts, pa.string())):
            self.tokens += [h[at[k] : at[k + 1]] for k in range(len(at) - 1)]
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        for k, t in enumerate(self.tokens):
            if len(t):
                by_size.setdefault(min(MIN_TILE, len(t)), []).append(k)
        self.sieve = np.zeros(1 << 20, bool)
        for m, own in by_size.items():
            parts = [shingles(self.tokens[k], np.array([0, len(self.tokens[k])]), m)[0] for k in own]
            sizes = [len(x) for x in parts]
            seeds, owner, place = np.concatenate(parts), np.repeat(own, sizes), np.concatenate([np.arange(n) for n in sizes])
            self.sieve[(seeds & _SIEVE).astype(np.int64)] = True
            order = np.argsort(seeds, kind="stable")
            self.index[m] = seeds[order], owner[order], place[order]

    def leaks(self, h: np.ndarray, at: np.ndarray, threshold: float):
        """Yields (text, item, tiled tokens, item tokens, tiles, longest tile) of the leaks into texts.

        A seed counts once for each text, so a text opens each entry of the index at
        most once, however often seeds repeat in it or are shared by items.
        """
        for m, (seeds, owner, place) in self.index.items():
            s, where = shingles(h, at, m)
            look = np.flatnonzero(self.sieve[(s & _SIEVE).astype(np.int64)])
            low, high = np.searchsorted(seeds, s[look], "left"), np.searchsorted(seeds, s[look], "right")
            ok = high > low
            look, low, high = look[ok], low[ok], high[ok]
            for text, own in _by_text(np.searchsorted(where, look, "right") - 1):
                seed, first = np.unique(low[own], return_index=True)
                n = high[own][first] - seed
                entry = np.arange(int(n.sum())) + np.repeat(seed - (np.cumsum(n) - n), n)
                entry = entry[np.lexsort((place[entry], owner[entry]))]
                items, begin = np.unique(owner[entry], return_index=True)
                step = np.minimum(np.diff(place[entry], append=0), m)
                step[np.append(begin[1:], len(entry)) - 1] = m
                # tiles are made of seeds: what seeds do not cover no tile can
                for item in items[np.add.reduceat(step, begin) >= threshold * self.size[items]].tolist():
                    got = self._tiled(item, m, threshold, h[at[text] : at[text + 1]], s[look[own]], look[own] - where[text])
                    if got:
                        yield text, item, sum(t[2] for t in got), int(self.size[item]), len(got), got[0][2]

    def _tiled(self, item: int, m: int, threshold: float, body: np.ndarray, seeds: np.ndarray, place: np.ndarray) -> list:
        """Tiles of an item in a text that has these seeds at these places; empty if they cover too little."""
        own = self.tokens[item]
        mine = shingles(own, np.array([0, len(own)]), m)[0]
        near = np.unique((place[np.isin(seeds, mine)][:, None] + np.arange(m)).ravel())
        gap = np.flatnonzero(np.diff(near) > 1) + 1
        got = tiles(own, np.insert(body[near], gap, np.uint64(0)) if len(gap) else body[near], m)
        return got if sum(t[2] for t in got) >= threshold * len(own) else []


def _by_text(text: np.ndarray):
    """Yields each value of a sorted array and the slice that holds it."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1, [len(text)]]) if len(text) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(text[a]), slice(a, b)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The number of blocks of BLOCK_BYTES at most (one item longer than that is a block of its own), and a function that reads one."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("t")).where("t is not null and t != ''")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = -(-2 * total // BLOCK_BYTES)

    def block(k: int) -> Items:
        rows = items.where(F.pmod(F.xxhash64("t", "item"), F.lit(n)) == k).orderBy("item", "t").collect()
        return Items([r["item"] for r in rows], [r["t"] for r in rows])

    return n, block


def _each_block(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, step):
    """Yields step(broadcast block) for each block. With several blocks each result is written before the next
    block is read, so the driver and the executors hold one block at a time."""
    n, block = _blocks(benchmark, id_col, text_col)
    for k in range(n):
        sent = docs.sparkSession.sparkContext.broadcast(block(k))
        if n == 1:
            yield step(sent)
        else:
            yield written(step(sent))
            sent.destroy()


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, coverage, n_tiles, longest_tile) of each benchmark item found in a row of docs."""
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, `{item_col}` {item_kind.simpleString()}, coverage double, n_tiles int, longest_tile int"
    item_type = to_arrow_type(item_kind)

    def step(sent):
        def run(batches):
            items = sent.value
            for b in batches:
                rows, found = [], []
                for i, _, h, at in token_hashes(text_column(b.column(1))):
                    for text, item, tiled, size, n, longest in items.leaks(h, at, threshold):
                        rows.append(i + text)
                        found.append((items.ids[item], tiled / size, n, longest))
                if rows:
                    item, coverage, n, longest = zip(*found)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(item, item_type), pa.array(coverage), pa.array(n, pa.int32()), pa.array(longest, pa.int32())], names=[id_col, item_col, "coverage", "n_tiles", "longest_tile"])

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    parts = list(_each_block(docs, benchmark, item_col, item_text_col, step))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item, all columns as they were."""
    place = docs.columns.index(text_col)
    left = [docs]

    def step(sent):
        def run(batches):
            items = sent.value
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for i, _, h, at in token_hashes(text_column(b.column(place))):
                    for text, *_ in items.leaks(h, at, threshold):
                        keep[i + text] = False
                yield b.filter(pa.array(keep))

        return left[0].mapInArrow(run, docs.schema)

    for rows in _each_block(docs, benchmark, item_col, item_text_col, step):
        left[0] = rows
    return left[0]
