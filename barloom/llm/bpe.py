"""Byte-level BPE encoding and decoding with a rank queue (operator 7).

The merges of a batch run over one queue: a bucket for each merge rank holds the
positions of the pairs that merge to it, the symbols are a doubly linked list,
and a hierarchical bitmap over the ranks finds the lowest bucket in use. An entry
whose pair has changed since it was put in is stale and skipped. Pre-tokens are
independent, so the distinct pre-tokens of a batch share the queue. The entries of
the lowest bucket merge from left to right in one numpy step; of overlapping ones
(as in a run of one letter) every second. Only where a merge opens a pair of a
lower rank, on its left or with the symbol that then stands on its right, the
entries of that pre-token behind it wait until that pair has merged. So a long
pre-token takes as many steps as it has ranks in use, each as long as its bucket,
unless such pairs are frequent, which byte-pair vocabularies hardly have.

Cases: a null or empty text has no tokens and decodes to no bytes; rows with
equal ids are encoded one by one; other columns are not read; an empty table
gives an empty result.
"""

import base64
import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .textbytes import text_column

NONE = np.int32(2**31 - 1)
#: Distinct pre-tokens kept between batches; beyond that the store starts anew
#: (a reset costs only time)
KEPT = 300_000
#: Bytes of text encoded together.
CHUNK = 6 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankBitmap:
    """Which ranks have a bucket in use: words of 64 bits, and levels above that say which words are not zero."""

    def __init__(self, n: int):
        self.levels = []
        while True:
            n = (n + 63) // 64
            self.levels.append([0] * n)
            if n == 1:
                break

    def add(self, rank: int) -> None:
        for level in self.levels:
            level[rank >> 6] |= 1 << (rank & 63)
            rank >>= 6

    def discard(self, rank: int) -> None:
        for level in self.levels:
            level[rank >> 6] &= ~(1 << (rank & 63))
            if level[rank >> 6]:
                return
            rank >>= 6

    def first(self) -> int:
        """The lowest rank in use, or -1."""
        if not self.levels[-1][0]:
            return -1
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at << 6 | ((word & -word).bit_length() - 1)
        return at


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        key = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(key)
        self.bits = max(1, (4 * len(key)).bit_length())
        self._table(key[order], np.array(made, np.int32)[order])
        by_rank = sorted((rank, token) for token, rank in ranks.items())
        self.start, self.length = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        at = 0
        for rank, token in by_rank:
            self.start[rank], self.length[rank] = at, len(token)
            at += len(token)
        self.bytes = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)
        names = [b"%d " % i for i in range(self.size)]
        self.name_length = np.array([len(x) for x in names], np.int64)
        self.name_start = np.concatenate([[0], np.cumsum(self.name_length)[:-1]])
        self.names = np.frombuffer(b"".join(names), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _table(self, key: np.ndarray, made: np.ndarray) -> None:
        """An open hash table of the pairs that merge."""
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot, self.reach = self._slot(key), 1
        while len(key):
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            take = np.zeros(len(key), bool)
            take[first] = True
            take &= free
            self.keys[slot[take]], self.made[slot[take]] = key[take], made[take]
            key, made, slot = key[~take], made[~take], (slot[~take] + 1) & ((1 << self.bits) - 1)
            self.reach += 1

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, NONE if it doesn't."""
        key = a.astype(np.int64) * self.size + b
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.made[slot], NONE)
        look = np.flatnonzero((there != key) & (there != -1))
        mask = (1 << self.bits) - 1
        while len(look):
            slot[look] = (slot[look] + 1) & mask
            there = self.keys[slot[look]]
            hit = there == key[look]
            out[look[hit]] = self.made[slot[look[hit]]]
            look = look[~hit & (there != -1)]
        return out

    def _at_once(self, r: int, at: np.ndarray, token, piece, after, before) -> tuple[np.ndarray, np.ndarray]:
        """Of the sorted entries of rank r those that merge now, and those that wait behind a pair of lower rank."""
        n = len(at)
        chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
        head = np.maximum.accumulate(np.where(chained, 0, np.arange(n)))
        even = (np.arange(n) - head) % 2 == 0
        same = np.concatenate([[False], piece[at[1:]] == piece[at[:-1]]])
        if not same.any():
            return at, at[:0]
        take = at[even]
        gone = after[take]
        right, left = after[gone], before[take]
        # the symbol before is this rank too where the entry before it merges first
        joined = np.concatenate([[False], right[:-1] == take[1:]])
        a = np.where(joined, r, token[left])
        opens = np.minimum(np.where(left != 0, self.merged(np.where(left != 0, a, 0), np.full(len(take), r)), NONE), np.where(token[right] >= 0, self.merged(np.full(len(take), r), np.maximum(token[right], 0)), NONE)) < r
        if not opens.any():
            return take, at[:0]
        # entries behind the first such merge of their pre-token
        count = np.cumsum(opens) - opens
        own = np.searchsorted(piece[take], piece[take], "left")
        wait = count > count[own]
        stop = np.full(int(piece[take[-1]]) + 2, len(token), np.int64)
        np.minimum.at(stop, piece[take[wait]], take[wait])
        return take[~wait], at[at >= stop[piece[at]]]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and the offsets of each piece's."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        # symbols 1..n; 0 and n + 1 stand for no symbol
        token = np.concatenate([[-1], self.byte[raw], [-1]]).astype(np.int32)
        piece = np.concatenate([[-1], owner, [-2]]).astype(np.int32)
        after = np.minimum(np.arange(1, n + 3, dtype=np.int32), n + 1)
        before = np.maximum(np.arange(-1, n + 1, dtype=np.int32), 0)
        ends = piece[1:] != piece[:-1]
        after[:-1][ends] = n + 1
        before[1:][ends] = 0
        rank = np.full(n + 2, NONE, np.int32)
        at = np.flatnonzero(after[1 : n + 1] != n + 1) + 1
        rank[at] = self.merged(token[at], token[after[at]])
        at = at[rank[at] != NONE]
        buckets: dict[int, list] = defaultdict(list)
        used = RankBitmap(self.size)

        def put(positions: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            lows = ranks[np.concatenate([[0], cut])].tolist()
            edges = [0, *cut.tolist(), len(ranks)]
            for i, r in enumerate(lows):
                buckets[r].append(positions[edges[i] : edges[i + 1]])
                used.add(r)

        if len(at):
            put(at, rank[at])
        while (r := used.first()) >= 0:
            found = buckets.pop(r)
            used.discard(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at, later = self._at_once(r, at, token, piece, after, before)
                if len(later):
                    buckets[r].append(later)
                    used.add(r)
            gone = after[at]
            right, left = after[gone], before[at]
            token[at] = r
            token[gone] = -1
            rank[gone] = NONE
            after[at] = right
            before[right] = at
            before[n + 1] = 0
            new = np.where(right != n + 1, self.merged(token[at], token[right]), NONE)
            rank[at] = new
            new_left = np.where(left != 0, self.merged(token[left], token[at]), NONE)
            rank[left] = new_left
            rank[0] = NONE
            here, there = new != NONE, new_left != NONE
            if here.any() or there.any():
                put(np.concatenate([at[here], left[there]]), np.concatenate([new[here], new_left[there]]))
        alive = np.flatnonzero(token[1 : n + 1] >= 0) + 1
        counts = np.bincount(piece[alive], minlength=len(pieces)) if len(pieces) else np.zeros(0, np.int64)
        return token[alive], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, one span after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Codec:
    """Encodes texts; keeps the ids of pre-tokens it has met, up to KEPT of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.known = defaultdict()
        self.known.default_factory = self.known.__len__
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text's."""
        if len(self.known) > KEPT:
            self._forget()
        known, before = self.known, len(self.known)
        index = [np.fromiter(map(known.__getitem__, self.split(t)), np.int32) for t in texts]
        if len(known) > before:
            new = [s.encode() for s in list(known)[before:]]
            ids, at = self.vocabulary.encode_pieces(new)
            self.ids = np.concatenate([self.ids, ids])
            self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
        flat = np.concatenate(index) if index else np.zeros(0, np.int32)
        lengths = self.at[flat + 1] - self.at[flat]
        total = np.concatenate([[0], np.cumsum(lengths)])
        out = self.ids[gather(self.at[flat], lengths)]
        return out, total[np.concatenate([[0], np.cumsum([len(x) for x in index])]).astype(np.int64)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        v = self.vocabulary
        return v.bytes[gather(v.start[ids], v.length[ids])]

    def names(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        v = self.vocabulary
        return v.names[gather(v.name_start[ids], v.name_length[ids])][:-1].tobytes()


def _ranks_file(docs: DataFrame, path: str) -> str:
    """Sends the rank file (a fixed vocabulary) to the executors; its name there."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _chunks(column: pa.Array):
    """Row ranges of about CHUNK bytes."""
    sizes = np.cumsum(np.concatenate([[0], pc.binary_length(column).to_numpy(zero_copy_only=False)]))
    i, n = 0, len(column)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(sizes, sizes[i] + CHUNK, "right")) - 1))
        yield i, j
        i = j


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row of docs."""
    name = _ranks_file(docs, ranks_path)

    def run(batches):
        codec = Codec(read_ranks(SparkFiles.get(name)), pattern)
        for b in batches:
            texts = text_column(b.column(1))
            for i, j in _chunks(texts):
                ids, at = codec.encode(texts.slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) of each row of encoded."""
    name = _ranks_file(encoded, ranks_path)

    def run(batches):
        codec = Codec(read_ranks(SparkFiles.get(name)), r"$^")
        for b in batches:
            values = [codec.decode(np.asarray(x or [], np.int64)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.binary())], names=[id_col, "bytes"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, then decodes the ids: (id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    name = _ranks_file(docs, ranks_path)

    def run(batches):
        codec = Codec(read_ranks(SparkFiles.get(name)), pattern)
        for b in batches:
            texts = text_column(b.column(1))
            for i, j in _chunks(texts):
                ids, at = codec.encode(texts.slice(i, j - i).to_pylist())
                rows = [ids[at[k] : at[k + 1]] for k in range(j - i)]
                sha = [hashlib.sha256(codec.names(x)).hexdigest() for x in rows]
                back = [hashlib.sha256(codec.decode(x)).hexdigest() for x in rows]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(sha), pa.array(back)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
