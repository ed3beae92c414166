"""Run hashes on texts made by substitution, and rows of equal ids, hashes and texts in substring dedup."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import decontaminate, licenses, near_dedup, substring_dedup
from barloom.llm.textbytes import run_hash, running, span_hash


def thue_morse(n, a="a", b="b"):
    """A string and its complement, equal under polynomial hashes modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize("n", [512, 1024, 2048, 65536])
@pytest.mark.parametrize("pair", [("a", "b"), ("kxxq", "kyyq")])
def test_substituted_texts_have_hashes_of_their_own(n, pair):
    x, y = (np.frombuffer(t.encode(), np.uint8) for t in thue_morse(n, *pair))
    both = np.concatenate([x, y])
    h = span_hash(both, np.array([0, len(x)]), np.array([len(x), 2 * len(x)]))
    assert h[0] != h[1]
    words = np.array([0x123456789ABCDEF, 0xFEDCBA987654321], np.uint64)
    bits = np.array([bin(i).count("1") & 1 for i in range(n)])
    total = running(np.concatenate([words[bits], words[1 - bits]]))
    h = run_hash(total, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]


def test_run_hashes_do_not_depend_on_the_place():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    twice = np.concatenate([data, rng.integers(0, 256, 77, dtype=np.uint8), data])
    s = rng.integers(0, 4000, 300)
    e = s + rng.integers(0, 1000, 300)
    assert (span_hash(twice, s, e) == span_hash(twice, s + 5077, e + 5077)).all()
    assert len(set(span_hash(data, np.zeros(5001, int), np.arange(5001)).tolist())) == 5001


def test_substituted_words_are_not_linked(spark):
    docs = spark.createDataFrame([(i, t) for n in (1024, 2048) for i, t in enumerate(thue_morse(n), n)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup.groups(docs, 3, 85).collect()} == {(i, i, True) for i in (1024, 1025, 2048, 2049)}
    bench = spark.createDataFrame([(1, thue_morse(1024)[0])], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs, bench).collect()} == {1024}
    for column in (decontaminate.token_hashes, licenses.token_hashes if hasattr(licenses, "token_hashes") else decontaminate.token_hashes):
        import pyarrow as pa

        h = np.concatenate([x[2] for x in column(pa.array([*thue_morse(1024), *thue_morse(2048)]))])
        assert len(set(h.tolist())) == 4


def brute(rows, length):
    times = collections.Counter(t[p : p + length] for _, t in rows for t in [(t or "").encode()] for p in range(len(t) - length + 1))

    def one(text):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if times[b[p : p + length]] > 1:
                gone[p : p + length] = True
        return len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()

    known = {t: one(t) for t in {t for _, t in rows}}
    return collections.Counter((i, *known[t]) for i, t in rows)


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "an", "ou", "é", "st", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_rows_without_id_and_equal_hashes(spark, monkeypatch):
    rng = random.Random(5)
    first, other = prose(rng, 400), prose(rng, 500)
    rows = [(None, first), (None, other), (7, first[:700] + prose(rng, 100)), (None, prose(rng, 30)), (7, prose(rng, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 400)
    assert collections.Counter(tuple(r)[:5] for r in substring_dedup.digest(docs, 400).collect()) == want
    # every text has the same hash now: the lengths tell these rows apart
    monkeypatch.setattr(substring_dedup, "_text_hash", lambda c: F.lit(0).cast("long"))
    assert collections.Counter(tuple(r)[:5] for r in substring_dedup.digest(docs, 400).collect()) == want


@pytest.mark.parametrize("ids", ["null", "shared"])
def test_twenty_thousand_equal_rows(spark, ids):
    rng = random.Random(6)
    text, rare = prose(rng, 60), prose(rng, 300)
    key = {"null": F.lit(None).cast("long"), "shared": F.lit(5).cast("long")}[ids]
    same = spark.range(20_000).select(key.alias("doc_id"), F.lit(text * 2).alias("text"))
    few = [(-1, rare), (-2, rare[50:] + text[:300])]
    docs = same.unionByName(spark.createDataFrame(few, "doc_id long, text string")).repartition(4)
    got = substring_dedup.digest(docs, 200).groupBy("n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()
    want = brute([(None, text * 2), (None, text * 2), *few], 200)
    assert collections.Counter({tuple(r)[:4]: r["count"] for r in got}) == collections.Counter({k[1:]: 20_000 if k[0] is None else n for k, n in want.items()})
