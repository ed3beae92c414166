"""Operators against plain Python that goes the whole way: tiles, ring, posterior, policies, window scores, the whole pipeline; held-out accuracy and recall."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
import tempfile

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from barloom.llm import bpe, decontaminate, language, licenses, near_dedup, quality_model, quality_rules, queries, sharding, toxicity

from .test_operators import RANKS, prose, words

SF = "/root/testdata/sf0.01"


def tokens(t):
    return [w for w in re.split(r"[\x20\x09-\x0D!-/:-@\[-`{-~]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]


def plain_tiles(a, b, least):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    starts = collections.defaultdict(list)
    for j in range(len(b) - least + 1):
        starts[tuple(b[j : j + least])].append(j)
    while True:
        best, at = least, []
        for i in range(len(a) - least + 1):
            for j in starts.get(tuple(a[i : i + least]), ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, at = n, [(i, j)]
                elif n == best:
                    at.append((i, j))
        if not at:
            return out
        for i, j in at:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                out.append((i, j, best))


def plain_leaks(text, items):
    body = tokens(text)
    for item, t in items:
        own = tokens(t)
        if own:
            got = plain_tiles(own, body, min(5, len(own)))
            if sum(x[2] for x in got) >= 0.6 * len(own):
                yield item, sum(x[2] for x in got) / len(own), len(got), got[0][2]


def test_tiles_of_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(1, 4, rng.integers(0, n)).astype(np.uint64) for n in (30, 60))
        assert decontaminate.tiles(a, b, 3) == plain_tiles(a.tolist(), b.tolist(), 3)


def test_leaks_of_plain_search(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet").cache() for n in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(r.doc_id, *x) for r in docs.collect() for x in plain_leaks(r.text, items)}
    assert want and {tuple(r) for r in decontaminate.leaks(docs, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert {tuple(r) for r in decontaminate.leaks(docs, bench).collect()} == want
    kept = decontaminate.without_leaks(docs, bench.toDF("n", "body"), item_col="n", item_text_col="body")
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - {x[0] for x in want}


def test_periodic_texts_and_common_seeds_take_linear_time():
    import time

    began = time.time()
    a, b = np.tile([5, 7], 10_000).astype(np.uint64), np.insert(np.tile([7, 5], 100_000).astype(np.uint64), 70_000, 9)
    assert sum(x[2] for x in decontaminate.tiles(a, b)) == len(a)
    head = "please answer the following question now "
    items = decontaminate.Items(list(range(20_000)), [head + " ".join(f"{w}{i}" for w in "abcdefghij") for i in range(20_000)])
    texts = pa.array([head * 200] * 50 + [head + " ".join(f"{w}5" for w in "abcdefghij")])
    got = [x[:2] for _, _, h, at in decontaminate.token_hashes(texts) for x in items.leaks(h, at, 0.6)]
    assert got == [(50, 5)] and time.time() - began < 10


def test_ring_of_plain_walk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 20")).cache()
    shards, replicas = 7, 8
    nodes = sorted((r.at, r.shard, r.replica) for r in sharding.virtual_nodes(spark, shards, replicas).collect())
    key = sharding.keys(docs).withColumn("at", sharding._position(F.lit("key"), "id", "size", "text_crc32", "copy")).collect()
    arcs = collections.defaultdict(list)
    for r in sorted(key, key=lambda r: (r.at, r.id, r["size"], r.text_crc32, r.copy)):
        arcs[next((i for i, n in enumerate(nodes) if n[0] >= r.at), 0)].append(r)
    room = {s: len(key) // shards + (s < len(key) % shards) for s in range(shards)}
    of = [[i for i, n in enumerate(nodes) if n[1] == s] for s in range(shards)]
    placed, excess, spare = collections.Counter(), {}, {}
    for s in range(shards):
        left = room[s]
        for i in of[s]:
            placed.update((r.id, s) for r in arcs[i][:left])
            excess[i] = arcs[i][left:]
            left -= min(left, len(arcs[i]))
        for k, i in enumerate(of[s]):
            spare[i] = left // replicas + (k < left % replicas)
    level = list(itertools.accumulate(len(excess[i]) - spare[i] for i in range(len(nodes))))
    start = level.index(min(level)) + 1
    queue = collections.deque()
    for i in [*range(start, len(nodes)), *range(start)]:  # clockwise from where nothing is still looking for room
        queue.extend(excess[i])
        for _ in range(spare[i]):
            placed[queue.popleft().id, nodes[i][1]] += 1
    got = sharding.assign(docs, shards, replicas).select("doc_id", "shard").collect()
    mine = collections.Counter((r.doc_id, r.shard) for r in got)
    assert not queue and mine == placed
    more = collections.Counter((r.doc_id, r.shard) for r in sharding.assign(docs, shards + 1, replicas).select("doc_id", "shard").collect())
    assert sum((mine - more).values()) < 0.5 * len(got)  # a remainder by the shard count would move seven eighths


def test_edited_notices_are_found(spark):
    rng, rows, want = random.Random(12), [], set()
    # templates of this test, so that its figures do not depend on which notices are built in
    notices = {f"n{k}": prose(rng, n) for k, n in enumerate((25, 40, 60, 120))}
    for i in range(400):
        name = f"n{i % 4}"
        t = notices[name].split()
        for _ in range(rng.randint(0, 1 + len(t) // 40)):
            t[rng.randrange(len(t))] = "changed"
        own = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        full = own(notices[name].split())
        if len(full & own(t)) >= 0.8 * len(full):
            want.add((i, name))
        rows.append((i, " ".join([prose(rng, rng.randint(0, 90)), *t, prose(rng, rng.randint(0, 90))])))
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), notices).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 200


def test_policies_and_ablations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def failed(t):
        w, lines = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x], [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = list(zip(w, w[1:], w[2:]))
        times = collections.Counter(windows)
        repeated = len({i + j for i, x in enumerate(windows) if times[x] > 1 for j in range(3)})
        letters, upper = len(re.findall("[A-Za-z]", t or "")), len(re.findall("[A-Z]", t or ""))
        chars, n = sum(map(len, w)), len(w)
        rules = {"few_words": n < 50, "repeated_words": repeated * 2 > n, "symbols": sum(c in "#*$%&|<>" for c in t or "") * 100 > 15 * n, "duplicate_lines": len(lines) >= 4 and (len(lines) - len(set(lines))) * 2 > len(lines), "capitals": letters >= 100 and upper * 100 > 45 * letters, "long_words": chars > 25 * n, "short_words": n > 0 and chars < 2 * n}
        return {k for k, v in rules.items() if v}

    want = {r.doc_id: failed(r.text) for r in docs.collect()}
    entries = quality_rules.apply_policy(quality_rules.ledger(docs))
    base = F.col("fail_bits").bitwiseAND(quality_rules.BASE) != 0
    got = entries.select("doc_id", "kept", base.alias("base")).collect()
    assert {(r.doc_id, r.kept, r.base) for r in got} == {(i, not f, bool(f & {"few_words", "repeated_words"})) for i, f in want.items()}
    ablated = {(r.rule, r.failed, r.only_this) for r in quality_rules.ablations(entries).collect()}
    assert ablated == {(r.rule, r.failed, r.only_this) for r in queries.rule_ablations(spark, SF).where(f"documents = {len(want)}").collect()}
    assert ablated == {(n, sum(n in f for f in want.values()), sum(f == {n} for f in want.values())) for n, _ in quality_rules.RULES}


def test_posterior_by_hand(spark):
    rng = random.Random(7)
    texts = {"en": "the cat and the dog with that thing there", "de": "der hund und die katze sind nicht hier", "fr": "le chat et le chien sont avec nous ici"}
    docs = [(k, " ".join(rng.sample(t.split(), 6))) for k, t in texts.items() for _ in range(5)]
    hosts = ["a.one.de", "b.one.de", "www.two.com", "x.fr", "www.two.com"]
    pages = [(i, f"http://{rng.choice(hosts)}/p{i}", f'<html lang="{rng.choice(["en", "de", "fr"])}"><p>{" ".join(rng.sample(texts[rng.choice(list(texts))].split(), 3))}</p>') for i in range(40)]
    clean = lambda t: "".join(c if c.isalpha() else " " for c in t)

    def buckets(t):
        t = clean(t)
        for a, b, c in zip(t, t[1:], t[2:]):
            if b != " ":
                h = ((ord(a) * 65599 + ord(b)) * 65599 + ord(c)) & 0xFFFFFFFF
                yield (((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF) >> 18

    langs, size = sorted(texts), 1 << 14
    counts = {k: collections.Counter(b for lang, t in docs if lang == k for b in buckets(t)) for k in langs}
    log = {k: lambda b, k=k: math.log((counts[k][b] + 0.5) / (sum(counts[k].values()) + 0.5 * size)) for k in langs}
    seen = []
    for i, url, html in pages:
        host = re.match(r"http://([^/]+)", url)[1]
        text = re.sub("<[^>]*>", " ", html)
        ll = [sum(log[k](b) for b in buckets(text)) for k in langs]
        seen.append({"id": i, "ll": ll, "reads": ll.index(max(ll)), "host": host, "domain": ".".join(host.split(".")[-2:]), "suffix": host.split(".")[-1], "declared": re.search('lang="(..)"', html)[1]})
    every = [sum(p["reads"] == k for p in seen) for k in range(3)]
    want = {}
    for p in seen:
        votes = lambda key, k: sum(q["reads"] == k and q[key] == p[key] for q in seen if q is not p)  # noqa: E731, B023
        score = []
        for k in range(3):
            domain = (votes("domain", k) + 2 * (every[k] + 1) / (len(seen) + 3)) / (sum(votes("domain", j) for j in range(3)) + 2)
            host = (votes("host", k) + 4 * domain) / (sum(votes("host", j) for j in range(3)) + 4)
            share = [(votes(key, k) + 2 * (sum(votes(key, j) for j in range(3)) + 1) / (len(seen) + 1)) / (every[k] - (p["reads"] == k) + 2) for key in ("declared", "suffix")]
            score.append(0.1 * p["ll"][k] + math.log(host) + math.log(share[0]) + math.log(share[1]))
        top = max(score)
        want[p["id"]] = (langs[score.index(top)], 1 / sum(math.exp(s - top) for s in score))
    got = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "lang string, text string")).collect()
    assert all(r.lang == want[r.page_id][0] and abs(r.confidence - want[r.page_id][1]) < 1e-4 for r in got) and len(got) == 40


def test_window_scores_by_hand():
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=toxicity.ROWS), (np.ones(2), 0.0, 0.0, 1.0))

    def row(gram):
        h = 0
        for c in gram:
            h = (h * 0x01000193 + c + 1) & 0xFFFFFFFF
        return (((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF) >> 16

    def by_hand(t):
        z = []
        for w in re.split(rb"[\x20\x09-\x0D.,;:!?\"()|\[\]{}<>/]+", "".join(c.lower() if c.isascii() else c for c in t or "").encode()):
            if w:
                w = b" " + w + b" "
                z.append(np.mean([model.scalar[row(w[i : i + n])] for n in (3, 4, 5) for i in range(len(w) - n + 1)]))
        n = min(toxicity.WINDOW, len(z))
        return (max(np.mean(z[i : i + n]) for i in range(len(z) - n + 1)), np.log(np.mean(np.exp(z)))) if z else (0.0, 0.0)

    texts = [None, "", "a", "one two", "ab, cd! (ef)", " x " * 30] + [prose(random.Random(i), 5 * i) for i in range(1, 12)]
    assert np.allclose(model.values(pa.array(texts, pa.string())), [by_hand(t) for t in texts], atol=1e-4)


@pytest.mark.parametrize("make,col", [(quality_model.classify, "quality"), (toxicity.classify, "toxic")])
def test_held_out_labels(spark, make, col):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = make(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", col).collect()
    right, most = sum(r[0] == r[1] for r in rows), max(collections.Counter(r[1] for r in rows).values())
    assert len(rows) > 50 and right >= most, (right, most, len(rows))


INSULTS = ["idiot", "worthless", "disgusting", "pathetic", "moron"]


def noisy_rows(n):
    """(id, text, whether an insult is in it, label): one insult in a text of 90 words, a twentieth of the labels turned round."""
    rng, rows = random.Random(8), []
    for i in range(n):
        ws, bad = prose(rng, 90).split(), rng.random() < 0.2
        if bad:
            ws.insert(rng.randrange(90), rng.choice(INSULTS))
        rows.append((i, " ".join(ws), bad, int(bad != (rng.random() < 0.05))))
    return rows


def test_toxic_words_under_noisy_labels(spark):
    rows = noisy_rows(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [(bad, got[i].predicted) for i, _, bad, _ in rows if got[i].held_out]
    caught, wrong = sum(b and p for b, p in held), sum(not b and p for b, p in held)
    assert caught >= 0.95 * sum(b for b, _ in held) and wrong <= 0.01 * len(held), (caught, wrong, len(held))


def test_misspellings_never_seen():
    rows = noisy_rows(1200)
    model = toxicity.fit([t for _, t, _, _ in rows], np.array([y for *_, y in rows]))
    plain = prose(random.Random(1), 60)
    texts = [f"{plain} {w} {plain}" for w in ("idiott", "worthles", "disgustingg", "pathetics", "morron")]
    assert (model.scores(pa.array(texts)) > model.scores(pa.array([plain]))[0] + 0.1).sum() >= 4


def test_repeated_ids_of_labelled_rows(spark):
    rows = noisy_rows(400)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(5, f"{rows[5][1]} {k % 3}") for k in range(5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows] + [(5, k % 2) for k in range(3000)], "doc_id long, toxic int")
    seen = []
    real, toxicity.fit = toxicity.fit, lambda texts, y: seen.append((texts, y)) or 0.5
    try:
        got = toxicity.classify(docs, labels).count()
    finally:
        toxicity.fit = real
    learn = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    assert got == 5400 and len(seen[0][0]) == len(learn)


def test_recall_of_held_out_toxic_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    caught, toxic, alarms = sum(p * t for p, t in rows), sum(t for _, t in rows), sum(p * (1 - t) for p, t in rows)
    assert caught >= 0.8 * toxic and alarms <= 0.05 * toxic, (caught, toxic, alarms)


def test_pipeline_of_plain_steps(spark):
    import corpus_pipeline

    rng = random.Random(21)
    base, passage, item = prose(rng, 120), prose(rng, 90), prose(rng, 40)
    texts = [None, "", " \n ", "one two", base, base, base + " more", base.replace("th", "TH", 2), prose(rng, 3000), "aaaa " * 200, "### $$$ " * 60 + prose(rng, 60)]
    texts += [prose(rng, 80) + "\n" + passage + "\n" + prose(rng, 80) for _ in range(4)] + [prose(rng, rng.randint(40, 200)) for _ in range(25)]
    texts += [prose(rng, 60) + " " + item + " " + prose(rng, 60), prose(rng, 70) + " " + " ".join(item.split()[20:] + item.split()[:20])]
    rows = [(i, t, "en", "s", len(t or ""), i, "x") for i, t in enumerate(texts)]
    rows += [rows[4], rows[20], (None, prose(rng, 90), None, None, None, None, None), (None, base, None, None, None, 3, None)]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id long, component string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept_by_rules = {i for i, r in enumerate(quality_rules.apply_policy(quality_rules.ledger(spark.createDataFrame(list(enumerate(r[1] for r in rows)), "doc_id long, text string"))).orderBy("doc_id").collect()) if r.kept}
    docs = [r for i, r in enumerate(rows) if i in kept_by_rules]
    sets = [frozenset(zip(*(w[k:] for k in range(5)))) if len(w := words(r[1])) > 4 else frozenset([tuple(w)] if w else []) for r in docs]
    root = list(range(len(docs)))
    for _ in docs:
        for i, j in itertools.combinations(range(len(docs)), 2):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[i] = root[j] = min(root[i], root[j])
    groups = collections.defaultdict(list)
    for r, d in zip(root, docs):
        groups[r].append(d)
    docs = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    times = collections.Counter(b[p : p + 200] for r in docs for b in [(r[1] or "").encode()] for p in range(len(b) - 199))
    want = collections.Counter()
    ranks = bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in docs:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 199):
            if times[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        text = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if not list(plain_leaks(text, [(1, item)])):
            ids = enc.encode_ordinary(text)
            want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert collections.Counter(map(tuple, got)) == want and len(want) < len(rows) - 8
    none = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0


def test_ids_that_are_strings(spark):
    a = prose(random.Random(3), 80)
    docs = spark.createDataFrame([("b", a), ("a", a + " end"), ("c", "other words"), (None, a)], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.groups(docs).collect()} == {("b", "a"), ("a", "a"), (None, "a"), ("c", "c")}
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs).collect()) == ["a", "c"]
