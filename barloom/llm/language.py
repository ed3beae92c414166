"""Language identification by Bayesian fusion of evidence (operator 6).

The posterior of a page's language multiplies four kinds of evidence:

* the likelihood of its text under byte trigram counts of the labelled documents
  (all of them, added up by a grouped aggregation), tempered, since neighbouring
  trigrams are not independent;
* the language its markup declares, by how often pages whose text reads as a
  language declare each;
* the suffix of its address, by the same kind of table;
* the prior of its host, smoothed towards its domain and that towards all pages;
  a page's own vote is taken out of each first.

The last three tables are grouped aggregations over all pages, of what each page's
text reads as.

Cases: a null or empty page, or one without visible text, is decided by the other
evidence; a null or strange address is the host '' ; a null id is kept; rows with
equal ids are judged one by one; documents with a null language or text teach
nothing; without labelled documents the language is null; an empty table of pages
gives an empty result; other columns are not read.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written
from .textbytes import LOWER, sums, slabs, text_column

BUCKETS = 1 << 14
#: Weight of the text's log likelihood; pseudo-counts of domain for host, and of all pages for domain, markup and suffix.
TEMPER, HOST, REST = 0.1, 4.0, 2.0
_CLEAN = LOWER.copy()
_CLEAN[:65] = 32
_CLEAN[91:97] = 32
_CLEAN[123:128] = 32
_ENTITY = re.compile(rb"&#?\w{1,32};")
_NAME = re.compile(rb"<(script|style)\b", re.I)
_END = {name: re.compile(rb"</" + name + rb"\s*>", re.I) for name in (b"script", b"style")}
_DECLARED = re.compile(rb"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)


def visible(page: bytes) -> bytes:
    """The text of a page: without tags, comments, scripts, styles and entities, each a space.

    One pass forward: where something is never closed, that is found once and
    remembered, so broken pages take no longer than whole ones. What is not closed
    is text but for its bracket.
    """
    out, at, unclosed = [], 0, set()

    def close(kind, find, start):
        if kind in unclosed:
            return -1
        end = find(start)
        if end < 0:
            unclosed.add(kind)
        return end

    while (low := page.find(b"<", at)) >= 0:
        out.append(page[at:low])
        end, m = -1, _NAME.match(page, low)
        if m:
            name = m[1].lower()

            def after(start, name=name):
                x = _END[name].search(page, start)
                return x.end() if x else -1

            end = close(name, after, m.end())
        elif page.startswith(b"<!--", low):
            end = close(b"-->", lambda start: page.find(b"-->", start) + 3 if page.find(b"-->", start) >= 0 else -1, low + 4)
        if end < 0:
            end = close(b">", lambda start: page.find(b">", start) + 1 or -1, low + 1)
        at = end if end >= 0 else low + 1
        out.append(b" ")
    out.append(page[at:])
    return _ENTITY.sub(b" ", b"".join(out))


def trigram_buckets(data: np.ndarray, at: np.ndarray):
    """Bucket of the trigram at each byte, and whether it lies in its text and has a letter in the middle."""
    clean = _CLEAN[data].astype(np.uint32)
    n = max(0, len(clean) - 2)
    h = (clean[:n] * np.uint32(65599) + clean[1 : n + 1]) * np.uint32(65599) + clean[2 : n + 2]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    bucket = (h >> np.uint32(18)).astype(np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return bucket, (text[:n] == text[2 : n + 2]) & (clean[1 : n + 1] != 32), text[:n]


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text"):
    """Languages, in order, and log probabilities of the buckets of each."""

    def count(batches):
        total: dict = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for i, j, data, at in slabs(text_column(b.column(1))):
                bucket, ok, text = trigram_buckets(data, at)
                names, code = np.unique(langs[i:j].astype(str), return_inverse=True)
                grid = np.bincount(code[text[ok]] * BUCKETS + bucket[ok], minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, row in zip(names, grid):
                    total[name] = total.get(name, 0) + row
        for name, row in total.items():
            there = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(there)), pa.array(there), pa.array(row[there].astype(np.int64))], names=["lang", "bucket", "n"])

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), text_col)
    rows = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"]
    return langs, np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)) if langs else counts


def read_pages(pages: DataFrame, langs: list[str], logs: np.ndarray, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, host, domain, suffix, declared, text_log array<double>, reads) of each page."""
    k = len(langs)
    logs = logs.astype(np.float32)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            html = text_column(b.column(1))
            declared, bare = [], []
            for i, _, data, at in slabs(html):
                raw = data.tobytes()
                for x in range(len(at) - 1):
                    page = raw[at[x] : at[x + 1]]
                    m = _DECLARED.search(page)
                    declared.append(m[1].decode().lower() if m else "")
                    bare.append(visible(page).decode("utf-8", "ignore"))
            out = np.zeros((b.num_rows, k))
            for i, j, data, at in slabs(pa.array(bare, pa.string())):
                bucket, ok, _ = trigram_buckets(data, at)
                edges = np.minimum(at, len(bucket))
                for x in range(k):
                    out[i:j, x] = sums(np.where(ok, logs[x][bucket], 0.0), edges)
            reads = np.where((out < 0).any(1), out.argmax(1), -1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(declared, pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), pa.array(out.ravel())), pa.array(reads.astype(np.int32))], names=["id", "host", "declared", "text_log", "reads"])

    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"^\w+://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    rows = pages.select(id_col, html_col, host.alias("host")).mapInArrow(run, f"id {kind}, host string, declared string, text_log array<double>, reads int")
    parts = F.split("host", r"\.")
    n = F.size(parts)
    return rows.select("id", "host", F.when(n >= 2, F.concat_ws(".", F.get(parts, n - 2), F.get(parts, n - 1))).otherwise(F.col("host")).alias("domain"), F.get(parts, n - 1).alias("suffix"), "declared", "text_log", "reads")


def _votes(read: DataFrame, key: str, k: int) -> DataFrame:
    """For each key, how many of its pages read as each language."""
    votes = F.array(*(F.sum(F.when(F.col("reads") == i, 1).otherwise(0)).cast("double") for i in range(k)))
    return read.groupBy(key).agg(votes.alias(f"{key}_votes"))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(id, lang, confidence, text_lang, declared, suffix, host) of each page."""
    langs, logs = profiles(docs, lang_col, text_col)
    k = len(langs)
    if not k:
        return pages.select(id_col, *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"), ("suffix", "string"), ("host", "string"))))
    read = written(read_pages(pages, langs, logs, id_col, url_col, html_col))
    every = [float(x or 0) for x in read.agg(*(F.sum(F.when(F.col("reads") == i, 1).otherwise(0)) for i in range(k))).first()]
    base = [(x + 1) / (sum(every) + k) for x in every]
    for key in ("host", "domain", "suffix", "declared"):
        read = read.join(_votes(read.select(key, "reads"), key, k), key)
    own = lambda i: F.when(F.col("reads") == i, 1.0).otherwise(0.0)
    left = lambda key, i: F.col(f"{key}_votes")[i] - own(i)
    total = lambda key: sum((left(key, i) for i in range(1, k)), left(key, 0))
    for i in range(k):
        read = read.withColumn(f"_d{i}", (left("domain", i) + REST * base[i]) / (total("domain") + REST))
    scores = []
    for i in range(k):
        prior = (left("host", i) + HOST * F.col(f"_d{i}")) / (total("host") + HOST)
        # of the pages that read as language i, the share with this markup, and this suffix: smoothed to what all pages have
        share = lambda key: (left(key, i) + REST * (total(key) + 1) / (sum(every) + 1)) / (every[i] - own(i) + REST)  # noqa: E731, B023
        scores.append(TEMPER * F.col("text_log")[i] + F.log(prior) + F.log(share("declared")) + F.log(share("suffix")))
    read = read.withColumn("_s", F.array(*scores)).withColumn("_top", F.array_max("_s"))
    name = F.array(*(F.lit(x) for x in langs))
    weight = F.aggregate("_s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    return read.select(
        F.col("id").alias(id_col), F.get(name, F.array_position("_s", F.col("_top")).cast("int") - 1).alias("lang"), (1 / weight).alias("confidence"), F.when(F.col("reads") >= 0, F.get(name, F.col("reads"))).alias("text_lang"), "declared", "suffix", "host",
    )
