"""Secret scans over every historical version of a file, by an incremental ledger of blobs (operator 12).

1. A version is a row with a path (its id) and a text. The text is content-addressed
   by the SHA-256 of its UTF-8 bytes: equal texts are one blob, whatever their paths
   and however many versions repeat them. Copies meet before the shuffle already.
2. The ledger is a folder of Parquet files with a row (blob, pairs, found) for each
   blob and scan: which rules at which versions have looked at it, and what they
   found. A scan asks it for each blob which pairs of rule and version are unseen,
   reads only blobs that have one with only those rules, and appends its rows. A
   scan that fails appends nothing.
3. Findings of the blobs join back to all paths.

Rules are regular expressions; the leftmost non-overlapping matches of each are
taken first, and those that are too short are dropped afterwards. Places are code
points, ends exclusive.

Cases: a null text is the empty blob; a null id stays null; rows are versions, so
repeated rows and ids are reported one by one; other columns are not read; an empty
table gives an empty result and an empty row set in the ledger. Blobs that no row
holds any more stay in the ledger and are not reported.
"""

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import new_path, written
from .textbytes import text_column


@dataclass(frozen=True)
class Rule:
    """kind and version name a rule; a match counts if group `group` (0: all of it) has `least` characters."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    fold: bool = False

    @property
    def pair(self) -> str:
        return f"{self.kind}@{self.version}"


# The kinds of the contract, in its order. A match of the last two is a
# run that nothing shortens, so that asking for its length in the pattern drops the same
# matches as dropping short ones later, without making them.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 24),
)
#: Kinds that a line of a key file or a signed token gives away by its form alone.
MORE = (
    Rule("pem", 1, r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED |)PRIVATE KEY-----", 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
RULES = BASE + MORE
FOUND = "array<struct<kind:string,version:int,start:int,end:int>>"
LEDGER = f"blob string, pairs array<string>, found {FOUND}"


def matches(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Start and end of each match of a rule that is long enough."""
    # letters of the ASCII range only: Unicode would fold the Kelvin sign to k
    found = re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.fold else 0)).finditer(text)
    return [m.span() for m in found if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("t"))


def _ledger(spark, path: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def update(docs: DataFrame, ledger: str, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Scans the blobs of docs for the rules that the ledger has not seen them with, and adds what was found."""
    by_pair = {r.pair: r for r in rules}
    if len(by_pair) < len(rules):
        raise ValueError("two rules have one kind and version")
    blobs = _versions(docs, id_col, text_col).groupBy("blob").agg(F.first("t").alias("t"))
    spark = docs.sparkSession
    # rows written below are not part of the ledger as it is read here: the files are listed now
    seen = _ledger(spark, ledger).select(F.col("blob").alias("_b"), "pairs").groupBy("_b").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("seen"))
    every = F.array(*(F.lit(p) for p in by_pair))
    unseen = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    # both sides are dealt by blob at every size: neither the ledger nor the texts have a bound
    todo = blobs.join(seen.hint("shuffle_hash"), F.col("blob") == F.col("_b"), "left").select("blob", "t", unseen.alias("pairs")).where(F.size("pairs") > 0)

    def run(batches):
        for b in batches:
            found = []
            for text, pairs in zip(text_column(b.column(1)), b.column(2).to_pylist()):
                text = text.as_py()
                found.append([{"kind": by_pair[p].kind, "version": by_pair[p].version, "start": s, "end": e} for p in pairs for s, e in matches(by_pair[p], text)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, kind)], names=["blob", "pairs", "found"])

    todo.mapInArrow(run, LEDGER).write.mode("append").parquet(ledger)


def findings(docs: DataFrame, ledger: str, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob, found) of each version: what the ledger's scans by `rules` found in its blob, in the order of start and then of the rules."""
    wanted = F.array(*(F.lit(r.pair) for r in rules))
    order = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.pair, k)))
    spark = docs.sparkSession
    pair = lambda x: F.concat(x["kind"], F.lit("@"), x["version"].cast("string"))
    kept = F.filter("found", lambda x: F.array_contains(wanted, pair(x)))
    # a pair that two scans running at once have both looked for is there twice, with equal findings
    hits = _ledger(spark, ledger).where(F.size("found") > 0).select("blob", F.explode(kept).alias("x")).distinct().groupBy("blob").agg(F.collect_list("x").alias("found"))
    ranked = F.array_sort(F.transform("found", lambda x: F.struct(x["start"], order[pair(x)].alias("order"), x["end"], x["kind"], x["version"])))
    hits = hits.select(F.col("blob").alias("_b"), F.transform(ranked, lambda x: F.struct(x["kind"], x["version"], x["start"], x["end"])).alias("found"))
    # written, so that the join below is dealt by itself and Spark can split a blob that many paths hold
    hits = written(hits)
    paths = _versions(docs, id_col, text_col).select("path", "blob")
    joined = paths.join(hits.hint("merge"), F.col("blob") == F.col("_b"), "left")
    return joined.select(F.col("path").alias(id_col), "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def scan(docs: DataFrame, ledger: str | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Brings a ledger (of this call alone, if none is named) up to date with docs and returns findings."""
    ledger = ledger or new_path(docs.sparkSession)
    update(docs, ledger, rules, id_col, text_col)
    return findings(docs, ledger, rules, id_col, text_col)


def digests(found: DataFrame, base=BASE) -> DataFrame:
    """Of rows of findings: counts of the base kinds, the SHA-256 of their spans, and all spans."""
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("found", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in base]
    return found.select(*(c for c in found.columns if c not in ("blob", "found")), *counts, F.sha2(text(of(*(r.kind for r in base))), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
