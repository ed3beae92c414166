"""Quality rules as a bitmask ledger (operator 9).

Every rule is evaluated once for each document: the ledger keeps the
measurements and one integer with a bit for each rule that failed. Policies are
versioned masks over those bits, so a new policy, or the effect of leaving a
rule out, is a bitwise question to the ledger and never reads a text again.

Cases: a null or empty text has zero counts and fails ``few_words``; rows with
equal ids are judged one by one; a null id stays null; other columns are not read
(``filter_documents`` carries them through unchanged); an empty table gives an
empty ledger.
"""

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import WHITE, slabs, sums, text_column

SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True

#: Measurements of a document, all long.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
#: Rules in bit order: name, and when a document fails, of its measurements as columns or as numpy arrays.
RULES = (
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbols", lambda m: 100 * m["n_symbols"] > 15 * m["n_words"]),
    ("duplicate_lines", lambda m: (m["n_lines"] >= 4) & (100 * m["n_dup_lines"] > 50 * m["n_lines"])),
    ("capitals", lambda m: (m["n_letters"] >= 100) & (100 * m["n_upper"] > 45 * m["n_letters"])),
    ("long_words", lambda m: m["word_chars"] > 25 * m["n_words"]),
    ("short_words", lambda m: (m["n_words"] > 0) & (m["word_chars"] < 2 * m["n_words"])),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versioned policies: a document is rejected if one of the policy's bits is set.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"],
    "v2": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["capitals"] | BIT["long_words"] | BIT["short_words"],
}
CURRENT = "v2"


def _repeats(text: bytes) -> tuple[int, int, int, int]:
    """Words, lines with a word, such lines equal to an earlier one, words in repeated 3-word windows."""
    w = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(w, w[1:], w[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        hit = np.zeros(len(w), bool)
        at = np.flatnonzero(np.fromiter((times[x] > 1 for x in windows), bool, len(windows)))
        for j in range(3):
            hit[at + j] = True
        repeated = int(hit.sum())
    return len(w), len(lines), len(lines) - len(set(lines)), repeated


def measure(column) -> dict[str, np.ndarray]:
    """MEASURES of each text of an Arrow column."""
    column = text_column(column)
    out = {k: np.zeros(len(column), np.int64) for k in MEASURES}
    for i, j, data, at in slabs(column):
        out["word_chars"][i:j] = sums(((data & 0xC0) != 0x80) & ~WHITE[data], at)
        for name, kind in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER)):
            out[name][i:j] = sums(kind[data], at)
        raw = data.tobytes()
        for k in range(j - i):
            out["n_words"][i + k], out["n_lines"][i + k], out["n_dup_lines"][i + k], out["n_repeat_words"][i + k] = _repeats(raw[at[k] : at[k + 1]])
    return out


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the measurements of each row of docs."""

    def run(batches):
        for b in batches:
            got = measure(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[k]) for k in MEASURES)], names=[id_col, *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{k} long" for k in MEASURES))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``, the rules each document failed."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(rule({k: F.col(k) for k in MEASURES}), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES))
    return measurements(docs, id_col, text_col).withColumn("fail_bits", bits.cast("long"))


def apply_policy(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` under a policy; no text is read."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0)


def ablations(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects."""
    mask = F.lit(POLICIES[version]).cast("long")
    failed = F.col("fail_bits").bitwiseAND(mask)
    names = [n for n, _ in RULES if BIT[n] & POLICIES[version]]
    counts = entries.select(failed.alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    wide = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("documents"),
        F.coalesce(F.expr("bit_or(f)"), F.lit(0)).alias("ever_failed"),
        *(F.coalesce(F.sum(F.when(F.col("f").bitwiseAND(F.lit(BIT[n]).cast("long")) != 0, F.col("n"))), F.lit(0)).alias(f"fail_{n}") for n in names),
        *(F.coalesce(F.sum(F.when(F.col("f") == BIT[n], F.col("n"))), F.lit(0)).alias(f"only_{n}") for n in names),
    )
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"fail_{n}").alias("failed"), F.col(f"only_{n}").alias("only_this")) for n in names)))
    return wide.select("documents", each.alias("x")).select("documents", "x.*")


def filter_documents(docs: DataFrame, version: str = CURRENT, text_col: str = "text") -> DataFrame:
    """docs without the rows that a policy rejects, all columns as they were."""
    mask = POLICIES[version]

    def run(batches):
        for b in batches:
            m = measure(b.column(b.schema.get_field_index(text_col)))
            bits = sum(np.where(rule(m), BIT[name], 0) for name, rule in RULES)
            yield b.filter(pa.array((bits & mask) == 0))

    return docs.mapInArrow(run, docs.schema)

