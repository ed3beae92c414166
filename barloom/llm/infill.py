"""Fill-in-the-middle rows: a text's prefix, suffix and middle in training order (operator 11).

The Split pre-tokenizer of the tokenizers library, with isolated matches of
``TOKEN``, cuts a text into units and gives the code-point offsets of each; nothing
is trained. The length of that array is n, and the ends of its units at two ranks
are where the text is sliced. Ranks and form come from a SHA-256 of seed and id, so
a row is transformed the same way on any cluster and in any order.

A text is handed to the library in pieces of about ``PIECE`` code points, cut where
one unit ends and the next begins with white space: memory does not follow the
length of a text, and the units are those of the whole.

Cases: a null text is an empty one, which has no units and stays plain; a text that
holds a marker stays plain, so that every output can be undone; a null id hashes as
an empty string; rows are independent, so repeated ids and texts give repeated
rows; other columns are not read; an empty table gives an empty result.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .textbytes import text_column

#: White space with the word that follows, or what white space is left at the end.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
# The markers of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PIECE = 1 << 18
_CUT = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")


def unit_ends(text: str, split=None, piece: int = PIECE) -> list[int]:
    """Code-point offsets at which the units of a text end."""
    split = split or pre_tokenizers.Split(Regex(TOKEN), "isolated")
    ends, low = [], 0
    while low < len(text):
        cut = _CUT.search(text, low + piece) if low + piece < len(text) else None
        high = cut.start() if cut else len(text)
        ends += [low + end for _, (_, end) in split.pre_tokenize_str(text[low:high])]
        low = high
    return ends


def _arranged(text: str, form: str, a: int, b: int) -> str:
    """The text with its parts [0, a), [a, b) and [b, ...) in the order of a form."""
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if form == "spm" else text


def transform(docs: DataFrame, seed: str = "42", percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row: `percent` of the rows are rearranged, `spm_percent` of these suffix first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    form = F.when(draws[2] % 100 >= percent, "plain").otherwise(F.when(draws[3] % 100 < spm_percent, "spm").otherwise("psm"))

    def run(batches):
        split = pre_tokenizers.Split(Regex(TOKEN), "isolated")
        for batch in batches:
            out = []
            for text, first, second, form in zip(text_column(batch.column(1)), *(batch.column(k).to_pylist() for k in (2, 3, 4))):
                text = text.as_py()
                ends = unit_ends(text, split)
                n = len(ends)
                if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    form = "plain"
                if form == "plain":
                    out.append((n, form, None, None, text))
                    continue
                a, b = (ends[k - 1] if k else 0 for k in sorted((first % (n + 1), second % (n + 1))))
                out.append((n, form, a, b - a, _arranged(text, form, a, b)))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col), F.col(text_col), draws[0], draws[1], form).toDF("id", "text", "first", "second", "form")
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output, form) -> F.Column:
    """The text that a row was made from, of its output and form alone: in a rearranged row each marker occurs once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda *places: F.concat(*(F.get(parts, F.lit(k)) for k in places))
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """Rows of transform with SHA-256 sums of the output and of the text rebuilt from it in place of the output."""
    sums = [F.sha2(c, 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return made.select(*(c for c in made.columns if c != "output"), *sums)
