"""The corpus pipeline: rules, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept,
and returns a DataFrame. All but the last return the columns of documents.

Cases, the same in every stage: extra columns, whatever their names, are carried along
and not read; a null id is kept, and rows that share an id are judged one by one by
their texts; rows that repeat both are near duplicates, of which one stays; an empty
table gives an empty one. A null or empty text is rejected by the first stage (too few
words); where a stage is called by itself such a text stays as it is, since it repeats
nothing and leaks nothing, and has no tokens.
"""

import public_tokenizers

from barloom.llm import bpe, decontaminate, near_dedup, quality_rules, substring_dedup
from barloom.llm.tables import table, written

#: Bytes of a repeated passage: below those of 50 short words.
PASSAGE = 200


def quality(spark, docs, sf_dir):
    """Documents that the rules of the current policy reject go."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return near_dedup.keep_one(docs, k=5, percent=80)


def repeated_passages(spark, docs, sf_dir):
    """Bytes in strings of PASSAGE bytes that also start elsewhere are taken out of the text."""
    return substring_dedup.remove(docs, length=PASSAGE)


def benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark, docs, sf_dir):
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("substring_dedup", repeated_passages), ("decontamination", benchmark_leaks), ("bpe", tokens)]
#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
