"""Queries of the corpus operators, with the parameters of production."""

import public_tokenizers

from . import bpe, decontaminate, infill, language, licenses, near_dedup, negatives, quality_model, quality_rules, secrets, sharding, substring_dedup, toxicity
from .tables import table


def op1_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_model(spark, sf_dir):
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"), shards=40)


def op4_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_near_dedup(spark, sf_dir):
    return near_dedup.groups(table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_quality_rules(spark, sf_dir):
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    base = rows["fail_bits"].bitwiseAND(quality_rules.BASE) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def rule_ablations(spark, sf_dir):
    """Of each rule of the current policy: documents that fail it, and those that no other rule rejects."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(table(spark, sf_dir, "documents"), length=400)


def op11_fill_in_middle(spark, sf_dir):
    return infill.digests(infill.transform(table(spark, sf_dir, "documents"), "42", percent=50, spm_percent=80))


def op12_secret_scan(spark, sf_dir):
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op13_hard_negatives(spark, sf_dir):
    return negatives.mine(table(spark, sf_dir, "embeddings"), anchor_every=50, positives=5, negatives=3, low_percent=50, high_percent=95, noise=7)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_quality_model, op3_sharding, op4_license_scan, op5_toxicity, op6_language, op7_bpe, op8_near_dedup, op9_quality_rules, rule_ablations, op10_substring_dedup, op11_fill_in_middle, op12_secret_scan, op13_hard_negatives, pipeline)}

#: White space and other characters, as in operator 11.
_UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_INFILL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '{_UNITS}') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS x, array_to_string(units[a + 1:b], '') AS y, array_to_string(units[b + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: matches and the pieces between them, whose lengths add up to places."""
    q = pattern.replace("'", "''")
    return f"""SELECT k, '{kind}' AS kind, {order} AS o, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS s, length(found[i]) AS size
  FROM (SELECT k, string_split_regex(t, '{q}') AS pieces, regexp_extract_all(t, '{q}') AS found, regexp_extract_all(t, '{q}', {group}) AS part, unnest(range(1, len(regexp_extract_all(t, '{q}')) + 1)) AS i FROM d) WHERE length(part[i]) >= {least}"""


def _any_case(pattern: str) -> str:
    """The pattern with its ASCII letters in either case, and no others that fold to them."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in pattern)


_KEYS = _any_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [("assign", _KEYS, 2, 6), *((r.kind, r.pattern, r.group, r.least) for r in secrets.RULES[1:])]
_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join(_spans(kind, o, pattern, group, least) for o, (kind, pattern, group, least) in enumerate(_KINDS))}),
g AS (SELECT k, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + size AS BIGINT), ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + size AS BIGINT), ',' ORDER BY s, o) AS spans FROM x GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (k)"""

_NEGATIVES = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY rank <= 3"""

#: Without SQL are operators that learn, sketch or iterate; tests hold them against brute force.
ORACLES = {"op11_fill_in_middle": _INFILL, "op12_secret_scan": _SECRETS, "op13_hard_negatives": _NEGATIVES}
