"""Queries of the operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import alignment, decontaminate, fingerprints, language_id, license_scan, line_dedup, near_dedup, ngram_join, packing
from lintlake.llm import periodic, pii, repeats, toxicity
from lintlake.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(hits)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens; texts without tokens give zeros."""
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the texts of which a tenth get a period planted; texts without words have no run."""
    planted = periodic.with_planted_period(table(spark, sf_dir, "documents"))
    return periodic.run_digest(periodic.periodic_runs(planted))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of linked texts; texts without words are linked with nothing."""
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_fingerprints": op2_fingerprints,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_personal_data": op4_personal_data,
    "op5_repeated_strings": op5_repeated_strings,
    "op6_language": op6_language,
    "op7_toxicity": op7_toxicity,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_ngram_join": op13_ngram_join,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE: dict[str, str] = {
    "op3_near_duplicates": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, {_AZ}), '[^\x20\x09-\x0D]+'), []) w FROM documents),
n AS (SELECT doc_id, w, least(5, len(w)) n FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + n], ' ') s FROM (SELECT *, unnest(range(len(w) - n + 1)) i FROM n)),
z AS (SELECT doc_id, count(*) z FROM s GROUP BY 1),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN z a ON x = a.doc_id JOIN z b ON y = b.doc_id WHERE 100 * i >= 75 * (a.z + b.z - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x),
m AS (SELECT doc_id, min(c) c FROM r GROUP BY 1)
SELECT doc_id, coalesce(z, 0)::BIGINT n_shingles, c component_id, doc_id = c kept FROM m LEFT JOIN z USING (doc_id)
""",
    "op13_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, {_AZ}), '[^\x20\x09-\x0D]+'), []) w FROM documents),
n AS (SELECT doc_id, w, least(4, len(w)) n FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + n], ' ') s FROM (SELECT *, unnest(range(len(w) - n + 1)) i FROM n)),
z AS (SELECT doc_id, count(*) z FROM s GROUP BY 1),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN z a ON x = a.doc_id JOIN z b ON y = b.doc_id WHERE 100 * i >= 85 * (a.z + b.z - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x),
m AS (SELECT doc_id, min(c) c FROM r GROUP BY 1)
SELECT doc_id, coalesce(z, 0)::BIGINT n_shingles, c component_id FROM m LEFT JOIN z USING (doc_id)
""",
    "op9_decontamination": rf"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
wb AS (SELECT item_id, least(13, len(w)) n, unnest(range(len(w) - least(13, len(w)) + 1)) i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') s FROM wb),
lens AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w FROM documents),
wd AS (SELECT doc_id, n, unnest(range(len(w) - n + 1)) i, w FROM d, lens WHERE len(w) >= n),
sd AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') s FROM wd),
hit AS (SELECT doc_id, sd.n, i, item_id FROM sd JOIN win ON sd.n = win.n AND sd.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) n_items, string_agg(id, ',' ORDER BY id) ids
       FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
       sha256(coalesce(ids, '')) items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op10_line_dedup": """
WITH d AS (SELECT doc_id, coalesce(source, '') site, coalesce(text, '') body, string_split(coalesce(text, ''), chr(10)) w FROM documents),
l AS (SELECT doc_id, site, body, unnest(w) line, unnest(range(len(w))) pos FROM d),
f AS (SELECT doc_id, site, md5(body) content, pos, lower(trim(line)) norm FROM l WHERE lower(trim(line)) <> ''),
bad AS (SELECT norm, min((doc_id, pos)) first FROM f GROUP BY norm HAVING count(DISTINCT site) >= 10 AND count(DISTINCT content) >= 10),
cut AS (SELECT doc_id, list(pos) cut FROM f JOIN bad USING (norm) WHERE (doc_id, pos) <> first GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_lines, coalesce(len(cut), 0)::BIGINT n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(cut, []), i - 1)), chr(10))) kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
""",
}
