"""The queries ``opN_<name>``, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veinstone.llm.common import table
from veinstone.llm.decontamination import decontaminate
from veinstone.llm.importance import importance_resampling
from veinstone.llm.jaccard_join import jaccard_join
from veinstone.llm.language_id import language_id
from veinstone.llm.packing import pack
from veinstone.llm.quality_rules import GRIDS, PATH, quality_rules
from veinstone.llm.secret_scan import RULES, secret_scan
from veinstone.llm.token_counts import token_counts
from veinstone.llm.url_filters import url_filters
from veinstone.llm.warc import round_trip

URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(table(spark, sf_dir, "pages"), URL_RULES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_importance_resampling": op2_importance_resampling,
    "op5_quality_rules": op5_quality_rules,
    "op7_secret_scan": op7_secret_scan,
    "op3_language_id": op3_language_id,
    "op6_warc": op6_warc,
    "op8_jaccard_join": op8_jaccard_join,
    "op4_token_counts": op4_token_counts,
    "op9_url_filters": op9_url_filters,
    "op10_packing": op10_packing,
}

#: A host or path that a rule's matches as SQL: host equal or below, path starts so.
_URL_CASES = [("example.org/en/1", "example.org", "/en/1", "block"), ("example.org/es/", "example.org", "/es/", "block"), ("com/fr/", "com", "/fr/", "allow"), ("com/de/", "com", "/de/", "block"), ("org/", "org", "/", "allow")]
_URL_FITS = [(rule, f"(('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}'))", verdict) for rule, h, p, verdict in _URL_CASES]

_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _FOLDED.format("coalesce(text, '')") + r", '[0-9a-z\x{80}-\x{10FFFF}]+')"

_OP1 = f"""
    WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item, unnest([array_to_string(w[i:least(i + 9, len(w))], ' ') for i in range(1, greatest(len(w) - 9, 1) + 1)]) AS win, least(len(w), 10) AS n
        FROM items WHERE len(w) > 0),
    docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    places AS (
        SELECT doc_id, n, unnest([{{'pos0': i, 'win': array_to_string(w[i:i + n - 1], ' ')}} for i in range(1, len(w) - n + 2)]) AS p
        FROM docs, (SELECT DISTINCT n FROM windows)),
    hits AS (SELECT doc_id, item, p.pos0 AS pos0, windows.n AS n FROM places JOIN windows ON p.win = windows.win AND places.n = windows.n),
    words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(pos0, pos0 + n)) AS pos FROM (SELECT DISTINCT doc_id, pos0, n FROM hits)) GROUP BY doc_id),
    named AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hits GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)"""

_OP5_MEASURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)", "exclaim_share": "exclaims / greatest(n_words, 1)", "caps_share": "caps / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)", "mean_word": "word_chars / greatest(n_words, 1)",
}
_OP5 = f"""
    WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
    wins AS (SELECT doc_id, unnest([{{'pos0': i, 'win': array_to_string(w[i:i + 7], ' ')}} for i in range(1, len(w) - 6)]) AS p FROM texts),
    twice AS (SELECT doc_id, p.pos0 AS pos0 FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, p.win) > 1),
    repeats AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(pos0, pos0 + 8)) AS pos FROM twice) GROUP BY doc_id),
    counts AS (
        SELECT doc_id, lang, md5(text) AS print, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
               CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
               len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS exclaims, len(regexp_extract_all(text, '\\b[A-Z]{{3,}}')) AS caps
        FROM texts LEFT JOIN repeats USING (doc_id)),
    measured AS (SELECT *, {", ".join(f"{m_sql} AS {m}" for m, m_sql in _OP5_MEASURES.items())} FROM counts),
    good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) >= 1),
    held AS (SELECT DISTINCT lang, print, {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in GRIDS)} FROM measured JOIN good USING (doc_id) WHERE lang IS NOT NULL AND n_words > 0),
    firsts AS (SELECT lang, count(*) AS n_path FROM held WHERE print < '8' GROUP BY lang),
    grid AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {c}::DOUBLE)" for m, g in GRIDS.items() for c in g)}) t(m, c)),
    path AS (SELECT * FROM (VALUES {", ".join(f"({k}, {t}::DOUBLE)" for k, t in enumerate(PATH))}) t(k, share)),
    long AS ({" UNION ALL ".join(f"SELECT lang, '{m}' AS m, {m} AS v FROM held WHERE print < '8'" for m in GRIDS)}),
    tried AS (SELECT lang, m, c, count(*) FILTER (v > c) AS rejected FROM long JOIN grid USING (m) GROUP BY ALL),
    cuts AS (SELECT lang, k, m, min(c) AS cut FROM tried JOIN firsts USING (lang), path WHERE rejected <= share * n_path GROUP BY lang, k, m),
    wide AS (SELECT lang, k, {", ".join(f"max(cut) FILTER (m = '{m}') AS cut_{m}" for m in GRIDS)} FROM cuts GROUP BY lang, k),
    sets AS (SELECT lang, k, {", ".join(f"cut_{m}" for m in GRIDS)} FROM (SELECT lang, k FROM firsts, path) LEFT JOIN wide USING (lang, k)),
    tests AS (SELECT lang, k, count(*) AS n, count(*) FILTER ({" OR ".join(f"coalesce({m} > cut_{m}, false)" for m in GRIDS)}) AS x
              FROM held JOIN sets USING (lang) WHERE print >= '8' GROUP BY lang, k),
    strata AS (SELECT DISTINCT lang, n FROM tests),
    level AS (SELECT 0.05 / count(*) AS d FROM strata),
    terms AS (SELECT lang, n, unnest(range(0, CAST(ceil(n * 0.06) AS BIGINT) + 1)) AS k FROM strata),
    sums AS (SELECT lang, k, sum(exp(CASE WHEN n = k THEN 0 ELSE (n - k) * ln(0.94) END + lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.06))) OVER (PARTITION BY lang ORDER BY k) AS cdf FROM terms),
    allowed AS (SELECT lang, coalesce(max(k) FILTER (cdf <= d), -1) AS most FROM sums, level GROUP BY lang),
    passed AS (SELECT lang, k, bool_and(x <= most) OVER (PARTITION BY lang ORDER BY k) AS proved FROM tests JOIN allowed USING (lang)),
    last AS (SELECT lang, max(k) AS k FROM passed WHERE proved GROUP BY lang),
    final AS (SELECT sets.* FROM sets JOIN last USING (lang, k)),
    verdict AS (SELECT *, {" + ".join(f"coalesce({m} > cut_{m}, false)::INT" for m in GRIDS)} AS cut_rules, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
                FROM measured LEFT JOIN final USING (lang))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cut_rules, NOT base_failed AND cut_rules = 0 AS kept FROM verdict"""


_OP8 = """
    WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:least(i + 4, len(w))], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM texts WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    edges AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)),
    reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)"""


def _op7() -> str:
    def matches(i: int, kind: str, rx: str, group: int, least: int) -> str:
        rx = rx.replace("'", "''")
        return f"""
        SELECT doc_id, {i} AS o, '{kind}' AS kind, unnest([{{'s': list_sum([length(x) for x in gaps[1:k]]) + coalesce(list_sum([length(x) for x in found[1:k - 1]]), 0), 'n': length(found[k]), 'part': length(part[k])}} for k in range(1, len(found) + 1)]) AS m, {least} AS least
        FROM (SELECT doc_id, string_split_regex(text, '{rx}') AS gaps, regexp_extract_all(text, '{rx}') AS found, regexp_extract_all(text, '{rx}', {group}) AS part FROM texts)"""

    union = " UNION ALL ".join(matches(i, r.kind, r.pattern, r.group, r.least) for i, r in enumerate(RULES))
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({union}),
    spans AS (SELECT doc_id, o, m.s AS s, kind || ':' || CAST(m.s AS BIGINT) || ':' || CAST(m.s + m.n AS BIGINT) AS span FROM found WHERE m.part >= least),
    per AS (SELECT doc_id, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS b, count(*) FILTER (o = 2) AS c,
                   string_agg(span, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(span, ',' ORDER BY s, o) AS every
            FROM spans GROUP BY doc_id)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
    FROM documents LEFT JOIN per USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": _OP1,
    "op5_quality_rules": _OP5,
    "op7_secret_scan": _op7(),
    "op8_jaccard_join": _OP8,
    "op9_url_filters": f"""
        WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut)
        SELECT page_id, host, path,
               CASE {" ".join(f"WHEN {fits} THEN '{rule}'" for rule, fits, _ in _URL_FITS)} END AS rule,
               CASE {" ".join(f"WHEN {fits} THEN '{verdict}'" for _, fits, verdict in _URL_FITS)} ELSE 'allow' END AS verdict
        FROM parts""",
}
