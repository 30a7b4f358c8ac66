"""SQL of the queries: common table expressions, and for each query what selects from them."""

from __future__ import annotations

import re

from veinstone.operators import status as U
from veinstone.operators.filings import ITEMS, LABELS, RISK_ITEMS
from veinstone.plans import queries as Q
from veinstone.sources import star


def values(rows: list[tuple], columns: str) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") t({columns})"


def terms(dictionaries: list[tuple[int, int, int, str]]) -> str:
    rows = sorted({(t, d, p, k.strip().upper()) for t, d, p, words in dictionaries for k in words.split(",")})
    return values([(*r, i) for i, r in enumerate(rows)], "dictionary_type, dictionary_id, path_id, key_word, term_id")


def scored(pairs: str, by: str) -> str:
    return f"""SELECT *, factor1 / factor2 AS score FROM (
        SELECT {by}, count(*) AS factor1, avg(CASE WHEN d > 0 THEN 1.0::DOUBLE / d END) AS factor2 FROM ({pairs}) GROUP BY ALL) WHERE factor2 IS NOT NULL"""


def places_of(source: str, columns: list[str]) -> str:
    ids = ", ".join(columns)
    return f"SELECT DISTINCT document_id, {ids}, pos FROM (SELECT document_id, {ids}, unnest([{ids}]) AS term_id FROM {source}) JOIN places USING (document_id, term_id)"


def normed(source: str, by: str = "document_id") -> str:
    return f"SELECT *, score * 100 / max(score) OVER (PARTITION BY {by}) AS score_normalized FROM ({source})"


def with_mitigation(spots: str, columns: list[str]) -> str:
    ids = ", ".join(columns)
    return scored(f"SELECT s.document_id, {', '.join('s.' + c for c in columns)}, m.term_id AS mitigation_term_id, abs(s.pos - m.pos) AS d FROM {spots} s JOIN places m ON s.document_id = m.document_id AND m.dictionary_type = 1002 AND abs(s.pos - m.pos) <= 25", f"document_id, {ids}, mitigation_term_id")


def hit_rows(words: str, dictionary: str) -> str:
    return f"""SELECT document_id, dictionary_type, dictionary_id, path_id, key_word, term_id, pos FROM {words} JOIN {dictionary} t
               ON CASE WHEN key_word IN ('IT', 'I', 'T', '') THEN word = key_word ELSE upper(word) = key_word END"""


def stats(source: str, by: str) -> str:
    return f"""SELECT sector_id, year, {by}, cluster_count_all, CAST(cluster_count_all // n_documents AS BIGINT) AS cluster_count, round(score, 6) AS score,
                      round(score * 100 / max(score) OVER (PARTITION BY sector_id, year), 6) AS score_normalized
               FROM (SELECT sector_id, year, {by}, count(*) AS cluster_count_all, avg(score) AS score FROM {source} GROUP BY ALL) JOIN sector_docs USING (sector_id, year)"""


def averages(source: str, by: str, where: str = "true") -> str:
    return f"SELECT {by}, count(*) AS pathways, round(avg(score_normalized), 6) AS score FROM {source} WHERE {where} GROUP BY ALL"


KEY = "company_name, sector_id, year, exposure_path_name"
#: HTML without tags, as text.
PLAIN = r"replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce({}, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"


def header(label: str) -> str:
    return f"nullif(trim(regexp_extract(header, '(?s)^.*(?:^|\\n)[^\\S\\n]*{label}[^\\S\\n]*([^\\n]*)', 1)), '')"


def _headers() -> str:
    return "SELECT *, coalesce(try_cast(nullif(regexp_extract(coalesce(sic, ''), '\\d+'), '') AS INT), 0) AS sic_code_4_digit FROM (SELECT filing_id, " + ", ".join(f"{header(v)} AS {k}" for k, v in LABELS.items()) + " FROM parts)"


def _triangle(name: str, source: str) -> str:
    most = "OVER (PARTITION BY sector_id, year)"
    return f"""SELECT c.*, s.sector_{name} FROM (SELECT {KEY}, s * 100 / max(s) {most} AS company_{name} FROM (SELECT {KEY}, avg(score) AS s FROM {source} GROUP BY ALL)) c
        JOIN (SELECT sector_id, year, exposure_path_name, s * 100 / max(s) {most} AS sector_{name} FROM (SELECT sector_id, year, exposure_path_name, avg(score) AS s FROM {source} GROUP BY ALL)) s
        ON c.sector_id = s.sector_id AND c.year = s.year AND c.exposure_path_name = s.exposure_path_name"""


def xml_tag(name: str, value: str) -> str:
    escaped = f"replace(replace(replace(replace(replace({value}, '&', '&amp;'), chr(34), '&quot;'), chr(39), '&apos;'), '<', '&lt;'), '>', '&gt;')"
    return f"'<{name}>' || {escaped} || '</{name}>' || chr(10)"


FOUR = ["exp_term_id1", "exp_term_id2", "int_term_id1", "int_term_id2"]
CTES: dict[str, str] = {
    "docs": "SELECT doc_id AS document_id, source AS company_name, CAST(2015 + doc_id % 5 AS INT) AS year, CAST(1 + doc_id % 2 AS INT) AS content_type, CAST(CAST(substr(source, 4) AS INT) % 4 AS INT) AS sector_id, text FROM documents",
    "sector_docs": "SELECT sector_id, year, count(*) AS n_documents FROM docs GROUP BY ALL",
    "words": r"""SELECT document_id, unnest(w) AS raw, generate_subscripts(w, 1) AS pos FROM (
        SELECT document_id, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]|\?', ' ', 'g'), '[\t\n\x0B\f\r\x1C-\x1F ]+'), lambda x: x <> '') AS w FROM docs)""",
    "tokens": "SELECT document_id, pos, regexp_replace(raw, '[^A-Za-z0-9 /-]+', '', 'g') AS word FROM words",
    "terms": terms(star.DICTIONARIES), "terms_nested": terms(Q.NESTED), "terms_cased": terms(Q.CASED),
    "places": hit_rows("tokens", "terms"), "places_nested": hit_rows("tokens", "terms_nested"), "places_cased": hit_rows("tokens", "terms_cased"),
    "esg": values(star.ESG, "esg_category_id, esg_category_name"), "impact": values(star.IMPACT, "impact_category_id, esg_category_id, impact_category_name"),
    "pathway": values(star.PATHWAYS, "exposure_path_id, impact_category_id, exposure_path_name"), "internal": values(star.INTERNALIZATIONS, "internalization_id, exposure_path_id, internalization_name"),
    "mitigation": values(star.MITIGATIONS, "mitigation_id, dictionary_id, class_name, sub_class_name"), "sectors": values(star.SECTORS, "sector_id, sector_name"),
    "pathways": "SELECT * FROM pathway JOIN impact USING (impact_category_id) JOIN esg USING (esg_category_id)",
    "insight": normed(scored("""SELECT l.document_id, l.dictionary_type, l.dictionary_id, l.path_id, l.term_id AS term_id1, r.term_id AS term_id2, l.key_word AS key_word1, r.key_word AS key_word2, abs(l.pos - r.pos) AS d
        FROM places l JOIN places r ON l.document_id = r.document_id AND l.dictionary_type = r.dictionary_type AND l.dictionary_id = r.dictionary_id AND l.term_id < r.term_id AND abs(l.pos - r.pos) BETWEEN 1 AND 25
        WHERE l.dictionary_type <> 1002""", "document_id, dictionary_type, dictionary_id, path_id, term_id1, term_id2, key_word1, key_word2"), "document_id, dictionary_type"),
    "exposures": "SELECT * FROM (SELECT *, path_id AS exposure_path_id FROM insight WHERE dictionary_type = 1000) JOIN pathways USING (exposure_path_id) JOIN (SELECT * EXCLUDE text FROM docs) USING (document_id)",
    "internals": "SELECT * FROM insight WHERE dictionary_type = 1001",
    "exp_spots": places_of("exposures", ["term_id1", "term_id2"]), "int_spots": places_of("internals", ["term_id1", "term_id2"]),
    "exp_int": normed(scored("""SELECT e.document_id, e.term_id1 AS exp_term_id1, e.term_id2 AS exp_term_id2, i.term_id1 AS int_term_id1, i.term_id2 AS int_term_id2, abs(e.pos - i.pos) AS d
        FROM exp_spots e JOIN int_spots i ON e.document_id = i.document_id AND abs(e.pos - i.pos) <= 25""", "document_id, " + ", ".join(FOUR))),
    "mit_exp": normed(with_mitigation("exp_spots", ["term_id1", "term_id2"])), "mit_int": normed(with_mitigation("int_spots", ["term_id1", "term_id2"])),
    "strong": "SELECT * FROM exp_int WHERE score_normalized > 10", "strong_spots": places_of("strong", FOUR),
    "mit_exp_int": normed(f"SELECT * FROM ({with_mitigation('strong_spots', FOUR)}) WHERE score > 50"),
    "d": "SELECT * EXCLUDE text FROM docs",
    "int_names": "SELECT internalization_id, internalization_name FROM internal",
    "exp_mit_rows": "SELECT x.*, d.* EXCLUDE document_id, p.* FROM mit_exp x JOIN d USING (document_id) JOIN terms t ON x.term_id1 = t.term_id JOIN pathways p ON t.path_id = p.exposure_path_id",
    "int_mit_rows": "SELECT x.*, d.* EXCLUDE document_id, p.* FROM mit_int x JOIN d USING (document_id) JOIN terms t ON x.term_id1 = t.term_id JOIN internal i ON t.path_id = i.internalization_id JOIN pathways p ON i.exposure_path_id = p.exposure_path_id",
    "exp_int_rows": "SELECT x.*, d.* EXCLUDE document_id, p.*, i.* FROM exp_int x JOIN d USING (document_id) JOIN terms t ON x.exp_term_id1 = t.term_id JOIN terms s ON x.int_term_id1 = s.term_id JOIN pathways p ON t.path_id = p.exposure_path_id JOIN int_names i ON s.path_id = i.internalization_id",
    "exp_int_mit_rows": "SELECT x.*, d.* EXCLUDE document_id, p.*, i.* EXCLUDE exposure_path_id FROM mit_exp_int x JOIN d USING (document_id) JOIN terms t ON x.exp_term_id1 = t.term_id JOIN terms s ON x.int_term_id1 = s.term_id JOIN pathways p ON t.path_id = p.exposure_path_id JOIN internal i ON s.path_id = i.internalization_id AND i.exposure_path_id = p.exposure_path_id",
    "exp_mit_class": "SELECT r.*, class_name, sub_class_name FROM exp_mit_rows r JOIN terms t ON r.mitigation_term_id = t.term_id JOIN mitigation m ON t.dictionary_id = m.dictionary_id",
    "yoy": f"SELECT *, exposure_score * 100 / max(exposure_score) OVER (PARTITION BY sector_id, year, company_name) AS exposure_score_normalized FROM (SELECT {KEY}, avg(score) AS exposure_score FROM exposures GROUP BY ALL)",
    "sec_e": "SELECT *, max(s) OVER (PARTITION BY sector_id, year) AS most FROM (SELECT sector_id, year, exposure_path_name, avg(score) AS s FROM exposures GROUP BY ALL)",
    "sec_c": "SELECT *, max(s) OVER (PARTITION BY sector_id, year) AS most FROM (SELECT sector_id, year, exposure_path_name, avg(score) AS s FROM exp_mit_rows GROUP BY ALL)",
    "com_c": f"SELECT {KEY}, avg(score) AS c FROM exp_mit_rows GROUP BY ALL",
    "sec_ranked": "SELECT *, s * 100 / most AS sector_exposure FROM sec_e QUALIFY row_number() OVER (PARTITION BY sector_id, year ORDER BY s DESC, exposure_path_name) <= 10",
    "top10": """SELECT y.company_name, y.year, y.sector_id, y.exposure_path_name, CAST(r.rank AS INT) AS rank, r.sector_exposure,
        y.exposure_score * 100 / r.most AS company_exposure, coalesce(c.s * 100 / c.most, 0.0) AS sector_control, coalesce(k.c * 100 / c.most, 0.0) AS company_control
        FROM yoy y JOIN (SELECT *, row_number() OVER (PARTITION BY sector_id, year ORDER BY sector_exposure DESC, exposure_path_name) AS rank FROM sec_ranked) r USING (sector_id, year, exposure_path_name)
        LEFT JOIN sec_c c USING (sector_id, year, exposure_path_name) LEFT JOIN com_c k ON k.company_name = y.company_name AND k.sector_id = y.sector_id AND k.year = y.year AND k.exposure_path_name = y.exposure_path_name""",
    "context": values(Q.CONTEXT, "key_word, related, action"),
    "known": "SELECT key_word, related, bool_or(action = 'EXCLUDE') AS excluded FROM context GROUP BY ALL",
    "upper_words": "SELECT document_id, pos, upper(word) AS related FROM tokens WHERE word <> ''",
    "pairs": "SELECT v.related, t.dictionary_type, t.dictionary_id, t.key_word FROM (SELECT DISTINCT related FROM upper_words) v JOIN terms t ON contains(v.related, t.key_word) AND v.related <> t.key_word WHERE NOT EXISTS (SELECT 1 FROM terms o WHERE o.dictionary_id = t.dictionary_id AND o.key_word = v.related)",
    "related": "SELECT document_id, dictionary_type, dictionary_id, p.key_word, p.related, pos, CASE WHEN excluded IS NULL THEN 'UNKNOWN' WHEN excluded THEN 'EXCLUDE' ELSE 'INCLUDE' END AS status FROM upper_words JOIN pairs p USING (related) LEFT JOIN known k ON p.key_word = k.key_word AND p.related = k.related",
    "nested": "SELECT document_id, dictionary_id, key_word, list_sort(list(pos)) AS locs FROM places_nested GROUP BY ALL",
    "nested_pairs": "SELECT a.document_id, a.dictionary_id, a.key_word, b.key_word AS merged_with, list_concat(a.locs, list_filter(b.locs, lambda x: NOT list_contains(a.locs, x))) AS locs FROM nested a JOIN nested b ON a.document_id = b.document_id AND a.dictionary_id = b.dictionary_id AND contains(b.key_word, a.key_word) AND a.key_word <> b.key_word",
    "flagged": "SELECT document_id, company_name, year, sector_id, CAST(document_id % 3 AS INT) AS exposure_ind, CAST((document_id // 3) % 3 AS INT) AS internalization_ind, CAST((document_id // 9) % 3 AS INT) AS mitigation_ind FROM docs",
    "review_lines": values([(x,) for x in Q.REVIEW], "line"),
    "reviewed": "SELECT upper(trim(p[1])) AS key_word, upper(trim(p[2])) AS related, CASE WHEN upper(trim(p[3])) = 'INCLUDE' THEN 'INCLUDE' ELSE 'EXCLUDE' END AS action FROM (SELECT string_split(line, ':') AS p FROM review_lines) WHERE len(p) >= 3",
    "current_rows": values(Q.CURRENT, "key_word, related, action"),
    "index_lines": values([(x,) for x in Q.INDEX], "line"),
    "change": "SELECT company_name, year, exposure_path_name, avg(exposure_score) AS ei, CAST(year % 7 - 3 + length(company_name) AS DOUBLE) AS change FROM yoy GROUP BY ALL",
    "filings": values(Q.FILINGS, "filing_id, content").replace("SELECT *", "SELECT CAST(filing_id AS BIGINT) AS filing_id, content", 1) + """
        UNION ALL SELECT document_id + 1000, 'COMPANY CONFORMED NAME:' || chr(9) || company_name || chr(10) || 'CITY: C' || document_id || chr(10) || '<DOCUMENT>' || chr(10) || 'Index.' || chr(10) || 'Item 1. Business' || chr(10)
        || 'Item 1A. Risks' || chr(10) || 'Item 9C. Other' || chr(10) || '.' || chr(10) || 'Item 1. ' || coalesce(text, '') || '.' || chr(10) || 'ITEM 1A. Risk of ' || document_id
        || CASE WHEN document_id % 5 = 0 THEN '.' || chr(10) || 'Item 9A. a.' || chr(10) || 'Item 9A. b.' || chr(10) || 'Item 9A. c.' || chr(10) || 'CITY: BODY' || chr(10) || '</DOCUMENT>' ELSE '.' || chr(10) || '</DOCUMENT>' END FROM docs""",
    "parts": r"""SELECT filing_id, CASE WHEN opened = 0 THEN content ELSE substr(content, 1, opened - 1) END AS header, CASE WHEN opened = 0 OR body = '' THEN content ELSE body END AS body
        FROM (SELECT *, instr(content, '<DOCUMENT>') AS opened, regexp_extract(content, '(?s)<DOCUMENT>(.*?)</DOCUMENT>', 1) AS body FROM filings)""",
    "plain_text": "SELECT filing_id, regexp_replace(" + PLAIN.format("body") + r", '[^\x00-\x7F]', '', 'g') AS text FROM parts",
    "broken": r"SELECT filing_id, regexp_replace(replace(regexp_replace(text, '([\w\r:.;) *])\n', '\1<LINESEP>', 'g'), chr(10), ''), '(?i)<LINESEP>\s*Part I+[^\w]*', '<LINESEP>', 'g') AS text FROM plain_text",
    "numbered": r"""SELECT filing_id, array_to_string(list_transform(generate_series(1, len(gaps)), lambda i: gaps[i] || coalesce('ITEM' || number[i] || upper(letter[i]), '')), '') AS text FROM (
        SELECT filing_id, string_split_regex(marked, '\x01[^\x02]*\x02') AS gaps, regexp_extract_all(marked, '\x01(\d+)~([A-Ca-c]?)\x02', 1) AS number, regexp_extract_all(marked, '\x01(\d+)~([A-Ca-c]?)\x02', 2) AS letter
        FROM (SELECT filing_id, regexp_replace(text, '(?i)\bitem\s*(\d+)(?:\s*([A-C]))?([\s.:])', chr(1) || '\1~\2' || chr(2) || '\3', 'g') AS marked FROM broken))""",
    "mentions": r"""SELECT filing_id, text, unnest(list_transform(generate_series(1, len(found)), lambda k: {'item': item[k], 'at': CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS BIGINT)})) AS m
        FROM (SELECT filing_id, text, string_split_regex(text, '<LINESEP>\s*ITEM\d+\w?') AS gaps, regexp_extract_all(text, '<LINESEP>\s*ITEM\d+\w?') AS found, regexp_extract_all(text, '<LINESEP>\s*ITEM(\d+\w?)', 1) AS item FROM numbered)""",
    "item_names": "SELECT unnest(" + str(list(ITEMS)) + ") AS item, unnest(range(1, " + str(len(ITEMS) + 1) + ")) AS place",
    "item_places": "SELECT filing_id, place, list_sort(list(m.at)) AS ats FROM mentions JOIN item_names ON m.item = item_names.item GROUP BY ALL",
    "walked": f"""SELECT filing_id, place, pick, failed FROM (WITH RECURSIVE walk AS (
        SELECT filing_id, 0 AS place, CAST(NULL AS BIGINT) AS latest, CAST(NULL AS BIGINT) AS pick, false AS failed FROM numbered
        UNION ALL SELECT filing_id, place, coalesce(pick, latest), pick, failed OR coalesce(fails, false) FROM (
            SELECT w.filing_id, w.place + 1 AS place, w.latest, w.failed, len(ats) > 2 AND w.place + 1 > 1 AND w.latest IS NULL AS fails,
                   CASE WHEN ats IS NULL THEN NULL WHEN len(ats) <= 2 THEN ats[-1] WHEN w.place = 0 THEN ats[2] ELSE list_filter(ats, lambda x: x > w.latest)[1] END AS pick
            FROM walk w LEFT JOIN item_places i ON w.filing_id = i.filing_id AND w.place + 1 = i.place WHERE w.place < {len(ITEMS)}))
        SELECT * FROM walk)""",
    "outcomes": "SELECT filing_id, CASE WHEN bool_or(coalesce(failed, false)) THEN 'failed' WHEN count(pick) = 0 THEN 'item zero' ELSE 'full' END AS status FROM walked GROUP BY filing_id",
    "taken": "SELECT w.filing_id, w.place, w.pick AS start FROM walked w JOIN outcomes o ON w.filing_id = o.filing_id AND o.status = 'full' WHERE w.pick IS NOT NULL",
    "ended": "SELECT a.filing_id, a.place, a.start, arg_min(b.start, b.place) AS finish FROM taken a LEFT JOIN taken b ON a.filing_id = b.filing_id AND b.place > a.place AND b.start > a.start GROUP BY ALL",
    "section_rows": r"""SELECT filing_id, status, item, start, regexp_replace(regexp_replace(raw, '^[ \t\n\r]+', ''), '[ \t\n\r]+$', '') AS section FROM (
        SELECT e.filing_id, 'full' AS status, item, e.start, replace(substr(text, e.start + 1, coalesce(finish, length(text)) - e.start), '<LINESEP>', chr(10)) AS raw FROM ended e JOIN numbered USING (filing_id) JOIN item_names USING (place)
        UNION ALL SELECT filing_id, status, '0', behind, replace(substr(text, behind + 1), '<LINESEP>', chr(10)) FROM (SELECT filing_id, status, text, CAST(greatest(instr(text, 'ACCESSION NUMBER:') - 1, 0) AS BIGINT) AS behind FROM numbered JOIN outcomes USING (filing_id) WHERE status <> 'full'))""",
    "header_rows": _headers(),
    "staged": "SELECT document_id, company_name, year, sector_id, " + ", ".join(f"CAST(document_id // {i + 1} % 3 AS INT) AS {n}" for i, n in enumerate(Q.STAGES)) + ", " + ", ".join(f"CAST(document_id // {20 + i} % 3 AS INT) AS {f}_validation" for i, f in enumerate(U.FLAGS)) + " FROM docs",
    "types": values(U.DOCUMENT_TYPES, "content_type, document_type"),
    "page_text": "SELECT page_id, " + PLAIN.format("html") + " AS text FROM pages",
    "changes": "SELECT * EXCLUDE (s), round(s, 6) AS score, round(s / nullif(lag(s) OVER (PARTITION BY company_name, exposure_path_name ORDER BY year), 0) - 1, 6) AS pct_change FROM (SELECT company_name, exposure_path_name, year, avg(exposure_score) AS s FROM yoy GROUP BY ALL)",
    "split_change": "SELECT *, substr(md5(company_name || '|' || year || '|' || exposure_path_name), 1, 2) < '55' AS held FROM change",
    "fit": "SELECT regr_slope(change, ei) AS slope, regr_intercept(change, ei) AS intercept, count(*) AS n_train FROM split_change WHERE NOT held",
    "tri": f"SELECT {KEY}, " + ", ".join(f"company_{n}, sector_{n}" for n in ("ei", "em", "im")) + " FROM " + " JOIN ".join(f"({_triangle(n, t)})" + (f" USING ({KEY})" if n != "ei" else "") for n, t in (("ei", "exp_int_rows"), ("em", "exp_mit_rows"), ("im", "int_mit_rows"))),
}


def joined(column: str) -> str:
    return f"array_to_string({column}, ',')"


def six(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


FACTORS = "factor1, " + six("factor2", "score", "score_normalized")
HITS = f"SELECT document_id, dictionary_type, dictionary_id, key_word, count(*) AS frequency, {joined('list_sort(list(pos))')} AS locations FROM {{}} GROUP BY ALL"


def versus() -> str:
    path = "esg_category_name, exposure_path_name, year"
    pages = {"exposure": ("exposures", path), "internalization": ("exp_int_rows", f"{path}, internalization_name"), "mitigation": ("exp_mit_class", f"{path}, class_name, sub_class_name")}
    sides = {"company": ("company_name", "'src1'"), "competitor": ("company_name", "'src5'"), "sector": ("sector_id", "1")}
    one = lambda page, rows, by, side, col, v: f"SELECT '{page}' AS page, '{side}' AS side, CAST(row_number() OVER (ORDER BY score DESC, name) AS INT) AS rank, name, score FROM (SELECT concat_ws('/', {by}) AS name, score FROM ({averages(rows, f'{col}, {by}')}) WHERE {col} = {v}) QUALIFY rank <= 10"
    return " UNION ALL ".join(f"({one(page, rows, by, side, col, v)})" for page, (rows, by) in pages.items() for side, (col, v) in sides.items())


def api() -> str:
    here, ten = "company_name = 'src1' AND year = 2016", f"(SELECT * EXCLUDE (sector_exposure, company_exposure, sector_control, company_control), {six('sector_control', 'company_control')} FROM top10)"
    charts = {
        "triangle": (f"(SELECT exposure_path_name, year, {', '.join(f'round(round({c}, 6), 0) AS {c}' for c in TRI)} FROM tri WHERE {here})", TRI),
        "yoy": ("(SELECT y.exposure_path_name, y.year, round(round(exposure_score, 6), 0) AS exposure_score, round(round(exposure_score_normalized, 6), 0) AS exposure_score_normalized FROM yoy y JOIN top10 t ON y.company_name = t.company_name AND y.year = t.year AND y.exposure_path_name = t.exposure_path_name WHERE y.company_name = 'src1')", ["exposure_score", "exposure_score_normalized"]),
        "control": (f"(SELECT y.exposure_path_name, y.year, round(round(y.exposure_score, 6), 0) AS exposure_score, round(t.company_control, 0) AS control FROM yoy y JOIN {ten} t USING (company_name, year, exposure_path_name) WHERE company_name = 'src1' AND year = 2016)", ["exposure_score", "control"]),
        "top10": (f"(SELECT exposure_path_name, year, sector_control, company_control FROM {ten} WHERE {here})", ["sector_control", "company_control"]),
    }
    return " UNION ALL ".join(f"SELECT '{n}' AS chart, exposure_path_name, year, '{m}' AS measure, {m} AS value FROM {rows}" for n, (rows, ms) in charts.items() for m in ms)


TRI = [f"{who}_{n}" for n in ("ei", "em", "im") for who in ("company", "sector")]
TABLES = {"exposure": "insight WHERE dictionary_type = 1000 AND", "internalization": "insight WHERE dictionary_type = 1001 AND", "mitigation_exposure": "mit_exp WHERE", "mitigation_internalization": "mit_int WHERE", "exposure_internalization": "exp_int WHERE document_id % 11 <> 0 AND", "mitigation_exposure_internalization": "mit_exp_int WHERE"}
XML = (
    "'<?xml version=\"1.0\" encoding=\"ascii\"?>' || chr(10) || '<Document>' || chr(10) || '<HEADER>' || chr(10) || " + " || ".join(f"coalesce({xml_tag(k.upper(), k)}, '')" for k in LABELS)
    + " || '</HEADER>' || chr(10) || '<ITEMS>' || chr(10) || items || '</ITEMS>' || chr(10) || '</Document>'"
)
ITEM_XML = "'<ITEM' || item || '>' || " + xml_tag("X", "section").removeprefix("'<X>' || ").removesuffix(" || '</X>' || chr(10)") + " || chr(10) || '</ITEM' || item || '>' || chr(10)"
COMPANIES = "SELECT document_id, company_id FROM docs LEFT JOIN (SELECT company_name, year, row_number() OVER (ORDER BY company_name, year) + 1000 AS company_id FROM (SELECT DISTINCT company_name, year FROM docs WHERE year % 2 = 0)) USING (company_name, year)"
RISK = f">Item(?:\\s|&#160;|&nbsp;)(?:{RISK_ITEMS})\\.?|ITEM\\s(?:{RISK_ITEMS})"
WIDE = ", ".join(f"md5(max(section) FILTER (item = '{i}')) AS form_item{i.lower()}" for i in ("0", *ITEMS))
SELECTS: dict[str, str] = {
    "tokenize_counts": "SELECT document_id, count(*) AS n_tokens, count(*) FILTER (word = '') AS n_empty, count(DISTINCT upper(word)) AS n_distinct FROM tokens GROUP BY ALL",
    "keyword_hits": HITS.format("places"),
    "keyword_hits_case_sensitive": HITS.format("places_cased"),
    "related_words": "SELECT dictionary_id, key_word, status, count(DISTINCT related) AS n_related, count(*) AS n_places FROM related GROUP BY ALL",
    "related_unknown": "SELECT DISTINCT key_word || ':' || related || ':INCLUDE' AS line FROM related WHERE status = 'UNKNOWN'",
    "validation_failures": "SELECT document_id, dictionary_type, count(DISTINCT key_word || ':' || related) AS unknown_words FROM related WHERE status = 'UNKNOWN' GROUP BY ALL",
    "keyword_hits_included": HITS.format("(SELECT document_id, dictionary_type, dictionary_id, key_word, pos FROM places UNION SELECT document_id, dictionary_type, dictionary_id, key_word, pos FROM related WHERE status = 'INCLUDE')"),
    "keyword_hits_merged": f"""SELECT document_id, dictionary_id, key_word, merged_with, CAST(len(locs) AS BIGINT) AS frequency, {joined('locs')} AS locations FROM (
        SELECT * FROM nested_pairs UNION ALL SELECT document_id, dictionary_id, key_word, NULL, locs FROM nested n WHERE NOT EXISTS (SELECT 1 FROM nested_pairs p WHERE p.document_id = n.document_id AND p.dictionary_id = n.dictionary_id AND n.key_word IN (p.key_word, p.merged_with)))""",
    "insight_two_factor": f"SELECT document_id, dictionary_type, dictionary_id, key_word1, key_word2, {FACTORS} FROM insight",
    "insight_exp_int": f"SELECT document_id, {', '.join(FOUR)}, {FACTORS} FROM exp_int",
    "insight_mit_exp": f"SELECT document_id, term_id1, term_id2, mitigation_term_id, {FACTORS} FROM mit_exp",
    "insight_mit_int": f"SELECT document_id, term_id1, term_id2, mitigation_term_id, {FACTORS} FROM mit_int",
    "insight_mit_exp_int": f"SELECT document_id, {', '.join(FOUR)}, mitigation_term_id, {FACTORS} FROM mit_exp_int",
    "fd_factor": "SELECT l.document_id, l.dictionary_type, l.dictionary_id, l.key_word, CAST(l.pos AS INT) AS pos, count(*) AS neighbours, round(coalesce(sum(CASE WHEN l.pos <> r.pos THEN 1.0::DOUBLE / abs(l.pos - r.pos) END), 0.0), 6) AS fd_factor FROM places l JOIN places r ON l.document_id = r.document_id AND l.dictionary_id = r.dictionary_id AND l.dictionary_type = r.dictionary_type AND abs(l.pos - r.pos) <= 25 GROUP BY ALL",
    "sector_exposure": stats("exposures", "esg_category_name, exposure_path_id, exposure_path_name"),
    "exposure_sector_norm": "SELECT document_id, sector_id, year, key_word1, key_word2, round(score, 6) AS score, round(score * 100 / max(score) OVER (PARTITION BY sector_id, year), 6) AS score_normalized FROM exposures",
    "sector_exp_int": stats("exp_int_rows", "esg_category_name, exposure_path_name, internalization_name"),
    "sector_exp_mit": stats("exp_mit_class", "esg_category_name, exposure_path_id, exposure_path_name"),
    "sector_exp_int_mit": stats("exp_int_mit_rows", "esg_category_name, exposure_path_id, exposure_path_name, internalization_id, internalization_name"),
    "report_exposure": "SELECT * EXCLUDE (s), round(s, 6) AS score, round(s * 100 / max(s) OVER (PARTITION BY document_id), 6) AS score_normalized FROM (SELECT sector_id, company_name, year, document_id, content_type, esg_category_name, exposure_path_id, exposure_path_name, count(*) AS cluster_count, avg(score) AS s FROM exposures GROUP BY ALL)",
    "report_unique_keywords": f"SELECT document_id, path_id, {joined('list_sort(list(DISTINCT k))')} AS unique_key_words FROM (SELECT document_id, path_id, unnest([key_word1, key_word2]) AS k FROM insight WHERE dictionary_type = 1000) GROUP BY ALL",
    "dash_exposure": averages("exposures", "company_name, year, content_type, esg_category_name, exposure_path_name", "content_type = 1"),
    "dash_sector_exposure": averages("exposures JOIN sectors USING (sector_id)", "sector_name, year, esg_category_name, exposure_path_name", "year = 2016"),
    "dash_internalization": averages("exp_int_rows", "company_name, year, exposure_path_name, internalization_name"),
    "dash_mitigation": averages("exp_mit_class", "company_name, year, exposure_path_name, class_name, sub_class_name"),
    "sector_vs_company": f"SELECT 'company' AS kind, company_name AS name, year, exposure_path_name, pathways, score FROM ({averages('exposures', 'company_name, year, exposure_path_name')}) UNION ALL SELECT 'sector', sector_name, year, exposure_path_name, pathways, score FROM ({averages('exposures JOIN sectors USING (sector_id)', 'sector_name, year, exposure_path_name')})",
    "chart_yoy": f"SELECT {KEY}, {six('exposure_score', 'exposure_score_normalized')} FROM yoy",
    "chart_yoy_top5": f"SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY exposure_score DESC, company_name, exposure_path_name) AS INT) AS rank FROM (SELECT {KEY}, {six('exposure_score', 'exposure_score_normalized')} FROM yoy WHERE sector_id = 1) QUALIFY rank <= 5",
    "chart_top10": f"SELECT company_name, year, sector_id, exposure_path_name, rank, {six('sector_exposure', 'company_exposure', 'sector_control', 'company_control')} FROM top10",
    "chart_exposure_control": "SELECT company_name, year, exposure_path_name, round(company_exposure, 4) AS company_exposure, round(company_control, 4) AS company_control, CASE WHEN round(company_control, 4) >= 50 THEN 'green' ELSE 'red' END AS colour FROM top10 WHERE company_control > 0",
    "chart_yoy_of_top10": "SELECT y.company_name, y.year, y.exposure_path_name, round(exposure_score, 6) AS exposure_score FROM yoy y JOIN top10 t ON y.company_name = t.company_name AND y.year = t.year AND y.exposure_path_name = t.exposure_path_name",
    "top10_ranked": f"SELECT *, CAST(row_number() OVER (ORDER BY score DESC, company_name, year, exposure_path_name) AS INT) AS rank FROM ({averages('exposures', 'company_name, year, exposure_path_name')}) QUALIFY rank <= 10",
    "processing_status": "SELECT count(*) AS documents, " + ", ".join(f"count(*) FILTER ({f}_ind = {v}) AS {f}_{n}" for f in ("exposure", "internalization", "mitigation") for n, v in (("pending", 0), ("failed", 2))) + " FROM flagged",
    "pending_worklist": "SELECT document_id, company_name, year, sector_name, mitigation_ind FROM flagged JOIN sectors USING (sector_id) WHERE mitigation_ind IN (0, 2) AND exposure_ind = 1 AND internalization_ind = 1",
    "sector_worklist": "SELECT sector_id, year, count(*) AS documents, count(DISTINCT company_name) AS companies FROM flagged WHERE exposure_ind IN (0, 2) GROUP BY ALL",
    "batch_ids": "SELECT *, row_number() OVER (ORDER BY year, sector_id) + 1000 AS batch_id FROM (SELECT year, sector_id, count(*) AS documents FROM docs GROUP BY ALL)",
    "review_flags": "SELECT document_id, strlen(coalesce(text, '')) AS n_bytes, CAST(strlen(coalesce(text, '')) < 10000 AS INT) AS flagged_for_review FROM docs",
    "lookup_lists": "SELECT 'sector' AS list, sector_name AS entry FROM docs JOIN sectors USING (sector_id) UNION SELECT 'year', CAST(year AS VARCHAR) FROM docs UNION SELECT 'company', sector_name || '/' || company_name FROM docs JOIN sectors USING (sector_id) UNION SELECT 'document type', CASE WHEN content_type = 1 THEN 'Sustainability Report' ELSE '10-K' END FROM docs",
    "sectors_of_documents": "SELECT coalesce(sector_name, 'unmapped') AS sector_name, count(DISTINCT company_name) AS companies, count(DISTINCT year) AS years FROM docs LEFT JOIN (SELECT * FROM sectors WHERE sector_id <> 3) USING (sector_id) GROUP BY ALL",
    "dictionary_merge": f"SELECT key_word, action, {joined('list_sort(list(DISTINCT related))')} AS related FROM (SELECT key_word, related, action FROM current_rows UNION ALL SELECT key_word, related, action FROM reviewed) GROUP BY ALL",
    "dictionary_review": "SELECT key_word, related, CASE WHEN bool_or(action = 'INCLUDE') THEN 'INCLUDE' ELSE 'EXCLUDE' END AS action FROM reviewed GROUP BY ALL",
    "edgar_index_parse": "SELECT try_cast(p[1] AS BIGINT) AS cik, p[2] AS name, p[3] AS form, try_cast(replace(p[4], '-', '') AS INT) AS filing_date, p[5] AS path, p[1] || '-' || string_split(p[5], '/')[-1] AS file_name FROM (SELECT string_split(line, '|') AS p FROM index_lines) WHERE len(p) = 5 AND try_cast(p[1] AS BIGINT) IS NOT NULL AND try_cast(replace(p[4], '-', '') AS INT) IS NOT NULL AND contains(p[3], '10-K')",
    "html_to_text": "SELECT page_id, length(text) AS n_chars, md5(text) AS text_md5, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) + 4 * len(regexp_extract_all(text, '&')) + 5 * len(regexp_extract_all(text, '[\"'']')) + 3 * len(regexp_extract_all(text, '[<>]')) AS n_escaped FROM page_text",
    "factorize_paths": "SELECT *, row_number() OVER (ORDER BY first, source) - 1 AS code FROM (SELECT source, min(doc_id) AS first FROM documents GROUP BY ALL)",
    "stock_allocation": "SELECT company_name, year, exposure_path_name, change, round(ei, 6) AS ei, round(coalesce(change * ei / nullif(sum(ei) OVER (PARTITION BY company_name, year), 0), 0), 6) AS allocated FROM change",
    "group_sums": "SELECT company_name, round(sum(change), 6) AS change, round(sum(ei), 6) AS ei FROM change GROUP BY ALL",
    "standardize": "SELECT company_name, year, exposure_path_name, change, round(ei, 6) AS ei, round((ei - avg(ei) OVER ()) / nullif(stddev_pop(ei) OVER (), 0), 6) AS standardized FROM change",
    "melt_metrics": "SELECT company_name, year, exposure_path_name, 'ei' AS metric, round(ei, 6) AS value FROM change UNION ALL SELECT company_name, year, exposure_path_name, 'change', change FROM change",
    "pivot_metrics": "SELECT company_name, year, " + ", ".join(f"round(max({m}) FILTER (exposure_path_name = '{p}'), 6) AS \"{p} - {m}\"" for p in ("Emissions", "Safety") for m in ("ei", "change")) + " FROM change GROUP BY ALL",
    "chart_triangulation": f"SELECT {KEY}, {six(*TRI)} FROM tri",
    "avg_rank_pathways": "SELECT company_name, exposure_path_name, max(r) AS average_rank, count(*) AS n FROM (SELECT company_name, exposure_path_name, rank() OVER (PARTITION BY company_name ORDER BY exposure_path_name) + (count(*) OVER (PARTITION BY company_name, exposure_path_name) - 1) / 2 AS r FROM exposures) GROUP BY ALL",
    "score_pct_change": "SELECT * FROM changes",
    "complete_companies": f"SELECT * FROM ({COMPANIES}) JOIN (SELECT * EXCLUDE text FROM docs) USING (document_id) WHERE company_id IS NOT NULL AND year >= 2016",
    "dash_rounded": f"SELECT * REPLACE (round_even(score, 2) AS score) FROM ({averages('exposures', 'company_name, year, content_type, esg_category_name, exposure_path_name', 'content_type = 1')})",
    "mit_exp_sector_norm": "SELECT document_id, sector_id, year, term_id1, term_id2, mitigation_term_id, round(score, 6) AS score, round(score * 100 / max(score) OVER (PARTITION BY sector_id, year), 6) AS score_normalized FROM mit_exp JOIN d USING (document_id)",
    "document_upsert": "SELECT document_id, company_name, year, sector_id, " + ", ".join(f"CASE WHEN document_id % 7 = 0 THEN 0 ELSE {n} END AS {n}" for n in Q.STAGES) + ", CAST(CASE WHEN document_id % 7 = 0 THEN 8 ELSE 7 END AS INT) AS batch_id FROM staged",
    "all_counters": "SELECT " + ", ".join([f"count(*) FILTER ({n} = 0 AND {f}_validation = 1) AS {n}_pending" for n, f in zip(U.SEARCHES, U.FLAGS)] + [f"count(*) FILTER ({n} = 0) AS {n}_pending" for n in U.INSIGHTS] + [f"count(*) FILTER ({n} = 2) AS {n}_failed" for n in U.SEARCHES]) + " FROM staged",
    "gated_worklists": " UNION ALL ".join(f"SELECT '{n}' AS stage, document_id FROM staged WHERE {n} = 0 AND " + " AND ".join(f"{x} = 1" for x in needs) for n, needs in U.NEEDS.items()),
    "validation_states": "SELECT document_id, " + ", ".join(f"{f}_before" for f in U.FLAGS) + ", " + ", ".join(f"CAST(CASE WHEN {f}_before IN (0, 2) AND {f}_search = 0 THEN 1 ELSE {f}_before END AS INT) AS {f}_validation" for f in U.FLAGS) + " FROM (SELECT *, CAST(CASE WHEN document_id % 4 = 0 THEN 2 ELSE exposure_validation END AS INT) AS exposure_before, internalization_validation AS internalization_before, CAST(CASE WHEN document_id % 10 = 0 THEN 0 ELSE mitigation_validation END AS INT) AS mitigation_before FROM staged)",
    "pending_sources": "SELECT document_id AS id, company_name || ' ' || year || ' ' || document_type || '.txt' AS document_name, ['pdf', 'webpage', 'file'][document_id % 3 + 1] AS source_type, 'https://example.org/' || document_id AS source_url FROM docs JOIN types USING (content_type) WHERE document_id % 4 = 0",
    "company_ids": COMPANIES,
    "unmapped_documents": "SELECT document_id, sector_id FROM docs WHERE sector_id = 3",
    "filings_by_industry": "SELECT document_id, sic_code, industry_title, company_name FROM (SELECT *, sector_id + 1000 AS sic_code FROM docs WHERE year = 2016 AND content_type = 2 AND document_id % 4 = 1) JOIN (" + values(Q.INDUSTRIES, "sic_code, industry_title") + ") USING (sic_code) WHERE industry_title LIKE 'Oil%'",
    "sector_companies": "SELECT DISTINCT company_name FROM docs JOIN sectors USING (sector_id) WHERE sector_name = 'Finance'",
    "first_lookups": "SELECT sector_id AS lookup_id, sector_name AS description FROM sectors UNION ALL SELECT content_type + 100, document_type FROM types ORDER BY 1 LIMIT 5",
    "event_days": "SELECT CAST(day AS INT) AS day, 'events_' || day || '.csv' AS file_name, events FROM (SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS events FROM events GROUP BY ALL)",
    "telemetry_rating": "SELECT event_type, records, round(seconds, 6) AS seconds, round(records / seconds, 6) AS per_second, round(seconds * 1000 / records, 6) AS ms_per_record, CASE WHEN records / seconds > 1000 THEN 'excellent' WHEN records / seconds > 500 THEN 'very good' WHEN records / seconds > 100 THEN 'good' WHEN records / seconds > 50 THEN 'fair' ELSE 'needs work' END AS rating FROM (SELECT event_type, count(*) AS records, max(epoch_us(ts) / 3600000000) - min(epoch_us(ts) / 3600000000) AS seconds FROM events GROUP BY ALL)",
    "train_regression": "SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, n_train, count(*) AS n_test, round(avg(abs(change - guess)), 6) AS mae, round(avg((change - guess) ** 2), 6) AS mse, round(sqrt(avg((change - guess) ** 2)), 6) AS rmse FROM (SELECT *, slope * ei + intercept AS guess FROM split_change, fit WHERE held) GROUP BY ALL",
    "tune_regression": "SELECT unnest(['trees', 'linear']) AS model, count(*) FILTER (NOT held) AS n_train, count(*) FILTER (held) AS n_test, unnest([4, 2])::BIGINT AS candidates, true AS consistent FROM split_change",
    "hits_sink": HITS.format("(SELECT * FROM places WHERE NOT (document_id % 3 = 0 AND dictionary_type = 1000 AND pos > 50))"),
    "insight_sinks": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows, count(DISTINCT document_id) AS documents, round(sum(score), 3) AS score FROM {t} document_id % 5 <> 0" for n, t in TABLES.items()),
    "csv_exchange": "SELECT company_name AS company, year, round(exposure_score, 6) AS ei FROM yoy",
    "workbook_sheets": "SELECT company_name, year, round(exposure_score, 6) AS value, 'yoy' AS sheet FROM yoy UNION ALL SELECT company_name, year, round(exposure_score_normalized, 6), 'normalized' FROM yoy",
    "archived_documents": "SELECT document_id, length(text) AS n_chars, md5(text) AS text_md5 FROM docs",
    "document_pages": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS INT) AS page, length(coalesce(text, '')) AS n_chars FROM conversations",
    "report_exposure_all": "SELECT sector_id, company_name, year, document_id, content_type, esg_category_name, exposure_path_id, exposure_path_name, count(*) AS cluster_count, round(avg(score_normalized), 6) AS score_normalized, document_type FROM exposures JOIN types USING (content_type) GROUP BY ALL",
    "exposure_read": "SELECT *, CAST(row_number() OVER (ORDER BY score_normalized DESC, document_id, exposure_path_id) AS INT) AS rank FROM (SELECT company_name, year, document_id, exposure_path_id, cluster_count, round(s * 100 / max(s) OVER (PARTITION BY document_id), 6) AS score_normalized FROM (SELECT company_name, year, document_id, content_type, exposure_path_id, count(*) AS cluster_count, avg(score) AS s FROM exposures GROUP BY ALL) WHERE company_name = 'src1' AND content_type = 2)",
    "sector_exposure_read": f"SELECT esg_category_name, exposure_path_name, cluster_count, score_normalized FROM ({stats('exposures', 'esg_category_name, exposure_path_id, exposure_path_name')}) JOIN sectors USING (sector_id) WHERE year = 2016 AND sector_name = 'Finance'",
    "sector_internalization_read": f"SELECT esg_category_name, exposure_path_name, internalization_name, cluster_count, score_normalized FROM ({stats('exp_int_rows', 'esg_category_name, exposure_path_name, internalization_name')}) JOIN sectors USING (sector_id) WHERE year = 2016 AND sector_name = 'Finance'",
    "sector_mitigation_read": f"SELECT esg_category_name, exposure_path_name, internalization_name, class_name, sub_class_name, cluster_count, score_normalized FROM ({stats('(SELECT r.*, class_name, sub_class_name FROM exp_int_mit_rows r JOIN terms t ON r.mitigation_term_id = t.term_id JOIN mitigation m ON t.dictionary_id = m.dictionary_id)', 'esg_category_name, exposure_path_name, internalization_name, class_name, sub_class_name')}) JOIN sectors USING (sector_id) WHERE year = 2016 AND sector_name = 'Finance'",
    "financial_metrics": "SELECT company_name, year AS reporting_year, " + ", ".join(f"count(*) * {i + 1} / 4 AS {m}" for i, m in enumerate(Q.METRICS)) + ", 'X' || count(*) AS exchange_ref FROM docs WHERE company_name = 'src1' AND year = 2016 GROUP BY ALL",
    "top10_versus": versus(),
    "api_measures": api(),
    "escape_forms": "SELECT page_id, md5(replace(replace(replace(replace(replace(h, '&', '&amp;'), chr(34), '&quot;'), chr(39), '&apos;'), '<', '&lt;'), '>', '&gt;')) AS xml_md5, md5(replace(h, chr(39), chr(39) || chr(39))) AS sql_md5, md5(h) AS text_md5 FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)",
    "tenk_header": "SELECT * FROM header_rows",
    "tenk_sections": "SELECT filing_id, status, item, start, md5(section) AS section_md5 FROM section_rows",
    "tenk_wide": f"SELECT filing_id, {WIDE} FROM section_rows GROUP BY filing_id",
    "tenk_xml": f"SELECT filing_id, length(xml) AS n_chars, md5(xml) AS xml_md5 FROM (SELECT filing_id, {XML} AS xml FROM header_rows JOIN (SELECT filing_id, string_agg({ITEM_XML}, '' ORDER BY coalesce(place, 0)) AS items FROM section_rows LEFT JOIN item_names USING (item) GROUP BY filing_id) USING (filing_id))",
    "tenk_last_items": f"""SELECT filing_id, lower(regexp_replace(regexp_replace(m.t, '&#160;|&nbsp;', '', 'g'), '[\\s.>]', '', 'g')) AS item, max(m.at) AS start FROM (
        SELECT filing_id, unnest(list_transform(generate_series(1, len(found)), lambda k: {{'t': found[k], 'at': CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS BIGINT)}})) AS m
        FROM (SELECT filing_id, string_split_regex(content, '{RISK}') AS gaps, regexp_extract_all(content, '{RISK}') AS found FROM filings)) GROUP BY ALL""",
    "extraction_status": "SELECT status, count(*) AS filings FROM outcomes GROUP BY ALL",
    "dictionary_apply": "SELECT DISTINCT key_word, related, action, 1 AS applied, 0 AS again FROM (SELECT * FROM current_rows UNION ALL SELECT * FROM reviewed)",
    "review_listing": "SELECT *, CAST(row_number() OVER (ORDER BY key_word, related, action) AS INT) AS line FROM (SELECT DISTINCT * FROM reviewed)",
    "error_metrics": "SELECT round(avg(abs(ei - change)), 6) AS mae, round(avg((ei - change) ** 2), 6) AS mse, round(sqrt(avg((ei - change) ** 2)), 6) AS rmse FROM change",
}


def statement(select: str) -> str:
    """The select behind the expressions that it needs, in their order."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(CTES[name])

    visit(select)
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in need) + "\n" if need else "") + select


ORACLE_SQL = {name: statement(select) for name, select in SELECTS.items()}
