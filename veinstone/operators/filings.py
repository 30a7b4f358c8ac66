"""Structure of annual filings: headers and numbered items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.functions.text import ascii_only, html_text, sic_code, xml_escape

#: Labels of a filing's header, its items in their order, and the items that ``last_items`` looks for.
LABELS = {
    "conformed_name": "COMPANY CONFORMED NAME:", "sic": "STANDARD INDUSTRIAL CLASSIFICATION:", "irs_number": "IRS NUMBER:", "state_of_inc": "STATE OF INCORPORATION:", "fiscal_year_end": "FISCAL YEAR END:",
    "form_type": "FORM TYPE:", "street": "STREET 1:", "city": "CITY:", "state": "STATE:", "zip": "ZIP:",
}
ITEMS = ("1", "1A", "1B", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "9C", "10", "11", "12", "13", "14", "15", "16")
RISK_ITEMS = "1A|1B|7A|7|8"
BREAK = "<LINESEP>"
#: What a filing's extraction came to: its items, all of it as item zero, or an item whose start can't be told.
FULL, ZERO, FAILED = "full", "item zero", "failed"


def document_part(filings: DataFrame) -> DataFrame:
    """``header`` and ``body``: the first DOCUMENT element and what stands before it; without one all is body, and header too."""
    at = F.instr("content", "<DOCUMENT>")
    body = F.regexp_extract("content", r"(?s)<DOCUMENT>(.*?)</DOCUMENT>", 1)
    whole = (at == 0) | (body == "")
    return filings.select("filing_id", F.when(at == 0, F.col("content")).otherwise(F.substring(F.col("content"), F.lit(1), at - 1)).alias("header"), F.when(whole, F.col("content")).otherwise(body).alias("body"))


def header_fields(filings: DataFrame) -> DataFrame:
    """The labelled values of headers, the last of several, null where missing, and the first number of the SIC (0 without). What stands in the document isn't header."""
    header = document_part(filings).select("filing_id", "header")
    found = {n: F.regexp_extract("header", rf"(?s)^.*(?:^|\n)[^\S\n]*{label}[^\S\n]*([^\n]*)", 1) for n, label in LABELS.items()}
    rows = header.select("filing_id", *(F.nullif(F.trim(c), F.lit("")).alias(n) for n, c in found.items()))
    return rows.withColumn("sic_code_4_digit", sic_code(F.coalesce("sic", F.lit(""))))


def marked_lines(text: pd.Series) -> pd.Series:
    text = text.str.replace(r"(?<=[\w\r:.;) *])\n", BREAK, regex=True).str.replace("\n", "", regex=False)
    text = text.str.replace(BREAK + r"\s*Part I+[^\w]*", BREAK, regex=True, flags=re.I)
    text = text.str.replace(r"(?i)\bitem\s*(\d+)\s*([A-Ca-c])?\b(?=[\s.:])", lambda m: f"ITEM{m[1]}{(m[2] or '').upper()}", regex=True)
    return text


def starts(text: str) -> dict[str, int] | None:
    """Where each item starts. Of one place that, of two the later; of more the later of the first two for item 1, and for others the
    first after the start of the item that was accepted last. None if one of those has no item before it."""
    places: dict[str, list[int]] = {}
    for m in re.finditer(re.escape(BREAK) + r"\s*ITEM(\d+\w?)", text):
        if m[1] in ITEMS:
            places.setdefault(m[1], []).append(m.start())
    taken: dict[str, int] = {}
    last: int | None = None
    for item in ITEMS:
        at = places.get(item, [])
        if not at:
            continue
        if len(at) <= 2:
            pick = at[-1]
        elif item == "1":
            pick = at[1]
        elif last is None:
            return None
        else:
            later = [x for x in at if x > last]
            if not later:
                continue
            pick = later[0]
        taken[item] = last = pick
    return taken


def sections(filings: DataFrame) -> DataFrame:
    """``filing_id, status, item, start, section``: an item ends where the first later item with a greater start begins.

    Filings without items, or whose items can't be told apart (``FAILED``), give one row, item ``0``, with the text from
    ACCESSION NUMBER on, if it is there, else all of it. Which of several places an item starts at depends on the item
    before, so a filing is worked through in Python, one at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for filing, text in zip(df["filing_id"], marked_lines(df["text"]), strict=True):
                taken = starts(text)
                order = list((taken or {}).items())
                for i, (item, start) in enumerate(order):
                    end = next((s for _, s in order[i + 1 :] if s > start), len(text))
                    out.append((filing, FULL, item, start, text[start:end].replace(BREAK, "\n").strip(" \t\n\r")))
                if not order:
                    at = max(text.find("ACCESSION NUMBER:"), 0)
                    out.append((filing, FAILED if taken is None else ZERO, "0", at, text[at:].replace(BREAK, "\n").strip(" \t\n\r")))
            yield pd.DataFrame(out, columns=["filing_id", "status", "item", "start", "section"])

    body = document_part(filings).select("filing_id", ascii_only(html_text(F.col("body"))).alias("text"))
    return body.mapInPandas(run, "filing_id long, status string, item string, start long, section string")


def wide(parts: DataFrame) -> DataFrame:
    """A row for each filing with a column ``form_item<N>`` for item zero and each of the others."""
    rows = parts.groupBy("filing_id").pivot("item", ["0", *ITEMS]).agg(F.first("section"))
    return rows.select("filing_id", *(F.col(f"`{i}`").alias(f"form_item{i.lower()}") for i in ("0", *ITEMS)))


def status_counts(parts: DataFrame) -> DataFrame:
    """Filings by what their extraction came to."""
    return parts.select("filing_id", "status").distinct().groupBy("status").agg(F.count("*").alias("filings"))


def assembled(headers: DataFrame, parts: DataFrame) -> DataFrame:
    """``filing_id, xml``: header fields and items of a filing as one XML document, with escaped texts."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), xml_escape(value), F.lit(f"</{name}>\n"))
    head = F.concat(*(F.coalesce(tag(n.upper(), F.col(n)), F.lit("")) for n in LABELS))
    place = F.create_map(*(F.lit(x) for i, n in enumerate(("0", *ITEMS)) for x in (n, i)))
    item = F.concat(F.lit("<ITEM"), "item", F.lit(">"), xml_escape(F.col("section")), F.lit("\n</ITEM"), "item", F.lit(">\n"))
    # at most 23 items to a filing
    items = parts.groupBy("filing_id").agg(F.array_sort(F.collect_list(F.struct(F.element_at(place, F.col("item")).alias("place"), item.alias("xml")))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["xml"]), "")
    xml = F.concat(F.lit('<?xml version="1.0" encoding="ascii"?>\n<Document>\n<HEADER>\n'), head, F.lit("</HEADER>\n<ITEMS>\n"), body, F.lit("</ITEMS>\n</Document>"))
    return headers.join(items, "filing_id").select("filing_id", xml.alias("xml"))


def last_items(filings: DataFrame) -> DataFrame:
    """``filing_id, item, start``: of the items on risk, management's talk and statements the last mention in the raw content, by code points from 0."""
    pattern = rf">Item(?:\s|&#160;|&nbsp;)(?:{RISK_ITEMS})\.?|ITEM\s(?:{RISK_ITEMS})"
    found, gaps = F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), F.split("content", pattern, -1)
    each = F.arrays_zip(F.transform(gaps, lambda x: F.char_length(x)).alias("gap"), found.alias("text"))
    rows = filings.select("filing_id", F.posexplode(each).alias("i", "x")).select("filing_id", "i", "x.gap", "x.text")
    # a filing's mentions are few; offsets are sums over those before
    ends = F.sum(F.col("gap") + F.coalesce(F.char_length("text"), F.lit(0))).over(_by_filing())
    name = F.lower(F.regexp_replace(F.regexp_replace("text", "&#160;|&nbsp;", ""), r"[\s.>]", ""))
    rows = rows.withColumn("start", ends - F.char_length("text")).filter("text IS NOT NULL")
    return rows.groupBy("filing_id", name.alias("item")).agg(F.max("start").cast("long").alias("start"))


def _by_filing():
    from pyspark.sql import Window as W

    return W.partitionBy("filing_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
