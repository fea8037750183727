"""OFX, QIF and CAMT.053 statements, and workbook sheets, by expressions over whole texts."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import printed_pence

#: A workbook with more rows or columns, or of more bytes unpacked, is refused as a whole: it's no statement.
MOST_ROWS, MOST_COLUMNS, MOST_UNPACKED = 20_000, 200, 200 << 20


class Refused(ValueError):
    """Why a workbook isn't read."""


def _leaf(block: Column, tag: str) -> Column:
    """Text of an element that may not be closed."""
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?is)<{tag}>([^<\r\n]*)", 1)), F.lit(""))


def ofx(texts: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Transactions of OFX and QFX texts with their account, closing balance, outcome and reason.

    Only pounds are read. A file in another currency, or without a transaction, has one row of outcome problem that
    says so; a transaction without a date or an amount is a problem of its own.
    """
    body = F.col(text)
    own = texts.select(key, _leaf(body, "ACCTID").alias("account"), printed_pence(_leaf(F.regexp_extract(body, r"(?is)<LEDGERBAL>(.*?)(?:</LEDGERBAL>|$)", 1), "BALAMT")).alias("closing_pence"), F.coalesce(_leaf(body, "CURDEF"), F.lit("GBP")).alias("currency"), F.regexp_extract_all(body, F.lit(r"(?is)<STMTTRN>(.*?)(?=</STMTTRN>|<STMTTRN>|</BANKTRANLIST>)"), F.lit(1)).alias("blocks"))
    refused = F.when(F.col("currency") != "GBP", F.concat(F.lit("not in pounds: "), "currency")).when(F.coalesce(F.size("blocks"), F.lit(0)) < 1, "no transactions")
    told = own.withColumn("refused", refused)
    rows = told.select(key, "account", "closing_pence", "refused", F.posexplode_outer(F.when(F.col("refused").isNull(), F.col("blocks"))).alias("pos", "b"))
    b = F.col("b")
    day, pence = F.try_to_timestamp(F.substring(_leaf(b, "DTPOSTED"), 1, 8), F.lit("yyyyMMdd")).cast("date"), printed_pence(_leaf(b, "TRNAMT"))
    reason = F.coalesce("refused", F.when(day.isNull(), "no date"), F.when(pence.isNull(), "no amount"))
    return rows.select(
        key, "account", "closing_pence", "pos", day.alias("date"), pence.alias("amount_pence"), _leaf(b, "TRNTYPE").alias("bank_type"), _leaf(b, "FITID").alias("ref"),
        F.concat_ws(" ", _leaf(b, "NAME"), _leaf(b, "MEMO")).alias("description"), F.when(reason.isNull(), "row").otherwise("problem").alias("outcome"), reason.alias("reason"),
    )


def qif(texts: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Transactions of QIF texts. Dates are day first unless a file has a second number over 12."""
    rows = texts.select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), r"^\s*!Type:[^\n]*\n", ""), r"\n\^[ \t]*\n?")).alias("pos", "b")).where("trim(b) <> ''")
    code = lambda c: F.nullif(F.regexp_extract(F.col("b"), rf"(?m)^{c}(.*)$", 1), F.lit(""))
    own = rows.select(key, "pos", F.regexp_replace(F.coalesce(code("D"), F.lit("")), "['.-]", "/").alias("day"), printed_pence(F.coalesce(code("T"), code("U"))).alias("amount_pence"), F.concat_ws(" ", code("P"), code("M")).alias("description"), code("L").alias("bank_category"))
    second = F.regexp_extract("day", r"^\d+/(\d+)/", 1).try_cast("int")
    american = F.coalesce(F.max(second).over(Window.partitionBy(key)) > 12, F.lit(False))
    read = lambda short, long: F.when(F.col("day").rlike(r"/\d{4}$"), F.try_to_timestamp("day", F.lit(long))).otherwise(F.try_to_timestamp("day", F.lit(short))).cast("date")
    return own.withColumn("date", F.when(american, read("M/d/yy", "M/d/yyyy")).otherwise(read("d/M/yy", "d/M/yyyy"))).drop("day")


def camt(texts: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Entries of CAMT.053 texts with outcome: only booked ones are rows. Namespace prefixes are dropped first."""
    body = F.regexp_replace(F.col(text), r"<(/?)[A-Za-z0-9]+:", "<$1")
    inner = lambda c, tag: F.nullif(F.trim(F.regexp_extract(c, rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>", 1)), F.lit(""))
    own = texts.select(key, inner(body, "IBAN").alias("account"), F.regexp_extract_all(body, F.lit(r"(?s)<Ntry(?: [^>]*)?>(.*?)</Ntry>"), F.lit(1)).alias("blocks"))
    rows = own.select(key, "account", F.posexplode("blocks").alias("pos", "e"))
    e = F.col("e")
    debit = (inner(e, "CdtDbtInd") == "DBIT") != F.coalesce(inner(e, "RvslInd") == "true", F.lit(False))
    status = F.coalesce(inner(inner(e, "Sts"), "Cd"), inner(e, "Sts"))
    pence = printed_pence(inner(e, "Amt"))
    return rows.select(key, "account", "pos", F.substring(F.coalesce(inner(inner(e, "BookgDt"), "Dt"), inner(inner(e, "BookgDt"), "DtTm")), 1, 10).cast("date").alias("date"), F.when(debit, -pence).otherwise(pence).alias("amount_pence"), F.concat_ws(" ", inner(inner(e, "RltdPties"), "Nm"), inner(e, "Ustrd")).alias("description"), F.when(status == "BOOK", "row").otherwise("skipped").alias("outcome"), F.when(status != "BOOK", F.concat(F.lit("not booked: "), status)).alias("reason"))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheets(book: zipfile.ZipFile, names: set[str]) -> list[str]:
    """The parts that hold sheets, in the workbook's order; by number where it doesn't say."""
    numbered = sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (int((re.findall("[0-9]+", n) or ["0"])[-1]), n))
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        return numbered
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    ids = [v for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet") for k, v in s.items() if k.endswith("}id")]
    told = [t.lstrip("/") if t.startswith("/") else f"xl/{t}" for t in map(lambda i: targets.get(i, ""), ids)]
    return [n for n in told if n in names] or numbered


def sheet_rows(content: bytes) -> list[tuple[int, list[str]]]:
    """Row numbers and cells of the first sheet with data; numbers have two decimals, dates day first."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_UNPACKED:
            raise Refused("too large")
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dated = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            custom = {f.get("numFmtId"): f.get("formatCode", "") for f in styles.iter(f"{_NS}numFmt")}
            forms = styles.find(f"{_NS}cellXfs")
            dated = {i for i, x in enumerate(forms if forms is not None else []) if int(x.get("numFmtId", 0)) in range(14, 23) or re.search("[dy]", custom.get(x.get("numFmtId"), ""))}
        for name in _sheets(z, names):
            out = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_NS}row"):
                cells: dict[int, str] = {}
                for c in row:
                    at = 0
                    for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(letter) - 64
                    value, kind = c.findtext(f"{_NS}v"), c.get("t")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif value is not None and kind in (None, "n"):
                        number = float(value)
                        value = (datetime.date(1899, 12, 30) + datetime.timedelta(days=int(number))).strftime("%d/%m/%Y") if int(c.get("s", 0)) in dated else str(int(number)) if number == int(number) else f"{number:.2f}"
                    if value is not None and at > MOST_COLUMNS:
                        raise Refused("too many columns")
                    if value is not None:
                        cells[at or len(cells) + 1] = value.strip()
                if any(cells.values()) and len(out) == MOST_ROWS:
                    raise Refused("too many rows")
                if any(cells.values()):
                    last = max(k for k, v in cells.items() if v)
                    out.append((int(row.get("r", len(out) + 1)), [cells.get(k, "") for k in range(1, last + 1)]))
            if out:
                return out
    return []


def workbooks(files: DataFrame, key: str = "file", content: str = "content") -> DataFrame:
    """key, line and cells of workbooks, in the form that delimited records have, and reason: a workbook that can't be
    read, or is too large, has one row without cells that says why. One bad file fails no other."""

    def read(body) -> list[tuple]:
        try:
            return [(n, cells, None) for n, cells in sheet_rows(body)] or [(None, None, "no data")]
        except Refused as e:
            return [(None, None, str(e))]
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, TypeError, EOFError, NotImplementedError, zlib.error) as e:
            return [(None, None, f"unreadable: {type(e).__name__}")]

    def run(batches):
        for p in batches:
            yield pd.DataFrame([(k, *row) for k, body in zip(p[key], p["__body"]) for row in read(body)], columns=[key, "line", "cells", "reason"]).astype({"line": "Int32"})

    own = files.select(key, F.col(content).alias("__body"))
    return own.mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, line int, cells array<string>, reason string")
