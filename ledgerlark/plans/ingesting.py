"""Statement reading over texts that are written from the driver tables: one statement an account."""

from __future__ import annotations

import datetime
import io
import zipfile

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.money import pounds
from ..sources import delimited, files, markup
from .adapter import MOVEMENT, movements, with_sql
from .registry import query


def _bodies(rows, line, head=None, tail=None, order=("date", "id")):
    """A text for each account: a line for each of its movements between head and tail."""
    joined = rows.withColumn("line", line).groupBy("account_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n").alias("body"))
    return joined.select(F.col("account_id").alias("file"), F.concat(*[x for x in (head, F.col("body"), tail) if x is not None]).alias("text"))


def _csv(spark, sf_dir):
    """Account by account: a signed export with headings, one with two columns and newest first, one with fees and states."""
    rows = movements(spark, sf_dir)
    shown, day = pounds(F.col("amount_pence")), F.date_format("date", "dd/MM/yyyy")
    signed = _bodies(rows.where("account_id % 3 = 0"), F.concat_ws(",", day, F.concat(F.lit('"'), F.col("text"), F.lit(', main\nstore"')), F.lit("r1"), F.lit("CARD"), shown, F.lit("10.00"), F.lit("GROCERIES")), F.lit("Date,Counter Party,Reference,Type,Amount (GBP),Balance (GBP),Spending Category\n"))
    size = pounds(F.abs("amount_pence"))
    two = _bodies(rows.where("account_id % 3 = 1").withColumn("k", -F.unix_date("date")).withColumn("j", -F.col("id")), F.concat_ws(",", day, F.lit("DEB"), F.lit("11-22-33"), F.lit("12345678"), F.col("text"), F.when(F.col("amount_pence") < 0, size).otherwise(""), F.when(F.col("amount_pence") > 0, size).otherwise(""), F.lit("1.00")), F.lit("Transaction Date,Transaction Type,Sort Code,Account Number,Transaction Description,Debit Amount,Credit Amount,Balance\n"), order=("k", "j"))
    fees = _bodies(rows.where("account_id % 3 = 2"), F.concat_ws(",", F.lit("CARD_PAYMENT"), F.lit("Current"), F.date_format("date", "yyyy-MM-dd 10:00:00"), F.date_format("date", "yyyy-MM-dd 10:00:00"), F.col("text"), shown, F.when(F.col("id") % 4 == 0, "0.50").otherwise("0.00"), F.lit("GBP"), F.when(F.col("id") % 5 == 0, "PENDING").otherwise("COMPLETED"), F.lit("5.00")), F.lit("Type,Product,Started Date,Completed Date,Description,Amount,Fee,Currency,State,Balance\n"))
    return signed.unionByName(two).unionByName(fees)


@query(with_sql(MOVEMENT) + """, p AS (SELECT account_id AS file, CASE account_id % 3 WHEN 0 THEN 'starling' WHEN 1 THEN 'lloyds-halifax' ELSE 'revolut' END AS layout, CASE WHEN account_id % 3 = 2 AND id % 5 = 0 THEN 'skipped' ELSE 'row' END AS outcome,
        date, id, part, CASE part WHEN 0 THEN -50 ELSE amount_pence END AS amount_pence, CASE account_id % 3 WHEN 0 THEN text || ', main' || chr(10) || 'store r1' ELSE text END AS description
        FROM movement, (SELECT unnest([0, 1]) AS part) WHERE part = 1 OR (account_id % 3 = 2 AND id % 4 = 0 AND id % 5 <> 0))
    SELECT file, layout, outcome, date, amount_pence, description, CAST(row_number() OVER (PARTITION BY file ORDER BY date, id, part) AS INTEGER) AS pos FROM p""")
def S11_csv_layouts(spark, sf_dir):
    return delimited.parsed(_csv(spark, sf_dir)).select("file", "layout", "outcome", "date", "amount_pence", "description", "pos")


@query(with_sql(MOVEMENT) + "SELECT account_id AS file, CAST(count(*) AS BIGINT) AS rows, ',' AS mark, 'csv' AS kind FROM movement GROUP BY 1")
def S4_csv_records(spark, sf_dir):
    texts = _csv(spark, sf_dir)
    told = texts.select("file", delimited.delimiter(F.col("text")).alias("mark"), files.kind_of(F.col("text").cast("binary"))["kind"].alias("kind"))
    counted = delimited.headed(delimited.records(texts)).groupBy("file").agg(F.count("*").alias("rows"))
    return counted.join(told, "file").select("file", "rows", "mark", "kind")


_PARSED = "SELECT account_id AS file, CAST(row_number() OVER (PARTITION BY account_id ORDER BY date, id) - 1 AS INTEGER) AS pos, date, amount_pence, text AS description FROM movement"


@query(with_sql(MOVEMENT) + _PARSED.replace("text AS description", "text || ' memo' AS description"))
def S8_ofx(spark, sf_dir):
    block = F.concat(F.lit("<STMTTRN><TRNTYPE>DEBIT\n<DTPOSTED>"), F.date_format("date", "yyyyMMdd"), F.lit("120000\n<TRNAMT>"), pounds(F.col("amount_pence")), F.lit("\n<FITID>"), F.col("id").cast("string"), F.lit("\n<NAME>"), F.col("text"), F.lit("\n<MEMO>memo\n</STMTTRN>"))
    head, tail = F.lit("OFXHEADER:100\n\n<OFX><CURDEF>GBP\n<BANKACCTFROM><ACCTID>12345678\n</BANKACCTFROM><BANKTRANLIST>\n"), F.lit("\n</BANKTRANLIST><LEDGERBAL><BALAMT>12.34\n</LEDGERBAL></OFX>")
    return markup.ofx(_bodies(movements(spark, sf_dir), block, head, tail)).where("outcome = 'row'").select("file", "pos", "date", "amount_pence", "description")


@query(with_sql(MOVEMENT) + _PARSED)
def S9_qif(spark, sf_dir):
    """Month first in files that have a day after the twelfth, which tells it, day first in all others."""
    many = movements(spark, sf_dir)
    late = F.max(F.day("date")).over(Window.partitionBy("account_id")) > 12
    shown = F.when(F.col("late"), F.date_format("date", "MM/dd/yyyy")).otherwise(F.date_format("date", "dd/MM/yyyy"))
    block = F.concat(F.lit("D"), shown, F.lit("\nT"), pounds(F.col("amount_pence")), F.lit("\nP"), F.col("text"), F.lit("\n^"))
    return markup.qif(_bodies(many.withColumn("late", late), block, F.lit("!Type:Bank\n"))).select("file", "pos", "date", "amount_pence", "description")


@query(with_sql(MOVEMENT) + _PARSED.replace("text AS description", "text AS description, CASE WHEN id % 6 = 0 THEN 'skipped' ELSE 'row' END AS outcome"))
def S10_camt(spark, sf_dir):
    debit = F.when(F.col("amount_pence") < 0, "DBIT").otherwise("CRDT")
    block = F.concat(F.lit('<ns:Ntry><ns:Amt Ccy="GBP">'), pounds(F.abs("amount_pence")), F.lit("</ns:Amt><ns:CdtDbtInd>"), debit, F.lit("</ns:CdtDbtInd><ns:Sts><ns:Cd>"), F.when(F.col("id") % 6 == 0, "PDNG").otherwise("BOOK"), F.lit("</ns:Cd></ns:Sts><ns:BookgDt><ns:Dt>"), F.date_format("date", "yyyy-MM-dd"), F.lit("</ns:Dt></ns:BookgDt><ns:RmtInf><ns:Ustrd>"), F.col("text"), F.lit("</ns:Ustrd></ns:RmtInf></ns:Ntry>"))
    return markup.camt(_bodies(movements(spark, sf_dir), block, F.lit("<Document><Stmt>"), F.lit("</Stmt></Document>"))).select("file", "pos", "date", "amount_pence", "description", "outcome")


def _book(rows: pd.DataFrame) -> pd.DataFrame:
    """A workbook of one account's movements: dates as styled numbers, texts inline, amounts as numbers."""
    kept = rows.sort_values(["date", "id"])
    lines = ['<row r="1">' + "".join(f'<c r="{at}1" t="inlineStr"><is><t>{name}</t></is></c>' for at, name in zip("ABC", ("Date", "Description", "Amount"))) + "</row>"]
    for n, (day, text, pence) in enumerate(zip(kept["date"], kept["text"], kept["amount_pence"]), 2):
        serial = (day - datetime.date(1899, 12, 30)).days
        lines.append(f'<row r="{n}"><c r="A{n}" s="1"><v>{serial}</v></c><c r="B{n}" t="inlineStr"><is><t>{text}</t></is></c><c r="C{n}"><v>{pence / 100!r}</v></c></row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(lines)}</sheetData></worksheet>')
        z.writestr("xl/styles.xml", '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    return pd.DataFrame({"file": [int(kept["account_id"].iloc[0])], "content": [out.getvalue()]})


@query(with_sql(MOVEMENT) + """, n AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date, id) + 1 AS line FROM movement)
    SELECT account_id AS file, CAST(line AS INTEGER) AS line, strftime(date, '%d/%m/%Y') AS date, text, CASE WHEN amount_pence % 100 = 0 THEN CAST(amount_pence // 100 AS VARCHAR) ELSE printf('%.2f', amount_pence / 100.0) END AS amount FROM n WHERE account_id % 4 <> 0
    UNION ALL SELECT account_id, NULL, NULL, NULL, 'unreadable: BadZipFile' FROM movement WHERE account_id % 4 = 0 GROUP BY 1""")
def S7_workbooks(spark, sf_dir):
    """Workbooks of accounts, read cell by cell; a quarter of them is torn and says so."""
    books = movements(spark, sf_dir).groupBy("account_id").applyInPandas(_book, "file bigint, content binary")
    torn = books.withColumn("content", F.when(F.col("file") % 4 == 0, F.substring("content", 1, 40)).otherwise(F.col("content")))
    cell = lambda i: F.try_element_at("cells", F.lit(i))
    read = markup.workbooks(torn).where("line IS NULL OR line > 1")
    return read.select("file", "line", cell(1).alias("date"), cell(2).alias("text"), F.coalesce("reason", cell(3)).alias("amount"))
