import datetime
import io
import zipfile

from pyspark.sql import functions as F

from ledgerlark.sources import delimited, files, markup


def test_kinds(spark):
    heads = {b"%PDF-1.7": "pdf", b"\x89PNG\r\n": "image", b"PK\x03\x04": "xlsx", b"OFXHEADER:100\n<OFX>": "ofx", b"!Type:Bank\nD1": "qif", b"<?xml?><Document xmlns='urn:camt.053.001.08'>": "camt", b"a,b,c\n1,2,3\n4,5,6": "csv", b"hello": None, b"\xd0\xcf\x11\xe0": None, b"<a/>": None}
    df = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(heads)], "i int, content binary")
    got = df.select("i", files.kind_of(F.col("content"))["kind"].alias("kind")).orderBy("i").collect()
    assert [r.kind for r in got] == list(heads.values())


def test_text_decoding(spark):
    texts = [("£5\r\nx".encode(), "£5\nx"), ("£5".encode("utf-16"), "£5"), ("£5 – “x”".encode("cp1252"), "£5 – “x”"), (b"\xef\xbb\xbfa", "a")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(texts)], "i int, content binary")
    assert [r.t for r in df.select("i", files.decoded(F.col("content")).alias("t")).orderBy("i").collect()] == [t for _, t in texts]


def test_layouts(spark):
    amex = "Date,Description,Amount,Extended Details,Appears On Your Statement As,Reference,Category\n02/01/2024,SHOP,12.50,,,r,x\n03/01/2024,PAYMENT,-40.00,,,r,x\n"
    bare = "02/01/2024,TEA ROOM,-3.20\n03/01/2024,\"BIG, SHOP\",\"-1,003.20\"\n"
    unknown = "When,What\nfoo,bar\n"
    revolut = "Type,Product,Started Date,Completed Date,Description,Amount,Fee,Currency,State,Balance\nCARD,Current,2024-01-02 10:00:00,2024-01-02 10:00:00,TEA,-3.00,0.20,GBP,COMPLETED,1\nCARD,Current,2024-01-03 10:00:00,,TEA,-3.00,0.00,GBP,PENDING,1\nCARD,Current,2024-01-04 10:00:00,nonsense,TEA,-3.00,0.00,GBP,COMPLETED,1\n"
    texts = spark.createDataFrame([("amex", amex), ("bare", bare), ("unknown", unknown), ("revolut", revolut), ("empty", ""), ("null", None)], "file string, text string")
    long = spark.createDataFrame([("long", "When," + "x" * 2_000_000 + "\n")], "file string, text string")
    got = [tuple(r) for r in delimited.parsed(texts).orderBy("file", "pos").select("file", "layout", "outcome", "amount_pence", "date", "description").collect()]
    refused = [(r.file, r.outcome, r.reason) for r in delimited.parsed(texts.unionByName(long)).where("layout is null").orderBy("file", "pos").collect()]
    assert refused == [("empty", "problem", "no records"), ("long", "problem", "no known layout"), ("null", "problem", "no records"), ("unknown", "problem", "no known layout"), ("unknown", "problem", "no known layout")]
    got = [r for r in got if r[1] is not None]
    day = lambda d: datetime.date(2024, 1, d)
    assert got == [
        ("amex", "amex", "row", -1250, day(2), "SHOP"), ("amex", "amex", "row", 4000, day(3), "PAYMENT"),
        ("bare", "hsbc", "row", -320, day(2), "TEA ROOM"), ("bare", "hsbc", "row", -100320, day(3), "BIG, SHOP"),
        ("revolut", "revolut", "row", -20, day(2), "TEA"), ("revolut", "revolut", "row", -300, day(2), "TEA"), ("revolut", "revolut", "skipped", -300, None, "TEA"), ("revolut", "revolut", "problem", -300, None, "TEA"),
    ]


def test_workbooks(spark):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Date</t></is></c><c r="C1" t="s"><v>0</v></c></row><row r="2"><c r="A2" s="1"><v>45293</v></c><c r="C2"><v>-3.5</v></c></row></sheetData></worksheet>'
    styles = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Amount</t></si></sst>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/sharedStrings.xml", shared)
    got = markup.workbooks(spark.createDataFrame([("f", bytearray(out.getvalue()))], "file string, content binary")).orderBy("line").collect()
    assert [r.cells for r in got] == [["Date", "", "Amount"], ["02/01/2024", "", "-3.50"]]

    def book(rows):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')
        return bytearray(out.getvalue())

    files_ = [("bad", bytearray(b"PK not a zip")), ("none", book("")), ("tall", book("".join(f'<row r="{i}"><c r="A{i}"><v>1</v></c></row>' for i in range(1, markup.MOST_ROWS + 2)))), ("torn", book("<row>")), ("wide", book('<row r="1"><c r="ZZ1"><v>1</v></c></row>')), ("good", bytearray(b"") + book('<row r="1"><c r="A1"><v>1</v></c></row>'))]
    told = markup.workbooks(spark.createDataFrame(files_, "file string, content binary")).select("file", "line", "reason").collect()
    assert sorted(map(tuple, told)) == [("bad", None, "unreadable: BadZipFile"), ("good", 1, None), ("none", None, "no data"), ("tall", None, "too many rows"), ("torn", None, "unreadable: ParseError"), ("wide", None, "too many columns")]


def test_refused_ofx(spark):
    block = "<STMTTRN><DTPOSTED>20240102<TRNAMT>-1.50<NAME>SHOP</STMTTRN>"
    files_ = [("pounds", f"<OFX><CURDEF>GBP\n{block}"), ("euros", f"<OFX><CURDEF>EUR\n{block}"), ("none", "<OFX><CURDEF>GBP\n"), ("torn", "<OFX><STMTTRN><TRNAMT>x</STMTTRN>"), ("null", None)]
    got = markup.ofx(spark.createDataFrame(files_, "file string, text string")).select("file", "pos", "amount_pence", "outcome", "reason").collect()
    assert sorted(map(tuple, got), key=repr) == [("euros", None, None, "problem", "not in pounds: EUR"), ("none", None, None, "problem", "no transactions"), ("null", None, None, "problem", "no transactions"), ("pounds", 0, -150, "row", None), ("torn", 0, None, "problem", "no date")]


def test_american_qif_and_reversed_camt(spark):
    qif = "!Type:Bank\nD1/31/2024\nT-5.00\nPSHOP\n^\nD2/1'24\nT7.00\nPPAY\n^\n"
    got = markup.qif(spark.createDataFrame([("f", qif)], "file string, text string")).orderBy("pos").collect()
    assert [(r.date, r.amount_pence) for r in got] == [(datetime.date(2024, 1, 31), -500), (datetime.date(2024, 2, 1), 700)]
    camt = "<Stmt><Ntry><Amt Ccy='GBP'>5.00</Amt><CdtDbtInd>DBIT</CdtDbtInd><RvslInd>true</RvslInd><Sts>BOOK</Sts><BookgDt><Dt>2024-01-02</Dt></BookgDt></Ntry></Stmt>"
    got = markup.camt(spark.createDataFrame([("f", camt)], "file string, text string")).collect()
    assert [(r.amount_pence, r.outcome) for r in got] == [(500, "row")]
