"""Treemaps and batches against plain versions, and the order of a workbook's sheets."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from ledgerlark.functions.text import slug
from ledgerlark.operators import layout
from ledgerlark.sources import markup


def plain_batches(items, room, most, reply):
    """Batch of each item (tokens, line, line's tokens), or None where no batch can hold it."""
    out, batch, used, seen, n = [], -1, 0, set(), 0
    for tokens, line, more in items:
        own = tokens + (more if line else 0)
        if own > room or reply < 1:
            out.append(None)
            n = used = 0
            continue
        cost = tokens + (more if line and line not in seen else 0)
        if n == 0 or n >= min(most, reply) or used + cost > room:
            batch, used, seen, n, cost = batch + 1, 0, set(), 0, own
        used, n = used + cost, n + 1
        seen |= {line} - {None}
        out.append(batch)
    return out


def test_batches_equal_plain(spark):
    rng = random.Random(4)
    keys = {k: [(rng.randint(1, 40), rng.choice([None, "a", "b", "c"]), 9) for _ in range(n)] for k, n in enumerate([1, 7, 40, 300])}
    keys[9] = [(500, None, 0), (3, "a", 9), (60, "b", 9), (500, "a", 9)]
    rows = [(k, i, *x, "mine") for k, own in keys.items() for i, x in enumerate(own)]
    frame = spark.createDataFrame(rows, "k int, pos int, tokens bigint, line string, line_tokens bigint, n string")
    for room, reply, most in ((60, None, 60), (60, 3, 60), (100, 100, 5), (5, None, 60)):
        found = layout.batches(frame, "k", room, room_out=None if reply is None else 10 * reply + 9, out_per_item=10, most=most)
        assert found.columns == [*frame.columns, "batch"]
        want = {(k, i): b for k, own in keys.items() for i, b in enumerate(plain_batches(own, room, most, most if reply is None else reply))}
        assert {(r.k, r.pos): r.batch for r in found.collect()} == want
    assert {r.batch for r in layout.batches(frame, "k", 60, room_out=5, out_per_item=10).collect()} == {None}
    assert layout.batches(frame.limit(0), "k", 60).count() == 0


def worst(row, side):
    total = sum(row)
    return max(side * side * max(row) / total**2, total**2 / (side * side * min(row)))


def plain_treemap(values, x=0.0, y=0.0, w=100.0, h=100.0):
    own = sorted(((-v, k) for k, v in values.items() if v and v > 0))
    scale, out = w * h / sum(-v for v, _ in own), {}
    todo = [(-v * scale, k) for v, k in own]
    while todo:
        n, side = 1, min(w, h)
        while n < len(todo) and worst([a for a, _ in todo[: n + 1]], side) <= worst([a for a, _ in todo[:n]], side):
            n += 1
        thick, at = sum(a for a, _ in todo[:n]) / side, 0.0
        for a, k in todo[:n]:
            out[k] = (x, y + at, thick, a / thick) if w >= h else (x + at, y, a / thick, thick)
            at += a / thick
        x, y, w, h = (x + thick, y, w - thick, h) if w >= h else (x, y + thick, w, h - thick)
        todo = todo[n:]
    return out


def test_treemaps_equal_plain(spark):
    rng = random.Random(8)
    maps = {p: {i: rng.choice([0, None, 5, 5, rng.randint(1, 1000)]) for i in range(n)} for p, n in enumerate([2, 5, 12, 40])}
    maps[7] = {1: 3}
    rows = [(p, i, v) for p, own in maps.items() for i, v in own.items()]
    found = layout.treemap(spark.createDataFrame(rows, "p int, i int, v bigint"), "p", "i", "v").collect()
    for p, own in maps.items():
        got = {r.i: (r.x, r.y, r.w, r.h) for r in found if r.p == p}
        want = plain_treemap(own) if any(own.values()) else {}
        assert got.keys() == want.keys() and all(abs(a - b) < 1e-6 for k in want for a, b in zip(got[k], want[k]))
        assert not want or abs(sum(w * h for *_, w, h in got.values()) - 10_000) < 1e-6


def test_sheets_in_the_workbook_s_order(spark):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = '<worksheet {}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{}</t></is></c></row></sheetData></worksheet>'.format
    book = f'<workbook {ns} xmlns:r="r"><sheets><sheet name="b" r:id="r2"/><sheet name="a" r:id="r1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/sheet2.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet10.xml"/></Relationships>'
    files = []
    for name, told in (("by number", False), ("told", True)):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in (10, 2):
                z.writestr(f"xl/worksheets/sheet{n}.xml", sheet(ns, n))
            if told:
                z.writestr("xl/workbook.xml", book)
                z.writestr("xl/_rels/workbook.xml.rels", rels)
        files.append((name, bytearray(out.getvalue())))
    got = {r.file: r.cells for r in markup.workbooks(spark.createDataFrame(files, "file string, content binary")).collect()}
    assert got == {"by number": ["2"], "told": ["10"]}


def test_slugs_of_latin_letters(spark):
    cases = {"Őrség & Şile": "orseg-and-sile", "ÀÉÎÕÜ ñç": "aeiou-nc", "Hà Nội": "ha-noi", "Café": "cafe", "--": "", "ŁÓDŹ": "odz"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", slug(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == cases
