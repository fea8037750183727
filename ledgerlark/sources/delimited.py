"""Delimited exports: records, header, layout, and rows with a reason for each that isn't one."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.dates import pattern_of, printed_date
from ..functions.money import direction, has_credit_marker, printed_pence
from ..functions.text import header_key, normal_description
from ..shared import cut, dealt, in_parts
from .layouts import LAYOUTS, Layout

#: Records that are looked through for a header.
HEADER_SCAN = 15
#: Records that Python hands back at once.
MOST_OUT = 5_000


def delimiter(text: Column) -> Column:
    """Of , ; tab and | the one that the last three of the first eight lines hold most surely."""
    lines = F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, 8)
    last = F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 2), F.lit(3))
    counted = lambda d: F.array_min(F.transform(last, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))))
    marks = (",", ";", "\t", "|")
    best = F.array_max(F.array(*[F.struct(counted(d).alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("mark")) for i, d in enumerate(marks)]))
    return F.coalesce(best["mark"], F.lit(","))


def _read(k, body: str, mark: str):
    reader, line = csv.reader(io.StringIO(body, newline=""), delimiter=mark), 1
    try:
        for cells in reader:
            if any(c.strip() for c in cells):
                yield k, line, [c.strip() for c in cells]
            line = reader.line_num + 1
    except csv.Error:  # the rest of a file that can't be read is one record without cells
        yield k, line, []


def record_batches(batches, schema: pa.Schema):
    """Records of batches (key, text, mark): one text at a time is Python's, its records go back in parts of MOST_OUT."""
    csv.field_size_limit(2**31 - 1)  # a long cell is a cell like any other
    for batch in batches:
        for some in in_parts((r for own in zip(*batch.columns) for r in _read(*(x.as_py() for x in own))), MOST_OUT):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def records(texts: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """key, line (of the record's first character) and cells; quoted cells may hold line ends.

    Quoting across lines needs a reader that knows line numbers: a small helper per file.
    """

    shape = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("line", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))])
    schema = to_arrow_schema(shape)
    own = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"), delimiter(F.coalesce(F.col(text), F.lit(""))).alias("__mark"))
    return own.mapInArrow(lambda batches: record_batches(batches, schema), shape)


def is_date(cell: Column) -> Column:
    return printed_date(cell).isNotNull()


def headers(rows: DataFrame, key: str = "file", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """key, header (null where a file has none) and header_line.

    The first of the leading records that holds a known signature; else the first that has two filled
    cells, neither date nor money among them, before a record of its width that has a date.
    """
    by = Window.partitionBy(key).orderBy("line")
    normal = F.transform("cells", normal_description)
    known = F.lit(False)
    for x in layouts:
        if x.signature:
            known = known | (F.size(F.array_except(F.array(*[F.lit(h.lower()) for h in x.signature]), normal)) == 0)
    early = rows.withColumn("__n", F.row_number().over(by)).withColumn("__next", F.lead("cells").over(by))
    filled = F.size(F.filter("cells", lambda c: c != "")) >= 2
    plain = ~F.exists("cells", lambda c: is_date(c) | printed_pence(c).isNotNull())
    followed = (F.size("__next") == F.size("cells")) & F.exists("__next", is_date)
    ranked = early.where(F.col("__n") <= HEADER_SCAN).select(key, F.when(known, F.struct(F.lit(0).alias("r"), "line", normal.alias("cells"))).when(filled & plain & followed, F.struct(F.lit(1).alias("r"), "line", normal.alias("cells"))).alias("h"))
    return ranked.groupBy(key).agg(F.min("h").alias("h")).select(key, F.col("h.line").alias("header_line"), F.col("h.cells").alias("header"))


def headed(rows: DataFrame, key: str = "file", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The rows below their file's header, or all where it has none, with the header and its line."""
    header = headers(rows, key, layouts)
    return rows.join(header, key).where(F.col("header_line").isNull() | (F.col("line") > F.col("header_line")))


def layout_of(header: Column, width: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Id of the layout with the largest signature that the header holds; without a header, by the number of columns."""
    fits = [F.when(F.size(F.array_except(F.array(*[F.lit(h.lower()) for h in x.signature]), header)) == 0, F.struct(F.lit(len(x.signature)).alias("n"), F.lit(x.id).alias("id"))) for x in layouts if x.signature]
    bare = F.coalesce(*[F.when(width == x.columns, F.lit(x.id)) for x in layouts if x.columns])
    return F.when(header.isNull(), bare).otherwise(F.array_max(F.array_compact(F.array(*fits)))["id"])


def layout_id(rows: DataFrame, learned: DataFrame, width: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """rows (header, side) with layout: one learned for the header's key and the account's side, else as layout_of tells.

    learned: header_key, side, layout_id; one row for each key and side.
    """
    keyed = rows.withColumn("header_key", F.when(F.col("header").isNotNull(), header_key(F.col("header"))))
    found = keyed.join(learned.select("header_key", "side", "layout_id"), ["header_key", "side"], "left")
    return found.withColumn("layout", F.coalesce("layout_id", layout_of(F.col("header"), width, layouts))).drop("header_key", "layout_id")


def missing_columns(header: Column, width: Column, layout: Layout) -> Column:
    """The columns that a layout names and a file lacks, in the layout's order; without a header those beyond its width."""
    named = [layout.date, *layout.description, layout.amount, layout.money_out, layout.money_in, layout.balance, layout.merchant, layout.category, layout.type, layout.direction, layout.fee, *(column for column, *_ in layout.skip)]
    lacks = lambda c: (width <= int(c[1:])) if c.startswith("#") else F.coalesce(~F.array_contains(header, c.lower()), F.lit(True))
    return F.array_distinct(F.array_compact(F.array(*[F.when(lacks(c), F.lit(c)) for c in dict.fromkeys(named) if c])))


def table_parts(rows: DataFrame, key: str = "file", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """rows (of records) with ref (L and the line) and part: preamble, header or data. Without a header all are data."""
    header = headers(rows, key, layouts)
    part = F.when(F.col("header_line").isNull() | (F.col("line") > F.col("header_line")), "data").when(F.col("line") == F.col("header_line"), "header").otherwise("preamble")
    return rows.join(header, key).select(key, F.concat(F.lit("L"), F.col("line").cast("string")).alias("ref"), part.alias("part"), "cells")


def _get(name: str) -> Column:
    if not name:
        return F.lit("")
    at = F.lit(int(name[1:]) + 1) if name.startswith("#") else F.array_position("header", name.lower()).cast("int")
    return F.when(at > 0, F.coalesce(F.try_element_at("cells", at), F.lit(""))).otherwise("")


def mapped(rows: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, key: str = "file") -> DataFrame:
    """key, line, layout, outcome (row, skipped or problem), reason, date, amount_pence, fee_pence, description, balance_after_pence ...

    One projection for all layouts: each picks its cells, and these are read alike. Rules in order:
    skips, date, amount (two columns, or one with a direction or a card's view), zero.
    """
    of = lambda x: F.col("layout") == x.id
    pick = lambda attr: F.coalesce(*[F.when(of(x), _get(getattr(x, attr))) for x in layouts if getattr(x, attr)], F.lit("")).alias(attr)
    described = F.coalesce(*[F.when(of(x), F.array_join(F.filter(F.array(*[_get(d) for d in x.description]), lambda d: d != ""), " ")) for x in layouts])
    reason = F.coalesce(*[F.when(of(x) & ~_get(column).isin(*stay), F.lit(why)) for x in layouts for column, stay, why in x.skip], F.lit(None).cast("string"))
    formats = sorted({f for x in layouts for f in x.formats})
    own_formats = F.coalesce(*[F.when(of(x), F.array(*[F.lit(f) for f in x.formats])) for x in layouts])
    told = lambda ids: F.col("layout").isin(*ids) if ids else F.lit(False)
    cells = rows.select(
        key, "line", "layout", reason.alias("skip"), own_formats.alias("formats"), described.alias("description"),
        *[pick(attr) for attr in ("date", "amount", "money_out", "money_in", "direction", "fee", "balance", "merchant", "category", "type")],
        F.coalesce(told([x.id for x in layouts if x.perspective == "card"]), F.lit(False)).alias("card"), F.coalesce(told([x.id for x in layouts if not x.amount]), F.lit(False)).alias("two"),
    )
    date = F.coalesce(*[F.when(F.array_contains("formats", f), printed_date(F.col("date"), (pattern_of(f),))) for f in formats])
    read = cells.select(
        key, "line", "layout", "skip", "two", "description", date.alias("date"), "merchant", F.col("category").alias("bank_category"), F.col("type").alias("bank_type"),
        printed_pence(F.col("amount")).alias("size"), has_credit_marker(F.col("amount")).alias("credit"), direction(F.col("direction")).alias("side"), "card",
        printed_pence(F.col("money_out")).alias("out"), printed_pence(F.col("money_in")).alias("into"), (-F.abs(printed_pence(F.col("fee")))).alias("fee_pence"), printed_pence(F.col("balance")).alias("balance_after_pence"),
    )
    turned = F.when(~F.col("card"), F.col("size")).when(F.col("credit"), F.abs("size")).otherwise(-F.col("size"))
    one = F.when(F.col("side").isNull(), turned).otherwise(F.abs("size") * F.col("side"))
    filled = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    two = F.when(filled("out"), -F.abs("out")).when(filled("into"), F.abs("into")).when(F.col("out").isNotNull() | F.col("into").isNotNull(), F.lit(0).cast("bigint"))
    amount = F.when(F.col("two"), two).otherwise(one)
    verdict = lambda outcome, why: F.struct(F.lit(outcome).alias("outcome"), why.alias("reason"))
    judged = (
        F.when(F.col("layout").isNull(), verdict("problem", F.lit("no known layout")))
        .when(F.col("skip").isNotNull(), verdict("skipped", F.col("skip")))
        .when(F.col("date").isNull(), verdict("problem", F.lit("no date")))
        .when(F.col("two") & filled("out") & filled("into"), verdict("problem", F.lit("both money out and money in")))
        .when(amount.isNull(), verdict("problem", F.lit("no amount")))
        .when(amount == 0, verdict("skipped", F.lit("zero amount")))
        .otherwise(verdict("row", F.lit(None).cast("string")))
    )
    return read.withColumn("amount_pence", amount.cast("bigint")).withColumn("v", judged).select(key, "line", "layout", "v.outcome", "v.reason", "date", "amount_pence", "fee_pence", "description", "merchant", "bank_category", "bank_type", "balance_after_pence")


def parsed(texts: DataFrame, key: str = "file", text: str = "text", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Rows of delimited texts with layout, outcome and pos: oldest first, a fee just before its payment.

    Every file has a row: those of no known layout are problems line by line, and a file without records is one.
    """
    rows = cut(headed(records(texts, key, text), key, layouts))
    width = F.max(F.size("cells")).over(Window.partitionBy(key))
    # written: what is read from a line is used many times below, and would be read as often
    out = cut(mapped(rows.withColumn("layout", layout_of(F.col("header"), width, layouts)), layouts, key))
    is_fee = lambda: F.coalesce(F.col("fee_pence") != 0, F.lit(False)) & (F.col("outcome") == "row")
    parts = F.when(is_fee(), F.array(F.struct(F.lit(0).alias("part"), F.col("fee_pence").alias("pence")), F.struct(F.lit(1).alias("part"), F.col("amount_pence").alias("pence")))).otherwise(F.array(F.struct(F.lit(1).alias("part"), F.col("amount_pence").alias("pence"))))
    split = out.withColumn("p", F.explode(parts)).withColumn("amount_pence", F.col("p.pence")).withColumn("part", F.col("p.part")).drop("p", "fee_pence")
    ends = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dated = F.when(F.col("outcome") == "row", F.col("date"))
    newest_first = F.first(dated, ignorenulls=True).over(ends) > F.last(dated, ignorenulls=True).over(ends)
    ordered = split.withColumn("__order", F.when(newest_first, -F.col("line")).otherwise(F.col("line")))
    told = ordered.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("__order", "part"))).drop("__order")
    empty = texts.select(key).join(rows.select(key).distinct(), key, "left_anti")
    return told.unionByName(empty.select(key, F.lit("problem").alias("outcome"), F.lit("no records").alias("reason"), F.lit(1).alias("pos")), allowMissingColumns=True)


#: What a cell looks like, without its value: kinds in the order in which they're tried.
CELL_KINDS = ("empty", "date", "money", "marker", "number", "text")
#: A column is of a kind if so large a share of its filled cells is.
COLUMN_SHARE = 0.8


def cell_kind(cell: Column) -> Column:
    text = F.trim(F.coalesce(cell, F.lit("")))
    return (
        F.when(text == "", "empty").when(is_date(text), "date").when(direction(text).isNotNull(), "marker")
        .when(printed_pence(text).isNotNull() & text.rlike(r"[.,£$€()+−-]"), "money").when(text.rlike(r"^\d+$"), "number").otherwise("text")
    )


def inferred_columns(rows: DataFrame, key: str = "file") -> DataFrame:
    """key, at (the column's place from 0), kind (of most of its filled cells) and format (of dates: the one that reads most
    of them, the first of equals), from records (key, line, cells) below the header. No value leaves the column."""
    each = rows.select(key, F.posexplode("cells").alias("at", "cell"))
    formats = sorted({f for x in LAYOUTS for f in x.formats})
    read = [printed_date(F.col("cell"), (pattern_of(f),)).isNotNull().alias(f"r{i}") for i, f in enumerate(formats)]
    # what a cell looks like is told once of equal ones; written, so that rows of a frequent one can be split
    looks = cut(dealt(each.select("cell").distinct()).select("cell", cell_kind(F.col("cell")).alias("kind"), *read))
    cells = each.join(looks.where("kind <> 'empty'"), "cell")  # asked before it's written, this would be told of every cell
    reads = [F.count_if(f"r{i}").alias(f"r{i}") for i in range(len(formats))]
    counted = cells.groupBy(key, "at").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in CELL_KINDS[1:]], *reads)
    likely = F.coalesce(*[F.when(F.col(k) >= COLUMN_SHARE * F.col("n"), k) for k in CELL_KINDS[1:]], F.lit("text"))
    best = F.array_max(F.array(*[F.struct(F.col(f"r{i}").alias("n"), F.lit(-i).alias("rank"), F.lit(f).alias("format")) for i, f in enumerate(formats)]))
    return counted.select(key, "at", likely.alias("kind"), F.when(likely == "date", best["format"]).alias("format"))


def inferred_layout(columns: DataFrame, key: str = "file") -> DataFrame:
    """key, date and its format, amount (one signed or marked column), out and into (two), direction: places or null, of
    columns as inferred_columns tells them. Of several money columns the last is taken for the balance."""
    places = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("at"))))
    told = columns.groupBy(key).agg(places("money").alias("money"), F.min_by("format", F.when(F.col("kind") == "date", F.col("at"))).alias("format"), F.min(F.when(F.col("kind") == "date", F.col("at"))).alias("date"), F.min(F.when(F.col("kind") == "marker", F.col("at"))).alias("direction"))
    n, at = F.size("money"), lambda i: F.try_element_at("money", F.lit(i))
    two = n >= 3
    return told.select(key, "date", "format", F.when(~two, at(1)).alias("amount"), F.when(two, at(1)).alias("out"), F.when(two, at(2)).alias("into"), F.when(n >= 2, at(-1)).alias("balance"), "direction")
