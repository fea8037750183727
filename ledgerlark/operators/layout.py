"""Layouts that depend on what was placed before: squarified treemaps, and batches of rows that fit a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

#: Rows of a batch at most; the rows that are looked at from each possible start of one.
MOST_ITEMS = 60


def treemap(rows: DataFrame, parent: str, item: str, value: str, width: float = 100.0, height: float = 100.0) -> DataFrame:
    """parent, item, x, y, w, h: the items of each parent as rectangles with areas in proportion to their values, as
    close to square as they go, largest first (equal ones by item). Values of nought, or null, have none.

    One fold over a parent's items, which are the branches of one node of a tree: rectangles are put into a row along
    the shorter side of what is left for as long as its worst aspect ratio doesn't get worse.
    """
    own = rows.where(F.col(value) > 0).groupBy(parent).agg(F.sort_array(F.collect_list(F.struct((-F.col(value)).cast("double").alias("minus"), F.col(item).alias("item")))).alias("items"))
    scaled = own.withColumn("total", F.expr("aggregate(items, 0D, (s, i) -> s - i.minus)")).withColumn("areas", F.transform("items", lambda i: -i["minus"] * F.lit(width * height) / F.col("total")))
    rect = "named_struct('x', {x}, 'y', {y}, 'w', {w}, 'h', {h})".format
    worst = lambda total, first, last, side: f"greatest({side} * {side} * {first} / ({total} * {total}), {total} * {total} / ({side} * {side} * {last}))"
    sums = lambda row: f"aggregate({row}, 0D, (t, a) -> t + a)"
    before = "aggregate(slice(s.row, 1, i), 0D, (t, b) -> t + b)"
    wide = "s.w >= s.h"
    thick = f"({sums('s.row')} / IF({wide}, s.h, s.w))"
    placed = f"transform(s.row, (a, i) -> IF({wide}, {rect(x='s.x', y=f's.y + {before} / {thick}', w=thick, h=f'a / {thick}')}, {rect(x=f's.x + {before} / {thick}', y='s.y', w=f'a / {thick}', h=thick)}))"
    state = "named_struct('x', {x}, 'y', {y}, 'w', {w}, 'h', {h}, 'row', {row}, 'out', {out})".format
    start = state(x="0D", y="0D", w=f"{float(width)}D", h=f"{float(height)}D", row="cast(array() AS array<double>)", out="cast(array() AS array<struct<x:double,y:double,w:double,h:double>>)")
    with_it = worst(f"({sums('s.row')} + a)", "get(s.row, 0)", "a", "least(s.w, s.h)")
    without = worst(sums("s.row"), "get(s.row, 0)", "element_at(s.row, -1)", "least(s.w, s.h)")
    put = state(x="s.x", y="s.y", w="s.w", h="s.h", row="concat(s.row, array(a))", out="s.out")
    turn = state(x=f"IF({wide}, s.x + {thick}, s.x)", y=f"IF({wide}, s.y, s.y + {thick})", w=f"IF({wide}, s.w - {thick}, s.w)", h=f"IF({wide}, s.h, s.h - {thick})", row="array(a)", out=f"concat(s.out, {placed})")
    laid = scaled.select(parent, "items", F.expr(f"aggregate(areas, {start}, (s, a) -> IF(size(s.row) = 0 OR {with_it} <= {without}, {put}, {turn}), s -> concat(s.out, {placed}))").alias("rects"))
    each = laid.select(parent, F.explode(F.arrays_zip("items", "rects")).alias("z"))
    return each.select(parent, F.col("z.items.item").alias(item), *[F.col(f"z.rects.{c}").alias(c) for c in "xywh"])


def batches(rows: DataFrame, key: str, room_in: int, room_out: int | None = None, out_per_item: int = 0, most: int = MOST_ITEMS) -> DataFrame:
    """rows (key, pos, tokens, line, line_tokens) with batch, from 0 within a key: greedy, in order.

    A batch holds at most most rows, room_in tokens and, at out_per_item a row, room_out tokens of reply. A line that
    several rows share (null: none) costs its tokens once a batch. batch is null for rows that no batch can hold; each
    of them stands alone.

    Where a batch that starts at a row ends depends on the rows from there on alone, most of them at the utmost, so
    all rows are asked side by side. Which rows do start one is told by jumps from start to start that double in length
    each round, so rounds grow with the logarithm of a key's batches, and no list of a key is made.
    """
    reply = max(0, room_out // out_per_item) if room_out is not None and out_per_item else most
    most = min(most, reply)
    by = Window.partitionBy(key).orderBy("pos")
    numbered = rows.withColumn("__i", F.row_number().over(by))
    if most < 1:
        return rows.withColumn("batch", F.lit(None).cast("bigint"))
    ahead = F.collect_list(F.struct("tokens", "line", "line_tokens")).over(by.rowsBetween(0, most - 1))
    # tokens and lines so far, and how many rows fit; the fold stops counting at the first that doesn't
    cost = "x.tokens + IF(x.line IS NULL OR array_contains(s.seen, x.line), 0, x.line_tokens)"
    grown = f"named_struct('n', s.n + 1, 'used', s.used + {cost}, 'seen', IF(x.line IS NULL, s.seen, array_union(s.seen, array(x.line))), 'open', true)"
    zero = f"named_struct('n', 0, 'used', 0L, 'seen', cast(array() AS array<{rows.schema['line'].dataType.simpleString()}>), 'open', true)"
    fits = f"aggregate(__ahead, {zero}, (s, x) -> IF(s.open AND s.used + {cost} <= {room_in}, {grown}, named_struct('n', s.n, 'used', s.used, 'seen', s.seen, 'open', false)), s -> s.n)"
    sized = numbered.withColumn("__ahead", ahead).withColumn("__n", F.expr(fits)).drop("__ahead")
    jumps = cut(sized.select(F.col(key).alias("k"), F.col("__i").alias("i"), (F.col("__i") + F.greatest("__n", F.lit(1))).alias("to")))
    starts = cut(jumps.select("k").distinct().withColumn("i", F.lit(1)))
    steps, n = jumps, starts.count()
    while True:
        met = starts.join(steps, ["k", "i"]).select("k", F.col("to").alias("i"))
        starts = cut(starts.unionByName(met.join(jumps.select("k", "i"), ["k", "i"], "left_semi")).distinct())
        now = starts.count()
        if now == n:
            break
        n = now
        further = steps.select(F.col("k"), F.col("i").alias("to"), F.col("to").alias("further"))
        steps = cut(steps.join(further, ["k", "to"]).select("k", "i", F.col("further").alias("to")))
    marked = sized.join(starts.select(F.col("k").alias("__k"), F.col("i").alias("__at")), (F.col(key) == F.col("__k")) & (F.col("__i") == F.col("__at")), "left")
    number = F.sum(F.when(F.col("__at").isNotNull() & (F.col("__n") > 0), 1).otherwise(0)).over(Window.partitionBy(key).orderBy("__i")) - 1
    return marked.withColumn("batch", F.when(F.col("__n") > 0, number)).select(*rows.columns, "batch")
