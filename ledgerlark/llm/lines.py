"""Line de-duplication by content-defined line chunks, in DataFrame functions only.

Lines that aren't blank are hashed, and a rolling hash over two neighbouring line hashes is counted over all
texts. Two lines whose rolling hash occurs once can't both be in a repeated chunk, so a chunk ends between them:
what is left are runs, equal wherever a passage stands among other lines. Inside a run, a chunk starts where the
rolling hash is a local minimum (with two lines or more before it), so boundaries depend on nothing but the lines
around them and fall into step again after whatever differs. A line of over ``LONG_LINE`` words is a chunk of its own,
and no chunk has more than ``MOST_LINES``. What differs beside a short passage mostly lies at one end of a run, so the two
lines at either end of a run of three or more are a chunk too. Chunks of several lines, or of one long one, with ``LEAST_WORDS`` words or
more, that occur again anywhere are removed but for the first occurrence (smallest doc_id, then text, then place).

Where runs differ beside a passage, its first or last lines may lie in chunks of other lines. A removed chunk is
therefore extended line by line over the chunks beside it, as far as the lines equal those beside the first
occurrence. Every line that goes stands in an earlier place, so the first occurrence of each line stays. Blank lines
stay.

Lines are matched by 64-bit hashes and then by their bytes: of repeated hashes the distinct lines are counted, and
lines that share a hash without being equal are told apart by the lines themselves.

A null text has no lines and stays null; an empty one has one empty line. Rows repeated with one id and text
are one document: the same places go from each of them. Rows without an id lose nothing. An empty table
gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let  # noqa: F401
from .common import cut

#: A single line counts as a chunk if it has more words than this.
LONG_LINE = 50
#: Lines of a chunk at most, and words at least.
MOST_LINES, LEAST_WORDS = 16, 5


def _hash(line, bits: int) -> Column:
    return F.xxhash64(line) if bits == 64 else F.shiftrightunsigned(F.xxhash64(line), 64 - bits)


def lines_of(rows: DataFrame, hash_bits: int) -> DataFrame:
    """id, own (the text's hash), k (the line's number among those that aren't blank) and x (at, its number, and line) of rows (id, text)."""
    each = F.filter(F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("at"), line.alias("line"), _hash(line, hash_bits).alias("h"))), lambda x: F.trim(x["line"]) != "")
    return rows.where("id IS NOT NULL").select("id", F.xxhash64("text").alias("own"), each.alias("xs"))


def repeated(rows: DataFrame, hash_bits: int) -> DataFrame:
    """id, own, k, at, h (a line's hash, or its text's where hashes clash), words and linked (the pair with the line before
    repeats) of the lines of repeated pairs, and of repeated long lines; written.

    A row for each line of each text goes by its pair's hash; the lines' texts move only where a hash repeats, once each, to
    be compared.
    """
    found = lines_of(rows, hash_bits)
    words = lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"), F.regexp_count(x["line"], F.lit(r"\S+")).alias("words"))
    placed = found.select("id", "own", F.transform("xs", words).alias("xs"))
    pairs = placed.select("id", "own", F.posexplode(F.transform("xs", lambda x, i: F.struct(x.alias("x"), F.get("xs", i + 1).alias("y")))).alias("k", "p")).select("id", "own", "k", "p.x", "p.y")
    long = F.col("x.words") > LONG_LINE
    keyed = cut(pairs.select("id", "own", "k", "x", "y", F.explode(F.array_compact(F.array(F.when(F.col("y").isNotNull(), F.xxhash64("x.h", "y.h")), F.when(long, F.xxhash64(F.lit("alone"), "x.h"))))).alias("r")).distinct())
    # counts are written before the join, so that it is one of two plain shuffles and a pair of many rows can be split
    counts = cut(keyed.groupBy("r").agg(F.count("*").alias("n")).where("n > 1").select("r"))
    line = lambda k, x, linked: F.struct(k.alias("k"), x["at"].alias("at"), x["h"].alias("h"), x["words"].alias("words"), F.lit(linked).alias("linked"))
    is_pair = F.col("y").isNotNull() & (F.col("r") == F.xxhash64("x.h", "y.h"))
    both = F.when(is_pair, F.array(line(F.col("k"), F.col("x"), False), line(F.col("k") + 1, F.col("y"), True))).otherwise(F.array(line(F.col("k"), F.col("x"), False)))
    again = keyed.join(counts, "r", "left_semi").select("id", "own", F.explode(both).alias("l")).select("id", "own", "l.*")
    again = cut(again.groupBy("id", "own", "k", "at", "h", "words").agg(F.max("linked").alias("linked")))
    texts = found.select("id", "own", F.posexplode("xs").alias("k", "x")).select("id", "own", "k", "x.h", "x.line")
    distinct = texts.select("h", "line").distinct().join(again.select("h").distinct(), "h", "left_semi")
    clashing = cut(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    if clashing.isEmpty():
        return again.withColumn("h", F.col("h").cast("string"))
    told = texts.join(clashing, "h", "left_semi").select("id", "own", "k", F.concat(F.lit("="), "line").alias("told")).distinct()
    return cut(again.join(told, ["id", "own", "k"], "left").withColumn("h", F.coalesce("told", F.col("h").cast("string"))).drop("told"))


def chunks(again: DataFrame) -> DataFrame:
    """id, own, k, ats and hs (places and hashes of its lines), words, and hs and ats of the chunks beside it; written."""
    by = Window.partitionBy("id", "own").orderBy("k")
    goes_on = F.lead("linked").over(by)
    rolled = again.withColumn("r", F.when(goes_on, F.xxhash64("h", F.lead("h").over(by)))).withColumn("linked_before", F.coalesce(F.lag("linked").over(by), F.lit(False)))
    least = (F.col("r") < F.lag("r").over(by)) & (F.col("r") <= F.coalesce(F.lead("r").over(by), F.col("r"))) & F.col("linked") & F.col("linked_before")
    long = F.col("words") > LONG_LINE
    starts = ~F.col("linked") | F.coalesce(least, F.lit(False)) | long | F.coalesce(F.lag(long).over(by), F.lit(False))
    numbered = rolled.withColumn("chunk", F.sum(starts.cast("int")).over(by))
    inside = F.row_number().over(Window.partitionBy("id", "own", "chunk").orderBy("k")) - 1
    cuts = numbered.withColumn("part", F.floor(inside / MOST_LINES))
    lines = F.sort_array(F.collect_list(F.struct("k", "at", "h", "words")))
    made = cuts.groupBy("id", "own", "chunk", "part").agg(F.min("k").alias("k"), F.max("k").alias("last"), lines.alias("ls"))
    made = made.select("id", "own", "k", "last", F.col("ls.at").alias("ats"), F.col("ls.h").alias("hs"), F.col("ls.words").alias("ws"))
    none = F.array().cast("array<string>"), F.array().cast("array<int>")
    before = F.when(F.lag("last").over(by) == F.col("k") - 1, F.struct(F.lag("hs").over(by).alias("hs"), F.lag("ats").over(by).alias("ats")))
    beyond = F.when(F.lead("k").over(by) == F.col("last") + 1, F.struct(F.lead("hs").over(by).alias("hs"), F.lead("ats").over(by).alias("ats")))
    beside = made.withColumn("b", before).withColumn("a", beyond)
    filled = lambda c, f, i: F.coalesce(F.col(f"{c}.{f}"), none[i])
    whole = beside.select("id", "own", "k", "ws", "ats", "hs", *[filled(c, f, i).alias(f"{c}_{f}") for c in "ba" for i, f in enumerate(("hs", "ats"))])
    return cut(whole.select("id", "own", F.explode(F.concat(F.array(_as_chunk(0, None)), *[F.when((F.size("hs") > 2) & (F.size(c) == 0), F.array(part)).otherwise(F.array().cast(_CHUNKS)) for c, part in (("b_hs", _as_chunk(0, 2)), ("a_hs", _as_chunk(-2, 2)))])).alias("c")).select("id", "own", "c.*"))


_CHUNKS = "array<struct<k:int,words:int,ats:array<int>,hs:array<string>,b_hs:array<string>,b_ats:array<int>,a_hs:array<string>,a_ats:array<int>>>"


def _as_chunk(start: int, size: int | None) -> Column:
    """A chunk, or its first two or last two lines with its other lines beside them."""
    n = F.size("hs")
    taken = lambda c: F.col(c) if size is None else F.slice(c, F.lit(1) if start == 0 else n - 1, F.lit(2))
    rest = lambda c: F.slice(c, F.lit(3), n - 2) if start == 0 else F.slice(c, F.lit(1), n - 2)
    beside = {x: F.col(x) for x in ("b_hs", "b_ats", "a_hs", "a_ats")}
    if size is not None:
        beside |= {f"{'a' if start == 0 else 'b'}_{f}": rest(f) for f in ("hs", "ats")}
    k = F.col("k") if start == 0 else F.col("k") + n - 2
    words = F.aggregate(taken("ws"), F.lit(0), lambda s, w: s + w)
    return F.struct(k.cast("int").alias("k"), words.alias("words"), taken("ats").alias("ats"), taken("hs").alias("hs"), *[c.alias(x) for x, c in beside.items()])


def _in_common(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common from their start."""
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), False)
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def repeated_lines(docs: DataFrame, doc_id: str, text: str, hash_bits: int = 64) -> DataFrame:
    """id, own and gone: the places that a document loses.

    hash_bits under 64 shortens the hash, which tests use to make different lines share one.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    made = chunks(repeated(rows, hash_bits))
    counted = made.where(((F.size("hs") > 1) | (F.col("words") > LONG_LINE)) & (F.col("words") >= LEAST_WORDS))
    firsts = cut(counted.groupBy("hs").agg(F.min(F.struct("id", "own", "k", "b_hs", "a_hs")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = counted.join(firsts, "hs").where(F.struct("id", "own", "k") != F.struct("first.id", "first.own", "first.k"))
    ahead = _in_common(F.col("a_hs"), F.col("first.a_hs"))
    behind = _in_common(F.reverse("b_hs"), F.reverse(F.col("first.b_hs")))
    gone = F.concat("ats", F.slice("a_ats", F.lit(1), ahead), F.slice(F.reverse("b_ats"), F.lit(1), behind))
    return later.select("id", "own", F.explode(gone).alias("at")).groupBy("id", "own").agg(F.collect_set("at").alias("gone"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_bits: int = 64) -> DataFrame:
    """id, n_lines, n_removed (lines), and the text without the repeated chunks."""
    gone = repeated_lines(docs, doc_id, text, hash_bits).withColumnsRenamed({"id": "gone_id", "own": "gone_own"})
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    joined = rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_own")), "left")
    lines = F.split("text", "\n", -1)
    # the places that stay come from a set difference, whose time doesn't grow with lines times places
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = let(lines, lambda own: F.transform(stays, lambda i: F.get(own, i)))
    shown = joined.select("id", "text", F.size(lines).alias("n_lines"), F.when(F.col("gone").isNotNull(), left).alias("kept"))
    return shown.select(
        F.col("id").alias(doc_id),
        F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("bigint").alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("bigint").alias("n_removed"),
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
    )
