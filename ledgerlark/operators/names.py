"""People's names in the lines of a text, replaced by one label a person and put back.

Names are few a household and many in all, so they meet texts in a join: each word of a text meets the forms
that begin with it, and a form is there if the words after it are its other words. Of forms that begin at a
word the longest counts, and of those that overlap the first.

Full names of several words are found in any case, with or without accents, also as initial and surname. A
single word (a first name or surname of three letters or more, or a name of one word) counts only as written, in
title case or in capitals, so that "will" stays a word. A single word that two people share, or that is another's
whole name, stands for that other or for nobody. Words are bounded by what isn't a letter or an underscore.

Lines, or people, without a key meet nothing and stay; null texts stay null; lines repeated are each replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..shared import cut
from .accounts import role_labels
from .privacy import read

#: Words that a name has at most; the words after each word of a text that are carried along.
MOST_WORDS = 8
#: Letters of a single word that may stand for a person.
LEAST_LETTERS = 3
#: Letters, and further ones after an apostrophe that isn't a possessive's.
_LETTERS = r"\p{L}+(?:'(?![sS](?!\p{L}))\p{L}+)*"
_WORD = rf"(?<![\p{{L}}_]){_LETTERS}(?![\p{{L}}_])"
#: What may stand between the words of a name.
_BETWEEN = r"^[\s.'\-]{1,3}$"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_LETTERS), F.lit(0))


def labelled(people: DataFrame, key: str) -> DataFrame:
    """people (key, pos, name, role) with label, one for each: a label that comes again in a household has a number added."""
    own = role_labels(people, key)
    n = F.row_number().over(Window.partitionBy(key, "label").orderBy("name"))
    token = F.concat(F.lit("["), F.upper(F.replace("label", F.lit(" "), F.lit("_"))), F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit("]"))
    return own.select(key, "name", token.alias("token"))


def forms(people: DataFrame, key: str) -> DataFrame:
    """key, first (word), words (all, folded and in lower case), exact (spellings that alone count; null: any case), rank and token."""
    own = read(labelled(people, key), "name").withColumn("__words", _words(F.col("seen"))).where(F.size("__words").between(1, MOST_WORDS))
    spelled = lambda w: F.array_distinct(F.array(w, F.initcap(w), F.upper(w)))
    words, last, first = F.col("__words"), F.element_at("__words", -1), F.element_at("__words", 1)
    several = F.size(words) > 1
    form = lambda words, exact, rank: F.struct(words.alias("words"), exact.alias("exact"), F.lit(rank).alias("rank"))
    any_case = F.lit(None).cast("array<string>")
    whole = F.when(several, form(words, any_case, 0)).otherwise(form(words, spelled(first), 0))
    short = F.when(several & (F.length(last) >= LEAST_LETTERS), form(F.array(F.substring(first, 1, 1), last), any_case, 1))
    parts = [F.when(several & (F.length(w) >= LEAST_LETTERS), form(F.array(w), spelled(w), 2)) for w in (first, last)]
    each = own.select(key, "token", F.explode(F.array_compact(F.array(whole, short, *parts))).alias("f"))
    each = each.select(key, "token", F.transform("f.words", F.lower).alias("words"), F.col("f.exact").alias("exact"), F.col("f.rank").alias("rank")).distinct()
    # of equal forms a whole name's stands; parts and initials that are several people's stand for nobody
    by = Window.partitionBy(key, "words")
    told = each.withColumn("best", F.min("rank").over(by)).where("rank = best").withColumn("others", F.size(F.collect_set("token").over(by)))
    least = F.row_number().over(Window.partitionBy(key, "words").orderBy("token"))
    return told.where("others = 1 OR rank = 0").withColumn("n", least).where("n = 1").select(key, F.col("words")[0].alias("first"), "words", "exact", "rank", "token")


def replaced(lines: DataFrame, people: DataFrame, key: str, pos: str = "pos", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """lines with names replaced by [ADULT_A], [CHILD_1] ..., and the mapping key, kind, value, token, shown for all people.

    A text in which a name is found stands in normal form (single spaces); others stay as they are.
    """
    known = forms(people, key)
    # written: read twice, its rows must have the same numbers
    own = cut(lines.withColumn("__row", F.monotonically_increasing_id())) if "__row" not in lines.columns else lines
    seen = read(own.select("__row", key, text), text)
    word = S.each(S.found("seen", S.raw(_WORD)), lambda s: f"named_struct('start', {s}.start, 'end', {s}.end, 'word', {S.part('seen', s)})")
    after = "transform(w, (x, i) -> named_struct('start', x.start, 'word', x.word, 'next', slice(w, i + 1, {n})))".format(n=MOST_WORDS)
    met = seen.selectExpr("__row", f"`{key}`", "normal", "seen", f"{word} AS w").selectExpr("__row", f"`{key}`", "normal", "seen", f"explode({after}) AS x")
    met = met.withColumn("first", F.lower("x.word")).join(known, [key, "first"])
    size = F.size("words")
    mine = F.slice("x.next", F.lit(1), size)
    apart = F.expr(f"forall(sequence(1, size(words)), i -> i = 1 OR rlike(substring(seen, get(x.next, i - 2).end + 1, get(x.next, i - 1).start - get(x.next, i - 2).end), {S.raw(_BETWEEN)}))")
    is_there = (F.size(mine) == size) & (F.transform(mine, lambda m: F.lower(m["word"])) == F.col("words"))
    met = met.where(is_there & (F.col("exact").isNull() | F.array_contains("exact", F.col("x.word")))).where(apart)
    hit = F.struct(F.col("x.start").alias("start"), "rank", (-size).alias("size"), F.element_at(mine, -1)["end"].alias("end"), "token")
    hits = met.groupBy("__row").agg(F.first("normal").alias("__normal"), F.sort_array(F.collect_list(hit)).alias("hits"))
    # a line's hits in order, each that begins before the last one ended left out
    state = "named_struct('end', -1, 'taken', cast(array() AS array<struct<start:int,end:int,token:string>>))"
    take = "named_struct('end', h.end, 'taken', concat(s.taken, array(named_struct('start', cast(h.start AS int), 'end', cast(h.end AS int), 'token', h.token))))"
    taken = hits.selectExpr("__row", "__normal", f"aggregate(hits, {state}, (s, h) -> IF(h.start >= s.end, {take}, s), s -> s.taken) AS taken")
    gaps = "zip_with(concat(array(0), transform(taken, t -> t.end)), concat(transform(taken, t -> t.start), array(length(__normal))), (a, b) -> substring(__normal, a + 1, b - a))"
    shown = taken.selectExpr("__row", f"array_join(zip_with({gaps}, concat(transform(taken, t -> t.token), array('')), (g, t) -> concat(g, t)), '') AS __shown")
    found = own.join(shown, "__row", "left").withColumn(text, F.coalesce("__shown", text)).select(*lines.columns)
    mapping = labelled(people, key).select(key, F.lit("name").alias("kind"), F.upper("name").alias("value"), "token", F.col("name").alias("shown"))
    return found, mapping
