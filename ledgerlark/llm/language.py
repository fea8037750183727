"""Language identification by word-first backoff.

Training counts every word of every labelled document (nothing is sampled or left out): words by
language, and the 1- to 4-letter runs of these words, marked at their ends. The model is two tables,
of words and of runs, with log frequencies by language. A known word scores by itself; an unseen one
by its longest known runs, with shorter runs where longer ones are unknown. Frequencies are mixed
with a share (``FLOOR``) of the frequency over all languages, so that what a language hasn't seen
scores alike for all languages, however few words one was trained on. Languages are compared by the
sum over all words of a text; the score is the winner's share.

The tables grow with the corpus, so they stay in Spark. The most frequent words and runs, ``COMMON``
of each at most, are broadcast and scored where the texts are; the words beyond them are joined with
the tables, word by word, and their sums are joined back to the rows. Log frequencies are whole
numbers (65536ths), so the sums, and all results, are the same whichever way a word takes.

A word is a run of letters, in lower case. A null text, and one without a letter, is ``und`` with
score 0; so is any text if nothing could be learned. Ties go to the language with more training
words, then to the first by name. Repeated rows count and score each on its own; rows without a
language aren't learned from. Languages are taken to be few: each is a column of the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, inside, kept_in_worker, map_texts, short_batches, slices, starts_of

UNKNOWN = "und"
LONGEST_RUN = 4
#: Share of the joint frequency in each language's own.
FLOOR = 0.01
#: Words, and runs, that are broadcast at most; the others are joined.
COMMON = 150_000
#: Log frequencies are whole numbers of this part of one.
UNIT = 65_536
#: Characters whose words are told side by side.
BLOCK = 1 << 19


@dataclass
class Model:
    """langs: languages by training words, then name; words and runs: tables of key, n, s0, s1 ... (one column
    for each language); common_words (hashes, scores) and common_runs (runs, scores): the most frequent of them;
    all_words, all_runs: whether these are all there are."""

    langs: list[str]
    words: DataFrame | None = None
    runs: DataFrame | None = None
    common_words: tuple = (np.zeros(0, np.uint64), np.zeros((0, 0), np.int64))
    common_runs: tuple = ((), np.zeros((0, 0), np.int64))
    all_words: bool = True
    all_runs: bool = True
    id: str = field(default_factory=lambda: uuid.uuid4().hex)


# Words of texts


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Texts in lower case, as numbers and strings, about BLOCK characters at a time; longer texts are cut between words."""
    owners, parts, held = [], [], 0
    for k, text in enumerate(texts):
        text, start = text.lower(), 0
        while start < len(text):
            end = start + BLOCK - held
            while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
                end += 1
            owners.append(k)
            parts.append(text[start:end])
            held += len(parts[-1])
            start = end
            if held >= BLOCK:
                yield np.array(owners), parts
                owners, parts, held = [], [], 0
    if parts:
        yield np.array(owners), parts


def hashes_of(points: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of these sizes, whose letters stand one after the other."""
    h = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + inside(size).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.add.reduceat(h ^ (h >> np.uint64(32)), starts_of(size)) if len(size) else np.zeros(0, np.uint64)


def _words(owners: np.ndarray, parts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts' joined text, and their words: starts, ends, hashes, and the text that each is of."""
    joined = "\n".join(parts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    edge = np.diff(letter.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    return joined, start, end, hashes_of(points[letter], end - start), owners[np.searchsorted(bounds, start, "right")]


# Training


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, word, n over all rows: counted block by block before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                names = part.column(0).dictionary_encode()
                code = names.indices.to_numpy()
                for owners, parts in _blocks(part.column(1).to_pylist()):
                    joined, start, end, hashes, owner = _words(owners, parts)
                    key = hashes ^ (code[owner].astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
                    _, at, n = np.unique(key, return_index=True, return_counts=True)
                    words = [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
                    yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(code[owner[at]])).cast(pa.string()), pa.array(words, pa.string()), pa.array(n)], schema=schema)

    short_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{lang}`").cast("string"), F.col(f"`{text}`").cast("string")).dropna()
    return source.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def run_counts(words: DataFrame, counts: list[str]) -> DataFrame:
    """run and the sums of counts: the runs of letters of counted words, whose ends are marked < and >."""
    marked = F.concat(F.lit("<"), "word", F.lit(">"))
    # pieces of 64 letters and the few after them, so that a long word isn't copied once for each letter
    pieces = F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{1,{63 + LONGEST_RUN}}})).{{1,64}}"), F.lit(1))
    at = F.explode(F.sequence(F.lit(1), F.least(F.lit(64), F.length("marked")))).alias("at")
    placed = words.select(*counts, F.explode(pieces).alias("marked")).select(*counts, "marked", at)
    each = placed.select(*counts, F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_RUN), F.length("marked") - F.col("at") + 1))).alias("size"), "marked", "at")
    return each.groupBy(F.col("marked").substr(F.col("at"), F.col("size")).alias("run")).agg(*[F.sum(c).alias(c) for c in counts])


def _scored(counts: DataFrame, key: str, totals: list[Column]) -> DataFrame:
    """key, n (over all languages) and the log frequency in each language, of counts n0, n1 ..."""
    own = [F.col(f"n{i}") for i in range(len(totals))]
    n, total = sum(own[1:], own[0]), sum(totals[1:], totals[0])
    logs = [F.round(UNIT * F.ln((1 - FLOOR) * c / F.greatest(t, F.lit(1)) + FLOOR * n / total)).cast("bigint").alias(f"s{i}") for i, (c, t) in enumerate(zip(own, totals))]
    return counts.select(key, n.alias("n"), *logs)


def _common(table: DataFrame, most: int) -> tuple[pa.Table, bool]:
    """The rows with the largest n, most of them at most, and whether these are all: by the classes of n that fit whole."""
    size = F.floor(8 * F.log2("n"))
    left, least = most, None
    classes = sorted(((r.size, r["count"]) for r in table.groupBy(size.alias("size")).count().collect()), reverse=True)
    for kind, count in classes:
        if count > left:
            break
        left, least = left - count, kind
    found = table.where(size >= least) if least is not None else table.limit(0)
    return found.drop("n").toArrow(), not classes or least == classes[-1][0]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON) -> Model:
    counted = cut(word_counts(docs, text, lang))
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals, key=lambda x: (-totals[x], x))
    if not langs:
        return Model([])
    names = [f"n{i}" for i in range(len(langs))]
    own = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(c) for x, c in zip(langs, names)]
    wide = cut(counted.groupBy("word").agg(*own))
    runs = cut(run_counts(wide, names))
    by_size = {r["size"]: r for r in runs.groupBy(F.length("run").alias("size")).agg(*[F.sum(c).alias(c) for c in names]).collect()}
    of_size = lambda c: F.element_at(F.array(*[F.lit(by_size[k][c] if k in by_size else 0) for k in range(1, LONGEST_RUN + 1)]), F.length("run"))
    words, runs = _scored(wide, "word", [F.lit(totals[x]) for x in langs]), _scored(runs, "run", [of_size(c) for c in names])
    (some_words, all_words), (some_runs, all_runs) = _common(words, common), _common(runs, common)
    scores = lambda table: np.stack([table[f"s{i}"].to_numpy() for i in range(len(langs))], 1) if len(table) else np.zeros((0, len(langs)), np.int64)
    texts = some_words["word"].to_pylist()
    hashes = hashes_of(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts)))
    order = np.argsort(hashes)
    return Model(langs, words, runs, (hashes[order], scores(some_words)[order]), (some_runs["run"].to_pylist(), scores(some_runs)), all_words, all_runs)


# Scoring


def first_kernel(model):
    """Sums over the common words of each text, whether it has a letter, and its other words with their numbers."""
    hashes, scores = kept_in_worker(("language", model.value["id"]), lambda: model.value["words"])
    n_langs = model.value["langs"]
    rare_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def kernel(texts: pa.Array) -> list[pa.Array]:
        total, letters = np.zeros((len(texts), n_langs), np.int64), np.zeros(len(texts), bool)
        owners, words, counts = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
        for owners_of, parts in _blocks(texts.to_pylist()):
            joined, start, end, own, owner = _words(owners_of, parts)
            letters[owner] = True
            kind, at, of = np.unique(own, return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(hashes, kind), max(0, len(hashes) - 1))
            known = hashes[place] == kind if len(hashes) else np.zeros(len(kind), bool)
            for i in range(n_langs if known.any() else 0):
                value = np.where(known, scores[place, i], 0)
                total[:, i] += np.bincount(owner, value[of], len(texts)).astype(np.int64)
            if n_langs and not known.all():
                other = ~known[of]
                pair, n = np.unique(owner[other] * len(kind) + of[other], return_counts=True)
                which = at[pair % len(kind)]
                owners.append(pair // len(kind))
                words += [joined[a:b] for a, b in zip(start[which].tolist(), end[which].tolist())]
                counts.append(n)
        owner = np.concatenate(owners)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        rare = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(np.concatenate(counts))], names=["word", "n"])
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n_langs), pa.array(total.reshape(-1)))
        return [sums, pa.array(letters), pa.ListArray.from_arrays(pa.array(bounds), rare).cast(rare_type)]

    return kernel


def first_pass(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """docs' kept columns, sums (by language, of common words), letters, rare (other words and their numbers), and a number for each row."""
    fields = [T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("letters", T.BooleanType()), T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])))]
    common = docs.sparkSession.sparkContext.broadcast({"id": model.id, "words": model.common_words, "langs": len(model.langs)})
    return map_texts(docs, text, keep, fields, first_kernel, common).withColumn("row", F.monotonically_increasing_id())


def backoff_kernel(model):
    """Words that no training text has: sums over the places where a common run is the longest known one, the number
    of these places, and the places where longer runs, which aren't common, may be known."""

    def run(batches):
        runs, scores = kept_in_worker(("runs", model.value["id"]), lambda: ({r: i for i, r in enumerate(model.value["runs"][0])}, model.value["runs"][1]))
        n_langs, complete = model.value["langs"], model.value["complete"]
        for batch in batches:
            total, places, opened = [], [], []
            for word in batch.column(0).to_pylist():
                marked, found, asked = f"<{word}>", [], []
                for at in range(len(marked)):
                    longer, known = [], None
                    for size in range(min(LONGEST_RUN, len(marked) - at), 0, -1):
                        if (known := runs.get(marked[at : at + size])) is not None:
                            found.append(known)
                            break
                        longer.append(marked[at : at + size])
                    if longer and not complete:
                        asked.append({"at": at, "known": scores[known].tolist() if known is not None else None, "runs": longer})
                total.append(scores[found].sum(0).tolist() if found else [0] * n_langs)
                places.append(len(found))
                opened.append(asked)
            arrays = [batch.column(0), pa.array(total, pa.list_(pa.int64())), pa.array(places, pa.int64()), pa.array(opened, pa.list_(pa.struct([("at", pa.int64()), ("known", pa.list_(pa.int64())), ("runs", pa.list_(pa.string()))])))]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "total", "places", "opened"])

    return run


def unseen_scores(words: DataFrame, model: Model) -> DataFrame:
    """word and s0, s1 ... of words that the model doesn't have: the mean over their longest known runs."""
    langs = range(len(model.langs))
    common = words.sparkSession.sparkContext.broadcast({"id": model.id, "runs": model.common_runs, "langs": len(model.langs), "complete": model.all_runs})
    schema = "word string, total array<bigint>, places bigint, opened array<struct<at:bigint,known:array<bigint>,runs:array<string>>>"
    told = words.select("word").mapInArrow(lambda batches: backoff_kernel(common)(batches), schema)
    total, places = [F.col("total")[i] for i in langs], F.col("places")
    if not model.all_runs:  # a longer run takes the place of the shorter one that was known
        told = cut(told)
        asked = told.select("word", F.explode("opened").alias("o")).select("word", "o.at", "o.known", F.explode("o.runs").alias("run"))
        hits = asked.join(model.runs.drop("n"), "run").groupBy("word", "at").agg(F.max_by(F.struct("known", *[f"s{i}" for i in langs]), F.length("run")).alias("hit"))
        more = [F.sum(F.col(f"hit.s{i}") - F.coalesce(F.col("hit.known")[i], F.lit(0))).alias(f"d{i}") for i in langs]
        told = told.join(hits.groupBy("word").agg(*more, F.count(F.when(F.col("hit.known").isNull(), 1)).alias("new")), "word", "left")
        total, places = [t + F.coalesce(F.col(f"d{i}"), F.lit(0)) for i, t in zip(langs, total)], places + F.coalesce("new", F.lit(0))
    return told.select("word", *[F.when(places > 0, F.floor(t / places)).otherwise(0).cast("bigint").alias(f"s{i}") for i, t in zip(langs, total)])


def rare_sums(first: DataFrame, model: Model) -> DataFrame:
    """row and r0, r1 ...: sums over the words of each row that aren't common."""
    langs = range(len(model.langs))
    pairs = first.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.n")
    vocabulary = pairs.select("word").distinct()
    if model.all_words:
        scored = unseen_scores(vocabulary, model)
    else:
        looked_up = cut(vocabulary.join(model.words.drop("n"), "word", "left"))
        scored = looked_up.where("s0 is not null").unionByName(unseen_scores(looked_up.where("s0 is null"), model))
    # written, so that what meets below are two plain shuffles, and a word of many rows is split by adaptive execution
    scored = cut(scored)
    return pairs.join(scored, "word").groupBy("row").agg(*[F.sum(F.col("n") * F.col(f"s{i}")).alias(f"r{i}") for i in langs])


def _told(langs: list[str], totals: Column) -> tuple[Column, Column]:
    """The best language and its share."""
    best = F.array_max(totals)
    share = 1 / F.aggregate(totals, F.lit(0.0), lambda s, t: s + F.exp((t - best) / UNIT))
    return F.element_at(F.array(*map(F.lit, langs)), F.array_position(totals, best).cast("int")), share


def predicted(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs' kept columns, lang_pred and score; these take the places of columns of their names."""
    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("lang_pred", "score")]
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]
    first = first_pass(own, model, "text", own.columns[:-1])
    if not model.langs:
        return first.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    first = cut(first)
    totals = F.array(*[F.col("sums")[i] + F.coalesce(F.col(f"r{i}"), F.lit(0)) for i in range(len(model.langs))])
    joined = first.drop("rare").join(rare_sums(first, model), "row", "left").withColumn("totals", totals)
    best, share = _told(model.langs, F.col("totals"))
    return joined.select(*names, F.when(F.col("letters"), best).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("letters"), share).otherwise(0.0).alias("score"))


def told(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that aren't ``und``, with all their columns; where lang is null it becomes the predicted one.

    A text with a letter is never und, so what goes is known after the first pass; only rows without a language
    wait for the sums over their other words, and no other text moves. If nothing could be learned, documents with
    a letter stay as they are.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    shown = [F.col(new).alias(old) for old, new in names.items()]
    first = first_pass(docs.toDF(*names.values()), model, names[text], list(names.values())).where("letters")
    at = next((new for old, new in names.items() if old.lower() == lang.lower()), None)
    if not model.langs or at is None:
        return first.select(*shown)
    first = cut(first)
    waits = F.col(at).isNull() & (F.size("rare") > 0)
    waiting = first.where(waits)
    totals = F.array(*[F.col("sums")[i] + F.coalesce(F.col(f"r{i}"), F.lit(0)) for i in range(len(model.langs))])
    settled = first.where(~waits).withColumn("totals", F.col("sums"))
    summed = waiting.join(rare_sums(waiting, model), "row", "left").withColumn("totals", totals)
    both = settled.select(*names.values(), "totals").unionByName(summed.select(*names.values(), "totals"))
    return both.withColumn(at, F.coalesce(at, _told(model.langs, F.col("totals"))[0])).select(*shown)
