"""Benchmark decontamination by winnowing.

Words are runs of a-z, 0-9 and everything outside ASCII, after lower-casing A-Z. An item's windows
are its runs of 13 words (an item of fewer words is one window). Winnowing keeps, of every window's
k-word hashes, the smallest; as equal windows keep equal hashes, the kept fingerprints of documents
and items meet wherever they share a whole window. Each meeting is extended to its window and
compared word for word, so the result is exact.

The windows of items are counted first. Up to ``AT_HAND`` of them (with one row for each item that has
one) are broadcast, and documents meet them without a shuffle. Of a larger benchmark nothing goes
through the driver: kept fingerprints of documents and items are joined, then the hashes of the
windows around those that meet, then the words of the documents concerned. Both give the same.

Null and empty documents have no words and are clean; null and empty items have no window. Repeated
rows are judged each on its own; items that repeat an id count once. Items without an id count in
n_hit like all others and are missing only from the list of items. Without items, nothing is hit.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Packed, aside, buffer_of, cut, kept_in_worker, map_texts, short_batches, slices

WINDOW = 13
#: Words of a fingerprint; shorter windows use what they have.
GRAM = 5
#: Windows of items, counted for each item, that are broadcast at most; one takes some 300 bytes on an executor.
AT_HAND = 100_000
#: Bytes of text whose words are hashed at once.
BLOCK = 1 << 20

#: A-Z to a-z, digits and bytes of other alphabets as they are, all else to 0.
_WORD = np.zeros(256, np.uint8)
_WORD[48:58], _WORD[97:123], _WORD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_WORD[65:91] = _WORD[97:123]
_STEP, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS = np.cumprod(np.full(64, _STEP, np.uint64), dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lowered and separators 0; starts, ends and hashes of words."""
    global _POWERS
    data = _WORD[data]
    edge = np.diff(np.concatenate(([0], (data != 0).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes, at = [], 0
    while at < len(starts):  # as many words as fit a block, and one at least
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        size = ends[at:to] - starts[at:to]
        if len(_POWERS) < (most := int(size.max())):
            _POWERS = np.cumprod(np.full(2 * most, _STEP, np.uint64), dtype=np.uint64)
        part = data[starts[at] : ends[to - 1]]
        part = part[part != 0].astype(np.uint64)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        part *= _POWERS[np.arange(len(part)) - np.repeat(first, size)]
        hashes.append(_mix(np.add.reduceat(part, first) + size.astype(np.uint64)))
        at = to
    return data, starts, ends, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = max(0, len(hashes) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _NEXT + hashes[j : j + n]
    return _mix(total)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best of every run of width values, by doubling."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = best(values[: len(values) - step], values[step:])
        reach += step
    return values


def winnow(values: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the smallest of some run of width values (all places that tie)."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    if width == 1:
        return np.arange(len(values))
    least = _sliding(values, width, np.minimum)
    around = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    return np.flatnonzero(_sliding(around, width, np.maximum) == values)


@dataclass
class _Texts:
    """The words of some texts, one text after the other: where each starts in packed (words with a separator after
    each), its text, its hash; and the number of each text's first word."""

    packed: bytes
    place: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def starts(self, places: np.ndarray, n: int, k: int) -> np.ndarray:
        """The windows of n words, each inside one text, that hold one of the k-word grams at places."""
        s = np.unique((places[:, None] - np.arange(n - k + 1)).ravel())
        s = s[(s >= 0) & (s + n <= len(self.hashes))]
        return s[self.doc[s] == self.doc[s + n - 1]]

    def words(self, start: int, n: int) -> bytes:
        return self.packed[self.place[start] : self.place[start + n] - 1]


def read_words(texts: pa.Array) -> _Texts:
    raw, at = buffer_of(texts)
    n_docs = len(at) - 1
    apart = np.zeros(len(raw) + n_docs, np.uint8)  # a separator after each text keeps words of neighbours apart
    apart[np.arange(len(raw)) + np.repeat(np.arange(n_docs), np.diff(at))] = raw
    data, starts, ends, hashes = words_of(apart)
    kept = data != 0
    kept[1:] |= data[:-1] != 0
    doc = np.searchsorted(at[1:] + np.arange(1, n_docs + 1), starts, "right")
    return _Texts(data[kept].tobytes(), np.append(0, np.cumsum(ends - starts + 1)), doc, hashes, np.searchsorted(doc, np.arange(n_docs + 1)))


def _tally(t: _Texts, found: Iterable[tuple[int, int, list[str]]]) -> list[pa.Array]:
    """Words, hit words and items of each text, from occurrences (first word, words, items)."""
    hit = np.zeros(len(t.hashes) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(t.first) - 1)]
    for start, n, own in found:
        hit[start] += 1
        hit[start + n] -= 1
        items[t.doc[start]].update(own)
    covered = np.append(0, np.cumsum(np.cumsum(hit[:-1]) > 0))
    return [pa.array(np.diff(t.first)), pa.array(covered[t.first[1:]] - covered[t.first[:-1]]), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]


# Items


def item_windows(items: DataFrame, item_id: str, text: str, window: int, gram: int) -> DataFrame:
    """n, fp, win, words, item: every window of every item, with its number of words, smallest gram hash, own hash and words."""
    schema = pa.schema([("n", pa.int32()), ("fp", pa.int64()), ("win", pa.int64()), ("words", pa.binary()), ("item", pa.string())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                t = read_words(pc.fill_null(part.column(1), ""))
                size = np.minimum(np.diff(t.first), window)
                for n in np.unique(size[size > 0]).tolist():
                    k = min(gram, n)
                    s = np.arange(len(t.hashes) - n + 1)
                    s = s[(t.doc[s] == t.doc[s + n - 1]) & (size[t.doc[s]] == n)]
                    least = _sliding(grams(t.hashes, k), n - k + 1, np.minimum)[s]
                    words = [t.words(i, n) for i in s.tolist()]
                    item = part.column(0).take(pa.array(t.doc[s]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), n, np.int32)), pa.array(least.view(np.int64)), pa.array(grams(t.hashes, n)[s].view(np.int64)), pa.array(words, pa.binary()), item], schema=schema)

    short_batches(items.sparkSession)
    own = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    return own.mapInArrow(run, "n int, fp bigint, win bigint, words binary, item string")


def index_windows(rows: pa.Table) -> dict:
    """Windows by their number of words: all fingerprints, sorted; and hashes, sorted, with words and items."""
    index = {}
    for n in pc.unique(rows["n"]).to_pylist():
        own = rows.filter(pc.equal(rows["n"], n))
        order = np.argsort(own["win"].to_numpy().view(np.uint64), kind="stable")
        own = own.take(pa.array(order))
        index[n] = {"fingerprints": np.unique(own["fp"].to_numpy().view(np.uint64)), "hashes": own["win"].to_numpy().view(np.uint64), "words": own["words"].to_pylist(), "items": own["own"].to_pylist()}
    return index


# Documents, with all items at hand


def hit_kernel(packed, window: int, gram: int):
    index = kept_in_worker(("decontaminate", packed.id), lambda: pickle.loads(packed.packed.value))

    def kernel(texts: pa.Array) -> list[pa.Array]:
        t = read_words(texts)

        def found():
            for n, group in index.items():
                k = min(gram, n)
                values = grams(t.hashes, k)
                places = winnow(values, n - k + 1)
                at = np.minimum(np.searchsorted(group["fingerprints"], values[places]), len(group["fingerprints"]) - 1)
                starts = t.starts(places[group["fingerprints"][at] == values[places]], n, k)
                own = grams(t.hashes, n)[starts]
                low, high = (np.searchsorted(group["hashes"], own, side) for side in ("left", "right"))
                for i in np.flatnonzero(high > low).tolist():
                    for w in range(low[i], high[i]):  # more than one only where different windows share a hash
                        if t.words(starts[i], n) == group["words"][w]:
                            yield starts[i], n, group["items"][w]

        return _tally(t, found())

    return kernel


# Documents, joined with items


def mark_kernel(sizes: list[int], gram: int):
    """The kept fingerprints of each text, with the windows around each: their first words and hashes."""

    def kernel(texts: pa.Array) -> list[pa.Array]:
        t = read_words(texts)
        rows: list[list[dict]] = [[] for _ in range(len(texts))]
        for n in sizes:
            k = min(gram, n)
            values = grams(t.hashes, k)
            places, own = winnow(values, n - k + 1), grams(t.hashes, n).view(np.int64)
            for p, fp in zip(places.tolist(), values[places].view(np.int64).tolist()):
                s = t.starts(np.array([p]), n, k)
                if len(s):
                    rows[t.doc[p]].append({"n": n, "fp": fp, "start": int(s[0] - t.first[t.doc[p]]), "wins": own[s].tolist()})
        return [pa.array(rows, _MARKS)]

    return kernel


_MARKS = pa.list_(pa.struct([("n", pa.int32()), ("fp", pa.int64()), ("start", pa.int64()), ("wins", pa.list_(pa.int64()))]))
_MARK_TYPE = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("start", T.LongType()), T.StructField("wins", T.ArrayType(T.LongType()))]))


def _verify(batches):
    """row, text and candidates (start, n, words, items) to row and the counts."""
    for batch in batches:
        for part in slices(batch, 1):
            t = read_words(part.column(1))
            found = ((int(t.first[d]) + c["start"], c["n"], c["own"]) for d, own in enumerate(part.column(2).to_pylist()) for c in own if t.words(int(t.first[d]) + c["start"], c["n"]) == c["words"])
            yield pa.RecordBatch.from_arrays([part.column(0), *_tally(t, found)[1:]], names=["row", "n_hit", "items"])


def _joined(docs: DataFrame, windows: DataFrame, keep: list[str], text: str, gram: int) -> DataFrame:
    """The same by keyed joins: fingerprints of documents and items, then hashes of the windows around those that meet,
    then the words of documents that are left. Items and what they meet are written before a join, so that all joins
    are of plain shuffles, and a fingerprint of many documents is split by adaptive execution."""
    names = {c: f"c{i}" for i, c in enumerate(keep)}
    sizes = sorted(r.n for r in windows.select("n").distinct().collect())
    own = docs.select(*[F.col(f"`{c}`").alias(new) for c, new in names.items()], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    marked = cut(map_texts(own, "text", own.columns, [T.StructField("marks", _MARK_TYPE)], mark_kernel, sizes, gram).withColumn("row", F.monotonically_increasing_id()))
    marks = marked.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    met = marks.join(cut(windows.select("n", "fp").distinct()), ["n", "fp"], "left_semi")
    around = met.select("row", "n", "start", F.posexplode("wins").alias("more", "win")).select("row", "n", (F.col("start") + F.col("more")).alias("start"), "win").distinct()
    candidates = around.join(windows.select("n", "win", "words", "own"), ["n", "win"])
    by_row = cut(candidates.groupBy("row").agg(F.collect_list(F.struct("n", "start", "words", "own")).alias("candidates")))
    hits = marked.select("row", "text").join(by_row, "row").mapInArrow(_verify, "row bigint, n_hit bigint, items array<string>")
    shown = [F.col(new).alias(c) for c, new in names.items()]
    n_words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).cast("bigint").alias("n_words")
    none = F.array().cast("array<string>")
    return marked.drop("marks").select("row", *names.values(), n_words).join(hits, "row", "left").select(*shown, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", none).alias("items"))


def contamination(docs: DataFrame, bench: DataFrame, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, at_hand: int = AT_HAND) -> DataFrame:
    """docs' kept columns, n_words, n_hit (words inside an occurring window) and items (sorted ids of items with one).

    The three take the places of columns of their names.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]
    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("n_words", "n_hit", "items")]
    pairs = cut(item_windows(bench, item_id, item_text, window, gram).distinct())
    windows = pairs.groupBy("n", "fp", "win", "words").agg(F.collect_set("item").alias("own"))
    if pairs.count() > at_hand:
        return _joined(docs, cut(windows), keep, text, gram)
    return map_texts(docs, text, keep, fields, hit_kernel, Packed(docs.sparkSession, index_windows(windows.toArrow())), window, gram)


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean_documents(docs: DataFrame, bench: DataFrame, text: str = "text", unnamed: bool = False) -> DataFrame:
    """The documents of which less than a twentieth of the words are hit, with all their columns.

    unnamed: whether items without an id count too, as in contamination.
    """
    own, name, restore = aside(docs)
    items = bench if unnamed else bench.where("item_id is not null")
    return restore(contamination(own, items, text=name[text]).where(~is_contaminated()))
