"""Cross-tokenizer alignment by inverted pair bitmaps.

A text is encoded by two tokenizers: A by byte-level pieces, B by SentencePiece pieces. Byte offsets at
which tokens of both end cut the tokens into groups, and the two tokens that end there are a link. How
strongly a pair of ids belongs together is its number of links in the whole corpus.

Postings are inverted by pair. Documents are numbered within blocks of at most ``BLOCK`` documents; for
each pair of a block there is a compressed bitmap of its documents (their numbers in order, or plain bits
where they are many), and multiplicity planes: plane k is the bitmap of documents in which bit k of the
number of links beyond the first is set. Slices of a block are OR-merged when the block ends. Blocks
have no document in common, so the popcounts of their bitmaps add up: of the document bitmap to the
number of documents of a pair, of the planes, by weight, to its number of links. The totals go back to
the postings, and each block returns the scores of its documents from its own bitmaps. A pair that all
texts hold is one row for each block, so nothing grows with how common it is.

Texts are cut where a single space stands between other characters; neither tokenizer has a token that
goes over such a place (checked for B's pieces), so equal words are encoded once in a slice.

A null or empty text has no tokens: zeros, and no groups. So has a text whose tokens' bytes don't give a
space and the text, as with a U+2581 of its own. Rows repeated count each on its own, rows without an id
too; an empty table gives none. Columns in ``keep`` that are called like a computed one give way to it.
The files of both tokenizers are parameters and are read where texts are encoded.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, inside, kept_in_worker, short_batches, slices, starts_of

#: Documents of a block at most, and its entries (pairs of a document) after which it ends.
BLOCK, ENTRIES = 8192, 2_000_000
#: Words, and their characters, that a worker remembers at most.
MEMORY, MEMORY_CHARS = 400_000, 16 << 20
#: Where texts may be cut: a single space between characters that aren't white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _byte_level() -> dict[str, int]:
    """Byte-level alphabets show a printable byte of Latin-1 as itself and the others, in order, from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """One tokenizer: how it encodes, and the bytes of its ids, flat."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode = encode
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start, self.data = starts_of(self.size), np.frombuffer(b"".join(tokens), np.uint8)

    def written(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, one after the other."""
        size = self.size[ids]
        return self.data[np.repeat(self.start[ids], size) + inside(size)]


def sides(a_file: str, b_file: str) -> tuple[Side, Side]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_file), SentencePieceProcessor(model_file=b_file)
    a.encode_special_tokens = True
    of = _byte_level()
    names = [a.id_to_token(i) or "" for i in range(a.get_vocab_size())]
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("a piece goes over a place where texts are cut")
    return (
        Side(lambda texts: [e.ids for e in a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], [bytes(of[c] for c in x) if all(c in of for c in x) else x.encode() for x in names]),
        Side(lambda texts: b.encode(texts, out_type=int, num_threads=1), [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]),
    )


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), size


class Aligner:
    """Counts, groups and pairs of whole texts; words are remembered within bounds."""

    def __init__(self, a_file: str, b_file: str):
        self.sides = sides(a_file, b_file)
        # an id as text, and what follows it: a comma inside a group, a bar or a semicolon at the end of its side
        most = max(len(s.size) for s in self.sides)
        self.shown = [Side(None, [f"{i}{mark}".encode() for i in range(most)]) for mark in ",|;"]
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.chars, self.groups = 0, []
        self.numbers, self.fails = np.zeros((0, 4), np.int64), np.zeros(0, bool)
        self.keys, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode words. Those that begin and end with other than white space are joined again, as a text has them, and
        are told apart by their bytes."""
        joins = [not w[:1].isspace() and not w[-1:].isspace() and w != "" and "▁" not in w for w in words]
        plain, odd = [w for w, j in zip(words, joins) if j], [w for w, j in zip(words, joins) if not j]
        lines = [" ".join(plain[i : i + 200]) for i in range(0, len(plain), 200)]
        for own, texts in ((plain, lines), *[([w], [w]) for w in odd]):
            if own:
                ids = [_flat(side.encode(texts))[0] for side in self.sides]
                self._keep(own, ids)

    def _keep(self, words: list[str], ids: list[np.ndarray]) -> None:
        """Remember words from the tokens of all of them: numbers of tokens, groups and links, the groups' text, linked pairs."""
        utf = [(" " + w).encode() for w in words]
        size = np.fromiter(map(len, utf), np.int64, len(utf))
        want = np.frombuffer(b"".join(utf), np.uint8)
        if not all(np.array_equal(side.written(own), want) for side, own in zip(self.sides, ids)):
            if len(words) > 1:  # one by one, to tell whose bytes differ
                for w in words:
                    self._keep([w], [_flat(side.encode([w]))[0] for side in self.sides])
                return
            size, ids = np.zeros(1, np.int64), [i[:0] for i in ids]
        # every token has bytes, so the ends of tokens rise and each end belongs to one token
        ends = [np.cumsum(side.size[own]) for side, own in zip(self.sides, ids)]
        common, at_a, at_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        stops = np.cumsum(size)
        word = np.searchsorted(stops, common)
        links = np.bincount(word, minlength=len(words))
        tokens = [np.bincount(np.searchsorted(stops, e), minlength=len(words)) for e in ends]
        # the groups as text: A's tokens of a group, then B's
        text, keys = [], []
        for side, (own, last, e, mark) in enumerate(((ids[0], at_a, ends[0], 1), (ids[1], at_b, ends[1], 2))):
            is_last = np.zeros(len(own), bool)
            is_last[last] = True
            text.append(np.where(is_last, mark, 0) * len(self.shown[0].size) + own)
            keys.append(np.searchsorted(common, e) * 2 + side)
        text, keys = np.concatenate(text), np.concatenate(keys)
        text = text[np.argsort(keys, kind="stable")]
        mark, own = text // len(self.shown[0].size), text % len(self.shown[0].size)
        length = np.choose(mark, [s.size[own] for s in self.shown])
        out, at = np.zeros(int(length.sum()), np.uint8), starts_of(length)
        for k, shown in enumerate(self.shown):
            here = mark == k
            out[np.repeat(at[here], length[here]) + inside(length[here])] = shown.written(own[here])
        bounds = np.concatenate(([0], np.cumsum(np.bincount(np.searchsorted(stops, common[np.sort(keys) // 2]), length, len(words)).astype(np.int64)))).tolist()
        out = out.tobytes()
        known = len(self.groups)
        self.groups += [out[i:j] for i, j in zip(bounds, bounds[1:])]
        self.fails = np.concatenate((self.fails, size == 0))
        self.numbers = np.concatenate((self.numbers, np.stack((*tokens, links, links), 1)))
        self.keys = np.concatenate((self.keys, (ids[0][at_a] << 32) | ids[1][at_b]))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(links)))
        self.code.update((w, known + i) for i, w in enumerate(words))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text n_a, n_b, n_groups, n_links, and its groups; of all texts the entries: pair, text and number of
        links, ordered by pair, then text."""
        found = [CUT.split(t) if t else [] for t in texts]  # each part stands after a space
        new = list({w: None for own in found for w in own if w not in self.code})
        if len(self.code) + len(new) > MEMORY or self.chars + sum(map(len, new)) > MEMORY_CHARS:
            self._forget()
            new = list({w: None for own in found for w in own})
        if new:
            self.chars += sum(map(len, new))
            self._learn(new)
        counts, groups, owners, codes = np.zeros((len(texts), 4), np.int64), [], [], []
        for i, own in enumerate(found):
            at = [self.code[w] for w in own]
            whole = b"".join([self.groups[k] for k in at])[:-1]
            at = np.array(at, np.int64)
            if not own or self.fails[at].any():
                groups.append(b"")
                continue
            groups.append(whole)
            counts[i] = self.numbers[at].sum(0)
            at, n = np.unique(at, return_counts=True)
            codes.append((at, n))
            owners.append(np.full(len(at), i))
        if not codes:
            return counts, groups, (np.zeros(0, np.int64),) * 3
        code, n, owner = np.concatenate([c for c, _ in codes]), np.concatenate([n for _, n in codes]), np.concatenate(owners)
        links = self.first[code + 1] - self.first[code]
        at = np.repeat(self.first[code], links) + inside(links)
        return counts, groups, summed(self.keys[at], np.repeat(owner, links), np.repeat(n, links))


def summed(pair: np.ndarray, doc: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by pair and document with their links added: the OR of postings, with its multiplicities."""
    if not len(pair):
        return pair, doc, links
    kinds, pair = np.unique(pair, return_inverse=True)
    key = pair * (int(doc.max()) + 1) + doc
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    links = np.add.reduceat(links[order], first)
    order = order[first]
    return kinds[pair[order]], doc[order], links


# bitmaps


def packed(owner: np.ndarray, doc: np.ndarray, owners: int) -> pa.Array:
    """One compressed bitmap for each owner from its documents, in order: 16-bit numbers, or BLOCK bits if that's shorter."""
    count = np.bincount(owner, minlength=owners)
    dense = count * 16 >= BLOCK
    size = np.where(dense, BLOCK // 8, 2 * count)
    offsets = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(offsets[-1]), np.uint8)
    plain = ~dense[owner]
    at = offsets[owner[plain]] + 2 * inside(count)[plain]
    out[at], out[at + 1] = doc[plain] & 255, doc[plain] >> 8
    np.bitwise_or.at(out, offsets[owner[~plain]] + (doc[~plain] >> 3), np.left_shift(1, doc[~plain] & 7).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), owners, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def unpacked(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Owner and document of every bit that is set."""
    size = pc.binary_length(bitmaps).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    data = np.frombuffer(b"".join(bitmaps.to_pylist()), np.uint8)
    dense = np.repeat(size == BLOCK // 8, size)
    few = data[~dense].reshape(-1, 2).astype(np.int64)
    bits = np.unpackbits(data[dense].reshape(-1, BLOCK // 8), axis=1, bitorder="little")
    row, doc = np.nonzero(bits)
    return np.concatenate((owner[~dense][::2], np.flatnonzero(size == BLOCK // 8)[row])), np.concatenate((few[:, 0] | few[:, 1] << 8, doc))


def planes_of(extra: np.ndarray, owner: np.ndarray, doc: np.ndarray, owners: int) -> tuple[np.ndarray, pa.Array]:
    """Numbers beyond the first as bit planes: how many planes each owner has, and the planes of all, one after the other."""
    most = np.zeros(owners, np.int64)
    np.maximum.at(most, owner, extra)
    number = np.zeros(owners, np.int64)
    while (more := most >> number > 0).any():
        number += more
    first, places, docs = starts_of(number), [], []
    for k in range(int(number.max(initial=0))):
        has = (extra >> k & 1).astype(bool)
        places.append(first[owner[has]] + k)
        docs.append(doc[has])
    place, own = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, docs))
    order = np.lexsort((own, place))
    return number, packed(place[order], own[order], int(number.sum()))


def popcounts(bitmaps: pa.Array) -> np.ndarray:
    owner, _ = unpacked(bitmaps)
    return np.bincount(owner, minlength=len(bitmaps))


_POSTING = "block bigint, number int, doc {doc}, pair bigint, docs bigint, links bigint, bits binary, planes array<binary>"


class Block:
    """Postings of up to BLOCK documents of one task."""

    def __init__(self, number: int):
        self.number, self.docs, self.entries, self.size = number, 0, [], 0

    def add(self, entries: tuple[np.ndarray, np.ndarray, np.ndarray], docs: int) -> None:
        pair, doc, links = entries
        self.entries.append((pair, doc + self.docs, links))
        self.docs, self.size = self.docs + docs, self.size + len(pair)

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, pa.Array]:
        """By pair: documents, links, the document bitmap, the number of planes, and all planes."""
        pair, doc, links = summed(*(np.concatenate([e[i] for e in self.entries]) for i in range(3)))
        pairs, owner = np.unique(pair, return_inverse=True)
        bits = packed(owner, doc, len(pairs))
        number, planes = planes_of(links - 1, owner, doc, len(pairs))
        plane_owner = np.repeat(np.arange(len(pairs)), number)
        docs = popcounts(bits)
        links = docs + np.bincount(plane_owner, (popcounts(planes) << inside(number)).astype(float), len(pairs)).astype(np.int64)
        return pairs, docs, links, bits, number, planes


def postings(docs: DataFrame, text: str, keep: list[str], a_file: str, b_file: str, with_groups: bool, entries: int = ENTRIES) -> DataFrame:
    """A row for every document (doc) and one for every pair of a block. Texts don't move."""
    spark = docs.sparkSession
    short_batches(spark)
    own = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("groups_sha256", T.StringType())] + [T.StructField("groups", T.StringType())] * with_groups
    taken = {f.name for f in own} | {"count_sum", "n_best"}
    keep = [c for c in keep if c.lower() not in taken]
    doc = T.StructType([docs.schema[c] for c in keep] + own)
    schema = T.StructType.fromDDL(_POSTING.format(doc="int"))
    schema["doc"].dataType = doc
    source = docs.select(F.spark_partition_id().alias("__task"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def doc_rows(block: Block, kept: list, counts: np.ndarray, groups: list[bytes], first: int, types: list) -> pa.RecordBatch:
        digests = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string())
        fields = [*kept, *[pa.array(counts[:, i]) for i in range(4)], digests, *([pa.array(groups, pa.binary()).cast(pa.string())] if with_groups else [])]
        n = len(groups)
        lead = [pa.array(np.full(n, block.number)), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.StructArray.from_arrays(fields, doc.names)]
        return pa.RecordBatch.from_arrays([*lead, *[pa.nulls(n, t) for t in types]], names=schema.names)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]

    def pair_rows(block: Block, like: pa.DataType) -> Iterator[pa.RecordBatch]:
        if not block.size:
            return
        pairs, docs, links, bits, number, planes = block.postings()
        planes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(number))).astype(np.int32)), planes)
        n = len(pairs)
        rows = pa.RecordBatch.from_arrays([pa.array(np.full(n, block.number)), pa.nulls(n, pa.int32()), pa.nulls(n, like), pa.array(pairs), pa.array(docs), pa.array(links), bits, planes], names=schema.names)
        for at in range(0, n, 10_000):
            yield rows.slice(at, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = kept_in_worker(("alignment", a_file, b_file), lambda: Aligner(a_file, b_file))
        block, like = None, None
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                if block and (block.docs + part.num_rows > BLOCK or block.size >= entries):
                    yield from pair_rows(block, like)
                    block = Block(block.number + 1)
                block = block or Block(part.column(0)[0].as_py() << 32)
                counts, groups, found = align(pc.fill_null(part.column(part.num_columns - 1), "").to_pylist())
                rows = doc_rows(block, part.columns[1:-1], counts, groups, block.docs, types)
                like = rows.column(2).type
                block.add(found, part.num_rows)
                yield rows
        if block:
            yield from pair_rows(block, like)

    return source.mapInArrow(run, schema)


def pair_totals(posted: DataFrame) -> DataFrame:
    """a, b, docs and links of every pair of ids in the corpus, and whether no pair of its b has more links.

    Bitmaps of different blocks hold different documents, so their popcounts add up. There is one best for each id of
    B's vocabulary, so that table is at most as long as the vocabulary and is broadcast.
    """
    pairs = cut(posted.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")))
    named = pairs.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "docs", "links")
    best = named.groupBy("b").agg(F.max("links").alias("best"))
    return named.join(F.broadcast(best), "b").select("pair", "a", "b", "docs", "links", (F.col("links") == F.col("best")).alias("is_best"))


def aligned(docs: DataFrame, a_file: str, b_file: str, keep: list[str], text: str = "text", with_groups: bool = True, entries: int = ENTRIES) -> DataFrame:
    """keep, then n_a, n_b, n_groups, n_links, count_sum, n_best, groups_sha256 and, if asked for, groups of every document."""
    posted = cut(postings(docs, text, keep, a_file, b_file, with_groups, entries))
    totals = pair_totals(posted).select("pair", F.col("links").alias("total"), F.col("is_best").cast("bigint").alias("is_best"))
    rows = posted.where("pair is null").select("block", "number", "doc", *[F.lit(None).cast(t).alias(c) for c, t in (("total", "bigint"), ("is_best", "bigint"), ("bits", "binary"), ("planes", "array<binary>"))])
    held = posted.where("pair is not null").select("block", "number", "doc", "pair", "bits", "planes").join(totals, "pair").select(*rows.columns)
    doc = posted.schema["doc"].dataType
    schema = T.StructType([*doc.fields, T.StructField("count_sum", T.LongType()), T.StructField("n_best", T.LongType())])

    def scores(table: pa.Table) -> pa.Table:
        is_doc = pc.is_valid(table.column("number"))
        own, held = table.filter(is_doc), table.filter(pc.invert(is_doc))
        sums = np.zeros((2, BLOCK), np.int64)
        bits, planes = held.column("bits").combine_chunks(), held.column("planes").combine_chunks()
        weights = [held.column(c).to_numpy().astype(np.int64) for c in ("total", "is_best")]
        number = pc.list_value_length(planes).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = planes.flatten()
        for bitmaps, of, power in ((bits, np.arange(held.num_rows), np.zeros(held.num_rows, np.int64)), (flat, np.repeat(np.arange(held.num_rows), number), inside(number))):
            row, doc_number = unpacked(bitmaps)
            for total, weight in zip(sums, weights):
                np.add.at(total, doc_number, weight[of[row]] << power[row])
        at = own.column("number").to_numpy()
        fields = own.column("doc").combine_chunks().flatten()
        return pa.Table.from_arrays([*fields, pa.array(sums[0][at]), pa.array(sums[1][at])], names=schema.names)

    found = rows.unionByName(held).groupBy("block").applyInArrow(scores, schema)
    return found.select(*[c for c in schema.names if c in keep], *COUNTS, "count_sum", "n_best", "groups_sha256", *(["groups"] if with_groups else []))
