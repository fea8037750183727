"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text's spaces become U+2581 and one more is put before a text that isn't empty. The code points of
many texts form one flat symbol array, which is cut into words wherever no piece of the vocabulary
can cross; equal words are merged once. Each round finds every word's best-ranked pair by a segmented
minimum and merges it in all words at once, from the left; then the arrays are compacted, and words
without a pair leave. Where nothing that a merge could make outranks the merge itself, all places of
the best pair in a word merge in one round, for one after the other would give the same. Symbols that
aren't pieces fall back to bytes. Nothing is kept from one block of texts to the next, so memory
follows the block (``BLOCK`` characters, or one word, if a word is longer).

A word takes as many rounds as it has different merges: a word of a hundred thousand characters that
can't be cut anywhere (base64 without a break) takes seconds; repeats of one character a few rounds.

Null and empty texts give the begin and end ids alone and decode to the empty text. Repeated rows
are encoded each on its own; an empty table gives none. The model file is a parameter; it's read by
the driver and sent to the executors, which need no copy of it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import inside, kept_in_worker, map_texts, starts_of

SPACE = "▁"
#: Characters that are merged side by side.
BLOCK = 1 << 19
#: The rank of what isn't a pair: above all ranks, and a position fits below it in 64 bits.
_NONE = np.int64(1 << 30)
_POINTS = 0x110000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


@dataclass(frozen=True)
class Vocabulary:
    """A BPE model's pieces, scores and kinds, and its special ids."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    unknown_surface: str

    @staticmethod
    def load(path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("only models that keep texts as they are, with a leading space, are supported")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        return Vocabulary(tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), tuple(p.type for p in model.pieces), model.trainer_spec.unk_surface)

    def __hash__(self) -> int:
        return hash((len(self.pieces), self.pieces[-1], self.scores[-1]))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted among sorted keys, and whether they're there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Encoder:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        ids = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == NORMAL}
        self.first_point = len(v.pieces)  # symbols: pieces by their ids, then characters by their code points
        self.begin, self.end = v.pieces.index("<s>"), v.pieces.index("</s>")
        self.byte_ids = np.array([v.pieces.index(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.symbol_of = np.arange(self.first_point, self.first_point + _POINTS, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        symbol = lambda p: ids[p] if p in ids else self.first_point + ord(p) if len(p) == 1 else None
        ranks = {s: r for r, s in enumerate(sorted({v.scores[i] for i in ids.values()}, reverse=True))}
        pairs = sorted((left << 32 | right, ranks[v.scores[i]], i) for p, i in ids.items() for cut in range(1, len(p)) if (left := symbol(p[:cut])) is not None and (right := symbol(p[cut:])) is not None)
        self.keys, self.rank, self.merged = (np.array(x, np.int64) for x in zip(*pairs))
        # A merge is settled if every pair that its result can be part of ranks after it.
        least = np.full(self.first_point + _POINTS, _NONE)
        np.minimum.at(least, self.keys >> 32, self.rank)
        np.minimum.at(least, self.keys & 0xFFFFFFFF, self.rank)
        self.settled = least[self.merged] > self.rank
        alike = {r: set() for r in self.rank.tolist()}  # one rank for several pieces: their places depend on each other
        for r, m in zip(self.rank.tolist(), self.merged.tolist()):
            alike[r].add(m)
        self.settled &= np.array([len(alike[r]) == 1 for r in self.rank.tolist()])
        inner = sorted({c for p in ids if len(p) > 1 for c in p})
        self.letter = np.zeros(_POINTS, np.int32)  # the place of a character among those of longer pieces, or 0
        self.letter[[ord(c) for c in inner]] = 1 + np.arange(len(inner))
        self.crossed = np.zeros((len(inner) + 1, len(inner) + 1), bool)  # characters that stand side by side in a piece
        for p in ids:
            if len(p) > 1:
                own = self.letter[[ord(c) for c in p]]
                self.crossed[own[:-1], own[1:]] = True
        surface = [p.replace(SPACE, " ").encode() if k == NORMAL else v.unknown_surface.encode() if k == UNKNOWN else b"" for p, k in zip(v.pieces, v.kinds)]
        for b, i in enumerate(self.byte_ids.tolist()):
            surface[i] = bytes([b])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_start = starts_of(self.surface_size)
        self.is_byte = np.zeros(len(v.pieces), bool)
        self.is_byte[self.byte_ids] = True
        self.spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(v.pieces, v.kinds)])
        self.ends = np.zeros(len(v.pieces), bool)
        self.ends[[self.begin, self.end]] = True

    # encoding

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, begin and end included, one text after the other, and the number of each one's ids."""
        flat, sizes, block, held = [], [], [], 0
        for k, text in enumerate(texts):
            for part in self._parts(SPACE + text.replace(" ", SPACE) if text else ""):
                block.append((k, part))
                held += len(part)
                if held >= BLOCK:
                    flat.append(self._block(block))
                    block, held = [], 0
        flat.append(self._block(block))
        owner, ids = (np.concatenate([x[i] for x in flat]) for i in (0, 1))
        size = np.bincount(owner, minlength=len(texts)) + 2
        out = np.empty(int(size.sum()), np.uint32)
        start = starts_of(size)
        out[start], out[start + size - 1] = self.begin, self.end
        out[np.arange(len(ids)) + 2 * owner + 1] = ids
        return out, size

    def _parts(self, text: str) -> list[str]:
        """A text in parts of about BLOCK characters, cut where no piece can cross."""
        parts, start = [], 0
        while len(text) - start > BLOCK:
            at = start + BLOCK
            while at < len(text):  # look on, some characters at a time, for a place to cut
                near = self.letter[np.frombuffer(text[at - 1 : at + 4096].encode("utf-32-le"), np.uint32)]
                if len(free := np.flatnonzero(~self.crossed[near[:-1], near[1:]])):
                    at += int(free[0])
                    break
                at += len(near) - 1
            parts.append(text[start:at])
            start = at
        return [*parts, text[start:]] if start < len(text) else parts

    def _block(self, block: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
        """For the ids of all parts in order: the text that each belongs to, and the id."""
        points = np.frombuffer("".join([part for _, part in block]).encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        part_size = np.fromiter((len(part) for _, part in block), np.int64, len(block))
        letter = self.letter[points]
        first = np.ones(len(points), bool)
        first[1:] = ~self.crossed[letter[:-1], letter[1:]]
        first[starts_of(part_size)] = True
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(points)))
        kind, of = self._distinct(points, start, size)
        ids, n = self._rounds(self.symbol_of[points[np.repeat(start[kind], size[kind]) + inside(size[kind])]].astype(np.int64), size[kind])
        text = np.repeat(np.array([k for k, _ in block], np.int64), part_size)[start]
        return np.repeat(text, n[of]), ids[np.repeat(starts_of(n)[of], n[of]) + inside(n[of])]

    @staticmethod
    def _distinct(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One place for each distinct word, and each word's number among them: by hash, then compared."""
        place = inside(size)
        h = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        _, kind, of = np.unique(np.add.reduceat(h ^ (h >> np.uint64(32)), start), return_index=True, return_inverse=True)
        same = size[kind[of]] == size
        twin = np.minimum(np.repeat(start[kind[of]], size) + place, len(points) - 1)
        same &= np.logical_and.reduceat(points[twin] == points, start)
        if not same.all():  # words that only share a hash stand for themselves
            other = np.flatnonzero(~same)
            of[other] = len(kind) + np.arange(len(other))
            kind = np.concatenate((kind, other))
        return kind, of

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and index of pairs."""
        at, there = _found(self.keys, (left << 32) | right)
        return np.where(there, self.rank[at], _NONE), at

    def _rounds(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, all merged side by side: ids in order of words, and their number for each word."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        words = len(size)
        word = np.repeat(np.arange(words), size)
        rank, pair = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        rank[:-1], pair[:-1] = self._look_up(symbols[:-1], symbols[1:])
        rank[:-1][word[:-1] != word[1:]] = _NONE
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(starts, len(symbols)))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), starts)
            is_open = (best >> 32) < _NONE
            if not is_open.all():  # words without a pair leave
                stay = np.repeat(is_open, size)
                done.append((word[~stay], symbols[~stay]))
                best, size = best[is_open], size[is_open]
                left = best & 0xFFFFFFFF
                best = (best >> 32 << 32) | (left - np.cumsum(~stay)[left])
                symbols, word, rank, pair = symbols[stay], word[stay], rank[stay], pair[stay]
                if not len(symbols):
                    break
            at, least = best & 0xFFFFFFFF, best >> 32
            chosen = np.flatnonzero((rank == np.repeat(np.where(self.settled[pair[at]], least, -1), size)))
            if len(chosen):  # of places that overlap, every other one from the left
                run = np.flatnonzero(np.concatenate(([True], np.diff(chosen) > 1)))
                nth = np.arange(len(chosen)) - np.repeat(run, np.diff(np.append(run, len(chosen))))
                chosen = chosen[nth % 2 == 0]
            is_merge = np.zeros(len(symbols), bool)
            is_merge[at[~self.settled[pair[at]]]] = True
            is_merge[chosen] = True
            at = np.flatnonzero(is_merge)
            symbols[at] = self.merged[pair[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # one symbol before each place is gone for each earlier place
            symbols, word, rank, pair = symbols[stay], word[stay], rank[stay], pair[stay]
            is_near = np.zeros(len(symbols), bool)
            is_near[at] = is_near[np.maximum(at - 1, 0)] = True
            near = np.flatnonzero(is_near[:-1])
            own, pair[near] = self._look_up(symbols[near], symbols[near + 1])
            own[word[near] != word[near + 1]] = _NONE
            rank[near] = own
            rank[-1] = _NONE
        word, symbols = (np.concatenate([x[i] for x in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        word, ids = self._with_bytes(word[order], symbols[order])
        return ids, np.bincount(word, minlength=words)

    def _with_bytes(self, word: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that aren't pieces in bytes of UTF-8."""
        lone = symbols >= self.first_point
        if not lone.any():
            return word, symbols
        point = np.where(lone, symbols - self.first_point, 0)
        n = np.where(lone, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
        k = inside(n)
        word, point, lone, size, ids = (np.repeat(x, n) for x in (word, point, lone, n, symbols))
        lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0])[size]
        byte = np.where(k == 0, lead | (point >> (6 * (size - 1))), 0x80 | ((point >> (6 * np.maximum(size - 1 - k, 0))) & 0x3F))
        return word, np.where(lone, self.byte_ids[np.where(lone, byte, 0)], ids)

    # decoding

    def decode(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of lists of ids, one after the other, and the number of bytes of each.

        A text's first piece loses its leading space; runs of byte pieces are read as UTF-8.
        """
        ids, n = ids.astype(np.int64), self.surface_size[ids]
        owner = np.repeat(np.arange(len(size)), size)
        real = np.flatnonzero(~self.ends[ids])
        lead = real[np.concatenate(([True], np.diff(owner[real]) > 0))] if len(real) else real
        start = self.surface_start[ids]
        lead = lead[self.spaced[ids[lead]]]
        start[lead] += 1
        n[lead] -= 1
        out = self.surface[np.repeat(start, n) + inside(n)]
        count = np.bincount(owner, n, len(size)).astype(np.int64)
        at = np.flatnonzero(self.is_byte[ids])
        if len(at):
            runs = np.split(at, np.flatnonzero((np.diff(at) > 1) | (np.diff(owner[at]) > 0)) + 1)
            if not _valid(self.surface[self.surface_start[ids[at]]], [len(r) for r in runs]):
                return self._repaired(out, n, owner, runs, len(size))
        return out, count

    @staticmethod
    def _repaired(out: np.ndarray, n: np.ndarray, owner: np.ndarray, runs: list[np.ndarray], texts: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with a replacement character for every byte of a run that belongs to no character."""
        begin, parts, last, extra = starts_of(n), [], 0, np.zeros(texts, np.int64)
        for run in runs:
            a, b = int(begin[run[0]]), int(begin[run[-1]]) + 1
            read = _replaced(out[a:b].tobytes())
            parts += [out[last:a], np.frombuffer(read, np.uint8)]
            extra[owner[run[0]]] += len(read) - (b - a)
            last = b
        return np.concatenate([*parts, out[last:]]), np.bincount(owner, n, texts).astype(np.int64) + extra


def _valid(raw: np.ndarray, sizes: list[int]) -> bool:
    """Whether each run of bytes is UTF-8 on its own: a line end after each keeps them apart."""
    apart = np.full(len(raw) + len(sizes), 10, np.uint8)
    apart[np.arange(len(raw)) + np.repeat(np.arange(len(sizes)), sizes)] = raw
    try:
        apart.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return True


def _replaced(run: bytes) -> bytes:
    """The run as it is, but a replacement character for every byte that belongs to no character."""
    out, at = [], 0
    while at < len(run):
        try:
            run[at:].decode()
            out.append(run[at:])
            break
        except UnicodeDecodeError as e:
            out += [run[at : at + e.start], "�".encode()]
            at += e.start + 1
    return b"".join(out)


def encoder_of(vocabulary) -> Encoder:
    """The worker's encoder of a broadcast vocabulary."""
    return kept_in_worker(("pieces", vocabulary.value), lambda: Encoder(vocabulary.value))


def _digests(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """SHA-256 of each of the stretches of data."""
    raw, at = memoryview(np.ascontiguousarray(data)).cast("B"), np.append(0, np.cumsum(size * data.itemsize)).tolist()
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string())


def encode_kernel(vocabulary, with_ids: bool):
    encoder = encoder_of(vocabulary)

    def kernel(texts: pa.Array) -> list[pa.Array]:
        ids, size = encoder.encode(texts.to_pylist())
        out = [pa.array(size), _digests(ids.astype("<u4", copy=False), size), _digests(*encoder.decode(ids, size))]
        if with_ids:
            out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(ids.view(np.int32))))
        return out

    return kernel


def encoded(docs: DataFrame, model: str, keep: list[str] | None = None, text: str = "text", with_ids: bool = True) -> DataFrame:
    """docs' kept columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    return map_texts(docs, text, keep if keep is not None else docs.columns, fields, encode_kernel, vocabulary, with_ids)


def decode_kernel(vocabulary):
    encoder = encoder_of(vocabulary)

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1).fill_null([])
            flat, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            data, n = encoder.decode(flat.astype(np.int64), size)
            texts = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.append(0, np.cumsum(n)).astype(np.int64)), pa.py_buffer(data.tobytes())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "decoded"])

    return run


def decoded(docs: DataFrame, model: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """keep and the text that a column of ids stands for (a null list decodes to the empty text)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])
    return docs.select(*keep, F.col(ids).cast("array<int>").alias("__ids")).mapInArrow(lambda batches: decode_kernel(vocabulary)(batches), schema)
