"""Quality classifier: supervised subword embeddings.

A word's features are hashed: the word itself, its character 3- and 4-grams, its shape, and a mark
for a word that repeats the one before it. Each feature has a learned vector; a word's vector is
the mean over its features, a text's the mean over its words, and a softmax over two classes gives
the score. Vectors and output weights are trained together by stochastic gradient descent in numpy,
on a bounded sample of labelled documents (``SAMPLE`` ids with the smallest hashes), inside one task.

Null and empty texts have the zero vector and score by the output's bias alone. Repeated rows score
each on its own; ids with several labels are learned with each; null labels are left out. Without
labels, or with a single class, all scores are that class's share (one half without any).
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Packed, kept_in_worker, map_texts

#: Labelled documents that a model is fitted on.
SAMPLE = 5_000
BUCKETS, WIDTH = 1 << 16, 8
PASSES, RATE, BATCH = 3, 0.5, 32
#: Words that a worker remembers, of 16 characters on average.
MEMORY = 800_000
REPEAT = "\x01repeat"


def _mix(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % BUCKETS


_POWERS = np.cumprod(np.full(80, 0x100000001B3, np.uint64), dtype=np.uint64)
#: Shapes of ASCII characters: capitals, letters (as all characters beyond ASCII) and digits; others stand for themselves.
_SHAPE = np.array([65 if 65 <= c < 91 else 97 if 97 <= c < 123 else 48 if 48 <= c < 58 else c for c in range(128)], np.uint64)


def features(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of whole words, all computed side by side: buckets, and the place of each one's word."""
    global _POWERS
    marked = [f"<{w}>" for w in found]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    if len(_POWERS) < (most := int(size.max(initial=0))):
        _POWERS = np.cumprod(np.full(2 * most, _POWERS[0], np.uint64), dtype=np.uint64)
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(marked)), size)
    place = np.arange(len(points)) - start[word]
    buckets, owners = [_mix(np.add.reduceat(points * _POWERS[place], start), 1)], [np.arange(len(marked))]
    shape = np.where(points < 128, _SHAPE[np.minimum(points, np.uint64(127)).astype(np.int64)], np.uint64(97))
    first = np.concatenate(([True], (shape[1:] != shape[:-1]) | (word[1:] != word[:-1])))
    kept_word = word[first]
    kept_start = np.flatnonzero(np.concatenate(([True], kept_word[1:] != kept_word[:-1])))
    kept_place = np.arange(len(kept_word)) - kept_start[kept_word]
    buckets.append(_mix(np.add.reduceat(shape[first] * _POWERS[kept_place], kept_start), 2))
    owners.append(np.arange(len(marked)))
    for n in (3, 4):
        at = np.flatnonzero(place + n <= size[word])
        buckets.append(_mix(sum((points[at + j] * _POWERS[j] for j in range(n)), np.zeros(len(at), np.uint64)), n))
        owners.append(word[at])
    return np.concatenate(buckets), np.concatenate(owners)


def words(text: str) -> list[str]:
    """Words by white space; a repeat of the word before stands as a mark of its own beside it."""
    found = text.split()
    return found + [REPEAT for a, b in zip(found, found[1:]) if a == b]


def sample_ids(labels: DataFrame, doc_id: str, label: str, size: int) -> DataFrame:
    """id and label of the size labelled rows with the smallest hashes."""
    own = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).dropna().distinct()
    return own.orderBy(F.xxhash64("id"), "id", "label").limit(size)


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, size: int = SAMPLE) -> DataFrame:
    """text and label of a bounded sample. The ids are at most size, so they may be broadcast."""
    ids = F.broadcast(sample_ids(labels, doc_id, label, size))
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(ids, "id").select("id", "text", "label")


def fit_in_one_task(sample: DataFrame, prepare, fit) -> dict:
    """fit(list of prepare(text), labels) over a bounded sample in one executor task; the model comes back.

    prepare runs where the texts are, so that only the features travel.
    """

    def shrink(batches):
        for batch in batches:
            own = [pickle.dumps(prepare(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), batch.column(2)], names=["id", "features", "label"])

    def run(batches):
        rows = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[1], r[2]))  # an order that doesn't depend on partitions
        model = fit([pickle.loads(x) for _, x, _ in rows], np.array([y for _, _, y in rows], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    small = sample.mapInArrow(shrink, T.StructType([sample.schema["id"], T.StructField("features", T.BinaryType()), sample.schema["label"]]))
    return pickle.loads(bytes(small.repartition(1).mapInArrow(run, "model binary").collect()[0].model))


def prepare(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a text and their shares in its mean vector."""
    count: dict[str, int] = {}
    for w in words(text):
        count[w] = count.get(w, 0) + 1
    if not count:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets, word = features(list(count))
    share = np.fromiter(count.values(), np.float64, len(count)) / np.bincount(word) / sum(count.values())
    bucket, at = np.unique(buckets.astype(np.int32), return_inverse=True)
    return bucket, np.bincount(at, share[word]).astype(np.float32)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> dict:
    """Vectors (BUCKETS x WIDTH) and softmax weights, by stochastic gradient descent with adaptive rates."""
    draw = np.random.default_rng(7)
    vectors = draw.uniform(-0.5 / WIDTH, 0.5 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    share = float(y.mean()) if len(y) else 0.5
    bias = np.log(np.array([1 - share + 1e-3, share + 1e-3]))
    out = draw.normal(0, 0.3, (WIDTH, 2))
    if len(y) and 0 < share < 1:
        target = np.stack((1 - y, y), 1)
        seen_v, seen_o, seen_b = np.full(BUCKETS, 1e-8, np.float32), np.full_like(out, 1e-8), np.full_like(bias, 1e-8)
        for _ in range(PASSES):
            order = draw.permutation(len(y))
            for at in range(0, len(y), BATCH):
                rows = order[at : at + BATCH]
                bucket = np.concatenate([texts[i][0] for i in rows])
                weight = np.concatenate([texts[i][1] for i in rows])
                row = np.repeat(np.arange(len(rows)), [len(texts[i][0]) for i in rows])
                part = vectors[bucket] * weight[:, None]
                mean = np.stack([np.bincount(row, part[:, k], len(rows)) for k in range(WIDTH)], 1) * 20
                z = mean @ out + bias
                z = np.exp(z - z.max(1, keepdims=True))
                error = (z / z.sum(1, keepdims=True) - target[rows]) / len(rows)
                grad_out, grad_bias = mean.T @ error, error.sum(0)
                back = (error @ out.T * 20)[row] * weight[:, None]
                touched, where = np.unique(bucket, return_inverse=True)
                step = np.stack([np.bincount(where, back[:, k], len(touched)) for k in range(WIDTH)], 1)
                seen_v[touched] += (step * step).mean(1)
                vectors[touched] -= (RATE * 0.2 * step / np.sqrt(seen_v[touched])[:, None]).astype(np.float32)
                seen_o += grad_out**2
                seen_b += grad_bias**2
                out -= RATE * 0.2 * grad_out / np.sqrt(seen_o)
                bias -= RATE * 0.2 * grad_bias / np.sqrt(seen_b)
    return {"vectors": vectors, "out": out * 20, "bias": bias}


class Scorer:
    def __init__(self, model: dict):
        self.model = model
        # a word's part in the logit difference is all that the two-class softmax needs of its vector
        self.slope = (model["vectors"] @ (model["out"][:, 1] - model["out"][:, 0])).astype(np.float64)
        self.bias = float(model["bias"][1] - model["bias"][0])
        self.memory: dict[str, float] = {}
        self.held = 0

    def learn(self, missing: set[str]) -> None:
        own = list(missing)
        self.held += sum(map(len, own))
        buckets, word = features(own)
        self.memory.update(zip(own, (np.bincount(word, self.slope[buckets]) / np.bincount(word)).tolist()))

    def __call__(self, texts: list[str]) -> list[float]:
        if len(self.memory) > MEMORY or self.held > 16 * MEMORY:
            self.memory.clear()
            self.held = 0
        memory, found = self.memory, [words(t) for t in texts]
        if missing := {w for own in found for w in own if w not in memory}:
            self.learn(missing)
        z = np.array([sum([memory[w] for w in own]) / len(own) if own else 0.0 for own in found]) + self.bias
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()


def score_kernel(model):
    scorer = kept_in_worker(("quality", model.id), lambda: Scorer(pickle.loads(model.packed.value)))
    return lambda texts: [pa.array(scorer(texts.to_pylist()), pa.float64())]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", size: int = SAMPLE) -> dict:
    return fit_in_one_task(labelled_sample(docs, labels, doc_id, text, label, size), prepare, fit)


def scored(docs: DataFrame, model: dict, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs' kept columns and score (0 to 1, higher: label 1 is likelier)."""
    return map_texts(docs, text, keep if keep is not None else docs.columns, [T.StructField("score", T.DoubleType())], score_kernel, Packed(docs.sparkSession, model))
