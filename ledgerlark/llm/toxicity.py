"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence's probability is a logistic function of its hashed
words and word beginnings, and a document is toxic unless every sentence is clean: noisy-or, 1 - product of (1 - p).
The word weights are trained from document labels alone, through the noisy-or, so the blame settles
on the sentences that carry it; these can then be located.

Sentences end at . ! ? and line ends; words are letter runs in lower case. A text without words
(null, empty) scores 0. Repeated rows score each on its own; null labels are left out, ids with
several labels are learned with each; without labels all scores are those of the starting bias.
"""

from __future__ import annotations

import pickle
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Packed, kept_in_worker, map_texts
from .quality import fit_in_one_task, labelled_sample

#: Labelled documents that a model is fitted on.
SAMPLE = 6_000
BUCKETS = 1 << 18
PASSES, RATE, BATCH = 20, 0.3, 64
#: What each pass takes off every weight: words that mark no label end at zero. Weights are never
#: negative: a word may make its sentence toxic, and no company of other words makes up for it.
SHRINK = 0.02
#: Sampled documents that a feature must occur in to be given a weight.
LEAST_DOCUMENTS = 3
#: A sentence's log odds before any word is seen.
BIAS = -7.0
#: Words that a worker remembers.
MEMORY = 500_000
_TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]+").findall
_SENTENCES = re.compile(r"[^.!?\n]+").finditer


@lru_cache(200_000)
def features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and its first 4 and 5 letters, for endings vary."""
    own = [word, *(f"<{word[:n]}" for n in (4, 5) if len(word) >= n)]
    return tuple(zlib.crc32(x.encode()) % BUCKETS for x in own)


def prepare(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each sentence's distinct words, one sentence after the other, and the sentences' sizes."""
    found, sizes, now = [], [], set()
    for token in [*_TOKENS(text.lower()), "."]:
        if token[0] in ".!?\n":
            if now:
                own = [f for w in now for f in features(w)]
                found += own
                sizes.append(len(own))
                now = set()
        else:
            now.add(token)
    return np.array(found, np.int32), np.array(sizes, np.int32)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> dict:
    """Word weights and bias: stochastic gradient descent on the noisy-or's log loss.

    Documents come in an order that doesn't depend on their labels, so batches are taken as they come.
    """
    weights, bias = np.zeros(BUCKETS), BIAS
    documents = np.zeros(BUCKETS, np.int64)
    for words, _ in texts:
        documents[np.unique(words)] += 1
    rare = documents < LEAST_DOCUMENTS
    full = [i for i, (_, sizes) in enumerate(texts) if len(sizes)]
    batches = []
    for at in range(0, len(full), BATCH):
        own = full[at : at + BATCH]
        words, sizes = (np.concatenate([texts[i][k] for i in own]) for k in (0, 1))
        sentences = [len(texts[i][1]) for i in own]
        first = lambda n: np.concatenate(([0], np.cumsum(n)[:-1]))
        batches.append((words, np.repeat(np.arange(len(sizes)), sizes), first(sizes), np.repeat(np.arange(len(own)), sentences), first(sentences), y[own]))
    for _ in range(PASSES):
        for words, sentence_of, first_word, doc_of, first_sentence, toxic in batches:
            z = bias + np.add.reduceat(weights[words], first_word)
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            clean = np.exp(np.add.reduceat(-np.logaddexp(0, z), first_sentence))  # that all sentences are
            blame = np.where(toxic == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
            slope = np.clip(blame[doc_of] * p, -1, 1)
            grad = np.bincount(words, slope[sentence_of], BUCKETS)
            grad[rare] = 0
            weights = np.maximum(weights - RATE * grad, 0)
            bias -= RATE * slope.sum() / len(toxic) / 10
        weights = np.maximum(weights - SHRINK, 0)
    return {"weights": weights.astype(np.float32), "bias": float(bias)}


class Scorer:
    def __init__(self, model: dict):
        self.weights, self.bias = model["weights"], model["bias"]
        self.memory: dict[str, float | None] = {}

    def learn(self, token: str) -> float | None:
        value = self.memory[token] = None if token[0] in ".!?\n" else float(self.weights[list(features(token))].sum())
        return value

    def sentences(self, text: str) -> list[float]:
        """Log odds of each sentence with words; a word counts once in a sentence."""
        if len(self.memory) > MEMORY:
            self.memory.clear()
        memory, learn, out, now, total = self.memory, self.learn, [], set(), 0.0
        for token in _TOKENS(text.lower()):
            weight = memory[token] if token in memory else learn(token)
            if weight is None:
                if now:
                    out.append(self.bias + total)
                    now, total = set(), 0.0
            elif token not in now:
                now.add(token)
                total += weight
        if now:
            out.append(self.bias + total)
        return out

    def __call__(self, text: str) -> float:
        z = self.sentences(text)
        return float(-np.expm1(-np.logaddexp(0, np.array(z)).sum())) if z else 0.0

    def locate(self, text: str, least: float) -> list[dict]:
        """Spans (code points, end exclusive) and probabilities of sentences that reach least."""
        out = []
        for m in _SENTENCES(text):
            if (z := self.sentences(m[0])) and (p := float(1 / (1 + np.exp(-z[0])))) >= least:
                out.append({"start": m.start(), "end": m.end(), "score": p})
        return out


def score_kernel(model, least: float | None):
    scorer = kept_in_worker(("toxicity", model.id), lambda: Scorer(pickle.loads(model.packed.value)))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def kernel(texts: pa.Array) -> list[pa.Array]:
        own = texts.to_pylist()
        score = [scorer(t) for t in own]
        out = [pa.array(score, pa.float64())]
        if least is not None:  # sentences are located in documents that a sentence can have made toxic
            out.append(pa.array([scorer.locate(t, least) if s >= least else [] for t, s in zip(own, score)], pa.list_(span)))
        return out

    return kernel


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", size: int = SAMPLE) -> dict:
    return fit_in_one_task(labelled_sample(docs, labels, doc_id, text, label, size), prepare, fit)


def scored(docs: DataFrame, model: dict, keep: list[str] | None = None, text: str = "text", locate: float | None = 0.5) -> DataFrame:
    """docs' kept columns, score and, unless locate is None, offending: the sentences that reach it."""
    fields = [T.StructField("score", T.DoubleType())]
    if locate is not None:
        fields.append(T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))))
    return map_texts(docs, text, keep if keep is not None else docs.columns, fields, score_kernel, Packed(docs.sparkSession, model), locate)
