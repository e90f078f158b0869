"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (and of the word itself), hashed into a table of
fixed size; a passage of 32 words has the mean vector of its places (a word that comes again and a place past the end
of the text leave theirs empty, with the zero vector), and a linear softmax reads it. A text is as toxic as its worst
passage, however long it is. The fit first takes passages of a text under the text's label, then, round
after round, the passage of each text that scores highest. As all is linear up to the softmax, a trained word is one number,
so scoring sums numbers that each worker keeps by word. The fit uses a bounded sample of labelled rows, drawn by
hash; scoring covers all whole texts.
"""

from __future__ import annotations

import zlib
from array import array
from collections import ChainMap
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact import text_key
from .shared import BROADCAST_KEYS, bounded, id_bucket, kept, save, small_batches, text_or_empty

#: Labelled rows of each class that the fit uses at most.
SAMPLE_ROWS = 2500
THRESHOLD = 0.3
BUCKETS = 1 << 16
SHORTEST, LONGEST = 3, 5
WIDTH = 8
PASSAGE = 32
#: The mean vector is multiplied by this before the softmax.
GAIN = 16.0
#: Rounds on drawn passages, then on the worst ones; passages drawn per text and round.
FIRST, EPOCHS, DRAWN = 2, 12, 4
BATCH, RATE, DECAY = 64, 0.2, 1e-6
#: A round goes over the texts again where they are fewer than this.
LEAST_DOCS = 8000
#: Words that a worker keeps the number of.
KEPT_WORDS = 500_000


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def subwords(word: bytes) -> list[int]:
    """Table rows of a word: itself and its n-grams of characters, with marks at both ends."""
    marked = f"<{word.decode(errors='replace')}>"
    grams = {marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)}
    return [zlib.crc32(g.encode()) % BUCKETS for g in sorted(grams | {marked})]


@dataclass
class Model:
    """values: by table row, its vector's part of the logit. A word's number is their mean over its subwords; a passage's logit is its words' numbers plus the bias."""

    values: np.ndarray
    bias: float

    def word(self, word: bytes) -> float:
        return float(self.values[subwords(word)].mean())


def passages(words: list) -> Iterator[set]:
    return (set(words[i : i + PASSAGE]) for i in range(0, len(words), PASSAGE))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Embeddings and a two-class softmax fitted together by Adagrad on mean log loss."""
    rng = np.random.default_rng(seed)
    known: dict[bytes, int] = {}
    words, lengths, counts, kept = array("i"), array("i"), array("i"), []
    for i, text in enumerate(texts):
        held = [sorted(x) for x in passages([known.setdefault(w, len(known)) for w in words_of(text)])]
        if held:
            kept.append(labels[i])
            counts.append(len(held))
            lengths.extend(map(len, held))
            words.extend(chain.from_iterable(held))
    if not kept:
        return Model(np.zeros(BUCKETS), -2.0)
    flat, sizes = array("i"), array("i")
    for w in known:
        grams = subwords(w)
        sizes.append(len(grams))
        flat.extend(grams)
    del known
    words, lengths, counts, flat, sizes = (np.frombuffer(x, np.int32) for x in (words, lengths, counts, flat, sizes))
    labels, n_docs = np.array(kept, np.int64), len(kept)
    begins = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)[:-1]])
    firsts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)[:-1]])
    table = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
    soft = rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = [np.full(x.shape, 1e-4, np.float32) for x in (table, soft, bias)]
    wanted = np.eye(2, dtype=np.float32)[labels]

    def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
        ends = np.cumsum(n)
        return np.repeat(first - ends + n, n) + np.arange(ends[-1])

    def step(picked: np.ndarray, wanted: np.ndarray, rate: float) -> None:
        n = lengths[picked]
        word = words[spread(starts[picked], n)]
        m = sizes[word]
        take = flat[spread(begins[word], m)]
        line = np.repeat(np.repeat(np.arange(len(picked)), n), m)
        weight = np.repeat(GAIN / (PASSAGE * m), m)
        mean = np.add.reduceat(table[take] * weight[:, None].astype(np.float32), np.searchsorted(line, np.arange(len(picked))))
        logit = mean @ soft + bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - wanted) / len(picked)
        used, at = np.unique(take, return_inverse=True)
        back = error @ soft.T
        grad = np.stack([np.bincount(at, weights=weight * back[line, d], minlength=len(used)) for d in range(WIDTH)], 1).astype(np.float32)
        grad += DECAY * table[used]
        grads = (mean.T @ error, error.sum(0))
        seen[0][used] += grad**2
        table[used] -= rate * grad / np.sqrt(seen[0][used])
        for values, past, grad in zip((soft, bias), seen[1:], grads, strict=True):
            past += grad**2
            values -= rate * grad / np.sqrt(past)

    for epoch in range(FIRST + EPOCHS):
        rate = RATE * (1 - epoch / (FIRST + EPOCHS))
        if epoch < FIRST:
            chosen = [firsts + rng.integers(0, counts) for _ in range(DRAWN)]
        else:
            number = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float64)
            number = np.add.reduceat(number[flat], begins[:-1]) / sizes
            scores = np.add.reduceat(number[words], starts)
            order = np.lexsort((-scores, np.repeat(np.arange(n_docs), counts)))
            chosen = [order[firsts]]
        for picked in chosen * max(1, LEAST_DOCS // n_docs):
            for batch in np.array_split(rng.permutation(n_docs), -(-n_docs // BATCH)):
                step(picked[batch], wanted[batch], rate)
    return Model((GAIN / PASSAGE * (table @ (soft[:, 1] - soft[:, 0]))).astype(np.float64), float(bias[1] - bias[0]))


def sample_labelled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, folds: int = 4, held_out: int = 2) -> tuple[list[str], list[int]]:
    """Texts and labels of at most so many rows of each class outside the held-out fold, the first in a hash order of their ids."""
    open_ = labels.filter((id_bucket("doc_id", folds) != held_out) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    drawn = [r for x in (0, 1) for r in open_.filter(F.col("toxic") == x).groupBy("doc_id").agg(F.lit(x).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    if not drawn:
        return [], []
    picked = docs.sparkSession.createDataFrame(drawn, "l_doc_id long, toxic int")  # bounded by the sample
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("l_doc_id")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["toxic"], r["text"]))
    return [r["text"] for r in found], [r["toxic"] for r in found]


def logit(text: str, model: Model, known: dict[bytes, float]) -> float:
    """A text's logit; numbers of new words go to known while it has room."""
    words = words_of(text)
    new = {w: model.word(w) for w in set(words).difference(known)}
    find = known.__getitem__
    if new:
        if len(known) < KEPT_WORDS and max(map(len, new)) <= 60:
            known.update(new)
        else:
            find = ChainMap(new, known).__getitem__
    return model.bias + max((sum(map(find, x)) for x in passages(words)), default=0.0)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Words stand between ASCII white space. A text without words (null, empty) has the score of the bias alone;
    without a model (no labelled rows) all scores are 0. Rows are scored apart from each other, so repeated rows score alike. A
    null doc_id stays null.
    """
    small_batches(docs.sparkSession)
    name = "" if model is None else f"{zlib.crc32(model.values.tobytes())}-{model.bias!r}"
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, known = sent.value, kept(f"words {name}", dict)  # numbers by word, for one model at a time
        for batch in batches:
            texts = batch.column(1).to_pylist()
            logits = np.clip([logit(x, fitted, known) for x in texts], -50, 50) if fitted else np.full(len(texts), -np.inf)
            out = 1 / (1 + np.exp(-logits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    scored = rows.mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects, all columns as they were. Equal texts score alike, so the text alone names a row's decision."""
    rows = docs.select(text_key(text_col).alias("digest"), F.col(text_col).alias("text"))
    rejected = save(score(rows, model, "digest", "text").filter("predicted = 1").select(F.col("doc_id").alias("_rejected")).distinct(), "toxic-texts")
    return docs.join(bounded(rejected, BROADCAST_KEYS), text_key(text_col) == F.col("_rejected"), "left_anti")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    texts, toxic = sample_labelled(docs, labels)
    return train(texts, toxic) if texts else None
