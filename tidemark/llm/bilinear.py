"""LM scoring with a log-bilinear neural model trained in numpy by noise-contrastive estimation.

Counts are taken over all training texts. The model's symbols are the text's end, the most frequent words, and classes of all other words:
one for each of the most frequent endings, one for the rest. There are more symbols where there are more training tokens. A word
of a class has its smoothed share of it, unknown words together one share more. Two words
of context add up, each scaled per coordinate, to a predicted vector; its products with the symbols' vectors and
biases are the logits. In each round every task trains on all its texts against noise drawn from the exact symbol counts, starting from the
round before; the tasks' parameters are averaged by tokens.
Batched matrix products over all contexts give the normalisers, so a scored probability is normalised exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_bucket, save, small_batches, text_or_empty

WIDTH = 32
#: Least and most symbols; an eighth of them are classes.
SYMBOLS = (512, 4096)
ENDING = 3
#: Words that every worker knows the count of, at most; the others' counts are joined.
KNOWN_WORDS = 200_000
NOISE, BATCH, RATE, ROUNDS = 32, 4096, 0.1, 2
FOLDS, HELD_OUT = 5, 1
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def symbols_for(tokens: int) -> int:
    """Symbols of a model for so many training tokens: the power of two nearest to an eighth of their root, within SYMBOLS."""
    return min(SYMBOLS[1], max(SYMBOLS[0], 1 << round(math.log2(max(math.sqrt(tokens) / 8, 1)))))


class KnownWords(dict):
    """Index of each known word; another word gives -1 less its class."""

    def __init__(self, words: dict[bytes, int], endings: dict[str, int], rest: int):
        super().__init__(words)
        self.endings, self.rest = endings, rest

    def __reduce__(self):
        return KnownWords, (dict(self), self.endings, self.rest)

    def __missing__(self, word: bytes) -> int:
        return -1 - self.endings.get(word.decode()[-ENDING:], self.rest)


@dataclass
class Vocabulary:
    """Counts of the training texts: tokens, distinct ones, texts; the known words with symbol, base and in-class log10; classes by ending; per class the log10 of its total.

    Symbols are the end, the frequent words, then the classes, the last of which has the endings that are not listed.
    """

    tokens: int
    types: int
    ends: int
    frequent: int
    words: KnownWords
    symbol: np.ndarray
    base: np.ndarray
    inner: np.ndarray
    endings: dict[str, int]
    class_total: np.ndarray
    noise: np.ndarray

    def ending(self, word: str) -> int:
        """The class of a word outside the frequent ones."""
        return self.endings.get(word[-ENDING:], len(self.class_total) - 1)

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Index of each word among the known ones; of another, -1 less its class."""
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def symbols(self, index: np.ndarray) -> np.ndarray:
        """Symbols of looked-up words, then the end."""
        out = np.where(index >= 0, self.symbol[np.maximum(index, 0)] if len(self.symbol) else 0, self.frequent - index)
        return np.append(out, 0)


@dataclass
class Parameters:
    """Symbol vectors as context (with the start's) and as target, context scales, biases."""

    context: np.ndarray
    target: np.ndarray
    scale: np.ndarray
    bias: np.ndarray

    @staticmethod
    def first(noise: np.ndarray, seed: int = 11) -> Parameters:
        rng = np.random.default_rng(seed)
        n = len(noise)
        return Parameters(rng.normal(0, 0.1, (n + 1, WIDTH)), rng.normal(0, 0.1, (n, WIDTH)), np.ones((2, WIDTH)), np.log(noise))

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.target, self.scale, self.bias]

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def unpack(self, flat: np.ndarray) -> Parameters:
        cut = np.cumsum([x.size for x in self.arrays()])[:-1]
        return Parameters(*(x.reshape(y.shape) for x, y in zip(np.split(flat, cut), self.arrays(), strict=True)))

    def normalisers(self, two_back: int) -> np.ndarray:
        """Natural log of the sum over all symbols, by the symbol before, for one symbol two back."""
        far, near = (self.context * s for s in self.scale)
        logits = (near + far[two_back]).astype(np.float32) @ self.target.T.astype(np.float32) + self.bias.astype(np.float32)
        top = logits.max(1)
        return top + np.log(np.exp(logits - top[:, None]).sum(1))


def all_normalisers(spark: SparkSession, model: Parameters) -> np.ndarray:
    """Normalisers by the symbol two back and the one before, one row of the matrix at a time in tasks: at most SYMBOLS[1] squared numbers."""
    sent, n = spark.sparkContext.broadcast(model), len(model.context)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([sent.value.normalisers(i).astype(np.float32).tobytes() for i in rows], pa.binary())], names=["id", "values"])

    out = np.empty((n, n), np.float32)
    for r in spark.range(0, n, 1, max(1, n // 64)).mapInArrow(work, "id long, values binary").collect():
        out[r["id"]] = np.frombuffer(r["values"], np.float32)
    return out


def contexts(symbols: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol two back, symbol before) of each symbol of a text; before the text stands the start."""
    before = np.full(min(2, len(symbols)), start, symbols.dtype)
    return np.concatenate([before, symbols[:-2]]), np.concatenate([before[:1], symbols[:-1]])


def _gather(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row; rows of 16 bits are sorted by their digits."""
    order = np.argsort(rows, kind="stable")
    sorted_ = rows.take(order)
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    out = np.zeros((n, values.shape[1]), values.dtype)
    out[sorted_[first]] = np.add.reduceat(values.take(order, 0), first)
    return out


class Trainer:
    """Noise-contrastive estimation by Adagrad, a batch at a time."""

    def __init__(self, start: Parameters, noise: np.ndarray, seed: int, rate: float = RATE):
        self.rate = rate
        self.p = Parameters(*(x.astype(np.float32) for x in start.arrays()))
        self.past = [np.full(x.shape, 1e-3, np.float32) for x in self.p.arrays()]
        self.rng, self.noise = np.random.default_rng(seed), noise
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.edges = np.cumsum(noise)

    def step(self, far: np.ndarray, near: np.ndarray, wanted: np.ndarray) -> None:
        p, n = self.p, len(self.noise)
        drawn = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), n - 1)
        h = p.context.take(far, 0)
        h *= p.scale[0]
        h += p.context.take(near, 0) * p.scale[1]
        target, other, shift = p.target.take(wanted, 0), p.target[drawn], p.bias - self.log_noise
        pull = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, target) + shift.take(wanted)))
        push = h @ -other.T
        push -= shift[drawn]
        np.exp(push, out=push)
        push += 1
        np.divide(-1, push, out=push)
        target *= pull[:, None]
        dh = push @ other
        dh += target
        pushed = push.T @ h
        h *= pull[:, None]
        d_target = _gather(wanted, h, n)
        d_bias = np.bincount(wanted, pull, n)
        np.add.at(d_target, drawn, pushed)
        np.add.at(d_bias, drawn, push.sum(0))
        # the scales are the same in all rows: sums by symbol first, scaled after
        by_far, by_near = _gather(far, dh, n + 1), _gather(near, dh, n + 1)
        d_context = by_far * p.scale[0] + by_near * p.scale[1]
        d_scale = np.stack([np.einsum("ij,ij->j", by_far, p.context), np.einsum("ij,ij->j", by_near, p.context)])
        for x, past, grad in zip(p.arrays(), self.past, (d_context, d_target, d_scale, d_bias), strict=True):
            grad = (grad / len(wanted)).astype(np.float32)
            past += grad * grad
            x += self.rate * grad / np.sqrt(past)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of the saved training texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        table = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
            if len(counts) > COUNTED:
                yield table()
                counts = Counter()
        if counts:
            yield table()

    return texts.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """What scoring needs of the saved counts: at most KNOWN_WORDS words, the symbols' endings, and sums."""
    tokens, types = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens, types = (tokens or 0) + ends, types + (ends > 0)
    least, held = 1, 0  # known are the words that come at least so often, a power of two
    for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect():  # 64 rows at most
        if held + r["count"] > KNOWN_WORDS:
            least = 2 << r["power"]
            break
        held += r["count"]
    top = counts.filter(F.col("n") >= least).toArrow().to_pandas().sort_values(["n", "word"], ascending=[False, True], kind="stable").reset_index(drop=True)
    n = top["n"].to_numpy(np.int64)
    size = symbols_for(tokens)
    classes = size // 8
    frequent = size - 1 - classes
    by_ending = save(counts.groupBy(F.expr(f"right(word, {ENDING})").alias("ending")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")), "lm-endings")
    listed = by_ending.orderBy(F.desc("n"), "ending").limit(classes - 1).collect()
    all_n, all_types = (x or 0 for x in by_ending.agg(F.sum("n"), F.sum("types")).first())
    endings = {r["ending"]: i for i, r in enumerate(listed)}
    held, sizes = np.zeros(classes), np.zeros(classes)
    held[: len(listed)], sizes[: len(listed)] = [r["n"] for r in listed], [r["types"] for r in listed]
    held[-1], sizes[-1] = all_n - held[:-1].sum(), all_types - sizes[:-1].sum()
    own = np.array([endings.get(w[-ENDING:], classes - 1) for w in top["word"]], np.int64)
    k = min(frequent, len(n))
    held -= np.bincount(own[:k], n[:k], classes)
    sizes -= np.bincount(own[:k], minlength=classes)
    class_total = np.log10(held + 0.5 * (sizes + 1))
    symbol = np.where(np.arange(len(n)) < k, 1 + np.arange(len(n)), 1 + frequent + own)
    base = np.log10((n + 0.5) / (tokens + 0.5 * (types + 1)))
    inner = np.where(np.arange(len(n)) < k, 0.0, np.log10(n + 0.5) - class_total[own])
    noise = np.concatenate([[ends], np.pad(n[:k], (0, frequent - k)), held]) + 0.5
    return Vocabulary(tokens, types, ends, frequent, KnownWords({w.encode(): i for i, w in enumerate(top["word"])}, endings, classes - 1), symbol, base, inner, endings, class_total, noise / noise.sum())


def symbol_table(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The training texts as symbols, saved: looked up once for all rounds."""
    sent = texts.sparkSession.sparkContext.broadcast(vocab)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sent.value.symbols(sent.value.lookup(words_of(x))).astype(np.uint16).tobytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["symbols"])

    return save(texts.mapInArrow(work, "symbols binary"), "lm-symbols")


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Parameters:
    """Parameters after so many rounds over all training texts, each averaged over the tasks; what a task reads, and so the result, follows the files' splits."""
    model, symbols = Parameters.first(vocab.noise), symbol_table(texts, vocab)
    for i in range(rounds):
        model = train_round(symbols, vocab.noise, model, i)
    return model


def train_round(symbols: DataFrame, noise: np.ndarray, start: Parameters, number: int) -> Parameters:
    """Averaged parameters of the tasks over all training texts."""
    sent = symbols.sparkSession.sparkContext.broadcast((noise, start))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noise, start = sent.value
        trainer, total = Trainer(start, noise, TaskContext.get().partitionId() + (number << 32), RATE / (1 + number)), 0
        for batch in batches:
            held = [np.frombuffer(x, np.uint16) for x in batch.column(0).to_pylist()]
            if not held:
                continue
            wanted = np.concatenate(held)
            far, near = (np.concatenate(x) for x in zip(*(contexts(x, len(noise)) for x in held), strict=True))
            order = trainer.rng.permutation(len(wanted))
            for i in range(0, len(order), BATCH):
                at = order[i : i + BATCH]
                trainer.step(far[at], near[at], wanted[at])
            total += len(wanted)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([trainer.p.pack().astype(np.float64).tobytes()], pa.binary())], names=["n", "values"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = 0, 0.0
        for batch in batches:
            for n, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += n
                mean = mean + (np.frombuffer(values) - mean) * (n / total)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([mean.tobytes()], pa.binary())], names=["n", "values"])

    parts = symbols.mapInArrow(work, "n long, values binary").repartition(8).mapInArrow(average, "n long, values binary").collect()  # 8 rows
    total = sum(r["n"] for r in parts)
    return start.unpack(sum(np.frombuffer(r["values"]) * (r["n"] / total) for r in parts)) if total else start


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Parameters) -> DataFrame:
    """Scores of docs(doc_id, text) under a model; the counts of words that workers do not know are joined."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab, model, all_normalisers(docs.sparkSession, model)))
    end_base = np.log10((vocab.ends + 0.5) / (vocab.tokens + 0.5 * (vocab.types + 1)))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.float64())
    names = ["uid", "doc_id", "n_tokens", "n_known", "base", "score", "word", "times", "class_total"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model, normal = sent.value
        far_, near_ = (model.context * s for s in model.scale)
        uid = TaskContext.get().partitionId() << 34
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                index = vocab.lookup(words)
                symbols = vocab.symbols(index)
                far, near = contexts(symbols, len(vocab.noise))
                total = 0.0
                for i in range(0, len(symbols), 1 << 16):
                    f, e, t = far[i : i + (1 << 16)], near[i : i + (1 << 16)], symbols[i : i + (1 << 16)]
                    total += float((((far_[f] + near_[e]) * model.target[t]).sum(1) + model.bias[t] - normal[f, e]).sum())
                known = index[index >= 0]
                rows.append((uid, doc_id, len(symbols), len(known) + (vocab.ends > 0), float(vocab.base[known].sum()) + end_base, total / np.log(10) + float(vocab.inner[known].sum()), None, None, None))
                if len(known) < len(index):
                    for w, times in Counter(map(words.__getitem__, np.flatnonzero(index < 0).tolist())).items():
                        name = w.decode()
                        rows.append((uid, None, None, None, None, None, name, times, float(vocab.class_total[vocab.ending(name)])))
                uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema(list(zip(names, kinds, strict=True))))

    schema = "uid long, doc_id long, n_tokens long, n_known long, base double, score double, word string, times long, class_total double"
    made = save(docs.mapInArrow(work, schema), "lm-scores")
    total = float(np.log10(vocab.tokens + 0.5 * (vocab.types + 1)))
    rare = made.filter("word is not null").select("uid", "word", "times", "class_total").join(counts, "word", "left")
    n, share = F.coalesce("n", F.lit(0)), F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    sums = rare.groupBy("uid").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("r_known"), F.sum(F.col("times") * (share - total)).alias("r_base"), F.sum(F.col("times") * (share - F.col("class_total"))).alias("r_score"))
    out = made.filter("word is null").join(sums, "uid", "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        "doc_id",
        (id_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        add("n_known", "r_known").cast("long").alias("n_known"),
        F.lit(int(vocab.tokens)).cast("long").alias("train_tokens"),
        add("base", "r_base").alias("base_score"),
        add("score", "r_score").alias("score"),
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Learns from rows outside the held-out fold (by crc32 of the id; a null id counts as the empty text). A-Z lower-cased, words stand between ASCII
    white space, each text has one end more; a null text is empty, one end. Repeated rows count and score each.
    Without training rows, scores are those of the first parameters; an empty table gives an empty result. Scores depend on how the
    files are split over tasks; counts and base scores do not.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    texts = rows.filter(id_bucket("doc_id", FOLDS) != HELD_OUT).select("text")
    counts = save(count_words(texts), "lm-counts")
    vocab = vocabulary(counts, texts.count())
    return score(rows, counts, vocab, train(texts, vocab))
