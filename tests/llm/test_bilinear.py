"""LM scoring: counts and base scores against brute force, normalised probabilities, held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import bilinear, shared

from .test_operators import some_rows, table


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("known", [10, 300_000])
def test_scores(spark, monkeypatch, known):
    monkeypatch.setattr(bilinear, "KNOWN_WORDS", known)
    rng = np.random.default_rng(1)
    rows = some_rows() + [(1000 + i, " ".join(["left right"] * int(rng.integers(1, 40))) if i % 2 else " ".join(rng.choice(list("uvwxyz"), 30)), "s") for i in range(600)]
    docs = table(spark, rows)
    got = {r["doc_id"]: r for r in bilinear.score_documents(docs).collect()}
    counts, ends = Counter(), 0
    for i, t, _ in rows:
        if not held(i):
            counts.update((t or "").encode().lower().split())
            ends += 1
    total, types = sum(counts.values()) + ends, len(counts) + 1
    log = lambda c: math.log10((c + 0.5) / (total + 0.5 * (types + 1)))
    assert len(got) == len(rows)
    for i, t, _ in rows:
        words, r = (t or "").encode().lower().split(), got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(i), len(words) + 1, total)
        assert r["n_known"] == 1 + sum(counts[w] > 0 for w in words)
        assert abs(r["base_score"] - log(ends) - sum(log(counts[w]) for w in words)) < 1e-6 * max(1, len(words))
    if known > 10:
        out = [r for r in got.values() if r["held_out"]]
        assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bilinear, "SYMBOLS", (64, 64))
    monkeypatch.setattr(bilinear, "KNOWN_WORDS", 120)
    rng = np.random.default_rng(4)
    rows = some_rows() + [(None, "no id here", "s"), (None, None, "s"), (3, "an id again", "s"), (2000, " ".join(rng.choice([f"x{i}ing" for i in range(90)], 12_000)), "s")]
    docs = table(spark, rows)
    texts = shared.save(docs.filter(shared.id_bucket("doc_id", 5) != 1).select(shared.text_or_empty().alias("text")), "t")
    counts = shared.save(bilinear.count_words(texts), "t")
    vocab = bilinear.vocabulary(counts, texts.count())
    model = bilinear.train(texts, vocab)
    got = Counter((r["doc_id"], r["n_tokens"], round(r["score"], 2)) for r in bilinear.score(docs.select("doc_id", shared.text_or_empty().alias("text")), counts, vocab, model).collect())
    counted = {r["word"]: r["n"] for r in counts.collect()}
    top = sorted(counted, key=lambda w: (-counted[w], w))[: int((vocab.symbol <= vocab.frequent).sum())]
    assert len(top) > 11
    symbol = {w: i + 1 for i, w in enumerate(top)}
    of = lambda w: symbol.get(w) or 1 + vocab.frequent + vocab.ending(w)
    total, kinds = Counter(), Counter()
    for w in counted:
        if w not in symbol:
            total[of(w)] += counted[w]
            kinds[of(w)] += 1
    table_ = {}

    def log_p(far, near):
        if (far, near) not in table_:
            h = model.context[far] * model.scale[0] + model.context[near] * model.scale[1]
            logits = h @ model.target.T + model.bias
            table_[far, near] = logits - np.log(np.exp(logits).sum())
        return table_[far, near]

    for i, t, _ in rows:
        words, far, near, score = [w.decode() for w in (t or "").encode().lower().split()], 64, 64, 0.0
        for w in [*words, None]:
            s = 0 if w is None else of(w)
            score += log_p(far, near)[s] / math.log(10)
            if w is not None and w not in symbol:
                score += math.log10((counted.get(w, 0) + 0.5) / (total[s] + 0.5 * (kinds[s] + 1)))
            far, near = near, s
        match = [k for k in got if k[:2] == (i, len(words) + 1) and abs(k[2] - score) < 0.011 + 1e-4 * abs(score)]
        assert match, (i, score)
    assert sum(got.values()) == len(rows)


def test_symbols_grow_with_the_corpus():
    sizes = [bilinear.symbols_for(n) for n in (0, 300_000, 20_000_000, 110_000_000, 10**9, 10**13)]
    assert sizes == [512, 512, 512, 1024, 4096, 4096]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    noise = rng.random(512)
    model = bilinear.Parameters.first(noise / noise.sum())
    model.bias += rng.normal(size=model.bias.shape)
    far, near = (model.context * s for s in model.scale)
    for f, e in [(0, 5), (512, 512), (511, 3)]:
        assert abs(np.exp((far[f] + near[e]) @ model.target.T + model.bias - model.normalisers(f)[e]).sum() - 1) < 1e-4


def test_empty(spark):
    assert bilinear.score_documents(table(spark, [])).count() == 0


def test_step_follows_the_plain_gradient():
    """One Adagrad step against sums written out token by token; 16-bit symbols give the same as wide ones."""
    rng = np.random.default_rng(2)
    noise = rng.random(7) + 0.1
    noise /= noise.sum()
    wanted, far, near = rng.integers(0, 7, 50), rng.integers(0, 8, 50), rng.integers(0, 8, 50)
    start = bilinear.Parameters(*(x + rng.normal(0, 0.3, x.shape) for x in bilinear.Parameters.first(noise).arrays()))
    drawn = np.minimum(np.searchsorted(np.cumsum(noise), np.random.default_rng(5).random(bilinear.NOISE)), 6)
    grads = [np.zeros(x.shape) for x in start.arrays()]
    for f, e, w in zip(far, near, wanted, strict=True):
        h = start.context[f] * start.scale[0] + start.context[e] * start.scale[1]
        dh = np.zeros(len(h))
        for symbol, label in [(w, 1), *((d, 0) for d in drawn)]:
            logit = h @ start.target[symbol] + start.bias[symbol] - np.log(bilinear.NOISE * noise[symbol])
            off = label - 1 / (1 + np.exp(-logit))
            dh += off * start.target[symbol]
            grads[1][symbol] += off * h
            grads[3][symbol] += off
        grads[0][f] += dh * start.scale[0]
        grads[0][e] += dh * start.scale[1]
        grads[2] += [dh * start.context[f], dh * start.context[e]]
    want = [x + bilinear.RATE * (g / 50) / np.sqrt(1e-3 + (g / 50) ** 2) for x, g in zip(start.arrays(), grads, strict=True)]
    for kind in (np.int64, np.uint16):
        trainer = bilinear.Trainer(start, noise, 5)
        trainer.step(far.astype(kind), near.astype(kind), wanted.astype(kind))
        for x, y in zip(trainer.p.arrays(), want, strict=True):
            assert np.allclose(x, y, atol=2e-4)
