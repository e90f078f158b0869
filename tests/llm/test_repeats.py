"""Repeated byte strings against a dictionary of all windows."""

import hashlib

import numpy as np

from tidemark.llm import repeats

from .test_operators import table


def brute(texts, length=200):
    seen = {}
    for i, t in enumerate(texts):
        for a in range(len(t) - length + 1):
            seen.setdefault(t[a : a + length], []).append((i, a))
    spans = {i: [] for i in range(len(texts))}
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                spans[i].append((a, a + length))
    return {i: repeats.merged(s) for i, s in spans.items()}


def made(rng, n):
    return "".join(rng.choice(list("abcdefgh é"), n))


def test_repeats(spark, monkeypatch):
    rng = np.random.default_rng(8)
    passage, short = made(rng, 700), made(rng, 150)
    texts = [made(rng, int(rng.integers(0, 900))) for _ in range(30)]
    texts += [made(rng, 50 + i) + passage[i * 7 : 400 + i * 11] + made(rng, 90) for i in range(12)]
    texts += [made(rng, 60) + short + made(rng, 60) for _ in range(10)]
    texts += [made(rng, 130 + i % 3) + passage[:230] + made(rng, 140) for i in range(90)]  # a hot place
    texts += ["ab " * 400, "x" * 260, made(rng, 300) * 3, texts[4], texts[4], "é" * 150, "", "z" * 199, "q" * 200, "q" * 200]
    texts += [texts[2] + "!" + made(rng, 230) + texts[3]]
    want = brute([t.encode() for t in texts])
    rows = [(i, t or None, "s") for i, t in enumerate(texts)]
    for block, shard in ((repeats.BLOCK_BYTES, repeats.SHARD_BYTES), (333, 2000)):
        monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
        monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
        got = {r["doc_id"]: r for r in repeats.find_repeats(table(spark, rows)).collect()}
        for i, t in enumerate(texts):
            data, spans, at, kept = t.encode(), want[i], 0, b""
            for a, b in spans:
                kept += data[at:a]
                at = b
            kept += data[at:]
            r = got[i]
            assert r["spans"] == [x for s in spans for x in s], i
            assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), len(data) - len(kept), len(spans))
            assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        if block != 333:
            assert repeats.find_repeats(table(spark, [])).count() == 0


def test_index_statistics():
    rng = np.random.default_rng(3)
    for text in [b"", b"a", b"aaaa", b"banana", b"abcabcabcab", bytes(rng.integers(97, 100, 400).astype(np.uint8))]:
        want = [max((next((k for k in range(len(text)) if i + k >= len(text) or j + k >= len(text) or text[i + k] != text[j + k]), 0) for j in range(len(text)) if j != i), default=0) for i in range(len(text))]
        for ends in {(), (len(text) // 2,), (len(text) - 1,), (len(text) // 3, len(text) // 2, len(text) - 1)} if text else {()}:
            ends = np.unique(np.array(ends, np.int64))
            streamed = repeats.RunLengthIndex(text, ends).statistics().tolist()
            held = ends[-1] + 1 if len(ends) else 0
            assert streamed == want[:held] + [0] * (len(text) - held), text
        order, rank = repeats.suffix_order(np.frombuffer(text, np.uint8))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:]) and rank[order].tolist() == list(range(len(text)))


def test_runs_are_few_in_a_repetitive_text():
    rng = np.random.default_rng(4)
    once = bytes(rng.integers(97, 123, 500).astype(np.uint8))
    index = repeats.RunLengthIndex(once * 40, np.array([20_000 - 1]))
    assert len(index.heads) < 600 and (index.statistics()[:19_000] >= 500).all()


def test_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(6)
    a, b = made(rng, 300), made(rng, 420)
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (7, "x" + b + "y", "s"), (None, None, "s"), (None, made(rng, 250), "s"), (None, b, "s")]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.find_repeats(table(spark, rows)).collect())
    size = lambda t: len((t or "").encode())
    assert got == sorted((-1 if i is None else i, size(t), size(b) if i == 7 else 0 if i is None and t != b else size(t)) for i, t, _ in rows)


def test_steps_from_run_to_run(monkeypatch):
    """Statistics do not depend on how many runs are walked over before a row's run is searched for."""
    rng = np.random.default_rng(4)
    parts = [bytes(rng.choice(list(letters), int(rng.integers(1, 90))).astype(np.uint8)) for letters in (b"a", b"ab", b"abc", bytes(range(97, 123))) for _ in range(12)]
    parts += [parts[3] + parts[20], b"ab" * 40, parts[30] * 3]
    text = b"\xff".join(parts) + b"\xff"
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    want = []
    for i in range(len(text)):
        best = 0
        while i + best < len(text) and any(text.find(text[i : i + best + 1], a) not in (-1, i) for a in (0, i + 1)):
            best += 1
        want.append(best)
    for walk in (0, 1, repeats.WALK, 1000):
        monkeypatch.setattr(repeats, "WALK", walk)
        assert repeats.RunLengthIndex(text, ends).statistics().tolist() == want
