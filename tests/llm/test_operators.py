"""The operators against brute force, on small tables with nulls, ties, repeated rows, empty and long texts and further columns."""

import functools
import hashlib
import re
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import chat, components, exact, mixing, onebit, packing, shared, simhash, tokenfile, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, size string, copies int, root long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def table(spark, rows):
    """documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "k", 1, "z", 2, 3) for i, t, s in rows], SCHEMA)


def some_rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(60)]
    rows = []
    for i in range(120):
        n = int(rng.integers(0, 60))
        rows.append((i, " ".join(rng.choice(words, n)), ["a", "b", "É", None, ""][i % 5]))
    rows += [(200 + i, rows[3][1], "a") for i in range(40)]  # a group of copies
    rows += [(300, rows[4][1].replace(" ", " \t\n"), "b"), (301, None, "a"), (302, "", None), (303, " ", "b"), (304, "\x0b\x0c", "b")]
    long_ = " ".join(rng.choice(words, 9000))
    rows += [(305, long_, "a"), (306, long_ + " tail", "b"), (307, "\xa0x y \x1c", "b"), (308, "a <|endoftext|> b", "b"), (309, "one two", "b"), (310, "nul\x00 byte", "b")]
    return rows


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_exact_copies(spark, monkeypatch, bits):
    monkeypatch.setattr(exact, "HOT", 20)
    rows = some_rows()
    out = {r["doc_id"]: r for r in exact.find_copies(table(spark, rows), bucket_keys=4, key_bits=bits).collect()}
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    assert len(out) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            r = out[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(ids), i == min(ids))
            assert bytes(r["text_sha256"]) == hashlib.sha256(text.encode()).digest()


def test_exact_result_comes_through_the_index(spark, monkeypatch):
    docs = table(spark, [(1, "a b", "s"), (2, "a  b", "s"), (3, "c", "s")])
    monkeypatch.setattr(exact, "build_index", lambda keys, n: keys.limit(0).selectExpr("0L as bucket", "0 as depth", "key", "copies"))
    assert exact.find_copies(docs).filter("kept").count() == 3


def test_exact_keeps_columns_and_one_of_repeated_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, "a  b", "s"), (3, "c", "s"), (3, "d", "s"), (None, "a b", "s"), (None, None, None)]
    docs = table(spark, rows)
    out = exact.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] is not None) == [(1, "a b"), (3, "c"), (3, "d")]
    assert out.filter("doc_id is null").count() == 2


def test_directory_splits_overfull_buckets(spark):
    numbers = [0, 1, 1 << 59, 3 << 58, 1 << 61, 1 << 62, 3 << 62, (1 << 63) + 5]
    keys = shared.save(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, 1) for x in numbers], "key long, copies long"), "t")
    held = {}
    for r in exact.build_index(keys, 2).collect():
        assert r["bucket"] % (1 << 64) >> (64 - r["depth"]) == r["key"] % (1 << 64) >> (64 - r["depth"])
        held.setdefault((r["bucket"], r["depth"]), []).append(r["key"])
    assert sum(map(len, held.values())) == len(numbers) and all(len(x) <= 2 for x in held.values())
    assert {d for _, d in held} >= {2, 3, 5}
    assert exact.build_index(shared.save(keys.limit(0), "t")).count() == 0


@pytest.mark.parametrize("call", [exact.find_copies, exact.drop_copies, mixing.mix, mixing.repeat_rows, packing.pack, tokenfile.token_table, simhash.near_copies, lambda d: toxicity.score(d, None)])
def test_empty_table(spark, call):
    assert call(table(spark, [])).count() == 0


def fill(sizes, weights, epochs=3):
    """Targets by raising the level source by source, in fractions."""
    order = sorted(range(len(sizes)), key=lambda i: Fraction(epochs * sizes[i], weights[i]))
    left, open_, out = Fraction(sum(sizes)), sum(weights), {}
    for i in order:
        out[i] = min(Fraction(epochs * sizes[i]), left * weights[i] / open_)
        left, open_ = left - out[i], open_ - weights[i]
    return [out[i] for i in range(len(sizes))]


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 20)
    rows = some_rows()
    rows += [(None, f"null id {i} " + "w " * (i % 5), "a") for i in range(60)] + [(7, "again and again", "b")] * 30 + [(None, None, "a"), (400, "x y z", "\U0001F600"), (401, "x y z w", "\uffee")]
    got = mixing.mix(table(spark, rows), bins=8).collect()
    size = lambda t: len([w for w in SPACE.split(t or "") if w])
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    by_source = {n: sum(size(t) for _, t, s in rows if s == n) for n in names}
    targets = dict(zip(names, fill([by_source[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    assert sorted((str(i), size(t), by_source[s], float(targets[s])) for i, t, s in rows) == sorted((str(r["doc_id"]), r["size"], r["source_size"], r["target"]) for r in got)
    source = {(by_source[n], float(targets[n])): n for n in names}
    assert len(source) == len(names)
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["source_size"], r["target"]]] += r["taken"]
    assert all(abs(taken[n] - targets[n]) <= 1 for n in names)
    again = mixing.mix(table(spark, rows).repartition(3), bins=8).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["taken"]) for r in again)


@pytest.mark.parametrize("sizes", [[10, 100, 0, 5], [8, 8], [0, 0], [5], [1, 1, 1, 10**12, 3, 7 * 10**11], []])
def test_water_fill(spark, sizes):
    rows = spark.createDataFrame([(f"s{i:02d}" if i else None, x) for i, x in enumerate([*sizes[-1:], *sizes[:-1]])], "source string, source_size long")
    out = mixing.water_fill(shared.save(rows, "t")).collect()
    want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    got = [next(r for r in out if r["source"] == (f"s{i + 1:02d}" if i < len(sizes) - 1 else None)) for i in range(len(sizes))]
    for x, t, r in zip(sizes, want, got, strict=True):
        assert r["target"] == float(t) and abs(r["whole"] * x + r["extra"] - t) <= Fraction(1, 2) and 0 <= r["extra"] <= x


def test_repeat_rows(spark):
    docs = table(spark, some_rows())
    out = mixing.repeat_rows(docs, bins=4)
    assert out.columns == docs.columns and out.filter("doc_id is null").isEmpty()
    words = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(docs, bins=4).collect()}
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for i, (size, taken) in words.items():
        if size:
            assert abs(times.get(i, 0) - taken / size) <= 0.5


@functools.cache
def plain_tokenizer(file):
    return Tokenizer.from_file(public_tokenizers.path(file))


def plain_ids(file, text):
    return plain_tokenizer(file).encode(text, add_special_tokens=False).ids


def odd_texts():
    rng = np.random.default_rng(1)
    letters = list("ab 'sS.,!ßéΣσİ\t\n\r\v  1²́\x00\x1c\xa0　中😀<|>_-\\")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 40)))) for _ in range(1500)]
    return [*texts, "don't I'll  x'\n\n\n y", "  ", "\n", "", "a <|endoftext|> b <|startoftext|>", "x<|endoftext|>", "<|ENDOFTEXT|><|endoftext|>.,a<|startoftext|>!? <|endoftext", "\n <|endoftext|>\n  <|endoftext|> ", " lead", "trail ", "x" * 5000]


def test_word_ids():
    enc = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), cache_words=300)
    for _ in range(2):
        for text, ids in zip(odd_texts(), enc.encode(odd_texts()), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain_ids("word_bpe_49k.json", text)


def test_plain_words_by_the_model_alone():
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in [*range(97, 123), *range(0xDF, 0x100)] if c != 0xF7]
    words = ["".join(rng.choice(letters, int(rng.integers(1, 14)))) + str(rng.choice(["", ".", ",!", "###"])) for _ in range(3000)] + [chr(c) for c in range(0x21, 0x250)]
    enc = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for word, ids in zip(words, enc.encode(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain_ids("word_bpe_49k.json", word)


def test_byte_ids():
    enc = tokens.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    around = [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)} \n{chr(c)}.{chr(c)}" for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for i in range(0, len(around), 1000):
        texts = around[i : i + 1000]
        want = plain_tokenizer("byte_bpe_50k.json").encode_batch_fast(texts, add_special_tokens=False)
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [e.ids for e in want]
    for text, ids in zip(odd_texts(), enc.encode(odd_texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain_ids("byte_bpe_50k.json", text)


def test_pack(spark):
    rows = some_rows()
    out = packing.pack(table(spark, rows)).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t, _ in rows:
        ids, at = [*plain_ids("byte_bpe_50k.json", t or ""), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_differencing():
    assert packing.pack_lengths(np.array([], np.int64)).tolist() == []
    bins, sums = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums) == [14, 16] and np.bincount(bins, [8, 7, 6, 5, 4]).tolist() == sums.tolist()
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2049, 700)
    bins = packing.pack_lengths(lengths)
    assert np.bincount(bins, lengths).max() <= 2048
    for n, k in ((1, 1), (1, 4), (3, 1), (4, 9), (300, 7), (50, 50)):
        lengths = rng.integers(1, 100, n)
        bins, sums = packing.differencing(lengths, k)
        assert len(bins) == n and bins.max() < k and np.bincount(bins, lengths, k).tolist() == sums.tolist()
    bins, sums = packing.differencing(np.ones(20_000, np.int64), 10)
    assert sums.min() >= 1999
    lengths = np.array([b for n in rng.integers(1, 4000, 900) for _, b in packing.cuts(int(n))])
    used = len(set(packing.pack_lengths(lengths).tolist()))
    assert lengths.sum() / (used * 2048) > 0.98


def test_differencing_is_bounded_in_memory():
    tracemalloc.start()
    packing.differencing(np.ones(50_000, np.int64), 512)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_pack_of_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 100)
    out = packing.pack(table(spark, [(None, None, "s")] * 700 + [(1, "a b c", "s")] * 300))
    assert out.groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("words"), F.max(F.col("offset") + F.col("length")).alias("end")).filter("words <> end or end > 2048").isEmpty()
    assert out.count() == 1000 and out.select(F.shiftright("sequence_id", 32)).distinct().count() > 5


def test_token_files_with_repeated_and_missing_ids(spark):
    rows = [(5, f"text {i % 7}", "s") for i in range(60)] + [(None, "no id", "s"), (None, None, "s"), (4, "four", "s"), (6, "", "s")]
    out = sorted(tokenfile.token_table(table(spark, rows)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None, None, 4, *[5] * 60, 6]
    at = 0
    for r in out:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    want = sorted(tuple([*plain_ids("word_bpe_49k.json", t or ""), 2]) for _, t, _ in rows)
    assert sorted(tuple(np.frombuffer(r["ids"], "<u4").tolist()) for r in out) == want


def test_token_files(spark):
    rows = some_rows()
    out = {r["doc_id"]: r for r in tokenfile.token_table(table(spark, rows)).collect()}
    at = 0
    for i, t, _ in sorted(rows):
        ids = [*plain_ids("word_bpe_49k.json", t or ""), 2]
        assert (out[i]["start"], out[i]["n_tokens"], np.frombuffer(out[i]["ids"], "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)


def test_token_file_reads_single_documents(tmp_path):
    samples = [np.arange(i, dtype=np.uint16).tobytes() * 20 for i in range(60)]
    dictionary = tokenfile.train_dictionary(samples, 2048)
    with open(tmp_path / "f", "wb") as f:
        writer = tokenfile.TokenWriter(f, dictionary, 2)
        for i in range(5):
            writer.add(None if i == 0 else i, np.arange(i * 3))
        writer.close()

    import pyarrow.fs as pafs

    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as source:
        reader = tokenfile.TokenReader(source, dictionary)
        assert reader.read(3).tolist() == list(range(9)) and reader.read(0).tolist() == [] and len(reader) == 5
        with pytest.raises(ValueError, match="dictionary"):
            tokenfile.TokenReader(source, dictionary + b"x")


def bits_of(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, distance):
    """The smallest id of each row's component, all pairs compared."""
    values = sorted(set(prints.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, v in prints.items():
        least[find(v)] = min(least.get(find(v), i), i)
    return {i: least[find(v)] for i, v in prints.items()}


def test_simhash_of_texts(spark):
    rows = some_rows()
    out = {r["doc_id"]: r for r in simhash.near_copies(table(spark, rows)).collect()}
    prints = {i: bits_of(t or "") for i, t, _ in rows}
    assert {i: r["fp"] % (1 << 64) for i, r in out.items()} == prints
    assert {i: r["component_id"] for i, r in out.items()} == reachable(prints, 4)


@pytest.mark.parametrize("large", [2, 64])
def test_links_of_dense_prints(spark, large):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {0: 0, 1: (1 << 64) - 1, 2: 1 << 63}
    for i in range(3, 700):
        v = int(centres[i % 12] if i % 3 else centres[0])
        for b in rng.choice(64, int(rng.integers(0, 9)), replace=False):
            v ^= 1 << int(b)
        prints[i] = v
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in set(prints.values())]
    nodes = spark.createDataFrame(signed, "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in simhash.link_prints(nodes, large_bucket=large).collect()}
    want = reachable(prints, 4)
    classes = {}
    for i, v in prints.items():
        classes.setdefault(want[i], set()).add(v)
    for members in classes.values():
        assert len({roots.get(v, v) for v in members}) == 1
    assert len({roots.get(v, v - (1 << 64) if v >> 63 else v) for v in prints.values()}) == len(classes)


def test_thresholds_obey_the_pigeonhole():
    even = [[0.5] * 22, [0.5] * 21, [0.5] * 21]
    assert sum(simhash.deal_thresholds(10_000_000, [2.0**-22, 2.0**-21, 2.0**-21], even)[1]) == 2
    dealt = simhash.deal_thresholds(100, [1.0, 1e-6, 1e-6], even)[1]
    assert dealt[0] == min(dealt) and sum(dealt) == 2


def test_partitions_by_number_of_prints():
    half = lambda n: simhash.choose_groups(n, n * (np.full((64, 64), 0.25) + np.eye(64) * 0.25))
    assert len(half(10_000)) > len(half(10**8)) >= len(half(10**10)) == 2
    assert sorted(b for g in half(10**6) for b in g) == list(range(64))


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6), (9, 8), (8, 7), (7, 3), (2, 1)], "a long, b long")
    assert {r["node"]: r["root"] for r in components.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 4}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["root"] for r in components.components(chain).collect()} == {0}


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[50:90] = x[0]  # ties
    rows = [(i, [float(v) for v in x[i]], "c") for i in range(700)]
    rows += [(700, None, "c"), (701, [0.0] * 16, "c"), (702, [float("nan")] + [1.0] * 15, "c"), (703, [None] + [1.0] * 15, "c"), (704, [float("inf")] * 16, "c"), (705, [], "c"), (None, [1.0] * 16, "c"), (720, [1.0, 2.0], "c"), (721, [3.0, 2.0], "c")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim string")
    compared = []
    out = onebit.nearest(vectors, F.col("vec_id") % 20 == 0, block_rows=200, compared=compared).collect()
    assert sum(a for a, _ in compared) < sum(b for _, b in compared)
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    exact_ = x.astype(np.float64) @ x.astype(np.float64).T
    hits = 0
    for q in range(0, 700, 20):
        order = sorted((i for i in range(700) if i != q), key=lambda i: (-round(exact_[q, i], 9), i))[:20]
        assert len(found[q]) == 20
        assert all(abs(s - exact_[q, i]) < 1e-9 for i, s in found[q])
        assert found[q] == sorted(found[q], key=lambda p: (-p[1], p[0]))
        hits += len({i for i, _ in found[q]} & set(order))
    assert hits / (35 * 20) > 0.95
    assert found[720] == [(721, 7.0)] and set(found) == {*range(0, 700, 20), 720}
    twice = spark.createDataFrame([(20, [1.0, 0.0], "c"), (20, [0.0, 1.0], "c"), (1, [1.0, 2.0], "c"), (1, [1.0, 2.0], "c"), (2, [3.0, 1.0], "c")], vectors.schema)
    assert sorted(tuple(r) for r in onebit.nearest(twice, F.col("vec_id") % 20 == 0, k=2).collect()) == [(20, 1, 1, 2.0), (20, 1, 2, 3.0), (20, 2, 1, 1.0), (20, 2, 1, 2.0)]
    assert onebit.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_chat(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\s> <s> <\\\\/s>", "[\\INST][/INST\\]", "a\\", "", None, "é\n\x00", "<<s>>", "[[INST]]\\[INST]", "a <|endoftext|> b"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, 5) for i, t in enumerate(odd)]
    rows += [(2, None, None, "x", 5), (2, 0, "assistant", "y", 5), (2, 0, "assistant", "y", 5), (None, 1, "a\nb[INST]\\n", "z", 5), (3, 0, "assistant", odd[0], 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    out = {r["conv_id"]: r for r in chat.format_and_read(turns).collect()}
    assert set(out) == {1, 2, 3, None}
    for conv, r in out.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text, _ in rows if c == conv))
        said = "".join(f"{role}\n{text}\n" for *_, role, text in own)
        learned = "".join(text for *_, role, text in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    for text in odd:
        hidden = chat.escape(text or "")
        assert chat.unescape(hidden) == (text or "") and not any(c in hidden for c in chat.CONTROLS)


def test_toxicity_learns_and_scores(spark):
    rng = np.random.default_rng(4)
    clean = [f"{a}{b}" for a in ("th", "er", "on", "an", "re") for b in ("ing", "ed", "es", "ly", "ou", "at")]
    rows, marks = [], []
    for i in range(900):
        words = list(rng.choice(clean, int(rng.integers(5, 200))))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words[int(rng.integers(0, len(words)))] = str(rng.choice(["moronic", "morons", "Moron!", "scumbag", "scum", "scummy"]))
        rows.append((i, " ".join(words), "s"))
        marks.append((i, None, int(toxic)))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "such scummish moronity", "s"), (None, "thing ered", "s")]
    docs, labels = table(spark, rows), spark.createDataFrame([*marks, (5000, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    truth = {i: t for i, _, t in marks}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1002]["predicted"] == 1 and by_id[1000]["score"] == by_id[1001]["score"] < 0.3
    assert toxicity.fit(docs, labels.limit(0)) is None
