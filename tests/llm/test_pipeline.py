"""The pipeline's stages and the whole of it against brute force, with near copies at 0.8, null and repeated ids, null and empty texts."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from tidemark.llm import jaccard, mixing, packing, queries, repeats, shared, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
RNG = np.random.default_rng(8)


def text_of(n, stem="w"):
    return " ".join(f"{stem}{i}" for i in RNG.integers(0, 3000, n))


def edited(text, *places):
    words = text.split()
    for p in places:
        words[p] = f"edit{p}"
    return " ".join(words)


def some_rows():
    a, b, c, d = text_of(49), text_of(204), text_of(5), text_of(60)
    # 49 words have 45 shingles: one word at place 10 touches 5 of them (40/50 = 0.8), with the last word 6 (39/51 < 0.8)
    rows = [(1, a), (2, edited(a, 10)), (3, edited(a, 10, 48)), (4, b), (5, edited(b, 20, 90, 160)), (6, c), (7, c + " more"), (8, "one two"), (9, "one  TWO"), (10, "one two three")]
    rows += [(11, d), (11, edited(d, 0)), (11, text_of(40)), (None, d), (None, edited(d, 59)), (None, "nobody's text"), (None, "nobody's text"), (12, d), (12, d)]
    rows += [(13, None), (14, ""), (15, " "), (None, None), (16, "bad words here so bad"), (None, "bad words here so bad"), (16, "good words stay here always")]
    base = text_of(120, "h")
    rows += [(100 + i, edited(base, *RNG.integers(0, 120, 3))) for i in range(60)]
    return rows + [(200 + i, text_of(int(RNG.integers(5, 80)))) for i in range(40)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "ab"[k % 2], k) for k, (i, t) in enumerate(rows)], SCHEMA)


def got(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def shingles(text):
    words = [w for w in SPACE.split((text or "").lower()) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def rank(row):
    return (row[0] is None, row[0] or 0)


def brute_exact(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[SPACE.sub(" ", row[1] or "")].append(row)
    return {text: min(map(rank, group)) for text, group in groups.items()}


def brute_components(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[find(i)].append(row)
    return list(groups.values())


def test_exact_stage(spark):
    rows = some_rows()
    out = got(corpus_pipeline.drop_copies(spark, frame(spark, rows), ""))
    want = brute_exact(rows)
    assert Counter((SPACE.sub(" ", t or ""), rank((i, t))) for i, t in out.elements()) == Counter(want.items())


@pytest.mark.parametrize("large", [1, 8])
def test_near_stage(spark, monkeypatch, large):
    monkeypatch.setattr(jaccard.find_near_copies, "__defaults__", (*jaccard.find_near_copies.__defaults__[:-1], large))
    rows = some_rows()
    out = got(corpus_pipeline.drop_near_copies(spark, frame(spark, rows), ""))
    groups = brute_components(rows)
    assert sum(out.values()) == len(groups)
    for group in groups:
        kept = [r for r in set(group) if out[r]]
        assert len(kept) == 1 and out[kept[0]] == 1 and rank(kept[0]) == min(map(rank, group))


def test_crowd_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)
    base = text_of(150, "c")
    texts = [edited(base, *RNG.choice(150, int(RNG.integers(1, 7)), replace=False)) for _ in range(70)]
    sets = [jaccard.shingle_set(t) for t in texts]
    link = np.array([[jaccard.alike(x, y) for y in sets] for x in sets])
    root = list(range(70))
    for i in range(20):  # as if pivots had joined only these
        root[i] = min(j for j in range(i + 1) if link[i, j])
    rows = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "node long, hashes binary")
    left = spark.createDataFrame([(k, i, len(sets[i]), root[i], 0) for k in (1, 2) for i in range(70)], "key long, node long, n int, root long, main long")
    edges = [tuple(r) for r in jaccard._crowd_links(left, rows).collect()]
    assert all(link[a, b] and root[a] != root[b] for a, b in edges) and any(link[a, b] for a in range(20, 70) for b in range(a))

    def joined(pairs):
        of = list(root)
        for a, b in pairs:
            old, new = of[a], of[b]
            of = [new if x == old else x for x in of]
        return {frozenset(i for i in range(70) if of[i] == x) for x in of}

    # pairs inside the main component of the buckets are no one's question: those of the others must all be joined
    assert joined(edges) == joined((a, b) for a in range(70) for b in range(70) if link[a, b] and (root[a] or root[b]))


def test_near_copies_at_and_under_the_limit():
    x = text_of(49)
    hashed = [jaccard.shingle_set(t) for t in (x, edited(x, 10), edited(x, 10, 48))]
    assert jaccard.alike(hashed[0], hashed[1]) and not jaccard.alike(hashed[0], hashed[2])
    met = 0
    for i in range(300):
        words = text_of(49, f"s{i}x")
        a, b = (jaccard.minima(jaccard.shingle_set(t)) for t in (words, edited(words, 10)))
        met += bool(set(jaccard.band_keys(a).tolist()) & set(jaccard.band_keys(b).tolist())) and (a.astype(np.uint8) == b.astype(np.uint8)).sum() >= jaccard.LEAST_EQUAL
    assert met == 300


def labelled(spark, path):
    rows = some_rows() + [(1000 + i, f"{text_of(12)} {'bad so bad' if i % 2 else 'good and fine'} {text_of(12)}") for i in range(200)]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def brute_toxic(spark, path, rows):
    model = toxicity.fit(frame(spark, rows), spark.read.parquet(f"{path}/labels.parquet"))
    return [(i, t) for i, t in rows if 1 / (1 + np.exp(-toxicity.logit(t or "", model, {}))) < toxicity.THRESHOLD]


def test_toxicity_stage_and_the_whole(spark, tmp_path):
    rows = labelled(spark, tmp_path)
    clean = brute_toxic(spark, tmp_path, rows)
    assert 0 < len(clean) < len(rows) and (None, "bad words here so bad") not in clean and (16, "good words stay here always") in clean
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert got(corpus_pipeline.reject_toxic(spark, docs, str(tmp_path))) == Counter(clean)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    left = got(docs)
    once = brute_exact(clean)
    # which of several equal ranks stays is open; the number of groups is not
    groups = brute_components([(None if r[0] else r[1], t) for t, r in once.items()])
    assert sum(left.values()) == len(groups)
    assert Counter(rank(r) for r in left.elements()) == Counter(min(map(rank, g)) for g in groups)
    mixed = mixing.repeat_rows(docs)
    want = Counter(tuple(r) for r in packing.pack(mixed).collect())
    assert want and Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_repeats_with_one_id_on_two_texts(spark):
    twice, alone = text_of(80, "t"), text_of(80, "u")
    rows = [(1, twice), (2, twice), (2, alone), (3, "x " + alone)]
    out = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in repeats.find_repeats(frame(spark, rows)).collect()}
    assert out[2, len(alone)] == len(alone) and out[3, len(alone) + 2] == len(alone)


def test_registered_simhash_query(spark, tmp_path):
    rows = list({i: (i, t) for i, t in some_rows() if i is not None}.values())
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op6_simhash(spark, str(tmp_path)).collect()}
    prints = {i: simhash.fingerprint(t or "") for i, t in rows}
    least = dict(zip(prints, prints, strict=True))
    for _ in prints:
        now = {i: min(least[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if now == least:
            break
        least = now
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in out.items()} == {i: (f"{prints[i]:016x}", least[i]) for i in prints}


def test_fingerprints_propose_pairs_and_sets_decide(spark):
    """Without any band key in common, near copies that SimHash joins are linked, others with a near fingerprint are not."""
    a = text_of(400)
    texts = [a, edited(a, 399), edited(a, 0), text_of(400), text_of(300)]
    sets = [jaccard.shingle_set(t) for t in texts]
    prints = [simhash.fingerprint_of([x]) for x in sets]
    assert all((prints[0] ^ prints[i]).bit_count() <= simhash.DISTANCE for i in (1, 2))
    prints[4] = prints[0]  # as if unlike texts met in a fingerprint
    rows = [(i, len(x), fp - (1 << 64) if fp >> 63 else fp, [], jaccard.minima(x).astype(np.uint8).tobytes(), x.tobytes()) for i, (x, fp) in enumerate(zip(sets, prints, strict=True))]
    nodes = spark.createDataFrame(rows, "node long, n int, fp long, keys array<long>, sketch binary, hashes binary")
    assert {(r["node"], r["root"]) for r in jaccard.link_sets(nodes, nodes.select("node", "hashes")).collect()} == {(0, 0), (1, 0), (2, 0)}


def test_a_worker_keeps_one_thing_at_a_time():
    one = shared.kept("one", dict)
    assert shared.kept("one", dict) is one
    shared.kept("two", dict)
    assert shared.kept("one", dict) is not one
