"""Removal of long repeated byte strings, with run-length Burrows-Wheeler indexes over the repetitive part of a corpus.

Every start of a `length`-byte window is dealt to a place by content alone: by the smallest hash of the k-byte strings in
the window and by how far it lies from the start, so equal windows meet wherever they stand. Neighbouring starts of one
place form a segment. Segments whose common core was met once in the corpus hold no repeated window and go; equal ones are
counted before they are shuffled. All others are indexed in shards that hold all segments of a core: the transform of a
shard's segments is compressed to runs, with samples at the runs' ends of what the suffixes before them share with their
neighbours. Matching statistics are streamed from each segment's end to its start by steps through the runs alone: inside a run
the match grows by the byte, at a run's end the sample takes over. Starts with a statistic of `length` or more are
repeated; their windows are joined to spans of the documents. Cores with more segments than a shard holds are cut
into single windows first, so that no core makes a shard of its own size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact import drop_keyed
from .shared import BROADCAST_KEYS, bounded, save, small_batches, text_or_empty

LENGTH = 200
#: Bytes hashed at a place (a multiple of 8), and starts of one place in a segment at most.
GRAM, CLASS = 40, 81
#: Places of cores met more often than this are split into segments of fewer starts, with a longer common core.
HOT, HOT_CLASS = 64, 8
#: Bytes of segments in an index, and of texts that are hashed at once.
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 1 << 20
#: Runs that a step walks over before the run of its row is searched for.
WALK = 4

_STEPS = np.random.default_rng(9).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _words(data: bytes) -> np.ndarray:
    """The 8 bytes from each position on as one number; positions past the end read zeros."""
    padded = data + bytes(16)
    out = np.empty(len(data), np.uint64)
    for r in range(min(8, len(data))):
        n = (len(data) - r + 7) // 8
        out[r::8] = np.frombuffer(padded, "<u8", n, r)
    return out


def _core_keys(words: np.ndarray, at: np.ndarray, size: int, kind: np.ndarray) -> np.ndarray:
    """Hashes of the whole 8-byte words in the first `size` bytes from each place on."""
    total = _mixed(kind.astype(np.uint64) + np.uint64(size))
    for j in range(size // 8):
        total = total * np.uint64(31) + _mixed(words[at + 8 * j] * _STEPS[j])
    return _mixed(total)


def segments(data: bytes, ends: np.ndarray, class_size: int = CLASS, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, last start, core key) of the segments of joined documents, given where each ends.

    Each start of a window within a document lies in one segment; equal windows lie in segments with the same key.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64)
    words, width = _words(data), length - GRAM + 1
    n = len(data) - GRAM + 1
    key = np.zeros(n, np.uint64)
    for j in range(0, GRAM, 8):
        key += words[j : j + n] * _STEPS[j // 8]
    key = (_mixed(key) & ~np.uint64((1 << 28) - 1)) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    grid = np.full(rows * width, ~np.uint64(0))
    grid[:n] = key
    grid = grid.reshape(rows, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(data) - length + 1
    least = (np.minimum(after[:starts], before[width - 1 : width - 1 + starts]) & np.uint64((1 << 28) - 1)).astype(np.int64)
    s = np.arange(starts)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:starts]
    inside = s + length <= ends[doc]
    kind = (least - s) // class_size
    new = np.ones(starts, bool)
    new[1:] = (least[1:] != least[:-1]) | (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], starts) - 1
    # windows that run past a document's end are its last starts: cut them off
    last = np.minimum(last, ends[doc[first]] - length)
    ok = inside[first] & (last >= first)
    first, last = first[ok], last[ok]
    where, kind = least[first], kind[first]
    return doc[first], first, last, _core_keys(words, where - class_size * kind, length - class_size + 1, kind)


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix) of bytes, by doubling: the first sort is on 5 bytes, each later one on twice as many as before.

    Two ranks and the place are sorted as one number while they fit into 63 bits, which is several times as fast as sorting places by ranks.
    """
    n = len(text)
    bits = max(n, 1).bit_length()
    place = np.arange(n, dtype=np.int64)

    def ordered(code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width + bits > 63:
            order = np.argsort(code)
            return order, code[order]
        packed = np.sort((code << bits) | place)
        return packed & ((1 << bits) - 1), packed >> bits

    code = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(5, np.uint8)]).astype(np.int64)
    for j in range(5):
        code = (code << 8) | padded[j : j + n]
    order, sorted_ = ordered(code, 40)
    rank, depth = np.empty(n, np.int64), 5
    rank[order] = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1])) + 1
    while n and rank.max() < n and depth < n:
        code = rank << bits
        code[: n - depth] |= rank[depth:]
        order, sorted_ = ordered(code, 2 * bits)
        rank[order] = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1])) + 1
        depth *= 2
    if n and rank.max() < n:  # suffixes that differ in nothing but their end
        order = np.lexsort((-place, rank))
        rank[order] = place + 1
    order = np.empty(n, np.int64)
    order[rank - 1] = place
    return order, rank - 1


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and b share, up to the end of the text."""
    n = len(words)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        p, q = a[live] + out[live], b[live] + out[live]
        ok = np.maximum(p, q) < n
        live, p, q = live[ok], p[ok], q[ok]
        differ = words[p] ^ words[q]
        same = differ == 0
        low = differ & (~differ + np.uint64(1))
        out[live] += np.where(same, 8, np.log2(np.where(same, 1, low).astype(np.float64)).astype(np.int64) // 8)
        live = live[same]
    return np.minimum(out, n - np.maximum(a, b))


class RunLengthIndex:
    """A run-compressed transform of a text, with samples at the ends of runs; statistics are streamed through the runs.

    heads, letters: first row and letter of each run. jump: what a step to the letter before adds to a row of the run; target: the run
    that the first row's step leads to, so that steps go from run to run without a search.
    above, below: what the suffix that such a step from the run's first (last) row leads to shares with the one above (below).
    """

    def __init__(self, text: bytes, ends: np.ndarray):
        data = np.frombuffer(text, np.uint8)
        n = self.n = len(data)
        order, rank = suffix_order(data)
        last = data[order - 1].astype(np.int16)
        last[order == 0] = 256  # nothing stands before the text: a run by itself
        self.heads = np.flatnonzero(np.append(True, last[1:] != last[:-1])[:n])
        self.letters = last[self.heads]
        self.tails = np.append(self.heads[1:], n)[: len(self.heads)] - 1
        size = self.tails - self.heads + 1
        begin = np.concatenate([[0], np.cumsum(np.bincount(data, minlength=257))])[:257]
        if n:
            begin[data[-1]] += 1  # the suffix of the last letter alone comes first among its letter's, and no row leads to it
        by_letter = np.argsort(self.letters, kind="stable")
        before = np.cumsum(size[by_letter]) - size[by_letter]
        first = np.searchsorted(self.letters[by_letter], self.letters[by_letter])
        reached = np.empty(len(self.heads), np.int64)
        reached[by_letter] = begin[self.letters[by_letter]] + before - before[first]
        self.jump = reached - self.heads
        self.target = np.empty(len(self.heads), np.int64)
        self.target[by_letter] = np.searchsorted(self.heads, reached[by_letter], "right") - 1  # in order: rows ascend from letter to letter
        words = _words(text)
        self.above, self.below = (self._shared(words, order, rows + self.jump, side) for rows, side in ((self.heads, -1), (self.tails, 1)))
        self.ends, self.rows = ends, rank[ends]
        self.at_ends = [self._shared(words, order, self.rows, side) for side in (-1, 1)]

    def _shared(self, words: np.ndarray, order: np.ndarray, rows: np.ndarray, side: int) -> np.ndarray:
        out, other = np.zeros(len(rows), np.int64), rows + side
        ok = (rows < self.n) & (other >= 0) & (other < self.n)
        out[ok] = common_prefix(words, order[rows[ok]], order[other[ok]])
        return out

    def _run(self, row: np.ndarray, run: np.ndarray) -> np.ndarray:
        """The run of each row, walked to from a run at or before it; rows that lie further are searched for."""
        live = np.flatnonzero(row > self.tails[run])
        for _ in range(WALK):
            if not len(live):
                return run
            run[live] += 1
            live = live[row[live] > self.tails[run[live]]]
        run[live] = np.searchsorted(self.heads, row[live], "right") - 1
        return run

    def statistics(self) -> np.ndarray:
        """For each position the longest prefix of its suffix that starts elsewhere as well; 0 after the last of the ends.

        Streams go from each end to the one before it, side by side, a letter a step.
        """
        out = np.zeros(self.n, np.int64)
        lengths = np.diff(np.concatenate([[-1], self.ends])) - 1
        lane = np.argsort(-lengths, kind="stable")
        at, row, lengths = self.ends[lane], self.rows[lane], lengths[lane]
        above, below = (x[lane] for x in self.at_ends)
        out[at] = np.maximum(above, below)
        run = np.searchsorted(self.heads, row, "right") - 1
        for step in range(1, int(lengths[0]) + 1 if len(lane) else 0):
            live = int(np.searchsorted(-lengths, -step, "right"))
            row, above, below, run = row[:live], above[:live], below[:live], run[:live]
            above = np.where(row == self.heads[run], self.above[run], above + 1)
            below = np.where(row == self.tails[run], self.below[run], below + 1)
            row = row + self.jump[run]
            run = self._run(row, self.target[run])
            out[at[:live] - step] = np.maximum(above, below)
        return out


def repeated_spans(parts: list[bytes], counts: list[int], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(part, from, to) of the bytes of distinct parts that are covered by windows met more than once; a part with a count over 1 is in the index twice."""
    held = parts + [p for p, n in zip(parts, counts, strict=True) if n > 1]
    text = b"\xff".join(held) + b"\xff"  # no UTF-8 text holds this byte
    ends = np.cumsum([len(p) + 1 for p in held]) - 1
    firsts = np.concatenate([[0], ends[:-1] + 1])
    found = RunLengthIndex(text, ends).statistics()
    part = np.repeat(np.arange(len(held)), ends + 1 - firsts)
    again = (np.minimum(found, ends[part] - np.arange(len(text))) >= length) & (part < len(parts))
    new = again.copy()
    new[1:] &= ~again[:-1] | (part[1:] != part[:-1])
    old = again.copy()
    old[:-1] &= ~again[1:] | (part[1:] != part[:-1])
    first, last = np.flatnonzero(new), np.flatnonzero(old)
    at = firsts[part[first]]
    return list(zip(part[first].tolist(), (first - at).tolist(), (last - at + length).tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Joined texts of about a block, with (text, offset in it) for each; long texts come in overlapping pieces that share no start."""
    held, places, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), BLOCK_BYTES):
            piece = text[at : at + BLOCK_BYTES + LENGTH - 1]
            held.append(piece)
            places.append((i, at))
            size += len(piece)
            if size >= BLOCK_BYTES:
                yield b"".join(held), places, np.cumsum([len(x) for x in held])
                held, places, size = [], [], 0
    if held:
        yield b"".join(held), places, np.cumsum([len(x) for x in held])


def _found(texts: list[bytes], class_size: int = CLASS) -> Iterator[tuple[int, int, int, int]]:
    """(text, first start, last start, key as a signed number) of all segments."""
    for data, places, ends in _blocks(texts):
        doc, first, last, key = segments(data, ends, class_size)
        begin = np.concatenate([[0], ends[:-1]])
        shift = np.array([at for _, at in places]) - begin
        which = np.array([i for i, _ in places])
        yield from zip(which[doc].tolist(), (first + shift[doc]).tolist(), (last + shift[doc]).tolist(), key.view(np.int64).tolist(), strict=True)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha, keys of each text's segments, in order."""
    for batch in batches:
        keys: list[list[int]] = [[] for _ in range(batch.num_rows)]
        for i, _, _, key in _found([x.encode() for x in batch.column(1).to_pylist()]):
            keys[i].append(key)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["sha", "keys"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of texts that have a key met before: sha, at, key, h1, h2, part."""
    for batch in batches:
        shas, texts = batch.column(0).to_pylist(), [x.encode() for x in batch.column(1).to_pylist()]
        again, hot = ([set(x or ()) for x in batch.column(i).to_pylist()] for i in (2, 3))
        held: tuple[list, ...] = ([], [], [], [], [], [])
        size = 0

        def add(i: int, a: int, b: int, key: int) -> int:
            part = texts[i][a : b + LENGTH]
            name = xxhash.xxh3_128_digest(part)
            for column, x in zip(held, (shas[i], a, key, int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True), part), strict=True):
                column.append(x)
            return len(part)

        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        table = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(held, kinds, strict=True)], names=["sha", "at", "key", "h1", "h2", "part"])
        spread: dict[int, list[tuple[int, int]]] = {}
        for i, a, b, key in _found(texts):
            if key in hot[i]:
                spread.setdefault(i, []).append((a, b))
            elif key in again[i]:
                size += add(i, a, b, key)
        for i, ranges in spread.items():  # the same starts, in segments of fewer
            text = texts[i]
            for a, b in merged([(a, b + 1) for a, b in ranges]):
                for _, x, y, key in _found([text[a : b - 1 + LENGTH]], HOT_CLASS):
                    size += add(i, a + x, a + y, key)
                    if size > 8 << 20:
                        yield table()
                        held, size = ([], [], [], [], [], []), 0
        if held[0]:
            yield table()


def _indexed(rows: pa.Table) -> pa.Table:
    parts, counts = rows["part"].to_pylist(), rows["n"].to_pylist()
    spans = repeated_spans(parts, counts)
    h1, h2 = rows["h1"].to_pylist(), rows["h2"].to_pylist()
    return pa.table({"h1": pa.array([h1[i] for i, _, _ in spans], pa.int64()), "h2": pa.array([h2[i] for i, _, _ in spans], pa.int64()), "lo": pa.array([a for _, a, _ in spans], pa.int64()), "hi": pa.array([b for _, _, b in spans], pa.int64())})


def _spans(parts: DataFrame) -> DataFrame:
    """Spans (h1, h2, lo, hi) of parts(key, h1, h2, part, n) by indexes over shards that hold whole keys."""
    shards = max(1, -(-(parts.agg(F.sum(F.octet_length("part"))).first()[0] or 0) // SHARD_BYTES))
    return parts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(_indexed, "h1 long, h2 long, lo long, hi long")


def _spans_of_wide(parts: DataFrame) -> DataFrame:
    """The same for parts of cores that are larger than a shard, window by window: equal windows are counted before they are indexed."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("part") - LENGTH)).alias("lo")
    windows = parts.select("h1", "h2", "n", "part", at).withColumn("window", F.expr(f"substring(part, lo + 1, {LENGTH})")).drop("part")
    windows = save(windows.withColumn("w1", F.xxhash64("window")).withColumn("w2", F.xxhash64(F.lit(9), "window")), "repeat-windows")
    kinds = save(windows.groupBy("window", "w1", "w2").agg(F.sum("n").alias("n")).filter("n > 1"), "repeat-kinds")
    found = save(_spans(kinds.select(F.col("w1").alias("key"), F.col("w1").alias("h1"), F.col("w2").alias("h2"), F.col("window").alias("part"), "n")), "repeat-wide")
    met = windows.select("h1", "h2", "lo", "w1", "w2").join(bounded(found.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"))), ["w1", "w2"])
    return met.select("h1", "h2", F.col("lo").cast("long").alias("lo"), (F.col("lo") + LENGTH).cast("long").alias("hi"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha, n_removed, n_spans, kept_sha256 and the spans of texts with repeated windows."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data, at, hashed = text.encode(), 0, hashlib.sha256()
            spans = merged([(x["lo"], x["hi"]) for x in spans])
            for a, b in spans:
                hashed.update(data[at:a])
                at = b
            hashed.update(data[at:])
            for column, x in zip(out, (sum(b - a for a, b in spans), len(spans), hashed.hexdigest(), [v for s in spans for v in s]), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True))], names=["sha", "n_removed", "n_spans", "kept_sha256", "spans"])


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (from, to, from, to, ... of the removed bytes).

    Removed is each byte covered by a LENGTH-byte string that starts anywhere else too, in the same text or another;
    matches do not cross texts. Texts are taken as UTF-8; a null text is empty. Rows with equal texts of
    LENGTH bytes or more lose all of them, also where they repeat a doc_id; equal texts are looked at once. A null doc_id
    stays null; an empty table gives an empty result; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    short = F.xxhash64("sha").alias("rid")  # should two texts share it, each looks at the other's keys as well
    named = rows.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    base = save(named.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "repeat-rows")
    groups = base.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    copied = save(groups.filter("copies > 1"), "repeat-copies")
    others = base.join(bounded(copied), "sha").filter("not (doc_id <=> first)").select("doc_id", F.col("sha").alias("digest"))
    once = drop_keyed(named.filter(F.octet_length("text") >= LENGTH), save(others.distinct(), "repeat-others"), F.col("sha")).select("sha", "text")
    places = save(once.mapInArrow(_arrays, "sha binary, keys array<long>"), "repeat-places")
    met = save(places.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1"), "repeat-keys")
    listed = places.select(short, F.explode("keys").alias("key")).join(met, "key").groupBy("rid").agg(F.collect_set("key").alias("again"), F.collect_set(F.when(F.col("count") > HOT, F.col("key"))).alias("hot"))
    listed = save(listed, "repeat-listed")
    once = once.select("sha", "text", short)
    held = save(once.join(bounded(listed.select("rid")), "rid", "left_semi"), "repeat-texts")
    cut = held.join(listed, "rid").select("sha", "text", "again", "hot").mapInArrow(_cut, "sha binary, at long, key long, h1 long, h2 long, part binary")
    cut = save(cut, "repeat-cut")
    parts = save(cut.groupBy("key", "h1", "h2", "part").agg(F.count(F.lit(1)).alias("n")), "repeat-parts")
    # a segment's own windows differ from each other, as they lie at different distances from its place
    cores = parts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("met"), F.sum(F.octet_length("part")).alias("bytes"))
    live = save(cores.filter("met > 1").select("key", (F.col("bytes") > SHARD_BYTES).alias("wide")), "repeat-cores")
    parts = save(parts.join(bounded(live, BROADCAST_KEYS), "key"), "repeat-indexed")
    spans = save(_spans(parts.filter("not wide").select("key", "h1", "h2", "part", "n")).unionByName(_spans_of_wide(parts.filter("wide"))), "repeat-spans")
    marks = cut.select("sha", "at", "h1", "h2").join(bounded(spans), ["h1", "h2"]).select("sha", F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")).alias("span"))
    marks = marks.groupBy("sha").agg(F.collect_set("span").alias("marks"))
    left = held.dropDuplicates(["sha"]).join(marks, "sha").select("sha", "text", "marks").mapInArrow(_kept, "sha binary, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    left = save(left, "repeat-left")
    out = base.join(bounded(copied.select("sha", F.lit(True).alias("whole"))), "sha", "left").join(bounded(left), "sha", "left")
    whole = F.col("whole").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(whole, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
    )
