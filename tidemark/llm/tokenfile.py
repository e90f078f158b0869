"""Token ids in files: documents compressed one by one with a shared zstandard dictionary.

A folder holds the dictionary, trained on the serialized ids of a bounded sample, and one file per range of doc_ids:
    header   magic, bytes per id, hash of the dictionary
    frames   one zstandard frame per document, in ascending order of doc_id
    index    doc_id, end of frame, number of ids: three arrays, one entry per document
    footer   documents, place of the index, magic
A document is read by its index entry alone. Files are named by the task that wrote them and count only if the
manifest of finished tasks lists them, so a task that is run again leaves no trace in the result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import open_fs, save, small_batches, text_or_empty, work_path
from .tokens import WordEncoder, default_file, encoder

MAGIC = b"TIDETOK1"
HEADER, FOOTER = struct.Struct("<8sIQ"), struct.Struct("<QQ8s")
VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Documents sampled for the dictionary, and its largest size in bytes.
SAMPLE_DOCS = 500
DICTIONARY_BYTES = 64 << 10
LEVEL = 1


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary, or none (empty) where there is too little to learn from."""
    if sum(map(len, samples)) < 8 * size:
        size = sum(map(len, samples)) // 8
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if size >= 1024 and len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


class TokenWriter:
    """Writes one file. add() takes documents in ascending order; close() writes the index."""

    def __init__(self, stream, dictionary: bytes, width: int):
        self.stream, self.kind = stream, np.dtype(f"<u{width}")
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=LEVEL)  # else each document would digest it again
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        self.stream.write(HEADER.pack(MAGIC, width, dictionary_hash(dictionary)))
        self.at, self.ids, self.ends, self.sizes = HEADER.size, [], [], []

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        frame = self.packer.compress(tokens.astype(self.kind).tobytes())
        self.stream.write(frame)
        self.at += len(frame)
        self.ids.append(-(1 << 63) if doc_id is None else doc_id)
        self.ends.append(self.at)
        self.sizes.append(len(tokens))

    def close(self) -> None:
        for column, kind in ((self.ids, "<i8"), (self.ends, "<u8"), (self.sizes, "<u8")):
            self.stream.write(np.array(column, kind).tobytes())
        self.stream.write(FOOTER.pack(len(self.ids), self.at, MAGIC))
        self.stream.close()


class TokenReader:
    """Reads one file: document i, or all in order."""

    def __init__(self, source, dictionary: bytes):
        self.source = source
        magic, self.width, known = HEADER.unpack(self._at(0, HEADER.size))
        n, at, last = FOOTER.unpack(self._at(source.size() - FOOTER.size, FOOTER.size))
        if magic != MAGIC or last != MAGIC:
            raise ValueError("not a token file")
        if known != dictionary_hash(dictionary):
            raise ValueError("the dictionary is not the one that the file was written with")
        index = self._at(at, 24 * n)
        self.ids, self.ends, self.sizes = (np.frombuffer(index, kind, n, 8 * n * i) for i, kind in enumerate(("<i8", "<u8", "<u8")))
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def __len__(self) -> int:
        return len(self.ids)

    def read(self, i: int) -> np.ndarray:
        start = int(self.ends[i - 1]) if i else HEADER.size
        data = self.unpacker.decompress(self._at(start, int(self.ends[i]) - start), max_output_size=int(self.sizes[i]) * self.width or 1)
        return np.frombuffer(data, f"<u{self.width}")


def _sample(docs: DataFrame, n: int) -> list[str]:
    """Texts of the n documents whose ids come first in a seeded hash order."""
    ids = [r[0] for r in docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    return [r["text"] for r in docs.filter(F.col("doc_id").isin(ids)).limit(2 * n).collect()] if ids else []


def write_tokens(docs: DataFrame, folder: str, vocabulary_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every whole text to files in a shared folder; returns the manifest, one row per file: name, first_id, last_id, docs, tokens.

    A null text is the empty text: its ids are the end id alone. Documents stand in ascending order of doc_id, a null
    id first, rows that repeat an id next to each other in some order. An empty table gives no file. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    file = vocabulary_file or default_file(VOCABULARY)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    enc = encoder(file, WordEncoder)
    width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
    kind = np.dtype(f"<u{width}")
    dictionary = train_dictionary([np.frombuffer(x, "<u4").astype(kind).tobytes() for x in enc.encode(_sample(rows, SAMPLE_DOCS)) if x])
    store, path = open_fs(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/dictionary") as out:
        out.write(dictionary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, name, end = encoder(file, WordEncoder), None, f"tokens-{uuid.uuid4().hex}", np.array([END_ID], "<u4")
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    own_store, own_path = open_fs(folder)
                    writer = TokenWriter(own_store.open_output_stream(f"{own_path}/{name}"), dictionary, width)
                writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "first_id": pa.array([writer.ids[0]], pa.int64()), "last_id": pa.array([writer.ids[-1]], pa.int64()), "docs": pa.array([len(writer.ids)], pa.int64()), "tokens": pa.array([sum(writer.sizes)], pa.int64())})

    # rows that repeat an id, however many, are dealt to several files by their text
    ordered = rows.withColumn("_salt", F.xxhash64("text")).repartitionByRange("doc_id", "_salt").sortWithinPartitions("doc_id", "_salt").drop("_salt")
    return save(ordered.mapInArrow(work, "name string, first_id long, last_id long, docs long, tokens long"), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads the manifest's files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    spark: SparkSession = manifest.sparkSession
    listed = sorted((r["first_id"], r["last_id"], r["name"], r["tokens"]) for r in manifest.collect())  # one row per file
    starts = np.concatenate([[0], np.cumsum([x[3] for x in listed], dtype=np.int64)])
    parts = [(x[2], int(start)) for x, start in zip(listed, starts, strict=False)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_fs(folder)
        with store.open_input_file(f"{path}/dictionary") as f:
            dictionary = f.read()
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{path}/{name}") as f:
                    reader, held, size = TokenReader(f, dictionary), ([], [], [], []), 0
                    for i in range(len(reader)):
                        ids = reader.read(i).astype("<u4")
                        doc_id = int(reader.ids[i])
                        for column, x in zip(held, (None if doc_id == -(1 << 63) else doc_id, start, len(ids), ids.tobytes()), strict=True):
                            column.append(x)
                        start, size = start + len(ids), size + 4 * len(ids)
                        if size > 8 << 20 or i == len(reader) - 1:
                            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in held[:3]), pa.array(held[3], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                            held, size = ([], [], [], []), 0

    files = spark.createDataFrame(parts, "name string, start long")
    return files.repartition(max(1, len(parts))).mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")


def token_table(docs: DataFrame) -> DataFrame:
    """The ids of all documents, written to files and read back."""
    folder = work_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder), folder)
