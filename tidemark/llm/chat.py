"""Chat formatting: token-level assembly of conversations with a loss mask.

A conversation is `<s>`, then for each turn `[INST]` role newline text `[/INST]`, then `</s>`. The four control strings are
reserved ids beyond the vocabulary, spliced between segments that are encoded by themselves; the same strings in a
role or text get a backslash after their first character (one more, if backslashes already stand there), so no content can pass for control,
and the reader takes it away again. The mask covers the texts of assistant turns; it follows from prefix sums of
the segments' lengths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save, small_batches
from .tokens import default_file, encoder

VOCABULARY = "byte_bpe_50k.json"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
LEARNED_ROLE = "assistant"

_STRING = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])")
_ESCAPED = re.compile(r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\])")


def escape(text: str) -> str:
    return _STRING.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[4]) + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def escape_role(role: str) -> str:
    """As escape; a newline, which ends the role, and the backslash are spelled out first."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(turns: list[tuple[str, bytes, bytes]], first_control: int, opens: bool, closes: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of consecutive turns (role, ids of role and newline, ids of text), with the conversation's marks at its ends."""
    begin, end, left, right = (np.array([first_control + i], np.uint32) for i in range(4))
    segments, learned = [], []
    for role, head, text in turns:
        segments += [left, np.frombuffer(head, "<u4"), np.frombuffer(text, "<u4"), right]
        learned += [0, 0, int(role == LEARNED_ROLE), 0]
    segments, learned = [begin] * opens + segments + [end] * closes, [0] * opens + learned + [0] * closes
    ends = np.cumsum([len(x) for x in segments])
    change = np.zeros(int(ends[-1]) + 1, np.int64)
    np.add.at(change, ends - [len(x) for x in segments], learned)
    np.add.at(change, ends, -np.array(learned))
    return np.concatenate(segments), np.cumsum(change)[:-1].astype(np.uint8)


def format_turns(conversations: DataFrame, vocabulary_file: str | None = None) -> DataFrame:
    """conv_id, turn_no, ids (little-endian unsigned 32-bit), loss_mask (one byte per id): one row per turn, a conversation's rows joined in order are its sequence.

    Turns stand in the order of turn, nulls first, ties by role and text; each row is a turn, repeated rows too. A null role
    or text is empty. Rows with a null conv_id are one conversation. Other columns are not looked at. An empty table gives no row.
    Texts are encoded before the rows are ordered; a conversation's turns pass through its task one by one.
    """
    small_batches(conversations.sparkSession)
    file = vocabulary_file or default_file(VOCABULARY)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            heads = enc.encode_plain([escape_role(x) + "\n" for x in roles])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary()), pa.array(enc.encode_plain([escape(x) for x in texts]), pa.binary())], names=["conv_id", "turn", "role", "text", "head_ids", "text_ids"])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        control = encoder(file).size
        waiting = None  # a turn whose successor is not known yet
        number = 0

        def row(turn: tuple, closes: bool) -> tuple:
            ids, mask = assemble([turn[1:]], control, number == 0, closes)
            return turn[0], number, ids.tobytes(), mask.tobytes()

        def table(rows: list[tuple]) -> pa.RecordBatch:
            a, b, c, d = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.binary())], names=["conv_id", "turn_no", "ids", "loss_mask"])

        for batch in batches:
            out = []
            for turn in zip(*(batch.column(i).to_pylist() for i in (0, 2, 4, 5)), strict=True):
                if waiting is not None:
                    same = waiting[0] == turn[0]
                    out.append(row(waiting, not same))
                    number = number + 1 if same else 0
                waiting = turn
            if out:
                yield table(out)
        if waiting is not None:
            yield table([row(waiting, True)])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kinds = "conv_id long, turn long, role string, text string, head_ids binary, text_ids binary"
    ordered = rows.mapInArrow(encoded, kinds).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(assembled, "conv_id long, turn_no long, ids binary, loss_mask binary")


def read_turns(formatted: DataFrame, vocabulary_file: str | None = None) -> DataFrame:
    """What formatted rows say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Roles and texts are parsed from the ids and unescaped; the loss figures are of the text under the mask.
    """
    file = vocabulary_file or default_file(VOCABULARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        table, control = enc.table, enc.size
        marks = [x.encode() for x in CONTROLS]
        spell = lambda ids: b"".join([table[i] for i in ids]).decode()
        done: list[tuple] = []
        now = None

        def finish(state: dict) -> tuple:
            return state["conv_id"], state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]

        for batch in batches:
            for conv_id, number, ids, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, mask = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8).astype(bool)
                if number == 0:
                    if now:
                        done.append(finish(now))
                    now = {"conv_id": conv_id, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                left, right = int(np.flatnonzero(ids == control + 2)[0]), int(np.flatnonzero(ids == control + 3)[0])
                role, _, text = spell(ids[left + 1 : right].tolist()).partition("\n")
                loss = unescape(spell(ids[mask].tolist()))
                now["turns"] += 1
                now["all"].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                now["loss"].update(loss.encode())
                now["loss_chars"] += len(loss)
                now["chars"] += len(b"".join([table[i] if i < control else marks[i - control] for i in ids.tolist()]).decode())
            if len(done) >= 1000:
                yield _digests(done)
                done = []
        if now:
            done.append(finish(now))
        if done:
            yield _digests(done)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return ordered.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def format_and_read(conversations: DataFrame) -> DataFrame:
    return read_turns(save(format_turns(conversations), "chat-formatted"))
