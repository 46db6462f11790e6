"""Chat formatting by columnar byte assembly.

Template: every turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and
roles each ``<``, any backslashes, ``|`` gains one backslash before the bar, so no control
string can occur in them and taking one backslash away gives the text back. Backslashes
and newlines of roles are written ``\\\\`` and ``\\n`` first.

Turns are dealt by (conversation, block of ``BLOCK`` turns) and sorted; each Arrow batch is
formatted at once: segment lengths, their cumulative offsets and the scatter index of every
text byte are computed in numpy, and headers, texts and ends are copied into one buffer
that becomes the output column. A conversation of any length is many rows (chunks) of
bounded size in order of (block, seq); a usual one is one row.

The loss mask is a list of spans (code points) over the chunk: the texts of ``assistant``
turns. :func:`read_back` parses the written chunks; its hashes of a whole conversation are
sequential by definition, so there one conversation is read as a stream by one task.

Defined cases: null role and null text are empty; turns are ordered by turn, role, text,
nulls first, so repeated turns have one order; a null conversation id is a conversation of
its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, slices

START, END = b"<|im_start|>", b"<|im_end|>"
BLOCK = 1024
CHUNK_BYTES = 4 << 20
_BACKSLASH, _BAR, _LESS = 92, 124, 60


def escape_text(x: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", x)


def unescape_text(x: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", x)


def escape_role(x: str) -> str:
    return escape_text(x.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(x: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape_text(x))


def parse(chunk: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted chunk."""
    start, end = START.decode(), END.decode()
    out = []
    for part in chunk.split(start)[1:]:
        role, _, text = part.partition("\n")
        out.append((unescape_role(role), unescape_text(text.removesuffix(end + "\n"))))
    return out


def _bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column without nulls."""
    a = pc.fill_null(a, "").cast(pa.large_string())
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def _bars_to_escape(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places of bars that follow ``<`` and any backslashes inside the same text."""
    bars = np.flatnonzero(data == _BAR)
    if not len(bars):
        return bars
    last = np.maximum.accumulate(np.where(data != _BACKSLASH, np.arange(len(data)), -1))
    before = np.where(bars > 0, last[np.maximum(bars - 1, 0)], -1)
    row = np.searchsorted(offs, bars, side="right") - 1
    return bars[(before >= offs[row]) & (data[np.maximum(before, 0)] == _LESS)]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all formatted turns: (buffer, turn offsets, and per turn the byte
    place and length of its escaped text)."""
    n = len(texts)
    data, offs = _bytes_of(texts)
    lens = np.diff(offs)
    bars = _bars_to_escape(data, offs)
    extra = np.bincount(np.searchsorted(offs, bars, side="right") - 1, minlength=n) if len(bars) else np.zeros(n, np.int64)
    enc = pc.fill_null(roles, "").dictionary_encode()
    heads = [START + escape_role(r).encode() + b"\n" for r in enc.dictionary.to_pylist()]
    code = enc.indices.to_numpy()
    head_len = np.fromiter(map(len, heads), np.int64, len(heads))[code]
    tail = np.frombuffer(END + b"\n", np.uint8)
    size = head_len + lens + extra + len(tail)
    ends = np.cumsum(size)
    begin = ends - size
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    body = begin + head_len
    grown = np.zeros(len(data), np.int64)  # backslashes up to each byte
    grown[bars] = 1
    grown = np.cumsum(grown)
    before = np.concatenate(([0], np.cumsum(extra)))[:-1]
    place = np.arange(len(data)) + np.repeat(body - offs[:-1] - before, lens) + grown
    out[place] = data
    out[place[bars] - 1] = _BACKSLASH
    for k, h in enumerate(heads):
        rows = begin[code == k]
        out[rows[:, None] + np.arange(len(h))] = np.frombuffer(h, np.uint8)
    out[(ends - len(tail))[:, None] + np.arange(len(tail))] = tail
    return out, np.concatenate(([0], ends)), body, lens + extra


def _chunks(batch: pa.RecordBatch, starts: np.ndarray, seqs: np.ndarray) -> pa.RecordBatch:
    """Chunk rows of a batch of sorted turns; ``starts``: first turn of every chunk."""
    out, offs, body, body_len = assemble(batch.column(2), batch.column(3))
    chars = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    bounds = np.append(starts, batch.num_rows)
    loss = np.flatnonzero(pc.fill_null(pc.equal(batch.column(2), "assistant"), False).to_numpy(zero_copy_only=False))
    owner = np.searchsorted(bounds, loss, side="right") - 1
    span0 = chars[body[loss]] - chars[offs[bounds[owner]]]
    span_n = chars[body[loss] + body_len[loss]] - chars[body[loss]]
    per = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(starts))))).astype(np.int32)
    text = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offs[bounds].astype(np.int32)), pa.py_buffer(out))
    spans = lambda v: pa.ListArray.from_arrays(pa.array(per), pa.array(v.astype(np.int64)))
    first = pa.array(starts)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(first), batch.column(1).take(first), pa.array(seqs, pa.int32()),
         pa.array(np.diff(bounds), pa.int64()), text, spans(span0), spans(span_n)],
        names=["conv_id", "block", "seq", "n_turns", "formatted", "loss_start", "loss_len"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, key, seq = None, None, 0

    def flush(b: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal key, seq
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        new = np.fromiter((i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))), bool, len(keys))
        starts = np.flatnonzero(new)
        seqs = np.zeros(len(starts), np.int64)
        if keys[0] == key:
            seqs[0] = seq + 1
        key, seq = keys[-1], int(seqs[-1])
        return _chunks(b, starts, seqs)

    for b in slices(batches, CHUNK_BYTES):
        if held is not None:
            b = pa.concat_batches([held, b])
            held = None
        ids, blocks = b.column(0).to_pylist(), b.column(1).to_pylist()
        last = b.num_rows - 1
        while last > 0 and (ids[last - 1], blocks[last - 1]) == (ids[-1], blocks[-1]):
            last -= 1
        if b.slice(last).nbytes < CHUNK_BYTES:  # its end may come with the next batch
            held = b.slice(last)
            if last:
                yield flush(b.slice(0, last))
        else:
            yield flush(b)
    if held is not None and held.num_rows:
        yield flush(held)


def format_chat(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """``(conv_id, block, seq, n_turns, formatted, loss_start, loss_len)`` chunks."""
    rows = turns.select(col(id_col).alias("conv_id"), F.floor(col(turn_col) / BLOCK).cast("long").alias("block"),
                        col(role_col).alias("role"), col(text_col).alias("text"), col(turn_col).alias("turn"))
    rows = (rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
            .select("conv_id", "block", "role", "text"))
    kind = turns.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_format, f"conv_id {kind}, block long, seq int, n_turns long, formatted string, "
                           "loss_start array<long>, loss_len array<long>")


def read_back(chunks: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        now, state, done = None, None, []

        def close():
            if state is not None:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def out():
            arrow = pa.schema([("conv_id", conv_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                               ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            got = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), arrow.types, strict=True)], schema=arrow)
            done.clear()
            return got

        conv_type = None
        for b in slices(batches):
            conv_type = b.column(0).type
            for conv, text, starts, lens in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, sha256(), 0, sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, n in zip(starts, lens, strict=True):
                    said = unescape_text(text[a:a + n])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield out()
        close()
        if done:
            yield out()

    rows = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "block", "seq")
    return rows.select("conv_id", "formatted", "loss_start", "loss_len").mapInArrow(run, schema)
