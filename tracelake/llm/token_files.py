"""Token-id files in Simple-8b words (operator 8).

A file holds, in this order and little-endian: the packed 64-bit words of all blocks, the escaped ids as unsigned 32-bit
integers, a footer of numpy arrays (`np.lib.format`): document ids, whether each is not null, the number of ids up to
and with each document, the number of words and of escapes before each block; last, 8 bytes of the footer's place and
the 8 bytes of MAGIC. Each block packs BLOCK ids (the last one fewer). A word's top 4 bits select how many slots of how
many bits follow. No slot is wider than 15 bits: an id from ESCAPE on is written as ESCAPE, and its value goes to the
escapes. The offsets let a reader decode any block by itself, with a few numpy operations a selector.
"""

from __future__ import annotations

import io
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, offsets, text_chunks, written
from .token_chunks import ByteBpe

MAGIC = b"TLAKES8B"
BLOCK = 1 << 16
#: Text bytes of a file, on average.
FILE_BYTES = 64 << 20
#: Text bytes that are encoded at once, so that their distinct chunks are looked up once.
ENCODED_BYTES = 8 << 20
ESCAPE = (1 << 15) - 1
#: Selector: (slots, bits). Most slots first; a fixed rule of 60 payload bits.
SLOTS = [(60 // b, b) for b in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15)]


#: For each number below ESCAPE + 1 the first selector whose slots are wide enough.
_selector = np.searchsorted([b for _, b in SLOTS], [x.bit_length() for x in range(ESCAPE + 1)]).astype(np.uint8)
_slots = np.array([s for s, _ in SLOTS])


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Simple-8b words of one block, greedily with the most slots that fit, and its escaped ids."""
    n, low = len(ids), np.minimum(ids, ESCAPE).astype(np.uint64)
    # The widest selector that the ids from each place on need, over 1, 2, 4, ... places; past the end there is room for padding.
    widest = [np.concatenate([_selector[low], np.zeros(64, np.uint8)])]
    for k in range(5):
        widest.append(np.maximum(widest[-1], np.append(widest[-1][1 << k :], np.zeros(1 << k, np.uint8))))
    best = np.full(n, len(SLOTS) - 1, np.uint8)
    for k in reversed(range(len(SLOTS) - 1)):
        slots = SLOTS[k][0]
        p = slots.bit_length() - 1
        over = slots - (1 << p)
        best[np.maximum(widest[p][:n], widest[p][over : over + n]) <= k] = k
    jump = (np.arange(n) + _slots[best]).tolist()
    at, starts = 0, []
    while at < n:
        starts.append(at)
        at = jump[at]
    starts = np.array(starts, np.int64)
    padded, kind = np.concatenate([low, np.zeros(60, np.uint64)]), best[starts]
    words = kind.astype(np.uint64) << np.uint64(60)
    for k, (slots, bits) in enumerate(SLOTS):
        own = np.flatnonzero(kind == k)
        if len(own):
            word, at = words[own], starts[own]
            for j in range(slots):
                word |= padded[at + j] << np.uint64(bits * j)
            words[own] = word
    return words, ids[ids >= ESCAPE].astype("<u4")


def unpack(words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The n ids of one block."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    slots = _slots[kind]
    start = np.cumsum(slots) - slots
    out = np.zeros(n + 60, np.uint32)
    for k, (s, bits) in enumerate(SLOTS):
        own = np.flatnonzero(kind == k)
        if len(own):
            shifts = np.arange(s, dtype=np.uint64) * np.uint64(bits)
            out[start[own][:, None] + np.arange(s)] = (words[own][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    out = out[:n]
    out[out == ESCAPE] = escapes
    return out


class Writer:
    """Streams documents into one file; holds one block and the footer."""

    def __init__(self, out):
        self.out, self.rest, self.held = out, [], 0
        self.doc_ids, self.ends, self.words, self.escapes = [], [], [0], [0]
        self.kept_escapes, self.n = [], 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents whose ids lie end to end."""
        self.rest.append(ids)
        self.held += len(ids)
        self.doc_ids += doc_ids
        self.ends += (self.n + np.cumsum(counts)).tolist()
        self.n += len(ids)
        if self.held >= BLOCK:
            held = np.concatenate(self.rest)
            for lo in range(0, len(held) - BLOCK + 1, BLOCK):
                self._block(held[lo : lo + BLOCK])
            self.rest = [held[len(held) // BLOCK * BLOCK :]]
            self.held = len(self.rest[0])

    def _block(self, ids: np.ndarray) -> None:
        words, escapes = pack(ids)
        self.out.write(words.astype("<u8").tobytes())
        self.words.append(self.words[-1] + len(words))
        self.escapes.append(self.escapes[-1] + len(escapes))
        self.kept_escapes.append(escapes)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        footer = io.BytesIO()
        for x in ([d or 0 for d in self.doc_ids], [d is not None for d in self.doc_ids], self.ends, self.words, self.escapes):
            np.lib.format.write_array(footer, np.array(x, "<i8"))
        for x in self.kept_escapes:
            self.out.write(x.tobytes())
        at = self.words[-1] * 8 + self.escapes[-1] * 4
        self.out.write(footer.getvalue() + at.to_bytes(8, "little") + MAGIC)
        self.out.close()


def read(file) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the file, its ids) of each document of an opened file, block by block."""
    size = file.size()
    file.seek(size - 16)
    tail = file.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a token file")
    at = int.from_bytes(tail[:8], "little")
    file.seek(at)
    footer = io.BytesIO(file.read(size - 16 - at))
    doc_ids, valid, ends, words, escapes = (np.lib.format.read_array(footer) for _ in range(5))
    total, held, lo, block = int(ends[-1]) if len(ends) else 0, np.zeros(0, np.uint32), 0, 0
    for doc, ok, end in zip(doc_ids.tolist(), valid.tolist(), ends.tolist(), strict=True):
        parts = [held]
        have = lo + len(held)
        while have < end:
            file.seek(int(words[block]) * 8)
            packed = np.frombuffer(file.read(int(words[block + 1] - words[block]) * 8), "<u8")
            file.seek(int(words[-1]) * 8 + int(escapes[block]) * 4)
            escaped = np.frombuffer(file.read(int(escapes[block + 1] - escapes[block]) * 4), "<u4")
            parts.append(unpack(packed, min(BLOCK, total - block * BLOCK), escaped))
            have += len(parts[-1])
            block += 1
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield doc if ok else None, lo, held[: end - lo]
        held, lo = held[end - lo :], end


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes each text with a byte-level BPE file of the tokenizers library and writes the ids under `folder`, in
    ascending order of the document ids over the files. Returns the manifest (part, file, n_docs, n_ids, start), one row
    a file: `start` counts the ids of all files before it.

    Texts are dealt out by ranges of (id, hash of the text), as many as hold `file_bytes` of text each, so a file has a
    bounded size at any size of the table, and rows of one id spread over files. Each task writes one file. A file's
    name is new in each attempt, and only those in the written manifest count: a lost executor or a repeated task leaves
    at most an unlisted file.

    A null text is empty and has only the end id; null ids come first; equal ids follow each other in the order of their
    texts' hashes. An empty table gives an empty manifest. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    files = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) / file_bytes))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(files, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, writer = ByteBpe.of(tokenizer), None
        for whole in batches:
            for b, _, _ in text_chunks(whole, "text", ENCODED_BYTES):
                if writer is None:
                    name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.s8b"
                    fs, path = FileSystem.from_uri(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    writer = Writer(fs.open_output_stream(path))
                ids, counts = bpe.encode_all(b.column("text"))
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                writer.add(b.column("id").to_pylist(), ids, counts)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "file": name, "n_docs": len(writer.ends), "n_ids": writer.n}])

    manifest = written(rows.mapInArrow(write, "part long, file string, n_docs long, n_ids long"), "manifest")
    return offsets(manifest, "part", "n_ids")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document in the files of a manifest."""
    files = manifest.select("file", "start").repartition(max(1, min(manifest.count(), 1 << 14)))

    def decode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            fs, path = FileSystem.from_uri(name)
            with fs.open_input_file(path) as f:
                rows = [(doc, start + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, before, ids in read(f)]
            yield pa.table([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["id", "start", "n_tokens", "ids_crc32"])

    def each(batch: pa.RecordBatch) -> pa.Table:
        tables = list(decode(batch))
        return pa.concat_tables(tables) if tables else pa.table({n: pa.array([], pa.int64()) for n in ("id", "start", "n_tokens", "ids_crc32")})

    return map_arrow(files, each, "id long, start long, n_tokens long, ids_crc32 long")
