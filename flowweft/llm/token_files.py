"""Token ids in fixed-width bit-packed files.

A file holds ids in the fewest bits the vocabulary needs, first bit highest, in
blocks of ``block_tokens`` ids that each start on a byte; an index at its end has
the place of every block and every document. So a block unpacks with numpy in one
go, and a document is read through the blocks it lies in.

    magic, bits, ids per block | blocks | ids of documents, which are not null, their
    first tokens, places of blocks | place of the index, documents, tokens, blocks, magic

Files are named after the attempt that wrote them, and only those in the returned
manifest count: a repeated task leaves a stray file but never a wrong row.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import shared_folder
from .encode import encoder

MAGIC = b"FWTOKEN1"
_HEAD, _TAIL = struct.Struct("<8sII"), struct.Struct("<QQQQ8s")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, highest bit first, padded with zeros to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits:]
    return np.packbits(wide.reshape(-1)).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    wide = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, 32 - bits:] = wide
    return np.packbits(full, axis=1).reshape(-1).view(">u4").astype(np.uint32)


class TokenWriter:
    """Writes one file; holds one block and the index in memory."""

    def __init__(self, stream, bits: int, block_tokens: int = 65_536):
        self.stream, self.bits, self.block = stream, bits, block_tokens
        self.place = stream.write(_HEAD.pack(MAGIC, bits, block_tokens)) or _HEAD.size
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = 0
        self.ids: list[int | None] = []
        self.starts, self.blocks = [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.tokens += len(ids)
        self.starts.append(self.tokens)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for at in range(0, whole, self.block):
            data = pack(ids[at:min(at + self.block, whole)], self.bits)
            self.blocks.append(self.place)
            self.stream.write(data)
            self.place += len(data)
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        index = self.place
        self.stream.write(np.array([x or 0 for x in self.ids], "<i8").tobytes())
        self.stream.write(np.array([x is not None for x in self.ids], np.uint8).tobytes())
        self.stream.write(np.array(self.starts, "<u8").tobytes())
        self.stream.write(np.array([*self.blocks, index], "<u8").tobytes())
        self.stream.write(_TAIL.pack(index, len(self.ids), self.tokens, len(self.blocks), MAGIC))
        self.stream.close()


class TokenFile:
    """Random access to a file's documents and token ranges."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        index, docs, self.tokens, blocks, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        head, self.bits, self.block = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if magic != MAGIC or head != MAGIC:
            raise ValueError(f"{path} is not a whole token file")
        raw = self.file.read_at(size - _TAIL.size - index, index)
        cut = [0, 8 * docs, 9 * docs, 9 * docs + 8 * (docs + 1), len(raw)]
        parts = [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        self.has_id = np.frombuffer(parts[1], np.uint8).astype(bool)
        self.doc_ids = np.frombuffer(parts[0], "<i8")
        self.starts = np.frombuffer(parts[2], "<u8").astype(np.int64)
        self.blocks = np.frombuffer(parts[3], "<u8").astype(np.int64)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def tokens_between(self, first: int, end: int) -> np.ndarray:
        """Ids at positions first to end - 1, read through the blocks that hold them."""
        if end <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (end - 1) // self.block
        data = self.file.read_at(int(self.blocks[b + 1] - self.blocks[a]), int(self.blocks[a]))
        out = []
        for k in range(a, b + 1):
            n = min(self.block, self.tokens - k * self.block)
            out.append(unpack(data[self.blocks[k] - self.blocks[a]:self.blocks[k + 1] - self.blocks[a]], n, self.bits))
        return np.concatenate(out)[first - a * self.block:end - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.tokens_between(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self, at_once: int = 16) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of every document, reading about ``at_once`` blocks at a time."""
        i = 0
        while i < len(self):
            j = int(np.searchsorted(self.starts, self.starts[i] + at_once * self.block, "right")) - 1
            j = min(max(j, i + 1), len(self))
            base = int(self.starts[i])
            ids = self.tokens_between(base, int(self.starts[j]))
            for k in range(i, j):
                yield k, ids[self.starts[k] - base:self.starts[k + 1] - base]
            i = j

    def close(self) -> None:
        self.file.close()


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, file_tokens: int = 16_000_000,
    block_tokens: int = 65_536, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Encode texts and write them in ascending id order; returns the manifest.

    Rows are ranged by (id, hash of the text) and sorted inside a range, so equal ids, null ids (first) and repeated
    rows have a fixed order too. A null text counts as empty; ``end_id`` follows every document. Manifest, one row
    per file: file, part, seq (their order), n_docs, n_tokens, start (tokens of all earlier files). An empty table
    gives an empty manifest. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text")
    ).withColumn("_h", F.xxhash64("_text"))
    ranged = rows.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h", "_text").select("_id", "_text")
    tail = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        one = encoder(tokenizer)
        bits = bits_for(max(one.vocabulary, (end_id or 0) + 1))
        part, made, out, name = TaskContext.get().partitionId(), [], None, ""

        def finish():
            out.close()
            made.append((name, part, len(made), len(out.ids), out.tokens))

        for batch in batches:
            encoded = one.encode_all(batch.column(1).to_pylist())
            for doc, raw in zip(batch.column(0).to_pylist(), encoded, strict=True):
                if out is None:
                    name = f"tokens-{part:06d}-{len(made):04d}-{uuid.uuid4().hex}.bin"
                    out = TokenWriter(store.open_output_stream(f"{root}/{name}"), bits, block_tokens)
                out.add(doc, np.frombuffer(raw + tail, "<u4"))
                if out.tokens >= file_tokens:
                    finish()
                    out = None
        if out is not None:
            finish()
        if made:
            columns = list(zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                ["file", "part", "seq", "n_docs", "n_tokens"],
            )

    manifest = materialize(ranged.mapInArrow(write, "file string, part long, seq long, n_docs long, n_tokens long"))
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the manifest's files.

    One task per file; a file is read a few blocks at a time. The checksum is over little-endian unsigned
    32-bit ids.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] * with_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, rows = TokenFile(store, f"{root}/{name}"), []
                for i, ids in file.documents():
                    doc = int(file.doc_ids[i]) if file.has_id[i] else None
                    row = (doc, start + int(file.starts[i]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    rows.append((*row, ids.tolist()) if with_ids else row)
                    if len(rows) == 4096 or with_ids and len(rows) == 64:
                        yield _batch(rows, fields)
                        rows = []
                file.close()
                if rows:
                    yield _batch(rows, fields)

    files = max(1, manifest.count())
    return manifest.select("file", "start").repartitionByRange(files, "file").mapInArrow(read, schema)


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields]
    )


def token_index(docs: DataFrame, tokenizer: str, end_id: int, file_tokens: int = 16_000_000) -> DataFrame:
    """Write the table's tokens to the shared folder and read them back: one row per document."""
    folder = shared_folder(docs.sparkSession)
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id, file_tokens), folder)
