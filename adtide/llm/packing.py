"""Texts compressed one by one, for steps that shuffle or write them before Python reads them again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard

from adtide.llm.words import buffers, chunks


def unpacked(batches: Iterable[pa.RecordBatch], limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Batches with the packed text in their last column, with plain bytes there instead."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        at = 0
        packed = batch.column(batch.num_columns - 1).to_pylist()
        while at < len(packed):
            texts, size, to = [], 0, at
            while to < len(packed) and (not texts or size < limit):
                texts.append(unpack.decompress(packed[to]) if packed[to] else b"")
                size += len(texts[-1])
                to += 1
            part = batch.slice(at, to - at)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.binary())], [*batch.schema.names[:-1], "text"])
            at = to


def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the text in their last column, named text, packed there instead."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in chunks(batches, "text"):
        data, offsets = buffers(batch.column(batch.num_columns - 1))
        raw, ends = data.tobytes(), offsets.tolist()
        packed = [packer.compress(raw[a:b]) if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], [*batch.schema.names[:-1], "packed"])
