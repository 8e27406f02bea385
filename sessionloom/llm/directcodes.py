"""Token ids in directly addressable codes: any token can be read without decoding a block.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first chunk
of every id; a bitmap says which ids go on, and their next chunks stand on level 1
in order, and so forth. A rank directory gives the number of set bits before every
512-bit stretch of a bitmap, so the place of an id on the next level is one lookup
and one count inside a stretch.

A shard is one value of this layout (all little-endian):
``DAC1``, u32 levels, u64 ids, then per level u64 chunks, the chunks, and, but for
the last level, the bitmap (whole 64-byte stretches) and the directory (u32 each).

Documents are written in ascending id order. Shards are bounded in tokens (a longer
document has a shard of its own) and are stored as rows of a table in the shared
folder, so every store that Spark can reach holds them.

Cases: a null or empty text is its end id alone; equal doc_ids keep their rows side
by side; no documents give no shards.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sessionloom.llm.packing import with_global_place, written
from sessionloom.llm.tokens import encoder
from sessionloom.llm.workers import slices, table

MAGIC = b"DAC1"
CHUNK = 8
STRETCH = 512
SHARD_TOKENS = 1 << 20


def pack_codes(ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, np.uint32)
    parts, levels, rest = [], 0, ids
    while levels == 0 or len(rest):
        levels += 1
        parts += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes()]
        more = rest >> CHUNK > 0
        rest = rest[more] >> CHUNK
        if len(rest):
            bits = np.packbits(more, bitorder="little")
            bits = np.pad(bits, (0, -len(bits) % (STRETCH // 8)))
            counts = np.bitwise_count(bits).reshape(-1, STRETCH // 8).sum(axis=1, dtype=np.uint32)
            ranks = (np.cumsum(counts) - counts).astype("<u4")
            parts += [bits.tobytes(), ranks.tobytes()]
    return MAGIC + struct.pack("<IQ", levels, len(ids)) + b"".join(parts)


class Codes:
    """Random access to the ids of a shard."""

    def __init__(self, shard: bytes):
        if shard[:4] != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        levels, self.size = struct.unpack_from("<IQ", shard, 4)
        self.levels, at = [], 16
        for level in range(levels):
            (n,) = struct.unpack_from("<Q", shard, at)
            chunks = np.frombuffer(shard, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if level + 1 < levels:
                stretches = -(-n // STRETCH)
                bits = np.frombuffer(shard, np.uint8, stretches * STRETCH // 8, at)
                at += len(bits)
                ranks = np.frombuffer(shard, "<u4", stretches, at)
                at += 4 * stretches
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, index: int) -> int:
        if not 0 <= index < self.size:
            raise IndexError(index)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[index]) << shift
            if bits is None or not bits[index >> 3] >> (index & 7) & 1:
                break
            index = self._rank(bits, ranks, index)
            shift += CHUNK
        return value

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, index: int) -> int:
        """Set bits before ``index``: the stretch's entry and a count inside it."""
        stretch = index // STRETCH
        whole = int(np.bitwise_count(bits[stretch * STRETCH // 8 : index >> 3]).sum())
        last = int(bits[index >> 3]) & ((1 << (index & 7)) - 1) if index & 7 else 0
        return int(ranks[stretch]) + whole + last.bit_count()

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``, found from the directory at ``start``."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where, shift = np.arange(len(out)), 0
        for chunks, bits, ranks in self.levels:
            if start >= stop:
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            if bits is None:
                break
            byte = start >> 3
            more = np.unpackbits(bits[byte : (stop + 7) >> 3], bitorder="little")
            more = more[start - 8 * byte : stop - 8 * byte].astype(bool)
            begin = self._rank(bits, ranks, start)
            where, shift = where[more], shift + CHUNK
            start, stop = begin, begin + len(where)
        return out


SHARDS = pa.schema(
    [("part", pa.int32()), ("place", pa.int64()), ("size", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
     ("sizes", pa.list_(pa.int64())), ("codes", pa.binary())]
)
SHARDS_SQL = "part int, place bigint, size bigint, doc_ids array<bigint>, sizes array<bigint>, codes binary"
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
READ_SQL = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def write(docs: DataFrame, tokenizer: str, end: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The table of written shards, whose rows follow each other in doc_id order.

    ``part`` numbers the ranges of doc_id, ``place`` is the number of ids before the
    shard within its range.
    """

    def encode(batches):
        coder, part, place = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names, ids, held = [], [], 0

        def shard():
            columns = {
                "part": [part], "place": [place], "size": [held], "doc_ids": [names],
                "sizes": [[len(i) for i in ids]], "codes": [pack_codes(np.concatenate(ids))],
            }
            return table(columns, SHARDS)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = coder.ids(text, end)
                if held and held + len(own) > shard_tokens:
                    yield shard()
                    place += held
                    names, ids, held = [], [], 0
                names.append(doc_id)
                ids.append(own)
                held += len(own)
        if held:
            yield shard()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(encode, SHARDS_SQL), "codes")


def read_back(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the codes."""

    def decode(batches):
        for batch in slices(batches, "codes"):
            for row in batch.to_pylist():
                codes, sizes = Codes(row["codes"]), np.array(row["sizes"], np.int64)
                stops = np.cumsum(sizes)
                ids = [codes.read(stop - size, stop) for size, stop in zip(sizes.tolist(), stops.tolist())]
                columns = {
                    "doc_id": row["doc_ids"], "start": row["before"] + row["place"] + stops - sizes,
                    "n_tokens": sizes, "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids],
                }
                yield table(columns, READ)

    return with_global_place(shards).mapInArrow(decode, READ_SQL)
