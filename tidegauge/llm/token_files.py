"""Token ids in bit-packed files.

Every id takes the bits that the vocabulary needs. A file has a header, the
documents' ids and first tokens, the byte offset of each block, and the blocks:
``BLOCK_IDS`` ids, packed without gaps and ending on a byte, so any block is found by its
offset and unpacked by itself with vectorised bit operations.

    magic "TIDTOK1\\n", then as little-endian uint64: bits, ids, documents, ids a block, blocks
    documents x (has_id uint64, doc_id int64, first id uint64)
    blocks x offset uint64 (from the start of the blocks), blocks

Documents come in ascending doc_id order (missing ids first; ties by text), in
files numbered in that order. A null or empty text is a document of its end id
alone. Repeated rows are written each. An empty table gives no files and an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.bpe import text_encoder
from tidegauge.llm.common import query, small_batches, table, text_of
from tidegauge.llm.files import create, new_name, read
from tidegauge.llm.tokens import public_path, tokenizer
from tidegauge.session import materialise, scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"TIDTOK1\n"
HEADER = "<8s5Q"
BLOCK_IDS = 1 << 16
#: A task begins another file after so many ids.
FILE_IDS = 1 << 23
#: Texts encoded at a time in a task.
BATCH = 256
MANIFEST = "part int, number int, path string, n_ids long, n_docs long"


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, lowest bit first."""
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits], bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    held = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = held
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def write_file(path: str, docs: list, ids: list[np.ndarray], bits: int) -> int:
    """Write documents' ids to a new file; returns how many ids it holds."""
    lengths = np.fromiter(map(len, ids), np.uint64, len(ids))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = [pack_bits(flat[a:a + BLOCK_IDS], bits) for a in range(0, len(flat), BLOCK_IDS)]
    index = np.zeros((len(docs), 3), "<i8")
    index[:, 0] = [d is not None for d in docs]
    index[:, 1] = [d or 0 for d in docs]
    index[:, 2] = np.cumsum(lengths) - lengths
    offsets = np.cumsum([0] + [len(b) for b in blocks])[:-1].astype("<u8")
    with create(path) as file:
        file.write(struct.pack(HEADER, MAGIC, bits, len(flat), len(docs), BLOCK_IDS, len(blocks)))
        for part in (index.tobytes(), offsets.tobytes(), *blocks):
            file.write(part)
    return len(flat)


class TokenFile:
    """Random access to one file: the index is read at once, blocks when asked for."""

    def __init__(self, path: str):
        self.path = path
        magic, self.bits, self.n_ids, n_docs, self.block_ids, n_blocks = struct.unpack(HEADER, read(path, 0, struct.calcsize(HEADER)))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        held = read(path, struct.calcsize(HEADER), 24 * n_docs + 8 * n_blocks)
        self.index = np.frombuffer(held, "<i8", 3 * n_docs).reshape(-1, 3)
        self.offsets = np.frombuffer(held, "<u8", n_blocks, 24 * n_docs)
        self.body = struct.calcsize(HEADER) + len(held)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to before ``end``, from the blocks they lie in."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        parts = []
        for block in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - block * self.block_ids)
            parts.append(unpack_bits(read(self.path, self.body + int(self.offsets[block]), -(-n * self.bits // 8)), self.bits, n))
        low = first * self.block_ids
        return np.concatenate(parts)[start - low:end - low]

    def documents(self):
        """``doc_id, first id, ids`` of every document, in order, a span of blocks at a time."""
        ends = np.append(self.index[1:, 2], self.n_ids)
        at = 0
        while at < len(self.index):
            upto = max(at + 1, int(np.searchsorted(ends, self.index[at, 2] + 16 * self.block_ids, "right")))
            low = int(self.index[at, 2])
            held = self.ids(low, int(ends[upto - 1]))
            for (known, doc_id, first), end in zip(self.index[at:upto].tolist(), ends[at:upto].tolist()):
                yield doc_id if known else None, first, held[first - low:end - low]
            at = upto


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents and return the table of files, with ``first_id`` counted over all."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    bits = bits_for(max(tokenizer(path).get_vocab_size(), end_id + 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    order = ["doc_id", "text"]
    dealt = rows.repartitionByRange(parts, F.col("doc_id")).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches):
        coder = text_encoder(path)
        held_docs, held_ids, n, number, part = [], [], 0, 0, None

        def flush():
            name = new_name(folder, f"part-{part:06d}-{number:04d}")
            size = write_file(name, held_docs, held_ids, bits)
            row = [(part, number, name, size, len(held_docs))]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*row), kinds)], names=[c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                part = some.column(2)[0].as_py()
                for doc, found in zip(some.column(0).to_pylist(), coder.texts(some.column(1).to_pylist())):
                    held_docs.append(doc)
                    held_ids.append(np.append(found, np.uint32(end_id)))
                    n += len(held_ids[-1])
                if n >= FILE_IDS:
                    yield flush()
                    held_docs, held_ids, n, number = [], [], 0, number + 1
        if held_docs:
            yield flush()

    files = materialise(small_batches(dealt).mapInArrow(run, MANIFEST), "token_files")
    # One row a file: the running total over files is a small window.
    before = F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("first_id", F.coalesce(before, F.lit(0)))


def read_tokens(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(doc, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, start, ids in TokenFile(name).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = files.select("path", "first_id").repartition(tasks, "path")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op3_token_files")
def op3(spark, sf_dir):
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_path(VOCABULARY)))
