"""Token ids in files of independent zstandard frames with a trailing seek table.

A shard file holds, one after the other:

- data frames, each a complete zstandard frame of at most ``FRAME_IDS`` ids (little-endian,
  2 or 4 bytes); a text longer than that continues in the next frame;
- a skippable frame with the document index: ids of the documents and their lengths;
- a skippable frame with the seek table of the public zstandard seekable format: sizes of
  each frame, compressed and not, and a checksum of its content.

So any zstandard tool unpacks a shard, and a reader fetches the table from the end, the
index before it, and then only the frames of the documents it wants, each of which it
checks. Shards are numbered in the order of the document ids. A shard appears under its
name only when complete and is named by its task attempt; the manifest, a table written
by Spark, names one shard per task, so lost executors and repeated attempts do no harm.

Null texts are empty: their only id is the end id. Null document ids come first. Rows with
one document id are ordered by a hash of their text; equal rows each have their own place.
An empty table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.bpe import encoder, text_buffer
from sluice import storage
from sluice.session import new_scratch, pin
from sluice.sources import files

FRAME_IDS = 1 << 16
LEVEL = 1

#: Fixed values of the seekable format and of our index frame.
_SKIP_INDEX = 0x184D2A50
_SKIP_TABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
_CHECKSUMS = 0x80
_INDEX = struct.Struct("<4sBxxxQ")
_TABLE_FOOT = struct.Struct("<IBI")

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"
LOCATED = "doc_id long, start long, n_tokens long, ids_crc32 long"


class ShardWriter:
    """Writes one shard; ``add`` takes documents in order, ``close`` ends the file."""

    def __init__(self, stream, dtype, frame_ids: int = FRAME_IDS):
        import zstandard

        self.stream, self.dtype = stream, np.dtype(dtype).newbyteorder("<")
        self.frame_ids = frame_ids
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = self.size = 0
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[int] = []
        self.valid: list[bool] = []
        self.lengths: list[int] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc or 0)
        self.valid.append(doc is not None)
        self.lengths.append(len(ids))
        self.total += len(ids)
        while len(ids):
            some = ids[: self.frame_ids - self.held]
            self.waiting.append(some)
            self.held += len(some)
            ids = ids[len(some) :]
            if self.held == self.frame_ids:
                self._frame()

    def _frame(self) -> None:
        import xxhash

        if not self.held:
            return
        content = np.concatenate(self.waiting).astype(self.dtype).tobytes()
        packed = self.packer.compress(content)
        self._put(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.waiting, self.held = [], 0

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._frame()
        index = _INDEX.pack(b"TOKX", self.dtype.itemsize, len(self.docs))
        index += np.array(self.docs, "<i8").tobytes() + np.array(self.valid, "u1").tobytes()
        index += np.array(self.lengths, "<u8").tobytes()
        self._put(struct.pack("<II", _SKIP_INDEX, len(index)) + index)
        table = np.array(self.table, "<u4").tobytes() + _TABLE_FOOT.pack(len(self.table), _CHECKSUMS, _SEEKABLE)
        self._put(struct.pack("<II", _SKIP_TABLE, len(table)) + table)


class ShardReader:
    """Random access to a shard through ranges of it: ``read_at(size, offset)``."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        frames, flags, magic = _TABLE_FOOT.unpack(read_at(_TABLE_FOOT.size, size - _TABLE_FOOT.size))
        if magic != _SEEKABLE or not flags & _CHECKSUMS:
            raise ValueError("no seek table with checksums")
        length = 12 * frames + _TABLE_FOOT.size
        table_at = size - length - 8
        rows = np.frombuffer(read_at(12 * frames, table_at + 8), "<u4").reshape(frames, 3).astype(np.int64)
        self.packed, self.unpacked, self.sums = rows.T if frames else np.zeros((3, 0), np.int64)
        self.at = np.cumsum(self.packed) - self.packed
        index_at = int(self.packed.sum())
        magic, length = struct.unpack("<II", read_at(8, index_at))
        index = read_at(length, index_at + 8)
        mark, width, docs = _INDEX.unpack_from(index)
        if magic != _SKIP_INDEX or mark != b"TOKX":
            raise ValueError("no document index")
        at = _INDEX.size
        self.docs = np.frombuffer(index, "<i8", docs, at)
        self.valid = np.frombuffer(index, "u1", docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(index, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.dtype = np.dtype(f"<u{width}")
        self.first = (np.cumsum(self.unpacked) - self.unpacked) // width
        self._last: tuple[int, np.ndarray] | None = None

    def frame(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        if self._last is None or self._last[0] != k:
            packed = self.read_at(int(self.packed[k]), int(self.at[k]))
            content = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.unpacked[k]))
            if len(content) != self.unpacked[k] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self._last = (k, np.frombuffer(content, self.dtype))
        return self._last[1]

    def ids(self, n: int) -> Iterator[np.ndarray]:
        """The ids of the n-th document, frame by frame."""
        low, high = int(self.starts[n]), int(self.starts[n] + self.lengths[n])
        k = int(np.searchsorted(self.first, low, "right")) - 1
        while low < high:
            own = self.frame(k)[low - int(self.first[k]) : high - int(self.first[k])]
            yield own
            low += len(own)
            k += 1


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode ``doc_id, text`` and write shards below ``folder``; returns the manifest.

    Documents are dealt into ranges of their ids and sorted there, so shard numbers, and
    places within a shard, ascend with the ids. ``end_id`` is appended to each document.
    """
    open_uri = files.uri_opener()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        target = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tok.zst"
        fs, path = open_uri(target)
        writer = stream = None
        try:
            for batch in batches:
                data, starts = text_buffer(batch.column(1))
                found, bounds = own.encode(data, starts, chunked=False)
                for doc, low, high in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                    if writer is None:
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        stream = fs.open_output_stream(path + ".part")
                        writer = ShardWriter(stream, own.dtype, frame_ids)
                    ids = found[low:high]
                    writer.add(doc, ids if end_id is None else np.append(ids, np.array(end_id, own.dtype)))
            if writer is None:
                return
            writer.close()
            stream.close()
            fs.move(path + ".part", path)
        except BaseException:
            if stream is not None:
                stream.close()
                fs.delete_file(path + ".part")
            raise
        row = [[shard], [target], [len(writer.docs)], [writer.total], [writer.size]]
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(row, kinds)], ["shard", "path", "n_docs", "n_tokens", "n_bytes"]
        )

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    return pin(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Each document's place among all ids, length and checksum, from the files alone.

    The manifest has a row per shard, so its running sum is small; the ids stay in tasks.
    """
    from pyspark.sql import Window

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    shards = max(1, min(manifest.count(), 100_000))
    open_uri = files.uri_opener()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = open_uri(path)
                with fs.open_input_file(name) as source:
                    reader = ShardReader(source.read_at, source.size())
                    for low in range(0, len(reader.docs), 10_000):
                        some = range(low, min(low + 10_000, len(reader.docs)))
                        sums = []
                        for n in some:
                            crc = 0
                            for ids in reader.ids(n):
                                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        cut = slice(some.start, some.stop)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.docs[cut], pa.int64(), mask=~reader.valid[cut]),
                                pa.array(reader.starts[cut] + base, pa.int64()),
                                pa.array(reader.lengths[cut], pa.int64()),
                                pa.array(sums, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return placed.select("path", "base").repartition(shards, "path").mapInArrow(run, LOCATED)


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids of the wanted ``doc_id`` rows: ``doc_id, ids``; only their frames are read.

    Wanted ids are matched with the shards by range, one row per wanted id and shard that
    can hold it, which are neighbours; null ids are not found.
    """
    open_uri = files.uri_opener()
    spark = manifest.sparkSession

    def spans(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = open_uri(path)
                with fs.open_input_file(name) as source:
                    reader = ShardReader(source.read_at, source.size())
                docs = reader.docs[reader.valid]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(docs)), pa.array(docs, pa.int64()), pa.array(np.flatnonzero(reader.valid), pa.int64())],
                    ["path", "doc_id", "place"],
                )

    def fetch(batches):
        for batch in batches:
            rows = sorted(zip(*(batch.column(i).to_pylist() for i in range(3))))
            reader, last = None, None
            docs, ids = [], []
            for path, doc, place in rows:
                if path != last:
                    fs, name = open_uri(path)
                    source = fs.open_input_file(name)
                    reader, last = ShardReader(source.read_at, source.size()), path
                docs.append(doc)
                ids.append(np.concatenate([*reader.ids(place), np.empty(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    index = manifest.select("path").mapInArrow(spans, "path string, doc_id long, place long")
    chosen = index.join(wanted.select("doc_id").distinct(), "doc_id").select("path", "doc_id", "place")
    return chosen.repartition("path").sortWithinPartitions("path", "place").mapInArrow(fetch, "doc_id long, ids array<long>")


def store_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the shards to ``folder`` (fresh below the shared folder if none), then read them back."""
    folder = storage.qualify(spark, folder or new_scratch(spark, "tokens"))
    return read_shards(spark, write_shards(docs, tokenizer, folder, **options))
