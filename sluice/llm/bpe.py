"""Byte-level BPE with content-defined chunk reuse.

A text is cut by a rolling hash into chunks, so that passages which documents share give
equal chunks wherever they stand. A worker encodes each chunk once. Tokens next to a chunk
edge may differ from those of the whole text; such an edge is repaired by encoding anew
the stretch around it, widened on both sides until it ends where the tokens of the whole
text provably have a border. There both sides agree, so the ids are the library's own.

A border that always holds for the byte-level pattern: a space followed by a character
that is not white space. Fewer borders are only slower, so doubtful bytes count as none.
Stretches between borders are remembered by content as well. Look-ups go by sorted numpy arrays
of 64-bit content hashes, and what is found is compared byte for byte: another text with an
equal hash is encoded on its own. Memory is bounded by ``MEMO_ENTRIES``.

Null and empty texts give no ids. Rows are independent of each other: repeated rows give
repeated results, an empty table an empty one. Very long texts are worked on in slices.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes worked on at a time, and what a worker remembers at most.
SLICE_BYTES = 1 << 21
MEMO_ENTRIES = 1_500_000
#: One chunk edge in so many bytes on average.
CHUNK_BYTES = 512
_WINDOW_STEPS = 4
_JOINED_BYTES = 1 << 15

#: ASCII white space, and first bytes of characters that may be white space.
_NOT_AFTER_BORDER = [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]


def _tables():
    random = np.random.default_rng(20240229)
    wide = random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    gear = random.integers(0, 2**32, 256, dtype=np.uint32)
    return wide, gear


_BYTE_HASH, _GEAR = _tables()
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_GOES_ON = np.ones(256, bool)
_GOES_ON[_NOT_AFTER_BORDER] = False


def borders(data: np.ndarray, starts: np.ndarray, apart: tuple[bytes, ...] = ()) -> np.ndarray:
    """Where stretches begin: text starts, and spaces before what is not white space.

    ``apart`` are strings that the tokenizer takes out of the text first; a space right
    before one belongs to the white space in front of it, so it is no border.
    """
    mask = np.zeros(len(data), bool)
    if len(data):
        np.logical_and(data[:-1] == 32, _GOES_ON[data[1:]], out=mask[:-1])
    raw = data.tobytes() if apart else b""
    for special in apart:
        at = raw.find(special)
        while at >= 0:
            if at:
                mask[at - 1] = False
            at = raw.find(special, at + 1)
    inside = starts[starts < len(data)]
    # The last byte of a text is followed by another text's first one: no border there.
    mask[inside[inside > 0] - 1] = False
    mask[inside] = True
    return np.flatnonzero(mask)


def chunk_edges(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Chunk edges by a rolling hash over the 16 bytes before them."""
    rolled = _GEAR[data]
    for step in range(_WINDOW_STEPS):
        reach = 1 << step
        ahead = rolled.copy()
        ahead[reach:] += rolled[:-reach] << np.uint32(reach)
        rolled = ahead
    edges = np.flatnonzero((rolled >> np.uint32(7)) % np.uint32(CHUNK_BYTES) == 0) + 1
    if not len(edges):
        return edges
    owner = np.searchsorted(starts, edges, "right") - 1
    return edges[(edges - starts[owner] >= 1 << _WINDOW_STEPS) & (edges < len(data))]


class SpanHash:
    """64-bit hashes of stretches of a slice, equal wherever equal bytes stand.

    Different bytes can have equal hashes: there are texts made for that.
    """

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(data):
            self.powers = np.cumprod(np.full(len(data), _BASE))
            self.inverse = np.cumprod(np.full(len(data), _BASE_INVERSE))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_HASH[data] * self.powers[: len(data)], out=sums[1:])
        hashed = (sums[ends] - sums[starts]) * self.inverse[starts]
        hashed ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        hashed ^= hashed >> np.uint64(32)
        return hashed * np.uint64(0xBF58476D1CE4E5B9)


def gather(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Stretches of a pool one after the other."""
    before = np.cumsum(count) - count
    return pool[np.repeat(start - before, count) + np.arange(int(count.sum()))]


class Pool:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.size = np.empty(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> int:
        """Where the values begin now."""
        start, self.size = self.size, self.size + len(values)
        if self.size > len(self.data):
            wider = np.empty(2 * self.size, self.data.dtype)
            wider[:start] = self.data[:start]
            self.data = wider
        self.data[start : self.size] = values
        return start


class Memo:
    """Ids by content, found by hash and compared; beyond ``limit`` entries it starts again."""

    def __init__(self, dtype, limit: int):
        self.dtype, self.limit = dtype, limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.start = self.count = self.place = self.length = np.empty(0, np.int64)
        self.ids, self.bytes = Pool(self.dtype), Pool(np.uint8)

    def look_up(
        self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, make: Callable
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each stretch of ``data`` in turn; ``make(positions)`` gives counts and ids of new ones."""
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            own = first[new]
            counts, ids = make(own)
            lengths = end[own] - begin[own]
            starts = self.ids.add(ids.astype(self.dtype)) + np.cumsum(counts) - counts
            places = self.bytes.add(gather(data, begin[own], lengths)) + np.cumsum(lengths) - lengths
            self.start = np.insert(self.start, at[new], starts)
            self.count = np.insert(self.count, at[new], counts)
            self.place = np.insert(self.place, at[new], places)
            self.length = np.insert(self.length, at[new], lengths)
            self.keys = np.insert(self.keys, at[new], unique[new])
            at = np.searchsorted(self.keys, unique)
        entry = at[inverse]
        start, count = self.start[entry], self.count[entry]
        odd = np.flatnonzero(~self._same(entry, data, begin, end))
        pool = self.ids.data
        if len(odd):
            counts, ids = make(odd)
            start[odd], count[odd] = self.ids.size + np.cumsum(counts) - counts, counts
            pool = np.concatenate([pool[: self.ids.size], ids.astype(self.dtype)])
        found = gather(pool, start, count)
        if len(self.keys) > self.limit or self.ids.size > 8 * self.limit:
            self.clear()
        return count, found

    def _same(self, entry: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the stretches hold the very bytes of their entries."""
        length = end - begin
        same = self.length[entry] == length
        some = np.flatnonzero(same & (length > 0))
        length = length[some]
        whole = len(some) and length.sum() == len(data) and np.array_equal(begin[some][1:], end[some][:-1])
        want = data if whole else gather(data, begin[some], length)
        differ = np.flatnonzero(gather(self.bytes.data, self.place[entry[some]], length) != want)
        if len(differ):
            same[some[np.searchsorted(np.cumsum(length), differ, "right")]] = False
        return same


class Encoder:
    """Ids of texts as the tokenizers library gives them without adding special tokens."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        import os

        # Tasks are the parallelism; the library must not start threads of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(self.tokenizer.to_str())
        before = parts.get("pre_tokenizer") or {}
        if (
            parts.get("normalizer")
            or before.get("type") != "ByteLevel"
            or before.get("add_prefix_space")
            or not before.get("use_regex", True)
            or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in parts["added_tokens"])
        ):
            raise ValueError(f"{path} is no plain byte-level BPE")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        added = {t["id"]: t["content"].encode() for t in parts["added_tokens"]}
        self.apart = tuple(added.values())
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        letters = _byte_letters()
        spelled = [b""] * size
        for token, i in vocabulary.items():
            spelled[i] = added.get(i) or bytes(letters[c] for c in token)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.hash = SpanHash()
        self.stretches = Memo(self.dtype, memo_entries)
        self.chunks = Memo(self.dtype, memo_entries // 8)

    def encode(
        self, data: np.ndarray, starts: np.ndarray, chunked: bool = True
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in one buffer, and where each text's ids begin."""
        ends = np.append(starts[1:], len(data))
        cuts = borders(data, starts, self.apart)
        regions = cuts
        if chunked and len(data):
            edges = chunk_edges(data, starts)
            own = np.searchsorted(cuts, edges, "right") - 1
            spans = own[cuts[own] < edges]  # stretches with an edge inside: to be repaired
            after = cuts[np.minimum(spans + 1, len(cuts) - 1)]
            mask = np.zeros(len(data), bool)
            for some in (starts[starts < len(data)], cuts[own[cuts[own] == edges]], cuts[spans], after):
                mask[some] = True
            regions = np.flatnonzero(mask)
        out, begun, counted = [], [], []
        for low, high in self._slices(regions, len(data)):
            begin = regions[low:high]
            stop = int(regions[high]) if high < len(regions) else len(data)
            base = int(begin[0])
            part = data[base:stop]
            tops = np.append(begin[1:], stop) - base
            if chunked:
                count, ids = self._regions(part, begin - base, tops, cuts, base)
            else:
                count, ids = self._stretches(part, begin - base, tops)
            out.append(ids)
            begun.append(begin)
            counted.append(count)
        ids = np.concatenate(out) if out else np.empty(0, self.dtype)
        where = np.concatenate(begun) if begun else np.empty(0, np.int64)
        total = np.concatenate([[0], np.cumsum(np.concatenate(counted))]) if counted else np.zeros(1, np.int64)
        return ids, total[np.searchsorted(where, np.append(starts, ends[-1:]), "left")]

    @staticmethod
    def _slices(edges: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        low = 0
        while low < len(edges):
            high = int(np.searchsorted(edges, edges[low] + SLICE_BYTES, "right"))
            high = max(low + 1, high if high == len(edges) and size - edges[low] <= SLICE_BYTES else high - 1)
            yield low, high
            low = high

    def _regions(self, data, begin, end, cuts, base):
        keys = self.hash(data, begin, end)

        def make(new):
            inner = [cuts[a:b] for a, b in zip(*(np.searchsorted(cuts, x[new] + base) for x in (begin, end)))]
            sizes = np.array([len(x) for x in inner])
            starts = np.concatenate(inner) - base
            # A stretch ends where the next one of its region begins, or with the region.
            ends = np.append(starts[1:], 0)
            ends[np.cumsum(sizes) - 1] = end[new]
            count, ids = self._stretches(data, starts, ends)
            return np.add.reduceat(count, np.cumsum(sizes) - sizes), ids

        return self.chunks.look_up(keys, data, begin, end, make)

    def _stretches(self, data, begin, end):
        raw = data.tobytes()

        def make(new):
            pieces = [raw[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist())]
            return self._library(pieces)

        return self.stretches.look_up(self.hash(data, begin, end), data, begin, end, make)

    def _library(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of stretches; those that start at a border go in one call."""
        alone = [i for i, p in enumerate(pieces) if len(p) < 2 or p[0] != 32 or not _GOES_ON[p[1]]]
        odd = set(alone)
        joined = [i for i in range(len(pieces)) if i not in odd]
        order, counts, found = [], [], []
        at = 0
        while at < len(joined):
            group, size = [], 0
            while at < len(joined) and (not group or size < _JOINED_BYTES):
                group.append(joined[at])
                size += len(pieces[joined[at]])
                at += 1
            text = b"".join([pieces[i] for i in group])
            ids = self._call([text.decode("utf-8", "replace")])[0]
            tops = np.cumsum([len(pieces[i]) for i in group])
            reach = np.cumsum(self.lengths[ids])
            cut = np.searchsorted(reach, tops) + 1
            if len(ids) and cut[-1] == len(ids) and np.array_equal(reach[cut - 1], tops):
                order.extend(group)
                counts.append(np.diff(cut, prepend=0))
                found.append(ids)
            else:
                alone.extend(group)
        for low in range(0, len(alone), 1000):
            some = alone[low : low + 1000]
            parts = self._call([pieces[i].decode("utf-8", "replace") for i in some])
            order.extend(some)
            counts.append(np.array([len(x) for x in parts], np.int64))
            found.extend(parts)
        count, place = np.concatenate(counts), np.argsort(order)
        return count[place], gather(np.concatenate(found), (np.cumsum(count) - count)[place], count[place])

    def _call(self, texts: list[str]) -> list[np.ndarray]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.int64) for e in done]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        """The UTF-8 text of each stretch of ids, special tokens spelled out."""
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = ids[low:high]
            text = gather(self.spelled, self.offsets[own], self.lengths[own]).tobytes()
            try:
                text.decode("utf-8")
            except UnicodeDecodeError:
                text = self.tokenizer.decode(own.tolist(), skip_special_tokens=False).encode()
            yield text


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process, so that its memory serves all of its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each row begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, where, values = column.buffers()
    edges = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or values is None:
        return np.empty(0, np.uint8), np.zeros(len(column), np.int64)
    return np.frombuffer(values, np.uint8)[edges[0] : edges[-1]], edges[:-1] - edges[0]


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode every text; all columns of ``docs`` but the text, and digests.

    Adds ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit numbers) and
    ``decoded_sha256``; with ``ids`` also ``ids`` and ``decoded`` themselves. A column of
    ``docs`` with such a name is left out of the result. No shuffle.
    """
    new = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if ids:
        new += [("ids", pa.list_(pa.int64())), ("decoded", pa.string())]
    kept = [c for c in docs.columns if c != text and c.lower() not in {n for n, _ in new}]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    schema = ", ".join(x for x in (schema, DIGESTS + (", ids array<long>, decoded string" if ids else "")) if x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            data, starts = text_buffer(batch.column(len(kept)))
            found, bounds = own.encode(data, starts)
            columns = {n: [] for n, _ in new}
            for low, high, text_bytes in zip(bounds, bounds[1:], own.decode(found, bounds)):
                part = found[low:high]
                columns["n_tokens"].append(int(high - low))
                columns["ids_sha256"].append(hashlib.sha256(part.astype("<u4").tobytes()).hexdigest())
                columns["decoded_sha256"].append(hashlib.sha256(text_bytes).hexdigest())
                if ids:
                    columns["ids"].append(part.astype(np.int64))
                    columns["decoded"].append(text_bytes.decode("utf-8", "replace"))
            arrays = [batch.column(i) for i in range(len(kept))]
            arrays += [pa.array(columns[n], kind) for n, kind in new]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(n for n, _ in new)])

    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*kept, text])]
    return docs.select(*carried).mapInArrow(run, schema)
