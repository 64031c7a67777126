"""Fill-in-the-middle transformation by a Fenwick tree over fixed blocks of the text.

A text is cut into units: code points, or the matches of a pattern from left to right (a unit
then reaches up to the next match, and what stands before the first match belongs to it). Of
each block of ``BLOCK`` bytes a Fenwick tree holds how many units and how many code points
begin there. A cut before a given unit descends the tree by binary lifting to its block,
summing up code points on the way, and looks for the boundary inside that block only.

Which texts are transformed, and where they are cut, follows from a digest of seed and id, so
that a task that is run again gives the same. A text that is empty or holds a sentinel stays
plain, since it could not be told apart afterwards; all others can be restored exactly.

Null texts are taken as empty, null ids as empty text in the digest. Rows are independent of
each other: repeated rows give repeated results, an empty table gives an empty one. Columns of
the table that are named like a new one are left out. A worker holds one batch of texts, and
for each text two bits of work per byte, whatever its length. No shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Rules:
    """How many texts in a hundred are transformed, and how many of these suffix first."""

    seed: int = 1
    percent: int = 90
    spm_percent: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str | None = None  # a pattern; none: code points

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def __post_init__(self):
        """Pieces must not be able to form a sentinel with the one they stand next to."""
        for sentinel in self.sentinels:
            if len(sentinel) < 2 or sentinel[0] in sentinel[1:]:
                raise ValueError(f"a sentinel's first character must not come again in it: {sentinel!r}")
        if len({s[0] for s in self.sentinels}) > 1 or len(set(self.sentinels)) < 3:
            raise ValueError("sentinels must differ and begin alike")
        if any(a != b and (a.startswith(b)) for a in self.sentinels for b in self.sentinels):
            raise ValueError("no sentinel may begin with another one")


class BlockTree:
    """Units and code points by block, as Fenwick trees; ``unit_starts`` marks first bytes."""

    def __init__(self, data: np.ndarray, unit: regex.Pattern | None = None, block: int = BLOCK):
        self.size, self.block = len(data), block
        self.code_starts = (data & 0xC0) != 0x80
        self.unit_starts = self.code_starts if unit is None else self._matches(data, unit)
        edges = np.arange(0, self.size, block)
        self.codes, total = self._tree(self.code_starts, edges)
        self.n_codes = self.n_units = total
        self.units = self.codes
        if unit is not None:
            self.units, self.n_units = self._tree(self.unit_starts, edges)

    def _matches(self, data: np.ndarray, unit: regex.Pattern) -> np.ndarray:
        found = [m.start() for m in unit.finditer(data.tobytes().decode()) if m.end() > m.start()]
        mask = np.zeros(self.size, bool)
        if self.size:
            mask[np.flatnonzero(self.code_starts)[found[1:]]] = True
            mask[0] = True
        return mask

    @staticmethod
    def _tree(mask: np.ndarray, edges: np.ndarray) -> tuple[list[int], int]:
        """Entry i sums the ``i & -i`` blocks up to the i-th; sums from running totals."""
        if not len(edges):
            return [0], 0
        sums = np.concatenate([[0], np.cumsum(np.add.reduceat(mask, edges, dtype=np.int64))])
        i = np.arange(1, len(sums))
        return [0, *(sums[i] - sums[i - (i & -i)]).tolist()], int(sums[-1])

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code point where a unit begins; the end of the text for the one after the last."""
        if unit >= self.n_units:
            return self.size, self.n_codes
        at = codes = 0
        step = 1 << (len(self.units) - 1).bit_length() >> 1
        while step:
            ahead = at + step
            if ahead < len(self.units) and self.units[ahead] <= unit:
                at = ahead
                unit -= self.units[at]
                codes += self.codes[at]
            step >>= 1
        low = at * self.block
        byte = low + int(np.flatnonzero(self.unit_starts[low : low + self.block])[unit])
        return byte, codes + int(np.count_nonzero(self.code_starts[low:byte]))


def draws(seed: int, doc_id) -> tuple[int, ...]:
    """The first four 32-bit numbers of the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def transform(
    text: bytes, doc_id, rules: Rules, unit: regex.Pattern | None, block: int = BLOCK
) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the text in its new order."""
    tree = BlockTree(np.frombuffer(text, np.uint8), unit, block)
    one, two, dice, turn = draws(rules.seed, doc_id)
    marks = [s.encode() for s in rules.sentinels]
    if not text or dice % 100 >= rules.percent or any(m in text for m in marks):
        return tree.n_units, PLAIN, None, None, text
    cuts = sorted((one % (tree.n_units + 1), two % (tree.n_units + 1)))
    (low, before), (high, upto) = (tree.cut(u) for u in cuts)
    head, body, tail = text[:low], text[low:high], text[high:]
    if turn % 100 < rules.spm_percent:
        out = b"".join([marks[1], tail, marks[0], head, marks[2], body])
        return tree.n_units, SPM, before, upto - before, out
    out = b"".join([marks[0], head, marks[1], tail, marks[2], body])
    return tree.n_units, PSM, before, upto - before, out


NEW = [
    ("n", pa.int64(), "long"),
    ("form", pa.string(), "string"),
    ("prefix_chars", pa.int64(), "long"),
    ("middle_chars", pa.int64(), "long"),
    ("output", pa.string(), "string"),
]


def fill_in_middle(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, then ``n, form, prefix_chars, middle_chars, output``."""
    kept = [c for c in docs.columns if c != text and c.lower() not in {name for name, _, _ in NEW}]
    if key not in kept:
        raise ValueError(f"the id must not be named like a new column: {key}")
    schema = ", ".join(
        [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{name} {kind}" for name, _, kind in NEW]
    )
    place = kept.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = regex.compile(rules.unit) if rules.unit else None
        for batch in batches:
            ids = batch.column(len(kept) + 1).to_pylist()
            texts = batch.column(len(kept)).fill_null("").cast(pa.binary())
            rows = [transform(t.as_py(), i, rules, unit) for t, i in zip(texts, ids)]
            new = [pa.array([r[j] for r in rows], pa.binary() if j == 4 else kind) for j, (_, kind, _) in enumerate(NEW)]
            new[4] = new[4].cast(pa.string())
            arrays = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(arrays + new, names=[*kept, *(name for name, _, _ in NEW)])

    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    carried += [F.col(f"`{text}`").cast("string").alias("body"), F.col(f"`{kept[place]}`").cast("string").alias("id")]
    return docs.select(*carried).mapInArrow(run, schema)


def restore(output: Column, form: Column, rules: Rules = Rules()) -> Column:
    """The text from which ``output`` was made; each sentinel comes once in it."""
    first, rest = {}, {}
    for name, mark in zip("PSM", rules.sentinels):
        first[name] = lambda c, m=mark: F.substring_index(c, m, 1)
        rest[name] = lambda c, m=mark: F.substring_index(c, m, -1)
    middle = rest["M"](output)
    psm = F.concat(first["S"](rest["P"](output)), middle, first["M"](rest["S"](output)))
    spm = F.concat(first["M"](rest["P"](output)), middle, first["P"](rest["S"](output)))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def fim_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per document the cut, and digests of the output and of what is restored from it."""
    made = fill_in_middle(docs.select("doc_id", "text"), rules)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
        F.sha2(F.encode(restore(F.col("output"), F.col("form"), rules), "UTF-8"), 256).alias("restored_sha256"),
    )
