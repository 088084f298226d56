"""Best-fit packing of tokenised documents into sequences of bounded length.

A document is its token ids followed by an end id. Only a longer one than a
sequence is cut. The pieces (ids aside, a few numbers each) are dealt to tasks of
very many, and each task packs its own online, of the next few (twice as many as
sequences may be open) the longest first: a fixed number of sequences is open; a bitset holds which free spaces occur among them, so the best fit is the
lowest set bit at or above the piece's length; when too many are open, the
fullest closes. What is open when a task ends closes as it is, ``most_open``
sequences at most out of hundreds of thousands.

The tokeniser lower-cases, drops white space and splits texts into runs of
letters, single digits and runs of other signs, so the ids of such a run do not
depend on what stands around it. Each task keeps a bounded table of runs and
their ids; a run found by its hash is compared byte for byte, and only runs
outside the table go to the tokeniser. Any other tokeniser file gets whole texts.

Defined cases: a null or empty text is its end id alone; repeated rows are
packed each; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches, written
from docloom.llm.textops import LOWER, NONSPACE, Words, ranges, slices, text_bytes

#: Tokens of a sequence at most.
LENGTH = 2048
#: Sequences open at a time.
OPEN = 2_048
#: Pieces that one task packs, about.
PER_TASK = 2_000_000
#: Runs of characters that a task keeps the ids of.
KEPT_RUNS = 200_000
#: Bytes of text tokenised at a time.
SLICE = 1 << 20

#: How a tokeniser file normalises and splits texts if runs can be taken one by one.
BY_RUNS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}

#: Kinds of bytes: 0 white space, 1 ASCII letter, 2 other ASCII sign, 3 apostrophe, 4 beyond ASCII.
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[39] = 3
_KIND[128:] = 4

_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write a byte as a visible character: itself, or the next free one from 256 on.
_AS_CHAR = {b: b for b in _VISIBLE} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_VISIBLE}))}
_PLAIN_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


class Tokens:
    """Ids of whole texts through a tokeniser file, with a bounded table of runs."""

    def __init__(self, path: str, end_id: int, kept: int = KEPT_RUNS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.by_runs = all(said.get(k) == v for k, v in BY_RUNS.items()) and said["model"]["type"] == "BPE"
        self.end_id, self.kept = end_id, kept
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # ascending
        # of each key: place and length of its ids, and of its bytes
        self.at = self.length = self.byte_at = self.bytes = np.zeros(0, np.int64)
        self.ids, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        rest = []
        for i, x in enumerate(texts):
            if _PLAIN_WORD.fullmatch(x):
                out[i] = [t.id for t in self.model.tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(_AS_CHAR))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        ids = self._encode([x.decode("utf-8", "replace") for x in texts])
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        where = np.searchsorted(self.keys, keys)
        put = lambda old, new: np.insert(old, where, new)
        self.at, self.length = put(self.at, len(self.ids) + np.cumsum(length) - length), put(self.length, length)
        self.byte_at, self.bytes = put(self.byte_at, len(self.raw) + np.cumsum(size) - size), put(self.bytes, size)
        self.keys = put(self.keys, keys)
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))])
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(texts), np.uint8)])

    def _plainly(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts as the tokeniser gives them."""
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        each = [e.ids + [self.end_id] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, each)])
        return np.fromiter(chain.from_iterable(each), np.uint32, int(ends[-1])), ends

    def encode(self, data: np.ndarray, offsets: np.ndarray, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end ids among them, and the offsets of each text in them."""
        low = LOWER[data]
        text = low.tobytes()
        # special strings are tokens of their own, whatever stands around them
        if not self.by_runs or any(x in text for x in self.special):
            return self._plainly(data, offsets)
        if split and len(offsets) == 2 and len(data) > 2 * SLICE:  # a very long text, in parts that end where a run does
            cuts, space = [0], ~NONSPACE[data]
            while len(data) - cuts[-1] > 2 * SLICE:
                near = np.flatnonzero(space[cuts[-1] + SLICE : cuts[-1] + 2 * SLICE])
                if not len(near):  # one run without end
                    break
                cuts.append(cuts[-1] + SLICE + int(near[0]))
            parts = [self.encode(data[a:b], np.array([0, b - a]), False)[0][:-1] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
            ids = np.concatenate([*parts, np.array([self.end_id], np.uint32)])
            return ids, np.array([0, len(ids)])
        kind = _KIND[data]
        breaks = np.zeros(len(data), bool)
        breaks[1:] = kind[1:] * kind[:-1] == 2  # between a letter and another sign
        runs = Words(data, offsets, NONSPACE, breaks)
        keys, first, which = np.unique(runs.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.kept:
            self._clear()
        where = np.searchsorted(self.keys, keys)
        found = np.zeros(len(keys), bool)
        inside = where < len(self.keys)
        found[inside] = self.keys[where[inside]] == keys[inside]
        new = np.flatnonzero(~found)
        if len(new):
            self._learn(keys[new], [text[i:j] for i, j in zip(runs.start[first[new]].tolist(), runs.end[first[new]].tolist(), strict=True)])
            where = np.searchsorted(self.keys, keys)
        mine = where[which.reshape(-1)]
        size = runs.end - runs.start
        same = (self.bytes[mine] == size).all() and np.array_equal(self.raw[ranges(self.byte_at[mine], size)], low[ranges(runs.start, size)])
        if not same:  # two runs of one hash
            return self._plainly(data, offsets)
        length, at = self.length[mine], self.at[mine]
        total = np.zeros(len(mine) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        rows = len(offsets) - 1
        ends = total[np.cumsum(runs.counts(rows))]  # of each text, in ids without end ids
        ids = np.insert(self.ids[ranges(at, length)], ends, self.end_id)
        return ids, np.concatenate([[0], ends + np.arange(1, rows + 1)])


class BestFit:
    """Online best fit with a bounded number of open sequences."""

    def __init__(self, length: int, most_open: int):
        self.length, self.most = length, most_open
        self.bits = 0  # bit f: some open sequence has f free
        self.by_free: dict[int, list] = defaultdict(list)
        self.open = 0

    def _take(self, free: int) -> list:
        sequence = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return sequence

    def put(self, size: int, piece) -> list:
        """Place a piece; returns the sequences that close, each a list of (offset, size, piece)."""
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.length, []
        sequence.append((self.length - free, size, piece))
        free -= size
        if not free:
            return [sequence]
        self.by_free[free].append(sequence)
        self.bits |= 1 << free
        self.open += 1
        if self.open > self.most:
            return [self._take((self.bits & -self.bits).bit_length() - 1)]
        return []

    def rest(self) -> list:
        """The sequences still open."""
        return [s for free in sorted(self.by_free) for s in self.by_free[free]]


def _pieces(path: str, end_id: int, length: int, keep_ids: bool):
    def cut(batches):
        tokens = Tokens(path, end_id)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                data, off, _ = text_bytes(batch.column(1))
                ids, at = tokens.encode(data, off)
                n = -(-np.diff(at) // length)  # pieces of each text, one at least
                row = np.repeat(np.arange(batch.num_rows), n)
                piece = ranges(np.zeros(len(n), np.int64), n)
                start = piece * length
                size = np.minimum(np.diff(at)[row] - start, length)
                begin = (at[:-1][row] + start).tolist()
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[i : i + k].tobytes()) for i, k in zip(begin, size.tolist(), strict=True)]
                arrays = [batch.column(0).take(pa.array(row)), pa.array(piece), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
                if keep_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    return cut


def _packer(length: int, most_open: int):
    def pack(batches):
        fit, number = BestFit(length, most_open), 0
        names, kinds = [], []

        def rows(closed: list) -> pa.RecordBatch:
            nonlocal number
            made = []
            for sequence in closed:
                made += [(*piece, number, offset) for offset, _, piece in sequence]
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), [*kinds, pa.int64(), pa.int64()], strict=True)], names=[*names, "sequence", "offset"])

        def placed(some: list):
            closed = []
            for piece in sorted(some, key=lambda x: -x[3]):
                closed += fit.put(piece[3], piece)
            if closed:
                yield rows(closed)

        waiting: list = []
        for batch in batches:
            names, kinds = batch.schema.names, batch.schema.types
            for piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(piece)
                if len(waiting) == 2 * most_open:
                    yield from placed(waiting)
                    waiting = []
        if waiting:
            yield from placed(waiting)
        if fit.open:
            yield rows(fit.rest())

    return pack


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = 0, most_open: int = OPEN, per_task: int = PER_TASK, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it; with ``keep_ids`` also the ids.

    ``sequence_id`` is unique over all tasks.
    """
    source = bound_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece long, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    pieces = written(source.mapInArrow(_pieces(tokenizer, end_id, length, keep_ids), schema), "pieces")
    packed = pieces.repartition(1 + pieces.count() // per_task).mapInArrow(_packer(length, most_open), schema + ", sequence long, offset long")
    number = (F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("sequence")).alias("sequence_id")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", number, "offset", *["ids"] * keep_ids)
