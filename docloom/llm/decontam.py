"""Benchmark decontamination: a hash set of normalised test windows, scanned over whole training texts.

The windows of the benchmark (13 consecutive words; a shorter item is one
window) are hashed and sent to every task; the items are read in blocks of
bounded size, so the set that travels is bounded whatever the benchmark's size:
a larger benchmark takes more passes over the texts, each adding to the hits and
written to the shared folder before the next, so that no two sets travel together.
A window of a text whose hash is in the set is compared word for word before it
counts.

Defined cases: a null or wordless text has no words, no hits and is kept as it
is; null or wordless items contribute nothing; repeated items each count;
repeated rows and ids are judged row by row; empty tables give empty results;
other columns pass through untouched, and where one is named like an output
column the output wins.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import bound_batches, forget, written
from docloom.llm.textops import ALNUM, Words, ranges, slices, text_bytes, windows, within

#: Words in a window.
WINDOW = 13
#: Bytes of benchmark text that one pass carries to the tasks.
BLOCK_BYTES = 8 << 20

_OUT = ("n_words", "n_hit", "hit_spans", "hit_items")


class WindowSet:
    """Windows of benchmark items in sorted arrays of hashes, with the words that they stand for and the items that hold them."""

    _BITS = 20

    def __init__(self, items: list[tuple[int, str]], window: int):
        raw = [(text or "").encode("utf-8", "surrogatepass") for _, text in items]
        data = np.frombuffer(b"".join(raw), np.uint8)
        words = Words(data, np.cumsum([0, *map(len, raw)]), ALNUM)
        size = words.end - words.start
        # all words one after the other, one space between
        self.start = np.cumsum(size + 1) - (size + 1)
        self.end = self.start + size
        joined = np.full(int((size + 1).sum()), ord(" "), np.uint8)
        joined[ranges(self.start, size)] = words.data[ranges(words.start, size)]
        self.text = joined.tobytes()
        hashes, counts = words.hashes(), words.counts(len(items))
        wide = np.minimum(counts, window)[words.row]  # words of the windows of each word's item
        ids = np.array([i for i, _ in items], np.int64)
        self.by_length = {}
        for n in np.unique(wide).tolist():
            keys = windows(hashes, n)
            at = np.flatnonzero((wide[: len(keys)] == n) & within(words.row, n))
            at = at[np.argsort(keys[at], kind="stable")]
            maybe = np.zeros(1 << self._BITS, bool)
            maybe[(keys[at] >> np.uint64(64 - self._BITS)).astype(np.int64)] = True
            self.by_length[n] = keys[at], maybe, at, ids[words.row[at]]

    def hits(self, words: Words, hashes: np.ndarray):
        """(first word, length, items) of each window of the set that the texts hold."""
        for n, (keys, maybe, at, owner) in self.by_length.items():
            w = windows(hashes, n)
            some = np.flatnonzero(maybe[(w >> np.uint64(64 - self._BITS)).astype(np.int64)] & within(words.row, n))
            first, end = (np.searchsorted(keys, w[some], side=side) for side in ("left", "right"))
            found = np.flatnonzero(first < end)
            for i, a, b in zip(some[found].tolist(), first[found].tolist(), end[found].tolist(), strict=True):
                mine = words.join(i, n)  # word for word
                owners = [int(owner[k]) for k in range(a, b) if self.text[self.start[at[k]] : self.end[at[k] + n - 1]] == mine]
                if owners:
                    yield i, n, owners


def _merge(old: list | None, new: list[tuple[int, int]]) -> list[dict]:
    """Union of the runs of hit words; each is (first word, end)."""
    out: list[list[int]] = []
    for a, b in sorted([(x["first_word"], x["end_word"]) for x in old or []] + new):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"first_word": a, "end_word": b} for a, b in out]


_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))
_ITEMS = pa.list_(pa.int64())


def _scanner(windows_of: WindowSet, text: str, first_pass: bool):
    def scan(batches):
        for whole in batches:
            for batch in slices(whole, text):
                rows = batch.num_rows
                data, off, _ = text_bytes(batch.column(batch.schema.get_field_index(text)))
                words = Words(data, off, ALNUM)
                counts = words.counts(rows)
                first = np.zeros(rows + 1, np.int64)
                np.cumsum(counts, out=first[1:])
                spans: dict[int, list] = defaultdict(list)
                items: dict[int, set] = defaultdict(set)
                for i, n, owners in windows_of.hits(words, words.hashes()):
                    r = int(words.row[i])
                    a = i - int(first[r])
                    mine = spans[r]
                    if mine and a <= mine[-1][1] and a >= mine[-1][0]:
                        mine[-1] = (mine[-1][0], max(mine[-1][1], a + n))
                    else:
                        mine.append((a, a + n))
                    items[r].update(owners)
                old_spans = [None] * rows if first_pass else batch.column(batch.schema.get_field_index("hit_spans")).to_pylist()
                old_items = [None] * rows if first_pass else batch.column(batch.schema.get_field_index("hit_items")).to_pylist()
                all_spans = [_merge(old_spans[r], spans.get(r, [])) for r in range(rows)]
                all_items = [sorted({*(old_items[r] or ()), *items.get(r, ())}) for r in range(rows)]
                hit = [sum(x["end_word"] - x["first_word"] for x in s) for s in all_spans]
                keep = [(f, batch.column(i)) for i, f in enumerate(batch.schema) if f.name not in _OUT]
                made = [("n_words", pa.array(counts, pa.int64())), ("n_hit", pa.array(hit, pa.int64())), ("hit_spans", pa.array(all_spans, _SPANS)), ("hit_items", pa.array(all_items, _ITEMS))]
                yield pa.RecordBatch.from_arrays([c for _, c in keep] + [c for _, c in made], names=[f.name for f, _ in keep] + [n for n, _ in made])

    return scan


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int):
    """The items in runs of bounded size; only one run is on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("long"), F.col(text)).where(F.col(item_id).isNotNull()).toLocalIterator():
        n = len(row[1] or "") + 64
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block  # at least one pass, so that words are counted


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``hit_spans`` (runs of hit words) and ``hit_items``.

    A word is hit if it lies in an occurrence of a window. ``hit_items`` are the
    ids of the items that have an occurring window, ascending.
    """
    out = bound_batches(docs).drop(*_OUT)
    schema = T.StructType([*out.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]))), T.StructField("hit_items", T.ArrayType(T.LongType()))])
    for k, block in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        before = written(out, "hits") if k else out
        if k > 1:
            forget(last)
        last = before
        out = before.mapInArrow(_scanner(WindowSet(block, window), text, k == 0), schema)
    return out


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit", one_in: int = 20):
    """Whether enough of the words are hit: at least one, and one in ``one_in`` of all."""
    return (F.col(n_hit) > 0) & (F.lit(one_in) * F.col(n_hit) >= F.col(n_words))


def drop_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    kept = scan(docs.select(F.struct("*").alias("_row"), F.col(options.get("text", "text")).alias("_text")), benchmark, **{**options, "text": "_text"})
    return kept.where(~contaminated()).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def _cutter(text: str):
    def cut(batches):
        for whole in batches:
            for batch in slices(whole, text):
                at = batch.schema.get_field_index(text)
                data, off, nulls = text_bytes(batch.column(at))
                words = Words(data, off, ALNUM)
                first = np.zeros(batch.num_rows + 1, np.int64)
                np.cumsum(words.counts(batch.num_rows), out=first[1:])
                out = []
                for r, spans in enumerate(batch.column(batch.schema.get_field_index("hit_spans")).to_pylist()):
                    keep, at_byte = [], off[r]
                    for s in spans or []:
                        keep.append(data[at_byte : words.start[first[r] + s["first_word"]]])
                        at_byte = words.end[first[r] + s["end_word"] - 1]
                    keep.append(data[at_byte : off[r + 1]])
                    out.append(None if nulls[r] else b"".join(x.tobytes() for x in keep).decode("utf-8", "replace"))
                yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return cut


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents with the hit words cut out of the texts; all else stays."""
    found = scan(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), benchmark, text="_text", **options)
    cut = found.mapInArrow(_cutter("_text"), found.schema)
    return cut.select(*(F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns))


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row a document: counts, a hash of the items' ids, and the verdict."""
    names = F.array_sort(F.transform("hit_items", lambda x: x.cast("string")))
    return found.select(F.col(doc_id), "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), contaminated().alias("contaminated"))
