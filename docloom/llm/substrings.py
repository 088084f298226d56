"""Exact substring dedup: every byte of a long string that also starts anywhere else is removed.

Suffixes that share their first ``length`` bytes with another one are adjacent in
the suffix order of all texts, and the rounds of interleave refinement that merge
the shards' Burrows-Wheeler transforms tell how long such common prefixes are.
Most suffixes are settled long before that many rounds, so they never enter them:

1. A string of ``length`` bytes is judged through its anchor: of the 8-byte grams
   that start in its first half, the one with the smallest hash, the leftmost of
   equals. Equal strings have their anchors at the same place inside, and the
   half string that follows the anchor is equal too. Each text is cut into runs
   of strings with a common anchor, named by a hash of the half string after it.
2. A run whose name occurs once is settled: nothing in it repeats. So is one that
   occurs more than once with all its bytes (a 128-bit digest): all of it repeats.
   Both take a count.
3. The runs that are left, mostly the ends of repeated passages, are merged. All
   that share a name meet in one task, whichever shard they are from. A round
   takes the byte that precedes each suffix (what a shard's transform holds for
   it) and stably partitions the interleave of the round before by it; a common
   prefix grows to one more than the least between its two suffixes in that
   interleave. Suffixes equally far from their anchors go through the rounds
   together, from the last byte to the first, and one leaves as soon as its
   longest common prefix cannot reach ``length`` any more. Where it does reach it,
   the string repeats. Bytes decide here, not hashes.
4. A name with very many different runs is dealt to several tasks; strings that
   are alone in theirs are counted once more over all of them, by digest.

Counts sum up before the shuffle and come back through joins whose large side
can be split, so a passage in a third of all documents is no hot spot. Every
table in between is in the shared folder, and no step changes its form with the
size of the input.

Defined cases: a null text is empty; a text shorter than ``length`` keeps all
its bytes; rows with the same id and text repeat each other and get the same
result; overlaps within one text count; an empty table gives no rows; other
columns pass through, and where one is named like an output column the output
wins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches, forget, written
from docloom.llm.textops import mix, ranges, runs, slices, text_bytes

#: Bytes of a string that must not occur twice.
LENGTH = 400
#: Different runs of one name that one task settles at a time, and runs of a task in all.
CHUNK, TASK = 8_192, 20_000
#: Bytes of one text handled at a time, and of contexts sent on together.
SEGMENT, SENT = 1 << 20, 1 << 20


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of each run of strings; places in the data."""
    n, half = len(data), length // 2
    size = np.diff(offsets)
    start = ranges(offsets[:-1], np.maximum(size - (length - 1), 0))
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    least = np.zeros(n, np.uint64)  # of each place: the hash of its gram, and the place in the low bits
    for k in range(8):
        least |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    least += np.uint64(1)
    least = mix(least)
    least &= ~np.uint64((1 << 31) - 1)
    least |= np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= half:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < half:
        least = np.minimum(least[: len(least) - (half - width)], least[half - width :])
    at = (least[start] & np.uint64((1 << 31) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return at[first], start[first], start[last]


def _segments(data: np.ndarray, offsets: np.ndarray, length: int, most: int):
    """(bytes, offsets, rows, base): short texts together, a long one in overlapping pieces."""
    size = np.diff(offsets)
    if size.max(initial=0) <= most:
        yield data, offsets, np.arange(len(size)), np.zeros(len(size), np.int64)
        return
    for r in range(len(size)):
        for a in range(0, max(1, int(size[r]) - length + 1), most):
            b = min(int(size[r]), a + most + length - 1)
            yield data[offsets[r] + a : offsets[r] + b], np.array([0, b - a]), np.array([r]), np.array([a])


def _document(doc_id: str, text: str) -> Column:
    """A 128-bit name of a row's id and text."""
    known = F.when(F.col(doc_id).isNull(), F.lit("n")).otherwise(F.concat(F.lit("i"), F.col(doc_id).cast("string")))
    return F.unhex(F.md5(F.concat_ws("\0", known, F.col(text).cast("string"))))


def _digest(x: bytes | memoryview) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


_RUN = ["name", "all", "row", "at", "before", "count"]


def _runs(length: int, segment: int):
    """Rows (name, digest of all bytes, document, anchor, bytes from first start to anchor, starts) of each run."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                data, off, _ = text_bytes(batch.column(1))
                for part, at, rows, base in _segments(data, off, length, segment):
                    a, s0, s1 = anchors(part, at, length)
                    if not len(a):
                        continue
                    raw = memoryview(np.ascontiguousarray(part))
                    seg = np.searchsorted(at, a, side="right") - 1
                    before, count = a - s0, s1 - s0 + 1
                    names = np.fromiter((xxhash.xxh3_64_intdigest(raw[i : i + length // 2]) for i in a.tolist()), np.uint64, len(a))
                    # the place of the anchor is part of what two equal runs have in common
                    every = [_digest(bytes(raw[i:j]) + k.to_bytes(4, "little")) for i, j, k in zip(s0.tolist(), (s1 + length).tolist(), before.tolist(), strict=True)]
                    place = a - at[:-1][seg] + base[seg]
                    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(every, pa.binary()), batch.column(0).take(pa.array(rows[seg])), pa.array(place), pa.array(before.astype(np.int32)), pa.array(count.astype(np.int32))], names=_RUN)

    return run


_ASKED = ("name", "row", "at", "before", "count", "more", "chunk", "chunks")


def _contexts(length: int):
    """The bytes of each run asked for: rows come with their text and the list of runs."""

    def run(batches):
        for batch in batches:
            asked = batch.column(batch.schema.get_field_index("asked"))
            texts = batch.column(batch.schema.get_field_index("text"))
            for r in range(batch.num_rows):
                each, text = asked[r].values, texts[r].as_buffer()
                at, before, count = (each.field(c).to_numpy() for c in ("at", "before", "count"))
                start, size = at - before, count.astype(np.int64) - 1 + length
                step = max(1, SENT // (2 * length))
                for i in range(0, len(each), step):
                    j = min(len(each), i + step)
                    part = pa.array([text[s : s + n].to_pybytes() for s, n in zip(start[i:j].tolist(), size[i:j].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(each.field(c).slice(i, j - i) for c in _ASKED), part], names=[*_ASKED, "bytes"])

    return run


def _least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first .. last], for each pair of places."""
    size = last - first + 1
    out = values[last]
    level, width, table = 0, 1, values
    depth = np.log2(size).astype(np.int64)
    most = int(depth.max(initial=0))
    while level < most:
        table = np.minimum(table[:-width], table[width:])  # of 2 width values each
        level, width = level + 1, 2 * width
        q = np.flatnonzero(depth == level)
        if len(q):
            out[q] = np.minimum(table[first[q]], table[last[q] - width + 1])
    return out


def repeats(data: np.ndarray, anchor: np.ndarray, before: np.ndarray, after: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, bytes before its anchor) of each string of ``length`` bytes that two contexts of a group share.

    A context is the bytes from ``before`` its anchor to ``after`` it; only strings
    equally far from their anchors are compared. The interleave of all contexts is
    refined byte by byte from the last to the first.
    """
    order = np.argsort(group, kind="stable")  # the interleave
    lcp = np.zeros(len(order), np.int64)  # common prefix of each suffix with the one before it
    found = []
    for place in range(int(after.max(initial=0)) - 1, -int(before.max(initial=0)) - 1, -1):
        if not len(order):
            break
        begun = place < after[order]
        symbol = np.where(begun, data[np.where(begun, anchor[order] + place, 0)].astype(np.int64), -1)
        key = group[order] * 257 + symbol + 1
        if (key[1:] < key[:-1]).any():
            turn = np.argsort(key, kind="stable")
            key = key[turn]
        else:
            turn = np.arange(len(order))
        new = np.zeros(len(order), np.int64)
        i = np.flatnonzero((key[1:] == key[:-1]) & (symbol[turn[1:]] >= 0)) + 1
        new[i] = 1 + _least_between(lcp, turn[i - 1] + 1, turn[i])
        order, lcp = order[turn], new
        near = np.maximum(lcp, np.append(lcp[1:], 0))
        if place <= 0:
            hit = order[near >= length]
            found.append((hit, np.full(len(hit), -place)))
        left = before[order] + place  # rounds that a suffix still has
        stay = np.flatnonzero((left > 0) & (near + left >= length))
        if len(stay) < len(order):
            lcp = np.minimum.reduceat(lcp[: stay[-1] + 1], np.append(0, stay[:-1] + 1)) if len(stay) else lcp[:0]
            order = order[stay]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([c for c, _ in found]), np.concatenate([x for _, x in found])


_SETTLED = "row binary, first long, last long, k binary"


def _settle(length: int):
    """Spans of repeated strings of the runs of one task; strings still open come with the digests that name them."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        name, at, before, count, more, chunks, chunk = (t.column(c).to_numpy() for c in ("name", "at", "before", "count", "more", "chunks", "chunk"))
        row, raw = t.column("row").combine_chunks(), t.column("bytes").combine_chunks()
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        data = np.frombuffer(raw.buffers()[2], np.uint8)
        _, group = np.unique(np.stack([name, chunk.astype(np.int64)]), axis=1, return_inverse=True)
        before, count = before.astype(np.int64), count.astype(np.int64)
        anchor = ends[:-1] + before
        which, far = repeats(data, anchor, before, np.diff(ends) - before, group.reshape(-1), length)
        twice = np.zeros(int(count.sum()), bool)  # of all strings of all runs
        start = np.cumsum(count) - count
        twice[start[which] + before[which] - far] = True
        of = np.repeat(np.arange(len(count)), count)
        place = at[of] - before[of] + np.arange(len(of)) - start[of]
        begin, end = runs(twice & ~more[of], of)
        yield pa.RecordBatch.from_arrays([row.take(pa.array(of[begin])), pa.array(place[begin]), pa.array(place[end - 1] + length), pa.nulls(len(begin), pa.binary())], names=["row", "first", "last", "k"])
        # other tasks need to know what this one has of names that are dealt to several
        view = memoryview(data)
        wide = np.flatnonzero((chunks > 1)[of])
        for i in range(0, len(wide), 20_000):
            w = wide[i : i + 20_000]
            begins = (ends[:-1][of[w]] + np.arange(len(of))[w] - start[of[w]]).tolist()
            keys = [_digest(name[g].tobytes() + bytes(view[b : b + length])) for b, g in zip(begins, of[w].tolist(), strict=True)]
            known = twice[w] | more[of[w]]
            rows = pa.array(np.where(known, -1, of[w]), mask=known)
            yield pa.RecordBatch.from_arrays([row.take(rows), pa.array(place[w]), pa.array(place[w] + length), pa.array(keys, pa.binary())], names=["row", "first", "last", "k"])

    return run


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """row (128-bit name of id and text) and ``spans``: stretches of bytes, first to before last, whose strings occur twice; they may overlap."""
    source = bound_batches(docs).where(F.octet_length(text) >= length).select(_document(doc_id, text).alias("row"), F.col(text).cast("string").alias("text"))
    every = written(source.mapInArrow(_runs(length, SEGMENT), "name long, all binary, row binary, at long, before int, count int"), "runs")
    names = every.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    names = written(names, "names")  # as a table of its own, so that the join can split a name of very many runs
    some = written(every.join(names.hint("merge"), "name"), "runs")
    forget(every, names)
    kinds = written(some.groupBy("name", "all").agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "before", "count")).alias("x")), "kinds")
    many = kinds.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1")
    many = written(many, "kinds")
    chunks = F.ceil(F.col("kinds") / CHUNK).cast("int")
    asked = kinds.join(many.hint("merge"), "name").select("name", "x.*", (F.col("n") > 1).alias("more"), F.pmod(F.xxhash64("all"), chunks).cast("int").alias("chunk"), chunks.alias("chunks"))
    asked = written(asked, "asked")
    forget(many)
    by_row = asked.groupBy("row").agg(F.collect_list(F.struct(*_ASKED)).alias("asked"))  # runs of one document
    # a row that repeats itself gives its runs once
    texts = source.dropDuplicates(["row"]) if source.groupBy("row").count().where("count > 1").limit(1).count() else source
    columns = "name long, row binary, at long, before int, count int, more boolean, chunk int, chunks int"
    bytes_of = texts.join(by_row.hint("merge"), "row").select("text", "asked").mapInArrow(_contexts(length), columns + ", bytes binary")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + asked.count() // TASK)
    settled = written(bytes_of.repartition(tasks, "name", "chunk").mapInArrow(_settle(length), _SETTLED), "settled")
    open_ = settled.where("k IS NOT NULL")
    twice = open_.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    late = open_.where("row IS NOT NULL").join(twice, "k").select("row", "first", "last")
    repeated = kinds.where("n > 1").select("name", "all")
    whole = some.join(repeated.hint("merge"), ["name", "all"]).select("row", (F.col("at") - F.col("before")).alias("first"), (F.col("at") - F.col("before") + F.col("count") - 1 + length).alias("last"))
    spans = settled.where("k IS NULL").select("row", "first", "last").union(late).union(whole)
    out = written(spans.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")  # of one document
    forget(some, kinds, asked, settled)
    return out


def _merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """The maximal stretches that spans cover together."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.append(True, first[1:] > last[:-1]))
    return list(zip(first[new].tolist(), last[np.append(new[1:], len(first)) - 1].tolist(), strict=True))


def _cut(keep_text: bool):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "_text"):
                spans, made = batch.column(2), []
                for text, mine in zip(batch.column(1), spans, strict=True):
                    raw = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
                    gone = _merged(mine.values.field("first").to_numpy(), mine.values.field("last").to_numpy()) if mine.is_valid else []
                    ends = [0, *(x for s in gone for x in s), raw.size]
                    kept = [raw[i:j] for i, j in zip(ends[::2], ends[1::2], strict=True)]
                    digest = hashlib.sha256()
                    for x in kept:
                        digest.update(x)
                    left = b"".join(map(memoryview, kept)).decode("utf-8", "replace") if keep_text and text.is_valid else None
                    made.append((raw.size, sum(j - i for i, j in gone), len(gone), digest.hexdigest(), left))
                columns = list(zip(*made, strict=True)) if made else [[]] * 5
                arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
                if keep_text:
                    arrays.append(pa.array(columns[4], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=["_row", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["_kept"] * keep_text])

    return run


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """The documents with repeated bytes cut out of the texts, and ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A cut inside a character leaves bytes that are no UTF-8; they read as the
    replacement sign, while ``kept_sha256`` is of the bytes. Without
    ``keep_text`` the texts are left out.
    """
    out = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    spans = repeated_spans(docs, doc_id=doc_id, text=text, length=length)
    columns = [c for c in docs.columns if c not in out and (keep_text or c != text)]
    base = docs.select(F.struct(*(c for c in columns if c != text)).alias("_row"), F.col(text).cast("string").alias("_text"), _document(doc_id, text).alias("_key"))
    joined = base.join(spans.withColumnRenamed("row", "_key").hint("merge"), "_key", "left").select("_row", "_text", "spans")
    kind = joined.schema["_row"].dataType.simpleString()
    cut = joined.mapInArrow(_cut(keep_text), f"_row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", _kept string" * keep_text)
    return cut.select(*(F.col("_kept").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in columns), *out)
