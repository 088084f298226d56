"""Language-model scoring: cross-entropy difference of a target and a background bigram model.

Both models count words and word pairs, the background over all documents, the
target over the documents marked as target, with one vocabulary. Nothing is capped,
so the model grows with the corpus. The background's counts are scaled to the
target's number of words (matched models, so that smoothing weighs alike), pairs
fall back to words, and words to a uniform share of the vocabulary. A document's
score is the difference of the two losses by word; the lower, the nearer to the
target.

1. One pass counts the words, by 64-bit hash, into a table.
2. Pairs of two of the ``TOP`` most frequent words (or of a document's start and
   one of them) are counted into a matrix, whose size depends on ``TOP`` alone;
   it goes to all tasks, so the pairs that a third of all documents may hold are
   scored where the texts are, and no other pair can be more than one in ``TOP``
   of all.
3. All other pairs of each text are dealt out once, by word, those of a frequent
   word to several tasks by the word before it. There a window counts each pair
   next to its texts, a join by word adds the words' counts, and the sums of
   each text leave. The part of a loss that belongs to the word before is taken
   where that word itself is counted: every word but the last stands before one.

Defined cases: a null or wordless text has no words and null losses and score;
null and unknown ids in the target table mark nothing; repeated rows count and
are scored each; without target documents the target model is uniform; pairs and
words that the model has not seen count as 0; an empty table gives no rows; other
columns pass through, and where one is named like an output column the output
wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches, small_side, written
from docloom.llm.textops import ALNUM, Words, slices, text_bytes

#: Weight of the fallback, in words, and of the uniform share, in words of the vocabulary.
FALLBACK, UNIFORM = 50.0, 0.1
#: Most frequent words, whose pairs with each other are counted in a matrix.
TOP = 512
#: Bytes of text whose pairs are sorted and sent on together.
SLICE = 4 << 20
#: What stands before a document's first word, and what marks rows that are no pairs: a last word, and sums of a text.
START, LAST, SUMS = np.uint64(0x5EED << 40), 1, 2
#: What a row counts for: its text's score, the background, the target.
SCORED, COUNTED, MARKED = 1, 2, 4


def _hashed(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of the word before it (the document's start has one too), and whether it is a document's last."""
    h = words.hashes()
    before, last = np.empty_like(h), np.ones(len(h), bool)
    if len(h):
        first = np.ones(len(h), bool)
        first[1:] = words.row[1:] != words.row[:-1]
        before[1:] = h[:-1]
        before[first] = START
        last[:-1] = first[1:]
    return h, before, last


def _counted(value: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, and how often each occurs in all and in marked places."""
    out, inverse = np.unique(value, return_inverse=True)
    inverse = inverse.reshape(-1)
    return out, np.bincount(inverse, minlength=len(out)), np.bincount(inverse, weights=marked, minlength=len(out)).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _word_counts(batches):
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            data, off, _ = text_bytes(batch.column(0))
            words = Words(data, off, ALNUM)
            marked = np.asarray(batch.column(1))[words.row]
            h, before, _ = _hashed(words)
            for value, at in ((h, 0), (before, 2)):
                word, n, m = _counted(value, marked)
                none = np.zeros(len(word), np.int64)
                counts = [none, none, none, none]
                counts[at : at + 2] = n, m
                yield pa.RecordBatch.from_arrays([_signed(word), *map(pa.array, counts)], names=["word", "n", "m", "cn", "cm"])


@dataclass
class Top:
    """The most frequent words, ascending by hash, with their counts; the last row is the documents' start."""

    words: np.ndarray
    counts: np.ndarray  # n, m, cn, cm of each
    pairs: np.ndarray  # n and m of each pair (before, word)

    def places(self, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each word and of the word before it; -1 if it has none."""
        at = []
        for value in (h, before):
            k = np.searchsorted(self.words, value)
            k[k == len(self.words)] = 0
            at.append(np.where(self.words[k] == value, k, -1) if len(self.words) else np.full(len(value), -1))
        at[1][before == START] = len(self.words)
        return at[0], at[1]


def _top_pairs(top: Top):
    def count(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                data, off, _ = text_bytes(batch.column(0))
                words = Words(data, off, ALNUM)
                h, before, _ = _hashed(words)
                a, b = top.places(h, before)
                both = (a >= 0) & (b >= 0)
                pair, n, m = _counted(b[both] * (TOP + 1) + a[both], np.asarray(batch.column(1))[words.row[both]])
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n), pa.array(m)], names=["pair", "n", "m"])

    return count


_ROW = "word long, salt int, before long, key long, what long, t double, b double"


def _rows(kind: int, top: Top, busy: np.ndarray, parts: np.ndarray, loss):
    """Rows of the pairs that the matrix lacks; if the texts are scored also their last words, and the sums of what the matrix has.

    ``busy`` are the words dealt to several tasks, ascending, ``parts`` to how many.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                key, name, marked = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(3))
                data, off, _ = text_bytes(batch.column(2))
                words = Words(data, off, ALNUM)
                h, before, last = _hashed(words)
                a, b = top.places(h, before)
                both = (a >= 0) & (b >= 0)
                made = []

                def put(word, before, row, what, t=None, b=None):
                    salt = np.zeros(len(word), np.int64) if t is None else key[row] & 0xFFFFF  # noqa: B023
                    k = np.searchsorted(busy, word)
                    k[k == len(busy)] = 0
                    some = np.flatnonzero(busy[k] == word) if len(busy) and t is None else np.zeros(0, np.int64)
                    salt[some] = (before[some] % parts[k[some]].astype(np.uint64)).astype(np.int64)
                    sums = [pa.nulls(len(word), pa.float64()) if x is None else pa.array(x) for x in (t, b)]
                    made.append(pa.RecordBatch.from_arrays([_signed(word), pa.array(salt.astype(np.int32)), _signed(before), pa.array(key[row]), pa.array(what), *sums], names=["word", "salt", "before", "key", "what", "t", "b"]))  # noqa: B023

                rest = np.flatnonzero(~both)
                w, v, r = h[rest], before[rest], words.row[rest]
                order = np.lexsort((r, v, w))
                w, v, r = w[order], v[order], r[order]
                fresh = np.ones(len(w), bool)
                fresh[1:] = (w[1:] != w[:-1]) | (v[1:] != v[:-1]) | (r[1:] != r[:-1])
                at = np.flatnonzero(fresh)
                put(w[at], v[at], r[at], np.diff(np.append(at, len(w))) * 8 + kind + np.where(marked[r[at]] & bool(kind & COUNTED), MARKED, 0))
                if kind & SCORED:
                    end = np.flatnonzero(last & (a < 0))
                    put(h[end], np.full(len(end), LAST, np.uint64), words.row[end], np.full(len(end), 8 + SCORED))
                    sums = [np.zeros(batch.num_rows), np.zeros(batch.num_rows)]
                    for k, total in enumerate(sums):
                        own = np.zeros(len(h))
                        own[both] = loss.pair(k, top.pairs[b[both], a[both], k ^ 1], top.counts[a[both], k ^ 1])
                        known = b >= 0
                        own[known] += loss.context(k, top.counts[b[known], 2 + (k ^ 1)])
                        total += np.bincount(words.row, weights=own, minlength=batch.num_rows)
                    n = words.counts(batch.num_rows)
                    have = np.flatnonzero(n > 0)
                    put(name[have].view(np.uint64), np.full(len(have), SUMS, np.uint64), have, n[have] * 8 + SCORED, sums[0][have], sums[1][have])
                yield from made

    return run


@dataclass
class Losses:
    """The two parts of a pair's loss in nats, of the target (0) and the background (1)."""

    target: int
    background: int
    vocabulary: int

    @property
    def scale(self) -> float:
        return self.target / self.background if self.target and self.background else 1.0

    def _numbers(self, k: int) -> tuple[float, float]:
        scale = self.scale if k else 1.0
        return scale, (self.background * scale if k else self.target) + UNIFORM * self.vocabulary

    def pair(self, k: int, pair, word):
        """Of the counts of the pair and of its word."""
        scale, total = self._numbers(k)
        x = pair * scale + FALLBACK * (word * scale + UNIFORM) / total
        return -(F.log(x) if isinstance(x, Column) else np.log(x))

    def context(self, k: int, before):
        """Of the count of the word before."""
        x = before * self._numbers(k)[0] + FALLBACK
        return F.log(x) if isinstance(x, Column) else np.log(x)


@dataclass
class Model:
    """Counts over one vocabulary: n in all documents, m in target ones; cn and cm as the word before another."""

    texts: DataFrame
    marked: DataFrame  # the texts, and whether each is of the target
    words: DataFrame
    top: Top
    losses: Losses


def train(docs: DataFrame, target_ids: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Counts over all documents; ``target_ids`` has the ids of the target ones in its first column."""
    ids = target_ids.select(F.col(target_ids.columns[0]).alias("_target")).where(F.col("_target").isNotNull()).distinct()
    source = bound_batches(docs).select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"))
    marked = source.join(small_side(ids), F.col("_id") == F.col("_target"), "left").select("text", F.col("_target").isNotNull().alias("marked"))
    words = marked.mapInArrow(_word_counts, "word long, n long, m long, cn long, cm long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "m", "cn", "cm")))
    words = written(words, "words")
    total = words.agg(F.sum("n"), F.sum("m"), F.count_if(F.col("n") > 0)).first()
    start = int(START.view(np.int64))
    most = words.where("n > 0").orderBy(F.desc("n"), "word").limit(TOP).union(words.where(F.col("word") == start)).toArrow()  # TOP + 1 rows
    hashes = most.column("word").to_numpy().view(np.uint64)
    counts = np.stack([most.column(c).to_numpy() for c in ("n", "m", "cn", "cm")], axis=1) if len(hashes) else np.zeros((0, 4), np.int64)
    order = np.argsort(hashes[hashes != START])
    top = Top(hashes[hashes != START][order], np.vstack([counts[hashes != START][order], counts[hashes == START] if (hashes == START).any() else np.zeros((1, 4), np.int64)]), np.zeros((TOP + 1, TOP + 1, 2), np.int64))
    found = marked.mapInArrow(_top_pairs(top), "pair long, n long, m long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()  # TOP squared rows at most
    pair = found.column("pair").to_numpy()
    for k, c in enumerate(("n", "m")):
        top.pairs[pair // (TOP + 1), pair % (TOP + 1), k] = found.column(c).to_numpy()
    return Model(docs.select(F.col(text).cast("string").alias("text")), marked, words, top, Losses(total[1] or 0, total[0] or 0, max(1, total[2])))


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The documents with ``n_words``, ``target_loss``, ``background_loss`` and ``score`` (target less background, by word)."""
    names = ("n_words", "target_loss", "background_loss", "score")
    spark, losses, top = docs.sparkSession, model.losses, model.top
    # a word of more than this share of all is dealt to several tasks
    share = max(1, losses.background // min(65_536, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = F.ceil(F.col("n") / share).cast("int")
    busy = model.words.where(parts > 1).select("word", parts.alias("parts")).toArrow()  # bounded by the share
    words_of, parts_of = busy.column("word").to_numpy().view(np.uint64), busy.column("parts").to_numpy()
    order = np.argsort(words_of)
    deal = lambda kind: _rows(kind, top, words_of[order], parts_of[order], losses)
    plain = F.col(text).cast("string")
    source = bound_batches(docs).select(plain.alias("text"))
    # a text's number is short beside its hash, which only the row of its sums carries
    keyed = lambda df, mark: df.select(F.monotonically_increasing_id().alias("key"), F.xxhash64("text").alias("name"), "text", mark.alias("marked"))
    if source.sameSemantics(model.texts):
        rows = keyed(model.marked, F.col("marked")).mapInArrow(deal(SCORED | COUNTED), _ROW)
    else:  # the model's pairs, and those of other texts
        rows = keyed(model.marked, F.col("marked")).mapInArrow(deal(COUNTED), _ROW).union(keyed(source, F.lit(False)).mapInArrow(deal(SCORED), _ROW))
    times, kind = F.shiftright("what", 3), F.col("what").bitwiseAND(7)
    pair = W.partitionBy("word", "salt", "before")
    count = lambda bit: F.sum(F.when(kind.bitwiseAND(bit) > 0, times).otherwise(F.lit(0))).over(pair)
    counted = rows.repartition("word", "salt").withColumn("n", count(COUNTED)).withColumn("m", count(MARKED)).where(kind.bitwiseAND(SCORED) > 0)
    is_top = F.col("word").isin([int(x) for x in top.words.view(np.int64)]) if len(top.words) else F.lit(False)
    stats = model.words.where("n > 0").select(F.col("word"), F.col("n").alias("wn"), F.col("m").alias("wm"), "cn", "cm", is_top.alias("top"), F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("salt"))
    both = counted.join(stats.hint("merge"), ["word", "salt"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))

    def part(k: int, own: str, pair: str, word: str, before: str):
        context = losses.context(k, zero(before))
        loss = losses.pair(k, F.col(pair), zero(word)) + F.when(F.coalesce("top", F.lit(False)), F.lit(0.0)).otherwise(context)
        return F.when(F.col("before") == SUMS, F.col(own)).when(F.col("before") == LAST, -context).otherwise(times * loss)

    own = F.col("before") == SUMS
    tokens, name = F.sum(F.when(own, times)), F.max(F.when(own, F.col("word")))
    sums = both.groupBy("key").agg(name.alias("name"), (F.sum(part(0, "t", "m", "wm", "cm")) / tokens).alias("target"), (F.sum(part(1, "b", "n", "wn", "cn")) / tokens).alias("background"))
    # equal texts have equal losses
    sums = small_side(written(sums.groupBy("name").agg(F.max("target").alias("target"), F.max("background").alias("background")), "losses"))
    words = F.coalesce(F.regexp_count(plain, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    base = docs.select(*(c for c in docs.columns if c not in names), words.alias("n_words"), F.xxhash64(plain).alias("_key"))
    out = base.join(sums.select(F.col("name").alias("_text_key"), F.round("target", 6).alias("target_loss"), F.round("background", 6).alias("background_loss")), (F.col("_key") == F.col("_text_key")) & (F.col("n_words") > 0), "left")
    return out.withColumn("score", F.round(F.col("target_loss") - F.col("background_loss"), 6)).select(*(c for c in docs.columns if c not in names), *names)
