"""Quality classifier: overlapping heuristic labellers, their accuracies by EM, and a hashed linear scorer.

Labellers look at whole texts and vote good, bad or nothing. How often each
combination of votes occurs, counted over all documents, is all that expectation
maximisation needs: a table whose size depends on the number of labellers alone.
It gives the labellers' vote probabilities in either class, and so a posterior
for each combination. Documents of a bounded sample, labelled by their
posteriors, train a logistic scorer over hashed words, word beginnings and style
marks, and the scorer judges every document. There are two such models, one for
poor and one for toxic texts; a document is kept if neither rejects it.

Where a table of human labels is given it is one more labeller, whose accuracy
is estimated like the others'.

Defined cases: a null or wordless text is poor (all its marks say so) and has
probabilities like any other; repeated rows are judged alike; an id labelled
more than once counts as labelled bad if any label says bad; an empty table
gives no rows; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import bound_batches
from docloom.llm.textops import ALNUM, NONSPACE, Words, mix, slices, text_bytes

#: Plain insults.
INSULTS = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]

#: Documents, about, whose posteriors train the scorer.
TRAIN_ROWS = 12_000
#: Slots of the hashed scorer, as a power of two.
BITS = 18
#: How much likelier a vote for bad is on bad documents than on good ones, at least: of a heuristic, and of a human.
PRECISE, HUMAN = 50.0, 500.0
#: Weight in training of a document that no human labelled and no heuristic called bad.
SILENT = 0.2
#: A heuristic knows one kind of bad text: it calls bad ones good at least this often, measured by how often it does good ones.
MISSES = 0.1
#: Probability of bad beyond which a document is rejected.
REJECT = 0.5

_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in "#$%&*<>{}[]\\^~=_+@"]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True

QUALITY_LABELLERS = ("capitals", "signs", "bars", "shouting", "repeats", "variety", "no_words")
TOXIC_LABELLERS = ("insult",)
_ABSTAIN = 2


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Marks:
    """Counts over a slice of texts on which labellers vote and the scorer builds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        self.rows = rows
        self.words = Words(data, offsets, ALNUM)
        self.hashes = self.words.hashes()
        row = self.words.row
        n = self.words.counts(rows)
        self.n = n
        d = np.maximum(n, 1)
        upper = (data >= 65) & (data <= 90)
        letters = _per_row(upper | ((data >= 97) & (data <= 122)), offsets)
        self.capitals = _per_row(upper, offsets) / np.maximum(letters, 1)
        self.signs = _per_row(_SIGNS[data], offsets) / d
        self.bars = _per_row(data == ord("|"), offsets) / d
        self.shouting = _per_row(data == ord("!"), offsets) / d
        self.stops = _per_row(_ENDS[data], offsets) / d
        same = np.zeros(len(row), bool)
        same[1:] = (self.hashes[1:] == self.hashes[:-1]) & (row[1:] == row[:-1])
        self.repeats = np.bincount(row[same], minlength=rows) / d
        # distinct words, sorted by row
        order = np.lexsort((self.hashes, row)) if len(row) else np.zeros(0, np.int64)
        h, r = self.hashes[order], row[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        self.distinct_order = order[fresh]
        self.variety = np.bincount(r[fresh], minlength=rows) / d
        self.insults = np.bincount(row[np.isin(self.hashes, _INSULT_HASHES)], minlength=rows)

    def votes(self) -> tuple[np.ndarray, np.ndarray]:
        """Combinations of votes on quality and on toxicity, as numbers in base 3; 1 good, 0 bad, 2 none."""

        def vote(bad, good):
            return np.where(bad, 0, np.where(good, 1, _ABSTAIN))

        some = self.n > 0
        q = [
            vote(some & (self.capitals > 0.5), some & (self.capitals < 0.2)),
            vote(some & (self.signs > 0.5), some & (self.signs < 0.1)),
            vote(some & (self.bars > 0.3), some & (self.bars < 0.05)),
            vote(some & (self.shouting > 0.3), some & (self.shouting < 0.1)),
            vote(some & (self.repeats > 0.3), some & (self.repeats < 0.1)),
            vote((self.n >= 50) & (self.variety < 0.15), (self.n >= 50) & (self.variety > 0.3)),
            vote(~some, np.zeros(self.rows, bool)),
        ]
        t = [
            vote(self.insults > 0, self.insults == 0),
        ]
        number = lambda votes: sum(v.astype(np.int64) * 3**k for k, v in enumerate(votes))
        return number(q), number(t)

    def slots(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, slot) of each document's distinct features, sorted by row."""
        w = self.words
        pick = self.distinct_order
        begin, begins = np.zeros(len(pick), np.uint64), []
        start, end = w.start[pick], w.end[pick]
        for k in range(6):
            inside = start + k < end
            begin[inside] = (begin[inside] << np.uint64(8)) | w.data[start[inside] + k]
            if k in (3, 5):
                begins.append(mix(begin ^ np.uint64((0xA5A5 + k) << 48)))
        r = w.row[pick]
        style_rows, style = [], []
        for k, share in enumerate((self.capitals, self.signs, self.bars, self.shouting, self.repeats, self.variety, self.stops)):
            style_rows.append(np.arange(self.rows))
            level = np.searchsorted([0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8], share)
            style.append(mix((np.uint64(1_000_003 * (k + 1)) + level.astype(np.uint64)) << np.uint64(20)))
        for k, number in enumerate(self.votes()):  # what the labellers say of the text is a feature each
            for j in range((len(QUALITY_LABELLERS), len(TOXIC_LABELLERS))[k]):
                style_rows.append(np.arange(self.rows))
                style.append(mix((number // 3**j % 3 + 10 * (j + 20 * k) + 7_000_000).astype(np.uint64) << np.uint64(24)))
        bias = np.full(self.rows, mix(np.array([99], np.uint64))[0])
        row = np.concatenate([r, r, r, *style_rows, np.arange(self.rows)])
        hashes = np.concatenate([self.hashes[pick], *begins, *style, bias])
        both = np.unique((row.astype(np.int64) << bits) | (hashes >> np.uint64(64 - bits)).astype(np.int64))
        return both >> bits, both & ((1 << bits) - 1)


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), ALNUM).hashes()


_INSULT_HASHES = _hash_words(INSULTS)


def _vote_rows(with_slots: bool, bits: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                data, off, _ = text_bytes(batch.column(1))
                m = Marks(data, off)
                q, t = m.votes()
                arrays, names = [batch.column(0), pa.array(q), pa.array(t)], ["doc_id", "q", "t"]
                if with_slots:
                    row, slot = m.slots(bits)
                    at = np.zeros(m.rows + 1, np.int32)
                    np.cumsum(np.bincount(row, minlength=m.rows), out=at[1:])
                    arrays.append(pa.ListArray.from_arrays(pa.array(at), pa.array(slot.astype(np.int32))))
                    names.append("slots")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def estimate(counts: dict[int, int], labellers: int, rounds: int = 100) -> tuple[dict[int, float], list, float]:
    """EM over combinations of votes: (probability of bad by combination, vote probabilities by labeller and class, share of bad).

    Labeller 0 is the human one.
    """
    if not counts:
        return {}, [], 0.0
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    votes = np.array([[k // 3**j % 3 for j in range(labellers)] for k in keys])
    bad = np.where((votes == 0).any(axis=1), 0.9, 0.05)
    for _ in range(rounds):
        share = min(max(float((n * bad).sum() / n.sum()), 1e-6), 1 - 1e-6)
        theta = np.zeros((labellers, 2, 3))
        for c, weight in enumerate((n * (1 - bad), n * bad)):
            for j in range(labellers):
                theta[j, c] = np.bincount(votes[:, j], weights=weight, minlength=3) + 0.1
                theta[j, c] /= theta[j, c].sum()
        # which class is which: a vote for bad must speak for it
        for j in range(labellers):
            most = theta[j, 1, 0] / (HUMAN if j == 0 else PRECISE)
            if theta[j, 0, 0] > most:
                theta[j, 0, 1:] *= (1 - most) / theta[j, 0, 1:].sum()
                theta[j, 0, 0] = most
            least = MISSES * theta[j, 0, 1]
            if j and theta[j, 1, 1] < least:
                theta[j, 1, [0, 2]] *= (1 - least) / theta[j, 1, [0, 2]].sum()
                theta[j, 1, 1] = least
        log = np.log(theta)
        odds = np.log(share / (1 - share)) + sum(log[j, 1, votes[:, j]] - log[j, 0, votes[:, j]] for j in range(labellers))
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        done = np.abs(new - bad).max() < 1e-9
        bad = new
        if done:
            break
    return dict(zip(keys, bad.tolist(), strict=True)), theta.tolist(), share


def fit_linear(row: np.ndarray, slot: np.ndarray, target: np.ndarray, weight: np.ndarray, bits: int, epochs: int = 12, batch: int = 64, step: float = 0.05, shrink: float = 1e-6) -> np.ndarray:
    """Weights of a logistic scorer on binary features: AdaGrad in small batches, the mean of the later epochs.

    row ascends from 0 and none is without features; the order of the rows is taken as it comes.
    """
    w, seen, total = np.zeros(1 << bits), np.full(1 << bits, 1e-6), np.zeros(1 << bits)
    n = len(target)
    at = np.searchsorted(row, np.arange(n + 1))
    for epoch in range(epochs):
        for i in range(0, n, batch):
            j = min(n, i + batch)
            mine, first = slot[at[i] : at[j]], at[i:j] - at[i]
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[mine], first), -30, 30)))
            slots, where = np.unique(mine, return_inverse=True)
            each = np.repeat((p - target[i:j]) * weight[i:j], np.diff(np.append(first, len(mine))))
            g = np.bincount(where.reshape(-1), weights=each) / (j - i) + shrink * w[slots]
            seen[slots] += g * g
            w[slots] -= step * g / np.sqrt(seen[slots])
        if 2 * epoch >= epochs:
            total += w
    return (total / max(1, epochs - (epochs + 1) // 2)).astype(np.float32)


class Model:
    """Two hashed linear scorers, and what EM said of the labellers."""

    def __init__(self, bits: int, quality: np.ndarray, toxic: np.ndarray, labellers: dict):
        self.bits, self.quality, self.toxic, self.labellers = bits, quality, toxic, labellers


def _says_bad(votes: int) -> bool:
    """Whether any labeller of the combination votes bad."""
    while votes:
        votes, one = divmod(votes, 3)
        if one == 0:
            return True
    return False


def _human(labels: DataFrame | None, ids: DataFrame) -> DataFrame:
    """Votes with the human ones put in front: one row a document."""
    if labels is None:
        return ids.withColumn("q", F.col("q") * 3 + _ABSTAIN).withColumn("t", F.col("t") * 3 + _ABSTAIN)
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("long").alias("_good"), F.max("toxic").cast("long").alias("_toxic"))
    out = ids.join(said, F.col("doc_id") == F.col("_id"), "left")
    q = F.when(F.col("_good") >= 1, 1).when(F.col("_good") == 0, 0).otherwise(_ABSTAIN)
    t = F.when(F.col("_toxic") >= 1, 0).when(F.col("_toxic") == 0, 1).otherwise(_ABSTAIN)
    return out.withColumn("q", F.col("q") * 3 + q).withColumn("t", F.col("t") * 3 + t).drop("_id", "_good", "_toxic")


def train(docs: DataFrame, labels: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, bits: int = BITS) -> Model:
    """A model from all documents' votes and the posteriors of about ``train_rows`` of them."""
    source = bound_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    votes = _human(labels, source.mapInArrow(_vote_rows(False, bits), f"doc_id {kind}, q long, t long"))
    table = votes.groupBy("q", "t").count().collect()
    counts_q: dict[int, int] = {}
    counts_t: dict[int, int] = {}
    for r in table:
        counts_q[r["q"]] = counts_q.get(r["q"], 0) + r["count"]
        counts_t[r["t"]] = counts_t.get(r["t"], 0) + r["count"]
    bad_q, theta_q, share_q = estimate(counts_q, len(QUALITY_LABELLERS) + 1)
    bad_t, theta_t, share_t = estimate(counts_t, len(TOXIC_LABELLERS) + 1)
    total = sum(counts_q.values())
    # the same documents whatever the partitioning, and after a lost task too
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * train_rows / max(total, 1))
    sample = source if total <= train_rows else source.where(drawn)
    rows = _human(labels, sample.mapInArrow(_vote_rows(True, bits), f"doc_id {kind}, q long, t long, slots array<int>")).select("q", "t", "slots", F.xxhash64("doc_id", F.size("slots"), F.element_at("slots", F.lit(-1))).alias("order")).toArrow()
    rows = rows.sort_by("order")  # the same order whatever the partitioning
    slot = rows.column("slots").combine_chunks()
    slot = slot.chunk(0) if isinstance(slot, pa.ChunkedArray) else slot
    length = np.diff(np.asarray(slot.offsets)) if len(slot) else np.zeros(0, np.int64)
    row, slot = np.repeat(np.arange(len(length), dtype=np.int32), length), np.asarray(slot.flatten()) if len(length) else np.zeros(0, np.int32)
    goal = lambda name, bad: np.array([bad[k] > 0.5 for k in rows.column(name).to_pylist()], float)
    sure = lambda name: np.array([1.0 if k % 3 != _ABSTAIN or _says_bad(k) else SILENT for k in rows.column(name).to_pylist()])
    said = {"quality": (share_q, dict(zip(("human", *QUALITY_LABELLERS), theta_q, strict=False))), "toxic": (share_t, dict(zip(("human", *TOXIC_LABELLERS), theta_t, strict=False)))}
    model = Model(bits, fit_linear(row, slot, goal("q", bad_q), sure("q"), bits), fit_linear(row, slot, goal("t", bad_t), sure("t"), bits), said)
    del rows, row, slot, length  # the driver needs the room for what follows
    pa.default_memory_pool().release_unused()
    return model


def _scorer(model: Model, text_at: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, whole.schema.names[text_at]):
                data, off, _ = text_bytes(batch.column(text_at))
                m = Marks(data, off)
                row, slot = m.slots(model.bits)
                at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                made = []
                for w in (model.quality, model.toxic):
                    odds = np.add.reduceat(w[slot].astype(np.float64), at)
                    made.append(pa.array(np.round(1 / (1 + np.exp(-np.clip(odds, -30, 30))), 6)))
                yield pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != text_at] + made, names=[n for k, n in enumerate(batch.schema.names) if k != text_at] + ["poor_probability", "toxic_probability"])

    return run


def score(docs: DataFrame, model: Model, *, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The documents with ``poor_probability``, ``toxic_probability`` and ``kept``."""
    names = ("poor_probability", "toxic_probability", "kept")
    packed = bound_batches(docs).select(F.struct("*").alias("_row"), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([packed.schema["_row"], T.StructField("poor_probability", T.DoubleType()), T.StructField("toxic_probability", T.DoubleType())])
    out = packed.mapInArrow(_scorer(model, 1), schema)
    kept = (F.col("poor_probability") <= reject) & (F.col("toxic_probability") <= reject)
    return out.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c not in names), *names[:2], kept.alias("kept"))
