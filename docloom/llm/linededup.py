"""Line dedup: a suffix array over line sequences by prefix doubling, in DataFrame operations alone.

A document is the sequence of its lines that are not blank. With ``whole``, a line
is deleted if it lies in a run of at least ``min_chars`` characters that also
occurs earlier, in an earlier document or place; so of each maximal repeated run
all copies but the first go. Without it only the shortest run of ``min_chars``
characters from each line on is compared: last lines of a repeat that are together
shorter than that stay.

Level 0 ranks the lines that occur more than once. Level j + 1 ranks the runs of
2^(j+1) lines by the pair of ranks of their halves; only runs that occur more
than once stay, so each level is the part of the suffix array whose common
prefix with a neighbour is that long, and its groups of equal rank are the
longest-common-prefix intervals. Ranks come from a range-partitioned sort of the
distinct pairs, hot or not one row each, and keep their order. A run of L lines
is told by two overlapping runs of 2^j lines, as usual. As every line has a
character, no run needs more than log2(min_chars) levels, however long the
maximal ones are: with ``whole`` the shortest runs up to each line are compared
too, and each line of a longer repeat lies in the shortest run from the repeat's
first line on or in the shortest run up to the line itself, both in the repeat.

Defined cases: a null text stays null and an empty one empty; rows with the same
id and text are one document and get the same result; rows with a null id have no
place in the order: they stay as they are and are no copy's original; blank lines are never
deleted; "earlier" is by id, then text hash, then line; an empty table gives no
rows; other columns pass through, and where one is named like an output column
the output wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import forget, small_side, written

#: Characters of a run that is worth deleting.
MIN_CHARS = 40


def _ranked(runs: DataFrame, by: list[str], what: str) -> DataFrame:
    """Distinct values of ``by`` that occur more than once, with an ascending rank ``r``."""
    more = runs.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return written(more.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("r", F.monotonically_increasing_id()), what)


def _run_length(lengths: Column, at: Column, least: int) -> Column:
    """Lines from the one at index ``at`` on that make ``least`` characters; null if too few are left."""
    state = F.aggregate(
        F.slice(lengths, at + 1, F.lit(least)),
        F.struct(F.lit(0).alias("chars"), F.lit(0).alias("lines")),
        lambda s, x: F.when(s["chars"] >= least, s).otherwise(F.struct((s["chars"] + x).alias("chars"), (s["lines"] + 1).alias("lines"))),
    )
    return F.when(F.get(lengths, at) >= least, 1).otherwise(F.when(state["chars"] >= least, state["lines"]))


def _ending_at(lengths: Column, at: Column, least: int) -> Column:
    """Lines up to the one at index ``at`` that make ``least`` characters; null if too few are before."""
    first = F.greatest(at - least + 1, F.lit(0))
    return _run_length(F.reverse(F.slice(lengths, first + 1, at - first + 1)), F.lit(0), least)


def _needs(at: Column, least: int, whole: bool) -> Column:
    """Numbers of lines of the runs from the line at index ``at`` on that are compared, from ``lengths`` and ``backs``."""
    forward = _run_length(F.col("lengths"), at, least)
    ahead = F.array(forward)
    if whole:
        # a run up to a line that begins here has a line of the next least - 1 as its last
        ends = F.transform(F.slice("backs", at + 1, F.lit(least)), lambda b, k: F.when(b == k + 1, b))
        ahead = F.concat(ahead, ends)
    return F.array_distinct(F.filter(ahead, lambda x: x.isNotNull()))


def _lines(docs: DataFrame, doc_id: str, text: str, least: int, whole: bool) -> DataFrame:
    """d, t, p (place among lines that are not blank), i (among all), needs (lines of the runs from it on), and 128 bits for the line."""
    every = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    base = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("t"), F.filter(every, lambda s: F.trim(s["x"]) != "").alias("lines"))
    base = base.withColumn("lengths", F.transform("lines", lambda s: F.length(s["x"])))
    if whole:
        base = base.withColumn("backs", F.transform("lengths", lambda x, p: _ending_at(F.col("lengths"), p, least)))
    packed = F.transform("lines", lambda s, p: F.struct(p.alias("p"), s["i"].alias("i"), _needs(p, least, whole).alias("needs"), F.xxhash64(s["x"]).alias("h1"), F.xxhash64(F.lit(20177), s["x"]).alias("h2")))
    return base.select("d", "t", F.inline(packed)).where(F.col("d").isNotNull())


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, whole: bool = True) -> DataFrame:
    """d, t (hash of the text) and ``spans``: first and last index of each maximal run of lines to delete, blank ones between included."""
    lines = written(_lines(docs, doc_id, text, min_chars, whole).dropDuplicates(["d", "t", "p"]), "lines")
    ranks = _ranked(lines, ["h1", "h2"], "ranks")
    now = written(lines.join(ranks, ["h1", "h2"]).select("d", "t", "p", "needs", "r"), "suffixes")
    forget(ranks)
    kept = [now]
    size, done = 1, None
    while True:
        # runs of size .. 2 size - 1 lines are told by their first and their last size lines
        mine = now.select("d", "t", "p", "r", F.explode("needs").alias("need")).where((F.col("need") >= size) & (F.col("need") < 2 * size))
        if size == 1:
            ends = mine.select("d", "t", "p", "need", F.lit(size).alias("level"), F.col("r").alias("ra"), F.col("r").alias("rb"))
        else:
            tail = now.select("d", "t", F.col("p").alias("q"), F.col("r").alias("rb"))
            ends = mine.withColumn("q", F.col("p") + F.col("need") - size).join(tail, ["d", "t", "q"]).select("d", "t", "p", "need", F.lit(size).alias("level"), F.col("r").alias("ra"), "rb")
        done = ends if done is None else done.union(ends)
        longer = now.where(F.exists("needs", lambda x: x >= 2 * size)).select("d", "t", "p").limit(1).count()
        if not longer:
            break
        second = now.select("d", "t", (F.col("p") - size).alias("p"), F.col("r").alias("r2"))
        pairs = written(now.withColumnRenamed("r", "r1").join(second, ["d", "t", "p"]), "pairs")
        ranks = _ranked(pairs, ["r1", "r2"], "ranks")
        now = written(pairs.join(ranks, ["r1", "r2"]).select("d", "t", "p", "needs", "r"), "suffixes")
        forget(pairs, ranks)
        kept.append(now)
        size *= 2
    done = written(done, "runs")
    forget(*kept)
    # need is part of the class: two runs of different length may share both ends
    by = ["level", "need", "ra", "rb"]
    first = done.groupBy(*by).agg(F.min(F.struct("d", "t", "p")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "firsts")  # so that a class of very many runs can be split in the join
    later = done.join(small_side(first), by).where(F.struct("d", "t", "p") != F.col("first"))
    gone = later.select("d", "t", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("need") - 1)).alias("p")).distinct()
    places = gone.join(lines.select("d", "t", "p", "i"), ["d", "t", "p"])
    # places of one document: runs of consecutive p
    grouped = places.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("p", "i"))).alias("x"))
    starts = F.filter("x", lambda s, k: (k == 0) | (F.get(F.col("x"), k - 1)["p"] != s["p"] - 1))
    stops = F.filter("x", lambda s, k: F.coalesce(F.get(F.col("x"), k + 1)["p"] != s["p"] + 1, F.lit(True)))
    spans = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda s: F.struct(s["a"]["i"].alias("first"), s["b"]["i"].alias("last"), (s["b"]["p"] - s["a"]["p"] + 1).alias("lines")))
    out = written(grouped.select("d", "t", spans.alias("spans")), "spans")
    forget(lines, done, first)
    return out


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, whole: bool = True) -> DataFrame:
    """The documents with later copies of repeated runs deleted from the texts, and ``removed_lines``, ``removed_runs``."""
    spans = repeated_spans(docs, doc_id=doc_id, text=text, min_chars=min_chars, whole=whole)
    spans = small_side(spans)
    out = ("removed_lines", "removed_runs")
    base = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_d"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
    joined = base.join(spans, (F.col("_d") == F.col("d")) & (F.col("_t") == F.col("t")), "left")
    blank = lambda x: F.trim(x) == ""
    left = F.filter(F.split("_text", "\n"), lambda x, i: blank(x) | ~F.exists("spans", lambda s: (i >= s["first"]) & (i <= s["last"])))
    new = F.when(F.col("spans").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n"))
    lines = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["lines"]), F.lit(0)).cast("long")
    runs = F.when(F.col("spans").isNull(), F.lit(0)).otherwise(F.size("spans")).cast("long")
    return joined.select(*(new.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in out), lines.alias("removed_lines"), runs.alias("removed_runs"))
