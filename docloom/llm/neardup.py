"""MinHash near-duplicates: bottom-k sketches from one hash function, inverted lists, exact confirmation.

1. A document is its set of distinct word shingles, hashed once. Documents with
   equal sets are one node from here on, whatever their number.
2. A node's sketch is the k smallest hashes of its set. How many of a sketch's
   values at least are in another sketch too, if the node has any partner, is
   known: exactly for sets up to k, and for larger ones with a miss of one pair in
   ten million at the very threshold. Nodes below that have no partner. Mostly few
   are left, and only those get their whole sets from here on: k grows to the
   size of the set, so nothing more rests on chance.
3. Values are ordered by how many of these nodes hold them, the rarest first. Two
   similar sets meet in the first value that both hold, and for either it lies so
   far in front that enough others follow. An entry of an inverted list therefore
   carries its ``reach``: the size of the largest set that it could be linked with
   through this list. A pair counts if either's size is in the other's reach.
4. Lists are worked off in rounds. In the first, each list's best hub (the member
   with the fewest values of its own, as an original has whose altered copies are
   like it but not like each other) is paired with all others of the list. Links
   are contracted to components. From then on a list is about the few entries
   outside its largest component: a bounded and growing number of them is paired
   with all of the list in each round, and leaves it. A list of one component is
   done. No pair that could matter is left out, and a group of near copies of any
   size costs a few rows for each member.
5. Pairs pass a filter on the estimate from the union's sketch; the full sets
   decide, and no pair is tried twice.

Nothing is collected: the driver sees counts only. Every round's state is a
table in the shared folder.

Defined cases: a text with fewer words than a shingle is one shingle of all its
words; one without words (or null) has an empty set, links with nothing and is
its own component; rows that share an id are each judged by their own text and
the component has the smallest id; a null id is larger than any other, so a
component has it only if all of its rows have it (``kept`` is then true for one
text of the component); an empty table gives no rows; other columns are not
carried by ``near_duplicates`` and pass through ``keep_one``, which keeps exactly
one row of each component, also where rows or ids are repeated.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches, forget, small_side, written
from docloom.llm.graph import components
from docloom.llm.textops import NONSPACE, Words, mix, slices, text_bytes, windows, within

#: Words of a shingle, and percent of the union that the intersection must reach.
SHINGLE, PERCENT = 5, 75
#: Values of a sketch.
SKETCH = 64
#: Probability of missing a pair at the very threshold.
RARELY = 1e-7
#: Members of a list whose pairs are taken at once, and how many times as many hubs each round has.
SHORT, MORE = 8, 16
#: Pairs of one set that one task holds together.
TOGETHER = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles, ascending by row and then by hash."""
    words = Words(data, offsets, NONSPACE)
    h = words.hashes()
    rows = len(offsets) - 1
    n = words.counts(rows)
    full = within(words.row, size)
    row, value = words.row[: len(full)][full], windows(h, size)[full]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        first = np.zeros(rows + 1, np.int64)
        np.cumsum(n, out=first[1:])
        for k in range(1, size):
            of = short[n[short] == k]
            if len(of):
                at = first[of]
                value = np.concatenate([value, windows(h, k)[at]])
                row = np.concatenate([row, of])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def _keys(row: np.ndarray, value: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each row's set; the same set has the same name."""
    rows = len(n)
    at = np.zeros(rows, np.int64)
    np.cumsum(n[:-1], out=at[1:])
    out = np.zeros((rows, 2), np.uint64)
    some = np.flatnonzero(n > 0)
    if len(some):
        with np.errstate(over="ignore"):
            out[some, 0] = mix(np.add.reduceat(mix(value ^ np.uint64(0x1234567)), at[some]) + n[some].astype(np.uint64))
            out[some, 1] = mix(np.bitwise_xor.reduceat(mix(value + np.uint64(0x7654321)), at[some]) + n[some].astype(np.uint64) * np.uint64(3))
    raw = out.astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] if n[i] else None for i in range(rows)]


def _signed(value: np.ndarray) -> pa.Array:
    """Signed numbers in the order of the hashes, so that Spark sorts a union as it was cut."""
    return pa.array((value ^ np.uint64(1 << 63)).view(np.int64))


def _sketcher(size: int, k: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                data, off, _ = text_bytes(batch.column(2))
                rows = batch.num_rows
                row, value = shingle_sets(data, off, size)
                n = np.bincount(row, minlength=rows)
                at = np.cumsum(n) - n
                low = np.arange(len(row)) - np.repeat(at, n) < k
                lists = np.zeros(rows + 1, np.int32)
                np.cumsum(np.minimum(n, k), out=lists[1:])
                sketch = pa.ListArray.from_arrays(pa.array(lists), _signed(value[low]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(_keys(row, value, n), pa.binary()), sketch], names=["doc_id", "t", "n", "key", "sketch"])

    return run


def _set_rows(size: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                data, off, _ = text_bytes(batch.column(1))
                row, value = shingle_sets(data, off, size)
                n = np.bincount(row, minlength=batch.num_rows)
                at = np.zeros(batch.num_rows + 1, np.int32)
                np.cumsum(n, out=at[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(at), _signed(value))], names=["node", "n", "full"])

    return run


def _surely(k: int, share: float) -> int:
    """The most values that k draws, each common with this probability, fail to have in common once in ten million times."""
    below = 0.0
    for c in range(k + 1):
        below += comb(k, c) * share**c * (1 - share) ** (k - c)
        if below > RARELY:
            return max(1, c)
    return k


def _least_shared(percent: int, k: int):
    """How many values of a sketch are in other sketches too at least, if the set of n has a partner."""
    n = F.col("n")
    # what the sketch of a larger partner may have cut off is lost
    larger = F.greatest(F.lit(k) + n - F.floor(n * 100 / percent), F.lit(1))
    return F.when(n <= k, F.least(F.ceil(n * percent / 100), larger)).otherwise(F.lit(_surely(k, percent / 100)))


def _within_reach(entries: DataFrame, *, other: str | None = None) -> DataFrame:
    """Entries for whose size and reach the list holds a partner; with ``other``, one outside the largest component for those inside."""
    bounds = [F.min("n").alias("least"), F.max("reach").alias("most"), F.count("*").alias("size")]
    if other:
        bounds += [F.min(F.when(F.col(other), F.col("n"))).alias("least_other"), F.max(F.when(F.col(other), F.col("reach"))).alias("most_other")]
    found = entries.drop("size").join(entries.groupBy("v").agg(*bounds).where("size > 1"), "v")
    found = found.where((F.col("reach") >= F.col("least")) & (F.col("n") <= F.col("most")))
    if other:
        found = found.where(F.col(other) | ((F.col("reach") >= F.col("least_other")) & (F.col("n") <= F.col("most_other"))))
    return found.drop("least", "most", "least_other", "most_other")


def _lists(sets: DataFrame, percent: int) -> DataFrame:
    """The entries of the inverted lists: v, node, n, alone (values that no other set holds), reach."""
    values = sets.select("node", F.explode("full").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    mine = values.join(shared, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"))  # values of one document
    n, alone = F.col("n"), F.col("n") - F.size("shared")
    least = F.ceil(n * percent / 100)
    front = mine.join(sets.select("node", "n"), "node").where(F.size("shared") >= least)
    front = front.select("node", "n", alone.alias("alone"), F.posexplode(F.slice("shared", 1, F.size("shared") - least + 1)).alias("i", "x"))
    reach = F.floor((100 + percent) * (n - F.col("alone") - F.col("i")) / percent) - n
    return front.select(F.col("x.v").alias("v"), "node", "n", "alone", reach.alias("reach"))


def _links(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    # a set with very many partners goes to several tasks
    busy = pairs.select("a").union(pairs.select("b")).groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts")).where("parts > 1")
    busy = written(busy, "busy")
    few = small_side(busy)
    full = pairs
    for side, other in (("a", "b"), ("b", "a")):
        parts = F.coalesce("parts", F.lit(1))
        full = full.join(few.withColumnRenamed("a", side), side, "left").withColumn("part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
        spread = sets.select(F.col("node").alias(side), F.col("n").alias("n" + side), F.col("full").alias("f" + side)).join(few.withColumnRenamed("a", side), side, "left")
        spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        full = full.join(spread, [side, "part"]).drop("part")
    union = F.slice(F.array_sort(F.array_union(F.slice("fa", 1, k), F.slice("fb", 1, k))), 1, k)
    common = F.size(F.array_intersect(F.array_intersect(union, F.slice("fa", 1, k)), F.slice("fb", 1, k)))
    exact = (F.col("na") <= k) & (F.col("nb") <= k)  # then the sketches are the sets
    likely = exact | (common >= F.least(F.lit(_surely(k, percent / 100)), F.size(union)))
    both = F.when(likely, F.size(F.array_intersect("fa", "fb")))
    links = written(full.where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b"), "links")
    forget(busy)
    return links


def _labelled(entries: DataFrame, label: DataFrame) -> DataFrame:
    """Entries of lists of more than one component, with their component and whether it is other than the list's largest."""
    at = entries.join(label.toDF("node", "root"), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    largest = at.groupBy("v", "comp").agg(F.count("*").alias("n")).groupBy("v").agg(F.max(F.struct("n", "comp")).alias("largest"), F.count("*").alias("comps")).where("comps > 1")
    return at.join(largest, "v").withColumn("other", F.col("comp") != F.col("largest.comp")).drop("largest", "comps")


def _components(sets: DataFrame, percent: int, k: int) -> DataFrame | None:
    """(node, root) of all nodes that are linked and not their component's smallest; None if nothing is."""
    entries = written(_within_reach(_lists(sets, percent)).drop("size"), "lists")
    label, tested, tables, hubs = None, None, [], 1
    while True:
        if label is None:
            at = _within_reach(entries).withColumn("comp", F.col("node")).withColumn("other", F.lit(True))
        else:
            at = _within_reach(_labelled(entries, label), other="other")
        at = written(at, "lists")
        forget(entries)
        if at.limit(1).count() == 0:
            forget(at)
            break
        order = F.xxhash64("node")
        short = F.col("size") <= SHORT
        slot = F.when(short, order).otherwise(F.pmod(order, F.lit(hubs)))
        hub = at.where("other").groupBy("v", slot.alias("slot")).agg(F.min(F.struct("alone", order.alias("h"), "node", "comp", "n", "reach")).alias("hub"))
        hub = written(hub.select("v", F.col("hub.node").alias("hub"), F.col("hub.comp").alias("hub_comp"), F.col("hub.n").alias("hub_n"), F.col("hub.reach").alias("hub_reach")), "hubs")
        near = at.join(hub, "v").where("comp <> hub_comp AND n <= hub_reach AND hub_n <= reach")
        pairs = near.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "candidates")
        tables.append(pairs)
        tested = pairs if tested is None else tested.union(pairs)
        links = _links(pairs, sets, percent, k)
        edges = links
        if label is not None:
            root = label.toDF("_n", "_r")
            edges = links.join(root, F.col("a") == F.col("_n"), "left").select(F.coalesce("_r", "a").alias("a"), "b")
            edges = edges.join(root, F.col("b") == F.col("_n"), "left").select("a", F.coalesce("_r", "b").alias("b")).union(root.select("_n", "_r"))
        new = components(edges)
        rest = at.where(~short).join(hub.select("v", F.col("hub").alias("node")), ["v", "node"], "left_anti")
        entries = written(rest.select("v", "node", "n", "alone", "reach"), "lists")
        forget(at, hub, links, *([label] if label is not None else []))
        label, hubs = new, hubs * MORE
    forget(*tables)
    return label


def _judged(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, k: int) -> DataFrame:
    """doc_id, t (hash of the text), n, component (its id), first (whether id and text are the component's first)."""
    source = bound_batches(docs).select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("t"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    base = written(source.mapInArrow(_sketcher(shingle, k), f"doc_id {kind}, t long, n long, key binary, sketch array<long>"), "sketches")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")  # a null id is the largest
    # equal sets are one node
    nodes = written(base.where("key IS NOT NULL").groupBy("key").agg(F.min(name).alias("head"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    thin = written(base.select("doc_id", "t", "n", "key"), "documents")
    forget(base)
    values = nodes.select("node", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v")
    mine = values.join(shared, "v").groupBy("node").agg(F.count("*").alias("shared"))
    some = written(mine.join(nodes.select("node", "head", "n"), "node").where(F.col("shared") >= _least_shared(percent, k)).select("node", "head"), "partners")
    chosen = source.withColumn("head", name).join(small_side(some), "head").select("node", "text")
    sets = written(chosen.mapInArrow(_set_rows(shingle), "node long, n long, full array<long>"), "sets")
    if sets.groupBy("node").count().where("count > 1").limit(1).count():  # rows that repeat themselves
        sets, again = written(sets.dropDuplicates(["node"]), "sets"), sets
        forget(again)
    label = _components(sets, percent, k)
    heads = nodes.select("node", "key", "head")
    whole = heads.withColumn("comp", F.col("node")) if label is None else heads.join(label.toDF("node", "root"), "node", "left").select("key", "head", F.coalesce("root", "node").alias("comp"))
    whole = written(whole.select("key", "head", "comp"), "heads")
    forget(nodes, some, sets, *([label] if label is not None else []))
    smallest = whole.groupBy("comp").agg(F.min("head").alias("component"))
    out = thin.join(whole.join(smallest, "comp").select("key", "component"), "key", "left")
    first = F.coalesce(name == F.col("component"), F.lit(True))
    return out.select("doc_id", "t", "n", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component.doc_id")).alias("component"), first.alias("first"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, k: int = SKETCH) -> DataFrame:
    """One row a document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id of its component) and ``kept``."""
    out = _judged(docs, doc_id, text, shingle, percent, k)
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.col("first") & F.col("doc_id").isNull())
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, k: int = SKETCH) -> DataFrame:
    """One document of each component, that of the smallest id, with the columns it came with; texts without words all stay."""
    judged = written(_judged(docs, doc_id, text, shingle, percent, k), "judged")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_t"))
    gone = written(judged.where("NOT first").select(F.col("doc_id").alias("_gone"), F.col("t").alias("_gone_t")).distinct(), "gone")
    left = rows.join(small_side(gone), same("_id", "_gone") & same("_t", "_gone_t"), "left_anti")
    again = written(judged.where("first AND n > 0").groupBy(F.col("doc_id").alias("_again"), F.col("t").alias("_again_t")).count().where("count > 1").drop("count"), "again")
    forget(judged)
    if again.limit(1).count():  # one of each repeated row
        is_again = same("_id", "_again") & same("_t", "_again_t")
        left = left.join(small_side(again), is_again, "left_anti").union(left.join(small_side(again), is_again, "left_semi").dropDuplicates(["_id", "_t"]))
    return left.select("_row.*")
