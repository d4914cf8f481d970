"""MinHash near-dedup (operator 6): an LSH forest of sorted signature orders.

1. Each text becomes its set of word shingles, a 128-bit digest of that set and ``trees * depth`` minhashes.
   Texts with equal sets are one class from here on, so exact copies cost one row however many they are.
2. Each tree orders the classes by their minhashes, starting at that tree's own, so that neighbours share the
   longest common prefixes. A class meets its ``window`` nearest places whose common prefix is ``depth`` long
   at least: where a region is crowded these agree to a greater depth, where it is sparse ``depth`` decides.
   Orders are range-partitioned, so a region of any size spreads over tasks; rows at the ends of tasks are
   compared in a further, much smaller order. Each class's best partner of all trees is verified on the full
   sets, and these links form components. This joins most of a large group of copies cheaply; it decides no link alone.
3. Every region (equal ``depth`` leading minhashes in a tree) that still holds more than one component is then
   searched whole: its classes come with their full sets, and each pair of different components is verified
   where it stands, so no candidate pairs are written; only links that join two components come out. Regions
   beyond ``block`` shingles are cut into blocks, and each pair of blocks is work of its own; pairs within the
   region's largest component need none.

All pairs that share a region in some tree are decided exactly: of pairs of similarity 0.8, 20 trees of depth 4
miss one in 38,000, of 0.9 one in 10**9, and a link is lost only if no chain of other links joins its ends.

Defined results: texts that are null, empty or only white space have no shingles, are linked with nothing
and are their own component. Fewer words than the width make one shingle. Rows that repeat an id, or have
a null id, are rows of their own; a component's id is the smallest id that is not null in it. The row kept has
the smallest (id, text fingerprint), null ids last; of rows that repeat both, ``keep_one_of_each`` keeps one. Very long
texts are read whole, some at a time. Other columns are not read, so their names may clash with any used here;
``keep_one_of_each`` passes them through. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, Scratch, WordHasher, mixed, shingle_hashes, slices, text_key, text_or_empty
from .components import connected_components

_WORDS = WordHasher()
PAIRS = "kind int, pid int, a binary, b binary, est int, key binary, n int"


def _perms(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * MIX_A)
    return seeds[:count] | np.uint64(1), seeds[count:]


def _signed(trees: int, depth: int, width: int, slice_bytes: int = 1_000_000):
    """Rows (id, text_key, text) -> (id, text_key, n, node, sig): sig holds each minhash as 4 bytes."""
    mul, add = _perms(trees * depth)

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            counts, nodes, sigs = [], [], []
            for a, b in slices([len(t) for t in texts], slice_bytes):
                sets = [np.unique(shingle_hashes(_WORDS.hashes(t.lower().split()), width)) for t in texts[a:b]]
                full = [s for s in sets if len(s)]
                starts = np.cumsum([0, *map(len, full)])[:-1]
                if full:
                    flat = np.concatenate(full)
                    mins = np.empty((len(full), len(mul)), ">u4")
                    for j in range(len(mul)):
                        mins[:, j] = np.minimum.reduceat(flat * mul[j] + add[j], starts) >> np.uint64(32)
                rows = iter(range(len(full)))
                for s in sets:
                    counts.append(len(s))
                    nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(mins[next(rows)].tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], names=["_ax_id", "_ax_text", "n", "node", "sig"])

    return run


def _ordered(trees: list[int], total: int, depth: int):
    """Rows (node, n, sig) -> one row per tree: its key is tree, the tree's minhashes, then a byte of each minhash from there on."""

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(m, total, 4)
            keys = []
            for t in trees:
                own = sig[:, t * depth : (t + 1) * depth].reshape(m, -1)
                rest = np.roll(sig[:, :, 3], -t * depth, axis=1)
                keys.append(np.c_[np.full((m, 1), t // 256, np.uint8), np.full((m, 1), t % 256, np.uint8), own, rest])
            size = keys[0].shape[1]
            buf = pa.py_buffer(np.concatenate(keys).tobytes())
            key = pa.Array.from_buffers(pa.binary(), m * len(trees), [None, pa.py_buffer((np.arange(m * len(trees) + 1) * size).astype(np.int32).tobytes()), buf])
            again = lambda c: pa.concat_arrays([batch.column(c)] * len(trees))
            yield pa.RecordBatch.from_arrays([again(0), again(1), key], names=["node", "n", "key"])

    return run


def _neighbours(depth: int, window: int, agree: int, similarity: tuple[int, int]):
    """Rows (node, n, label, key) in order, one partition -> each row's best partner (kind 0) and the rows at its ends (kind 1).

    A partition is a range of bounded size, held as arrays.
    """
    head = 2 + 4 * depth
    num, den = similarity

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        nodes, keys = (t.column(c).to_pylist() for c in ("node", "key"))
        n = np.array(t.column("n").to_pylist(), np.int64)
        grid = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
        names = {x: i for i, x in enumerate(dict.fromkeys(nodes))}
        node = np.array([names[x] for x in nodes])
        # bytes of the prefix that each row shares with the next one, of the bytes that tell regions apart
        apart = grid[1:, :head] != grid[:-1, :head]
        shared = np.where(apart.any(1), apart.argmax(1), head)
        left, right, ests = [], [], []
        at, common = np.arange(len(n)), np.full(len(n), head)
        for o in range(1, min(window, len(n) - 1) + 1):
            common = np.minimum(common[: len(n) - o], shared[o - 1 :])
            i = at[: len(n) - o][common == head]
            if not len(i):
                break
            j = i + o
            ok = (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & (node[i] != node[j])
            for x, y in ((i[ok][a : a + 50_000], j[ok][a : a + 50_000]) for a in range(0, int(ok.sum()), 50_000)):
                est = (grid[x, head:] == grid[y, head:]).sum(1)
                ok_ = est >= agree
                left.append(x[ok_]), right.append(y[ok_]), ests.append(est[ok_])
        i, j, est = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right, ests))
        if len(i):
            mine, other, e = np.r_[i, j], np.r_[j, i], np.r_[est, est]
            order = np.lexsort((other, -e, node[mine]))
            chosen = order[np.r_[True, np.diff(node[mine][order]) != 0]]
            i, j, est = mine[chosen], other[chosen], e[chosen]
        pid = TaskContext.get().partitionId()
        ends = sorted({*range(min(window, len(n))), *range(max(0, len(n) - window), len(n))})
        k, m = len(i), len(ends)
        none = [None] * k
        yield pa.RecordBatch.from_arrays([
            pa.array([0] * k + [1] * m, pa.int32()), pa.array([pid] * (k + m), pa.int32()),
            pa.array([nodes[x] for x in i.tolist()] + [nodes[x] for x in ends], pa.binary()), pa.array([nodes[x] for x in j.tolist()] + [None] * m, pa.binary()), pa.array([*est.tolist(), *[None] * m], pa.int32()),
            pa.array(none + [keys[x] for x in ends], pa.binary()), pa.array(none + [int(n[x]) for x in ends], pa.int32()),
        ], names=["kind", "pid", "a", "b", "est", "key", "n"])

    return run


def candidates(rows: DataFrame, trees: list[int], total: int, depth: int, window: int, agree: int, similarity, keep: Scratch, task_rows: int = 40_000) -> DataFrame:
    """(a, b, est) of neighbours in the orders of ``trees``: partners that classes named. ``rows``: (node, n, sig), one per class."""
    spark = rows.sparkSession
    scan = _neighbours(depth, window, agree, similarity)
    order = rows.select("node", "n", "sig").mapInArrow(_ordered(trees, total, depth), "node binary, n int, key binary")
    left = rows.count() * len(trees)
    found = None
    while left:
        parts = math.ceil(left / task_rows)
        # rows at the ends of ranges come round again until all of them fit one task's share
        spread = order.repartitionByRange(parts, "key", "node") if parts > 1 else order.coalesce(1)
        out = keep.written(spread.sortWithinPartitions("key", "node").mapInArrow(scan, PAIRS))
        pairs = out.filter("kind = 0").select("a", "b", "est")
        found = pairs if found is None else found.unionByName(pairs)
        if parts == 1:
            break
        ends = out.filter("kind = 1")
        order = ends.select(F.col("a").alias("node"), "n", "key")
        left = ends.count()
        if ends.select("pid").distinct().count() < 2:
            break
    return spark.createDataFrame([], "a binary, b binary, est int") if found is None else found


def _best(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: the partner with which each class of ``pairs`` (a, b, est) agrees most."""
    best = pairs.groupBy("a").agg(F.max(F.struct("est", "b")).alias("s")).select("a", F.col("s.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _regions(trees: int, total: int, depth: int):
    """Rows (node, n, label, sig) -> one row per tree: its region, a hash of tree and leading minhashes."""

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u4").reshape(m, total)
            for t in range(trees):
                region = np.full(m, t + 1, np.uint64)
                for j in range(t * depth, (t + 1) * depth):
                    region = mixed(region * MIX_A + sig[:, j].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), batch.column(0), batch.column(1), batch.column(2)], names=["region", "node", "n", "label"])

    return run


def _members(rows: DataFrame, trees: int, total: int, depth: int, block: int, small_rows: int, keep: Scratch) -> DataFrame:
    """(region, lo, hi, own, node, label): the classes of regions that hold more than one label, once for each pair of blocks they have part in.

    Blocks hold about ``block`` shingles. Those of the region's largest label come last and meet all others, but not one another.
    """
    placed = rows.select("node", "n", "label", "sig").mapInArrow(_regions(trees, total, depth), "region long, node binary, n int, label binary")
    per = placed.groupBy("region", "label").agg(F.sum("n").alias("size"))
    mixed_ = per.groupBy("region").agg(F.count("*").alias("labels"), F.sum("size").alias("all"), F.max("size").alias("most"), F.max_by(F.xxhash64("label"), F.col("size")).alias("major")).filter("labels > 1")
    whole = F.col("all") <= block
    blocks = lambda size: F.ceil(size / block).cast("int")
    mixed_ = keep.written(mixed_.select("region", F.when(~whole, F.col("major")).alias("major"), F.when(whole, 1).otherwise(blocks(F.col("all") - F.col("most"))).alias("others"), F.when(whole, 0).otherwise(blocks(F.col("most"))).alias("majors")))
    # up to small_rows rows of 24 bytes are sent to every task; beyond, both sides are shuffled
    at = placed.join(F.broadcast(mixed_) if mixed_.count() <= small_rows else mixed_, "region")
    part, last = F.xxhash64("node"), F.coalesce(F.xxhash64("label") == F.col("major"), F.lit(False))
    at = at.withColumn("last", last).withColumn("own", F.when(F.col("last"), F.col("others") + F.pmod(part, F.col("majors"))).otherwise(F.pmod(part, F.col("others"))).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") + F.when(F.col("last"), 0).otherwise(F.col("majors")) - 1)))
    return keep.written(at.select("region", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "label", "n"))


def joining(label: np.ndarray, own: np.ndarray, starts: np.ndarray, flat: np.ndarray, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Links (i, j) that join the labels of the rows whose sets lie in ``flat`` from ``starts`` on, as a tree: of two blocks, pairs across them."""
    num, den = similarity
    ends = np.r_[starts[1:], len(flat)]
    n = ends - starts
    codes = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(len(flat) + 1, bool)
    two = own[0] != own[-1]
    # the largest label comes last (rows are sorted so), or the second block does: pairs start from the rows before
    until = np.searchsorted(own, own[-1]) if two else int(np.searchsorted(label, label[-1]))
    label, links = label.copy(), []
    for i in range(until):
        a = until if two else i + 1
        j = a + np.flatnonzero((label[a:] != label[i]) & (den * np.minimum(n[a:], n[i]) >= num * np.maximum(n[a:], n[i])))
        if not len(j):
            continue
        mine = codes[starts[i] : ends[i]]
        mark[mine] = True
        if 4 * len(j) < len(label) - a:
            both = np.array([np.count_nonzero(mark[codes[starts[k] : ends[k]]]) for k in j.tolist()])
        else:
            both = np.add.reduceat(mark[codes[starts[a] :]], starts[a:] - starts[a], dtype=np.int64)[j - a]
        mark[mine] = False
        for k in j[den * both >= num * (n[i] + n[j] - both)].tolist():
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                links.append((i, k))
    return links


def _crossing(similarity: tuple[int, int]):
    """Rows (region, lo, hi, own, node, label, shingles), one partition sorted by the first three -> pairs (a, b) of labels that a link joins, within each group of the three."""

    def links(group: pa.Table):
        codes: dict[bytes, int] = {}
        label = np.array([codes.setdefault(x, len(codes)) for x in group.column("label").to_pylist()])
        if len(codes) < 2:
            return
        own, lo, hi = (group.column(c).to_numpy() for c in ("own", "lo", "hi"))
        if lo[0] != hi[0] and (own == own[0]).all():
            return
        # a block of its own: the rows of its largest label last
        rank = np.argsort(np.bincount(label), kind="stable")
        label = np.argsort(rank)[label]
        order = np.lexsort((label, own))
        sets = group.column("shingles").to_pylist()
        sets = [sets[k] for k in order.tolist()]
        starts = np.cumsum([0, *(len(x) // 8 for x in sets[:-1])])
        found = joining(label[order], own[order], starts, np.frombuffer(b"".join(sets), np.uint64), similarity)
        if found:
            names = group.column("label").combine_chunks().take(pa.array(order))
            yield pa.RecordBatch.from_arrays([names.take(pa.array([x[k] for x in found])) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            cut = np.flatnonzero(np.any([np.diff(rest.column(c).to_numpy()) != 0 for c in ("region", "lo", "hi")], axis=0)) + 1
            for a, b in zip([0, *cut], cut):
                yield from links(rest.slice(a, b - a))
            rest = rest.slice(cut[-1]) if len(cut) else rest
        if rest is not None:
            yield from links(rest)

    return run


def across(rows: DataFrame, shingles, trees: int, total: int, depth: int, similarity, keep: Scratch, block: int = 1_000_000, task_shingles: int = 2_000_000, small_rows: int = 200_000) -> DataFrame:
    """Pairs (a, b) of labels that a link on the full sets joins in some region. ``rows``: (node, n, label, sig); ``shingles``: nodes (node) -> (node, shingles)."""
    members = _members(rows, trees, total, depth, block, small_rows, keep)
    sets = shingles(members.select("node").distinct())
    parts = math.ceil((members.agg(F.sum("n")).first()[0] or 0) / task_shingles) or 1
    full = members.drop("n").join(sets, "node").select("region", "lo", "hi", "own", "node", "label", "shingles")
    return keep.written(full.repartition(parts, "region", "lo", "hi").sortWithinPartitions("region", "lo", "hi").mapInArrow(_crossing(similarity), "a binary, b binary"))


def _sets(width: int):
    """Rows (node, text) -> (node, shingles): the sorted hashes of the text's shingles, 8 bytes each."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts], 1_000_000):
                sets = [np.unique(shingle_hashes(_WORDS.hashes(t.lower().split()), width)).tobytes() for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _verified(similarity):
    num, den = similarity

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                ok.append(den * both >= num * (len(x) // 8 + len(y) // 8 - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, similarity) -> DataFrame:
    """The pairs (a, b) whose full sets (node, shingles) are similar enough."""
    left = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_verified(similarity), "a binary, b binary")


def _repeats(signed: DataFrame) -> bool:
    return bool(signed.groupBy("_ax_id", "_ax_text").count().filter("count > 1").limit(1).count())


def near_duplicates(
    docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (8, 10), trees: int = 20, depth: int = 4, window: int = 32, agree: int = 52,
    id_col: str = "doc_id", text_col: str = "text", task_rows: int = 40_000, small_rows: int = 200_000, block: int = 1_000_000, task_shingles: int = 2_000_000,
) -> DataFrame:
    """One row per row of ``docs``: _ax_id, _ax_text (fingerprint of the text), ``n_shingles``, ``component_id``, ``kept``.

    ``similarity`` is a fraction of whole numbers. ``window``: places apart, and ``agree``: equal minhashes of ``trees *
    depth`` from which a pair may be a best partner; they serve the first search alone. ``task_rows``, ``block`` and
    ``task_shingles`` size the tasks, ``small_rows`` bounds what is broadcast; none changes a result.
    """
    total = trees * depth
    kind = docs.schema[id_col].dataType.simpleString()
    keep = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_ax_id"), text_key(text_col).alias("_ax_text"), text_or_empty(text_col).alias("text"))
    signed = keep.written(texts.withColumn("text", F.col("text").cast("binary")).mapInArrow(_signed(trees, depth, width), f"_ax_id {kind}, _ax_text long, n long, node binary, sig binary"))
    classes = keep.written(signed.filter("n > 0").groupBy("node").agg(F.min("sig").alias("sig"), F.min("n").cast("int").alias("n"), F.min(F.struct("_ax_id", "_ax_text")).alias("k")))
    repeats = _repeats(signed)

    def shingles(nodes: DataFrame) -> DataFrame:
        keepers = keep.written(classes.join(nodes, "node").select("node", F.col("k._ax_id").alias("_ax_kid"), F.col("k._ax_text").alias("_ax_ktext")))
        # up to small_rows rows of 32 bytes are sent to every task; beyond, both sides are shuffled
        side = F.broadcast(keepers) if keepers.count() <= small_rows else keepers
        got = texts.join(side, texts["_ax_id"].eqNullSafe(side["_ax_kid"]) & (texts["_ax_text"] == side["_ax_ktext"])).select("node", F.col("text").cast("binary").alias("text"))
        got = got.mapInArrow(_sets(width), "node binary, shingles binary")
        return keep.written(got.dropDuplicates(["node"]) if repeats else got)

    best = keep.written(_best(candidates(classes, list(range(trees)), total, depth, window, agree, similarity, keep, task_rows)))
    ends = best.select(F.col("a").alias("node")).unionByName(best.select(F.col("b").alias("node"))).distinct()
    # a few labels more than components cost the second search some work, a full run of rounds more
    labels = keep.written(connected_components(verified(best, shingles(ends), similarity), keep, steps=1))
    labelled = classes.join(labels.withColumnRenamed("node", "_ax_node"), F.col("node") == F.col("_ax_node"), "left").select("node", "n", F.coalesce("label", "node").alias("label"), "sig")
    labelled = keep.written(labelled)
    joined = connected_components(across(labelled, shingles, trees, total, depth, similarity, keep, block, task_shingles, small_rows), keep)
    joined = joined.select(F.col("node").alias("_ax_from"), F.col("label").alias("_ax_to"))
    labels = labelled.join(joined, F.col("label") == F.col("_ax_from"), "left").select("node", F.coalesce("_ax_to", "label").alias("label"))
    small = signed.select("_ax_id", "_ax_text", "n", "node")
    rows = small.join(labels.withColumnRenamed("node", "_ax_node"), small["node"] == F.col("_ax_node"), "left").select("_ax_id", "_ax_text", "n", F.coalesce("label", small["node"]).alias("label"))
    rows = keep.written(rows)
    keep.clear(but=rows)
    lowest = rows.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("_ax_id").alias("component_id"), F.min(F.struct(F.col("_ax_id").isNull().alias("none"), "_ax_id", "_ax_text")).alias("first"))
    out = rows.join(lowest, "label", "left")
    component = F.coalesce("component_id", "_ax_id")
    # one text of each component stays, also where ids are null or repeat
    kept = F.col("label").isNull() | (F.col("_ax_id").eqNullSafe(F.col("first._ax_id")) & (F.col("_ax_text") == F.col("first._ax_text")))
    return out.select("_ax_id", "_ax_text", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def near_result(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the id is the component's), on 2-word shingles."""
    kept = F.col("_ax_id").eqNullSafe(F.col("component_id"))
    return near_duplicates(docs, width=2).select(F.col("_ax_id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, one row each, with their own columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    keep = near_duplicates(docs, **options).filter("kept").select(F.col("_ax_id").alias("_ax_kid"), F.col("_ax_text").alias("_ax_ktext")).distinct()
    d = docs.withColumn("_ax_text", text_key(text_col))
    out = d.join(keep, d[id_col].eqNullSafe(keep["_ax_kid"]) & (d["_ax_text"] == keep["_ax_ktext"]), "left_semi")
    if _repeats(d.select(F.col(id_col).alias("_ax_id"), "_ax_text")):
        out = out.dropDuplicates([id_col, "_ax_text"])
    return out.drop("_ax_text")
