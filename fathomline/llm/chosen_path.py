"""Near duplicates by a chosen-path set similarity join.

Texts with equal shingle sets form one class. Each class has a sketch of minwise
values. In each of several independent trees a class goes to the node of one of its
minwise tokens; nodes with too many classes branch again, each class along a few
minwise tokens that the node's path chooses, unless most of the node are near copies
of one class: then it is left whole. In small nodes all sketches are compared. What
the nodes leave together are candidate clusters; in these, links are confirmed on the
full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm._shared import by_bytes, mix64, stage, unstage
from fathomline.llm.shingles import shingle_sets

#: Minwise values in a sketch.
SKETCH = 128
#: Independent trees. A linked pair shares a token in one tree with probability 0.75 or more: 12 trees leave 6e-8.
TREES = 12
#: Tokens that a branching node chooses, classes that a node compares, and levels until a node is left whole.
#: With 2 choices and 3 levels a linked pair that branches at every level stays together in a tree with probability 0.61: 12 trees leave 1e-5.
CHOICES, NODE, DEPTH = 2, 1024, 3
#: A larger node is also left whole if this share of its classes resembles its pivot: branching can't part near copies.
ALIKE = 0.5
#: Equal sketch values that a candidate pair has at least: at similarity 0.75 the mean is 96 and this is 5 deviations below.
AGREE = 70
#: Sets, and shingles of sets, that are compared with each other at once, and members of a cluster that all its blocks have.
BLOCK, BLOCK_SHINGLES, PIVOTS = 512, 1 << 20, 4
#: Links that a task holds before it reduces them to a forest.
HELD = 200_000
PART_BYTES = 1 << 20
_A = mix64(np.arange(1, SKETCH + 1).astype(np.uint64)) | np.uint64(1)
_B = mix64(np.arange(1001, SKETCH + 1001).astype(np.uint64))


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two order-free hashes and the minwise values of sets, at least one and none of them empty."""
    flat = np.concatenate(sets)
    edges = np.cumsum([0, *(len(s) for s in sets[:-1])])
    one = np.add.reduceat(mix64(flat), edges)
    two = np.add.reduceat(mix64(flat ^ np.uint64(0x5BF03635DCE2A5B1)), edges)
    out = np.empty((len(sets), SKETCH), np.uint32)
    for k in range(SKETCH):
        out[:, k] = np.minimum.reduceat(((flat ^ _B[k]) * _A[k] >> np.uint64(32)).astype(np.uint32), edges)
    return one.view(np.int64), two.view(np.int64), out.view(np.int32)


def set_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, a, b, sketch) of every row of docs (doc_id, text), ids null or repeated as they are; the last three null for an empty set: no words, or a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text", PART_BYTES):
            for i in range(0, part.num_rows, 4096):
                b = part.slice(i, 4096)
                sets = shingle_sets(b.column(1).to_pylist())
                n = np.array([len(s) for s in sets], np.int64)
                full, at = n > 0, np.cumsum(n > 0) - 1
                take = pa.array(np.where(full, at, 0), mask=~full)
                one, two, sketch = sketches([s for s in sets if len(s)]) if full.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SKETCH), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sketch) + 1, dtype=np.int32) * SKETCH), pa.array(sketch.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(one).take(take), pa.array(two).take(take), lists.take(take)], ["doc_id", "n_shingles", "a", "b", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, a long, b long, sketch array<int>")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that rows equal in the first `keys` columns, which lie together, are in one batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in range(keys):
            x = b.column(k).to_numpy(zero_copy_only=False)
            before = held[-1].column(k)[-1].as_py() if held else None
            change[1:] |= x[1:] != x[:-1]
            change[0] |= bool(held) and x[0] != before
        cut = np.flatnonzero(change)
        if not len(cut):
            held.append(b)
            continue
        if held or cut[-1]:
            yield pa.Table.from_batches([*held, b.slice(0, cut[-1])]).combine_chunks().to_batches()[0]
        held = [b.slice(cut[-1])]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that the pairs connect it with."""
    label = np.arange(n)
    while len(left):
        one, two = label[left], label[right]  # places that are their own labels: these are relabelled, so that what has met stays together
        least = np.minimum(one, two)
        np.minimum.at(label, one, least)
        np.minimum.at(label, two, least)
        while (label != label[label]).any():
            label = label[label]
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return label


def node_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (node, rep, code) sorted by node: links (u, v) that connect the classes of a node whose sketches agree."""
    for b in _runs(batches, 1):
        node, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
        code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(node), SKETCH)
        left, right = [], []
        i, d = np.arange(len(node)), 1
        while len(i):
            i = i[i + d < len(node)]
            i = i[node[i] == node[i + d]]
            for k in range(0, len(i), 20_000):
                own = i[k : k + 20_000]
                near = own[(code[own] == code[own + d]).sum(1) >= AGREE]
                left.append(near)
                right.append(near + d)
            d += 1
        if left:
            root = _roots(len(node), np.concatenate(left), np.concatenate(right))
            own = rep != rep[root]
            yield pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[root[own]])], ["u", "v"])


def candidates(classes: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Links (u, v) of classes (rep, a, b, sketch; none of them null) that may be similar, from all trees, some of them several times. Tables written on the way are added to used, for deletion when the links have been read."""

    def kept(df: DataFrame, label: str) -> DataFrame:
        used.append(stage(df, label))
        return used[-1]

    tokens = F.array(*[F.xxhash64(F.lit(t), F.get("sketch", F.lit((t * 53 + 7) % SKETCH))) for t in range(TREES)])
    codes = classes.select("rep", "a", "b", F.transform("sketch", lambda x: F.hex(x.bitwiseAND(F.lit(255)) + 256)).alias("h")).select("rep", "a", "b", F.unhex(F.array_join(F.transform("h", lambda x: F.substr(x, F.lit(2), F.lit(2))), "")).alias("code"))
    here = classes.select("rep", "a", "b", F.explode(tokens).alias("node"))
    found, small = [], []
    for depth in range(DEPTH + 1):
        # a staged count has an exchange of its own in the join, whose large partitions Spark can then split
        counts = F.count("*").alias("size"), F.min("rep").alias("least"), F.min(F.xxhash64("a", "node")).alias("first")
        sizes = kept(here.groupBy("node").agg(*counts).where("size > 1"), "sizes")
        sized = kept(here.join(sizes, "node"), "nodes")
        small.append(sized.where(F.col("size") <= NODE).select("node", "rep", "a", "b"))
        large = sized.where(F.col("size") > NODE)
        if large.isEmpty():
            break
        if depth == DEPTH:
            found.append(large.where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")))
            break
        large = kept(large.join(classes.select("rep", "a", "b", "sketch"), ["rep", "a", "b"]), "large")
        pivots = kept(large.where(F.xxhash64("a", "node") == F.col("first")).select("node", F.col("sketch").alias("pivot")), "node-pivots")
        agree = F.size(F.filter(F.zip_with("sketch", "pivot", lambda x, y: x == y), lambda same: same))
        alike = kept(large.join(pivots, "node").groupBy("node").agg(F.avg((agree >= AGREE).cast("int")).alias("alike")), "alike")
        choice = [F.xxhash64("node", F.lit(j), F.get("sketch", F.pmod(F.xxhash64("node", F.lit(j)), F.lit(SKETCH)).cast("int"))) for j in range(CHOICES)]
        judged = kept(large.join(alike, "node").select("rep", "a", "b", "least", F.when(F.col("alike") < ALIKE, F.array(*choice)).alias("nodes")), "judged")
        found.append(judged.where("nodes is null and rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")))
        here = judged.where("nodes is not null").select("rep", "a", "b", F.explode("nodes").alias("node"))
    # the small nodes of all levels are compared in one pass
    nodes = small[0]
    for x in small[1:]:
        nodes = nodes.unionByName(x)
    nodes = nodes.join(codes, ["rep", "a", "b"]).select("node", "rep", "code")
    out = kept(nodes.repartition("node").sortWithinPartitions("node").mapInArrow(node_links, "u long, v long"), "links")
    for x in found:
        out = out.unionByName(x)
    return out


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From links (u, v): for each id but the smallest that a task's links connect, a link to that smallest."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, limit = 0, HELD

    def reduced() -> list[tuple[np.ndarray, np.ndarray]]:
        names, at = np.unique(np.concatenate([x for pair in held for x in pair]), return_inverse=True)
        ends = np.cumsum([0, *(len(x) for pair in held for x in pair)])
        left, right = (np.concatenate([at[a:b] for a, b in zip(ends[k:-1:2], ends[k + 1 :: 2])]) for k in range(2))
        root = _roots(len(names), left, right)
        own = root != np.arange(len(names))
        return [(names[own], names[root[own]])]

    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
        if size > limit:
            held = reduced()
            size = len(held[0][0])
            limit = HELD + 2 * size
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in reduced()[0]], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(u, v): for each id in links but the smallest of its component, that smallest id; staged.

    Each task first reduces its links to a forest. Then large-star and small-star
    steps in turn, each written to the shared folder, until each id that has a
    smaller neighbour has no other one: then all components are stars. The smallest
    neighbours tell that and are staged for the large-star step too: joined by them,
    the links of an id that very many share can be split among tasks.
    """
    own = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    edges = stage(own.mapInArrow(forest, "u long, v long"), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = stage(both.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most")), "least")
        if ends.where("least < u and least < most").isEmpty():
            unstage(edges)
            return ends.where("least < u").select("u", F.col("least").alias("v"))
        large = both.join(ends, "u").where("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
        near = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        star = near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = stage(star.distinct(), "edges")
        unstage(edges)
        unstage(ends)
        edges = new


def similar(sets: list[np.ndarray], split: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with 100 * intersection >= 75 * union; with split, only pairs of a place below it and one from it on."""
    n = np.array([len(s) for s in sets])
    m = len(sets)
    if m <= 6:
        pairs = [(i, j) for i in range(m) for j in range(i + 1, m) if not split or i < split <= j]
        same = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
        left, right = np.array(pairs, np.int64).reshape(-1, 2).T
    else:
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), n)
        keep = times[at] > 1
        place = np.cumsum(times > 1) - 1
        owner, at = owner[keep], place[at[keep]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        total = np.zeros((m, m), np.float64)
        for k in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            a, b = np.searchsorted(at, [k, k + 4096])
            table = np.zeros((m, 4096), np.float32)
            table[owner[a:b], at[a:b] - k] = 1
            total += table @ table.T
        left, right = np.triu_indices(m, 1)
        if split:
            own = (left < split) & (right >= split)
            left, right = left[own], right[own]
        same = np.rint(total[left, right]).astype(np.int64)
    near = 100 * same >= 75 * (n[left] + n[right] - same)
    return left[near], right[near]


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (cluster, block, rep, set) sorted by the first two: links (u, v) that connect similar sets of a block."""
    for b in _runs(batches, 2):
        keys = [b.column(k).to_numpy() for k in range(2)]
        edges = np.flatnonzero(np.r_[True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]), True])
        rep, data = b.column(2).to_numpy(), b.column(3)
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if z - a < 2:
                continue
            own = rep[a:z]
            root = _roots(z - a, *similar([np.frombuffer(x, np.uint64) for x in data[a:z].to_pylist()], 0))
            linked = own != own[root]
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(own[root[linked]])], ["u", "v"])


def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (cluster, i, j, block, label, set) sorted by the first four: links (u, v) between labels, enough to connect those that have similar sets."""
    for b in _runs(batches, 3):
        keys = [b.column(k).to_numpy() for k in range(3)]
        edges = np.flatnonzero(np.r_[True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1]), True])
        block, label, data = b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5)
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
            split = 0 if keys[1][a] == keys[2][a] else int((block[a:z] == keys[1][a]).sum())
            left, right = similar([np.frombuffer(x, np.uint64) for x in data[a:z].to_pylist()], split)
            names, at = np.unique(label[a:z], return_inverse=True)
            left, right = at[left], at[right]
            other = left != right
            root = _roots(len(names), left[other], right[other])
            own = root != np.arange(len(names))
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[root[own]])], ["u", "v"])


def full_sets(rows: DataFrame, keep: dict[str, str]) -> DataFrame:
    """The columns of keep (names and types; nulls as they are) and set, the sorted shingles of the column text; empty bytes for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", PART_BYTES):
            sets = [s.tobytes() for s in shingle_sets(b.column(len(keep)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sets, pa.binary())], [*keep, "set"])

    return rows.select(*keep, "text").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in keep.items()) + ", set binary")


def confirmed_components(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): the smallest class that confirmed links reach, for each class but the smallest.

    A candidate cluster is dealt into blocks, each with a few pivots of the whole
    cluster, and a block's sets are all compared. What is linked then needs no
    further comparison: only clusters of several blocks, be it by their sets or by
    their shingles, that are still in several parts have their parts compared across
    blocks.
    """
    used: list[DataFrame] = []
    found = components(candidates(classes, used))
    for table in used:
        unstage(table)
    roots = found.select(F.col("v").alias("rep"), F.col("v").alias("cluster")).distinct()
    members = found.select(F.col("u").alias("rep"), F.col("v").alias("cluster")).unionByName(roots)
    members = stage(members.join(classes.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles")), "rep"), "clusters")
    pivots = F.array(*[F.min_by("rep", F.xxhash64("rep", F.lit(k))) for k in range(PIVOTS)])
    sizes = stage(members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), pivots.alias("pivots")), "cluster-sizes")
    full = lambda n, shingles: F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES)  # noqa: E731  how many blocks sets fill
    blocks = F.ceil(full(F.col("n"), F.col("shingles"))).cast("int")
    at = F.when(F.array_contains("pivots", F.col("rep")), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), blocks).cast("int")))
    placed = members.join(sizes, "cluster").select("rep", "cluster", at.alias("blocks"))
    known = docs.where("text is not null").select("doc_id", "text")
    texts = known.join(placed, F.col("doc_id") == F.col("rep"))
    dealt = full_sets(texts, {"cluster": "long", "blocks": "array<int>", "rep": "long"}).select("cluster", F.explode("blocks").alias("block"), "rep", "set")
    first = dealt.repartition("cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(confirmed, "u long, v long")
    links = stage(first, "links")
    label = components(links)
    unstage(links)

    dealt = sizes.where(blocks > 1).select("cluster")
    if dealt.isEmpty():
        return label
    named = members.join(dealt, "cluster").join(label.withColumnsRenamed({"u": "rep", "v": "label"}), "rep", "left").select("rep", "cluster", "n_shingles", F.coalesce("label", "rep").alias("label"))
    parts = stage(named.groupBy("cluster", "label").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("load")), "parts")
    big = full(F.col("size"), F.col("load")) >= 1
    small = [F.sum(F.when(big, 0).otherwise(F.col(c))).alias(f"small_{c}") for c in ("size", "load")]
    still = parts.groupBy("cluster").agg(F.count("*").alias("parts"), *small).where("parts > 1")
    if still.isEmpty():
        return label
    own_blocks = lambda size, load: F.greatest(F.ceil(full(F.col(size), F.col(load))), F.lit(1))
    sub = F.when(big, F.pmod(F.xxhash64("rep"), own_blocks("size", "load"))).otherwise(F.pmod(F.xxhash64("label"), own_blocks("small_size", "small_load")))
    home = F.when(big, F.col("label"))
    rest = stage(named.join(still, "cluster").join(parts, ["cluster", "label"]).select("rep", "cluster", "label", home.alias("home"), F.xxhash64(big, home, sub).alias("block")), "rest")
    units = rest.select("cluster", "block", "home").distinct()
    left, right = (units.withColumnsRenamed({"block": name, "home": f"home_{name}"}) for name in "ij")
    pairs = left.join(right, "cluster").where("i <= j and not coalesce(home_i = home_j, false)")
    pairs = pairs.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    sets = full_sets(known.join(rest, F.col("doc_id") == F.col("rep")), {"cluster": "long", "block": "long", "label": "long"})
    crossed = sets.join(pairs, ["cluster", "block"]).select("cluster", "i", "j", "block", "label", "set")
    # rows of block i come first in a pair, as i <= j
    links = crossed.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block").mapInArrow(crossing, "u long, v long")
    links = stage(links, "links")
    joined = components(links)  # of labels alone, each the smallest of its part
    unstage(links)
    moved = label.join(joined.select(F.col("u").alias("v"), F.col("v").alias("root")), "v", "left").select("u", F.coalesce("root", "v").alias("v"))
    return moved.unionByName(joined)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Sets are the distinct shingles of five words of the folded text; documents with
    100 * intersection >= 75 * union are linked; component_id is the smallest id
    that links reach, kept whether it is the document's own. The search for links
    is randomized: TREES sets the chance to miss one; what it finds is exact.

    Nulls and edges: a text of fewer than five words is one shingle; one without
    words, or null, has an empty set and is linked with nothing. Rows that share an
    id are one document: links of one are links of all. A row with a null id is
    linked with nothing and has a null component_id and kept true. Ids may have any
    type with an order; an empty table gives no row; other columns are dropped.
    """
    kind = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not isinstance(kind, T.LongType | T.IntegerType | T.ShortType | T.ByteType):
        return _named(docs, id_col)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = stage(set_rows(docs), "shingle-sets")
    linked = rows.where("n_shingles > 0 and doc_id is not null")
    classes = stage(linked.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    label = confirmed_components(docs.where("doc_id is not null"), classes)
    several = linked.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "ab"]).where("min_a < max_a or min_b < max_b").select("doc_id")
    owned = stage(linked.select("doc_id", "a", "b").join(several, "doc_id").join(classes.select("a", "b", "rep"), ["a", "b"]).select("doc_id", "rep").distinct(), "owned")
    if not owned.isEmpty():  # the classes of an id's texts
        least = owned.groupBy("doc_id").agg(F.min("rep").alias("v"))
        label = components(label.unionByName(owned.join(least, "doc_id").select(F.col("rep").alias("u"), "v")))
    named = stage(classes.select("a", "b", "rep").join(label.withColumnsRenamed({"u": "rep", "v": "label"}), "rep", "left").select("a", "b", F.coalesce("label", "rep").alias("component")), "class-components")
    out = rows.select("doc_id", "n_shingles", "a", "b").join(named, ["a", "b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return out.select(F.col("doc_id").cast(kind).alias(id_col), "n_shingles", component.cast(kind).alias("component_id"), kept.alias("kept"))


def _named(docs: DataFrame, id_col: str) -> DataFrame:
    """near_duplicates() of documents whose ids aren't whole numbers: each distinct id gets a number, each component then its smallest id."""
    ids = stage(docs.where("doc_id is not null").select("doc_id").distinct().select(F.col("doc_id").alias("name"), F.monotonically_increasing_id().alias("number")), "numbers")
    found = stage(near_duplicates(docs.join(ids, F.col("doc_id") == F.col("name"), "left").select("number", "text"), "number"), "numbered")
    found = found.join(ids, "number", "left")
    least = stage(found.where("number is not null").groupBy("component_id").agg(F.min("name").alias("least")), "least-names")
    out = found.join(least, "component_id", "left")
    return out.select(F.col("name").alias(id_col), "n_shingles", F.col("least").alias("component_id"), F.coalesce(F.col("name") == F.col("least"), F.lit(True)).alias("kept"))
