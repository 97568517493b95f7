"""Operator 7, SimHash near-dedup with deletion-variant signatures.

Fingerprints within ``distance`` 2 of each other, cut into two 32-bit halves, differ by at most one
bit in some half. Each distinct fingerprint is therefore indexed under its halves with one bit
struck out (64 signatures); fingerprints that share a signature are compared. Small signatures are
compared whole in one task. A signature of more than ``bucket`` fingerprints is compared through
finer signatures instead, which hold four fingerprints at most and lose no link, so the work grows
in proportion to the fingerprints however dense a group is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, checkpointed, slices, without

SEED = 42
#: The bits set in each byte value, as rows of eight.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Up to so many signature keys (16 bytes each) are sent to every task; more are joined by shuffle.
BROADCAST_KEYS = 500_000
#: Of edges: those that a task shortens at once; those for which components() has a task, and the tasks it has at least.
STAR_EDGES, TASK_EDGES, LEAST_TASKS = 1_000_000, 100_000, 6


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of the text's ``size``-word shingles, repeats included; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
    n = len(words) - size + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=">u8", count=n).view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(hashes[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text_col: str = "text", size: int = 3) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long."""
    import pyarrow as pa

    docs = without(docs, "fp")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column(text_col).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "fp"])

    return docs.mapInArrow(each, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def _half(fp: Column, side: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if side == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def signatures(fps: DataFrame) -> DataFrame:
    """(key, fp): each half with each of its bits struck out; the key also says which half and bit."""
    keys = []
    for side in (0, 1):
        half = _half(F.col("fp"), side)
        keys += [half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))).bitwiseOR(F.lit((side << 37) | (bit << 32))) for bit in range(32)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _star(found: list[tuple[int, int]]):
    import pandas as pd

    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join all fingerprints of one signature which links within it connect: a tree for each part."""
    values = fps.view(np.uint64)
    left, edges = np.arange(len(values)), []
    while len(left):
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            near = (np.bitwise_count(values[left][:, None] ^ values[wave][None, :]) <= distance)
            hit = near.any(axis=1)
            edges += zip(fps[left[hit]].tolist(), fps[wave[near[hit].argmax(axis=1)]].tolist(), strict=True)
            wave, left = left[hit], left[~hit]
    return edges


def links(fps: DataFrame, distance: int = 2, bucket: int = 2048) -> DataFrame:
    """(u, v) over distinct fingerprints: pairs within ``distance`` that connect all fingerprints such pairs connect."""
    if distance != 2:
        raise ValueError("two halves with one bit struck out find distances up to 2")
    index = signatures(fps)
    shared = checkpointed(index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1"))
    two = shared.filter((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)).select("u", "v")
    more = shared.filter("n > 2").select("key", "n")
    more = F.broadcast(more) if more.count() <= BROADCAST_KEYS else more
    held = index.join(more, "key")

    def compared(batches: Iterator) -> Iterator:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for fps_ in batch["fps"]:
                out += _forest(np.asarray(fps_, dtype=np.int64), distance)
            yield _star(out)

    some = held.filter(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInPandas(compared, "u long, v long")
    return two.unionByName(some).unionByName(_dense(held.filter(F.col("n") > bucket))).distinct()


def _dense(held: DataFrame) -> DataFrame:
    """Links within large signatures (key, fp), by finer signatures that at most four fingerprints share.

    Members of a signature agree in its half but for the struck bit. Those that differ in it may
    differ by one more bit, in the other half: strike each of that half's bits too. Those that
    agree in it may differ by two bits of the other half: strike each pair of them. Members of
    such a finer signature differ in two bits at most, so all of them are linked.
    """
    found = []
    for side in (0, 1):
        mine = held.filter(F.shiftright("key", 37) == side)
        other = _half(F.col("fp"), 1 - side)
        one = F.array(*[F.struct(F.lit(b).alias("a"), F.lit(-1).alias("b"), other.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << b))).alias("rest")) for b in range(32)])
        masks = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), other.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << a) ^ (1 << b))).alias("rest")) for a in range(31) for b in range(a + 1, 32)])
        found.append(mine.select("fp", F.col("key").alias("k"), F.explode(one).alias("x")))
        found.append(mine.select("fp").distinct().select("fp", (_half(F.col("fp"), side) + F.lit((2 + side) << 40)).alias("k"), F.explode(masks).alias("x")))
    rows = found[0]
    for other_rows in found[1:]:
        rows = rows.unionByName(other_rows)
    groups = rows.groupBy("k", "x").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return groups.select("u", F.explode("fps").alias("v")).filter("u <> v").select("u", "v")


def _shortened(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): each node that these edges connect to a smaller one, with the least of them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, low, seen = at[: len(u)], at[len(u) :], np.arange(len(nodes)), None
    while seen is None or (low != seen).any():
        seen = low
        low, least = seen.copy(), np.minimum(seen[a], seen[b])
        for ends in (a, b, seen[a], seen[b]):
            np.minimum.at(low, ends, least)
        low = low[low]
    far = low != np.arange(len(nodes))
    return nodes[far], nodes[low[far]]


def shortened(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that connect what ``edges`` do: in each task, stars instead of what it has."""
    import pyarrow as pa

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("u", "v"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _shortened(*ends)], names=["u", "v"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= STAR_EDGES:
                yield star(held)
                held = []
        if held:
            yield star(held)

    return edges.select("u", "v").mapInArrow(each, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges (u, v) connect to each node that has an edge.

    Alternates large stars (neighbours above a node go to the least of its neighbours) and small
    stars (those below do), each a distributed join, until neither changes the edges; rounds grow
    with the logarithm of the nodes. Least neighbours are written out, so that both sides of the
    joins come from exchanges of their own and Spark can split the node of a giant component.
    Between rounds each task shortens what it has to stars, and there are only as many tasks as the
    edges need, as every one leaves files in each exchange.
    """
    now = checkpointed(shortened(edges.filter("u <> v")))
    tasks_for = lambda n: max(LEAST_TASKS, -(-n // TASK_EDGES))
    tasks = tasks_for(now.count())
    now = checkpointed(shortened(now.coalesce(tasks)).distinct().coalesce(tasks))
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0]:
        tasks = tasks_for(seen[0])
        now = now.coalesce(tasks)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.distinct().coalesce(tasks))
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("u").alias("c"), "m")
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct(F.col("c").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v")
        now = checkpointed(shortened(small.coalesce(tasks)).distinct().coalesce(tasks))
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 2, bucket: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``id_col``, ``fingerprint`` (16 hexadecimal digits), ``component_id`` and ``links``.

    ``component_id`` is the least id reachable over fingerprints within ``distance``, ``links``
    the number of documents that have the same component. Texts without words (null, empty, blank)
    have fingerprint 0, linked like any other. Repeated rows keep a row each; null ids never win,
    and a component of null ids alone has a null id. An empty table gives no rows.
    """
    marked = checkpointed(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", "fp"))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp"), distance, bucket))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    heads = checkpointed(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("links")))
    known = placed.join(heads, "root").select("fp", "component_id", "links")
    return marked.join(known, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


# --- near copies by the similarity of 5-word shingles ---
SIZE, SIMILARITY = 5, 0.8
#: A wide fingerprint has 320 bits in 20 segments of 16 and 64 bits more to compare by. Texts of similarity 0.8
#: differ in 0.15 of the bits, so a segment in at most one bit with a chance of 0.28, and none does with one of 0.0015.
SEGMENTS, WIDTH, LONGS = 20, 16, 6
NEAR_BITS, MOST_BITS = 20, 84  # of 64 and of 384: 3.6 deviations above what similarity 0.8 gives
BLOCK = 1 << 16
PART_BYTES = 8 << 20  # of texts of a part of a group
FEW, PART_ROWS = 16, 2048  # nodes of a key of which all pairs are compared at once; nodes of a part of a larger key
_STEPS = np.arange(1, LONGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_LONGS = [f"b{i}" for i in range(LONGS)]
SKETCH = T.StructType([T.StructField(n, T.LongType()) for n in ("content", "node", *_LONGS)] + [T.StructField("words", T.BooleanType())])


def shingles(text: str | None, size: int = SIZE) -> set[bytes]:
    """The text's runs of ``size`` words; all words if they are fewer, nothing without words."""
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False)))


def wide_fingerprint(text: str | None) -> tuple[int, np.ndarray]:
    """(digest of the set of shingles, its SimHash in ``LONGS`` longs); without words all bits are 0."""
    import xxhash

    found = shingles(text)
    hashes = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))
    ones = np.zeros(64 * LONGS, np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 255):  # as many as a byte can count
            z = hashes[at : at + 255, None] + _STEPS[None, :]
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
            z ^= z >> np.uint64(31)
            ones += np.add.reduce(np.unpackbits(z.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63), np.packbits(2 * ones > len(hashes)).view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """(id, content, node, b0-b5, words) of docs (id, text, content)."""
    import pyarrow as pa

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 8 << 20)):
            texts = batch.column("text").to_pylist()
            found = [wide_fingerprint(t) for t in texts]
            bits = np.array([f[1] for f in found], np.int64).reshape(-1, LONGS)
            columns = [batch.column("id"), batch.column("content"), pa.array([f[0] for f in found], pa.int64()), *[pa.array(bits[:, i]) for i in range(LONGS)], pa.array([bool((t or "").encode().split()) for t in texts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *SKETCH.names])

    return docs.select("id", "content", "text").mapInArrow(each, T.StructType([docs.schema["id"], *SKETCH.fields]))


def segment_keys(nodes: DataFrame, *more: str, segments: tuple[int, int] = (0, SEGMENTS), valued: bool = False) -> DataFrame:
    """(key, node, near) and ``more``: each of the segments with each of its bits struck out, 320 keys a node of all; near is the last long.

    ``valued``: the key is doubled, and has the value of the bit struck out as its last bit.
    """
    per, mask = 64 // WIDTH, (1 << WIDTH) - 1
    cuts = ", ".join(f"cast(shiftrightunsigned(b{s // per}, {WIDTH * (s % per)}) & {mask}L as int)" for s in range(*segments))
    masks = ", ".join(str(mask ^ (1 << b)) for b in range(WIDTH))
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")  # 320 rows come of each
    key = f"(c & m) | shiftleft((s + {segments[0]}) * {WIDTH} + b, {WIDTH})"
    key = f"shiftleft({key}, 1) | (shiftright(c, b) & 1)" if valued else key
    variants = f"transform(array({cuts}), (c, s) -> transform(array({masks}), (m, b) -> {key}))"
    return nodes.select(F.explode(F.flatten(F.expr(variants))).alias("key"), "node", F.col(f"b{LONGS - 1}").alias("near"), *more)


def _blocks(batches: Iterator) -> Iterator[list[np.ndarray]]:
    """Rows sorted by their first column, a key, in runs of whole keys; a key of over ``BLOCK`` rows comes in several."""
    held = None
    for batch in batches:
        rows = [batch.column(c).to_numpy().astype(np.int64) for c in range(batch.num_columns)]
        rows = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
        n = len(rows[0])
        cut = int(np.searchsorted(rows[0], rows[0][-1])) if n else 0
        if n - cut >= BLOCK:
            cut = n
        if cut:
            yield [r[:cut] for r in rows]
        held = [r[cut:] for r in rows]
    if held and len(held[0]):
        yield held


def _near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count((left ^ right).view(np.uint64)) <= NEAR_BITS


#: What a row (u, v) of :func:`met` says, to be combined: u and v may be alike; u and v, or a key u and its node v, are of one group.
PAIR, LINK = 1, 2


def _met(key: np.ndarray, value: np.ndarray, node: np.ndarray, near: np.ndarray, group: np.ndarray, few: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(u, v, what they are) of near nodes of different groups that share a key.

    Nodes that agree in a whole segment share all its keys, and are pairs in the first of these
    alone: in others only those are that differ in the bit struck out. Where the nodes of a key make
    as many pairs as they are, or more, links that connect the same nodes stand for the pairs. Keys
    of up to ``few`` nodes are compared together, others one at a time.
    """
    new = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    size = np.diff(np.append(new, len(key)))
    at, first = np.flatnonzero(np.repeat(size <= few, size)), (key >> WIDTH) % WIDTH == 0
    of, some = np.repeat(np.arange(len(size)), size), []
    for back in range(1, int(size[size <= few].max(initial=1))):
        at = at[at >= back]
        at = at[key[at] == key[at - back]]
        to = at - back
        hit = (group[at] != group[to]) & (first[at] | (value[at] != value[to]))
        hit[hit] = _near(near[at[hit]], near[to[hit]])
        some.append((to[hit], at[hit]))
    if some:
        u, v = (np.concatenate([x[i] for x in some]) for i in (0, 1))
        dense = np.bincount(of[u], minlength=len(size))[of[u]] >= size[of[u]]
        yield node[u[~dense]], node[v[~dense]], PAIR
        yield node[u[dense]], node[v[dense]], LINK
    for begin, n in zip(new[size > few].tolist(), size[size > few].tolist(), strict=True):
        ours, marks, groups = (x[begin : begin + n] for x in (node, near, group))
        ones = 0 if first[begin] else int(np.searchsorted(value[begin : begin + n], 1))
        pairs, held = [], 0
        for i in range(ones or (n - 1) * bool(first[begin])):
            to = max(ones, i + 1)
            others = to + np.flatnonzero(_near(marks[to:], marks[i]) & (groups[to:] != groups[i]))
            pairs.append((np.full(len(others), ours[i]), ours[others], PAIR))
            held += len(others)
            if held >= n:
                pairs = _linked(ours, marks, groups)
                break
        yield from pairs


def _linked(node: np.ndarray, near: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Links between near nodes, those of different groups, that with the groups connect all near ones."""
    left, wave = np.arange(len(node)), []
    while len(left):
        if not wave:
            wave, left = [int(left[0])], left[1:]
        i = wave.pop()
        hit = _near(near[left], near[i])
        taken, left = left[hit], left[~hit]
        wave += taken.tolist()
        taken = taken[group[taken] != group[i]]
        yield np.full(len(taken), node[i]), node[taken], LINK


def met(index: DataFrame, few: int) -> DataFrame:
    """(u, v, kind): what :func:`_met` finds in the keys of ``index`` (key, node, near and perhaps root, a group that the node has).

    A key's rows are in one task. They are few, as each node has one row in each of hundreds of keys, and
    if they are over ``BLOCK`` all the same, the key links all its nodes.
    """
    import pyarrow as pa

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, last = _blocks(batches), None
        block = next(blocks, None)
        while block:
            after = next(blocks, None)
            key, node = block[0], block[2]
            found = list(_met(*block, few))
            for open_, goes_on in ((key[0], last is not None and last == key[0]), (key[-1], after is not None and after[0][0] == key[-1])):
                if goes_on:
                    found.append((key[key == open_], node[key == open_], LINK))
            u, v, kind = (np.concatenate(x) for x in zip((key[:0], key[:0], key[:0]), *((u, v, np.full(len(u), kind)) for u, v, kind in found), strict=True))
            low, least = _shortened(u[kind == LINK], v[kind == LINK])
            pairs = np.unique(np.stack([u, v])[:, kind == PAIR], axis=1)
            ends = np.append(least, 0)[np.searchsorted(low, pairs)], np.append(low, 0)[np.searchsorted(low, pairs)] == pairs
            tops = np.where(ends[1], ends[0], pairs)
            pairs = pairs[:, tops[0] != tops[1]]  # others are linked
            if len(low) + pairs.shape[1]:
                kind = np.repeat([LINK, PAIR], [len(low), pairs.shape[1]])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(least, pairs[0])), pa.array(np.append(low, pairs[1])), pa.array(kind)], names=["u", "v", "kind"])
            last, block = key[-1], after

    group = F.coalesce("root", "node") if "root" in index.columns else F.col("node")
    rows = index.repartitionByRange(F.shiftright("key", 1)).sortWithinPartitions("key", "node")
    rows = rows.select(F.shiftright("key", 1).alias("key"), F.col("key").bitwiseAND(F.lit(1)).alias("value"), "node", "near", group.alias("group"))
    found = rows.mapInArrow(each, "u long, v long, kind long")
    return found.groupBy("u", "v").agg(F.bit_or("kind").alias("kind"))


def grouping(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): the pairs of ``met`` that are near in all bits, and its links."""
    linked = F.col("kind").bitwiseAND(F.lit(LINK)) != 0
    sides = [nodes.select(F.col("node").alias(c), F.array(*_LONGS).alias(f"bits_{c}")) for c in ("u", "v")]
    differ = F.aggregate(F.zip_with("bits_u", "bits_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    pairs = found.filter(~linked).join(sides[0], "u").join(sides[1], "v").filter(differ <= MOST_BITS)
    return pairs.select("u", "v").unionByName(found.filter(linked).select("u", "v"))


def _across(node: np.ndarray, root: np.ndarray, part: np.ndarray, apart: bool, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of different roots among nodes that share a key; ``apart``: and of different parts."""
    for i in range(len(node) - 1):
        at = np.flatnonzero((root[i + 1 :] != root[i]) & _near(bits[i + 1 :, -1], bits[i, -1])) + i + 1
        if apart:
            at = at[part[at] != part[i]]
        at = at[np.bitwise_count((bits[at] ^ bits[i]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= MOST_BITS]
        yield np.full(len(at), node[i]), node[at]


def crowded(nodes: DataFrame, part_rows: int, keys: DataFrame | None = None) -> DataFrame:
    """(u, v), u < v: all pairs of ``nodes`` (node, root, b0-b5) that share a key, are near in all bits and differ in root.

    With ``keys`` (key), only these count. A key whose nodes have one root has no such pair and goes. Nodes of another are cut into parts
    of about ``part_rows``, and each pair of parts meets in a task of its own.
    """
    import pyarrow as pa

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            starts = np.flatnonzero(np.diff(block[0], prepend=block[0][:1] - 1))
            found = []
            for begin, end in zip(starts, np.append(starts[1:], len(block[0])), strict=True):
                _, apart, node, root, part, *bits = (c[begin:end] for c in block)
                found += _across(node, root, part, bool(apart[0]), np.stack(bits, axis=1))
            u, v = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            if len(u):
                pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    rows = segment_keys(nodes, "root", *_LONGS)
    if keys is not None:
        rows = rows.join(_small(keys), "key", "left_semi")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    rows = rows.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / part_rows)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rows = rows.withColumn("other", other).withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    place = F.xxhash64("key", "low", "high").alias("place")
    rows = rows.select(place, F.when(F.col("low") < F.col("high"), 1).otherwise(0).cast("long").alias("apart"), "node", "root", "part", *_LONGS)
    return rows.repartition("place").sortWithinPartitions("place", "apart").mapInArrow(each, "u long, v long").distinct()


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` of a few numbers, sent to every task if they are at most ``BROADCAST_KEYS``; more are joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows


def across_groups(hubs: DataFrame, roots: DataFrame | None, nodes: DataFrame, texts: DataFrame, scratch: Scratch, similarity: float, part_rows: int) -> DataFrame:
    """(u, v): verified pairs that connect all nodes which pairs of ``similarity`` connect inside the groups that ``hubs`` (hub, node) make up.

    Nodes of one root in ``roots`` (node, root) are connected already. A group is cut into parts of about ``part_rows`` nodes or ``PART_BYTES`` of text, and each two parts meet in a
    task, where all pairs of different roots are compared by all bits and near ones by their shingles.
    So a text moves once for each part of its group, not for each pair, and no pairs are written but those that connect.
    """
    import pyarrow as pa

    groups = components(hubs.select(F.col("hub").alias("u"), F.col("node").alias("v")))
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "hub_group")
    members = groups.join(nodes.select("node", "best.content", *_LONGS), "node")
    if roots is None:
        members = scratch.table(members.withColumn("root", F.col("node")), "members")
    else:
        members = scratch.table(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
        mixed = members.groupBy("hub_group").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("hub_group")
        members = members.join(mixed, "hub_group", "left_semi")
    held = scratch.table(texts.join(_small(members.select("content", "node")), "content").dropDuplicates(["node"]).select("node", "text"), "group-texts")
    whole = members.join(held, "node")
    size = F.greatest(F.count("*") / part_rows, F.sum(F.octet_length("text")) / PART_BYTES)
    rows = whole.join(whole.groupBy("hub_group").agg(F.ceil(size).alias("parts")), "hub_group").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    rows = rows.select(F.xxhash64("hub_group", low, high).alias("place"), F.when(low < high, 1).otherwise(0).cast("long").alias("apart"), "node", "root", "part", *_LONGS, "text")

    def connecting(numbers: list[np.ndarray], said: list[str]) -> list[tuple[int, int]]:
        apart, node, root, part, *bits = numbers
        sets: dict[int, set[bytes]] = {}
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        def words(i: int) -> set[bytes]:
            if i not in sets:
                sets[i] = shingles(said[i])
            return sets[i]

        marks, out = np.stack(bits, axis=1), []
        for i in range(len(node) - 1):
            at = np.flatnonzero(np.bitwise_count((marks[i + 1 :] ^ marks[i]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= MOST_BITS) + i + 1
            at = at[(root[at] != root[i]) & ((part[at] != part[i]) | (apart[0] == 0))]
            for j in at.tolist():
                x, y = top(int(root[i])), top(int(root[j]))
                if x == y:
                    continue
                mine, other = words(i), words(j)
                least, most = sorted((len(mine), len(other)))
                if least >= similarity * most and (same := len(mine & other)) / (least + most - same) >= similarity:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(node[i]), int(node[j])))
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list) -> pa.RecordBatch:
            found = connecting([np.concatenate([h[0][c] for h in held]) for c in range(len(held[0][0]))], [t for h in held for t in h[1]])
            return pa.RecordBatch.from_arrays([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], names=["u", "v"])

        last, held = None, []
        for batch in batches:
            place = batch.column("place").to_numpy()
            cuts = [*np.flatnonzero(np.diff(place, prepend=place[:1] - 1)).tolist(), len(place)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if held and place[begin] != last:
                    yield done(held)
                    held = []
                last, piece = place[begin], batch.slice(begin, end - begin)
                held.append(([piece.column(c).to_numpy() for c in ("apart", "node", "root", "part", *_LONGS)], piece.column("text").to_pylist()))
        if held:
            yield done(held)

    return scratch.table(rows.repartition("place").sortWithinPartitions("place").mapInArrow(each, "u long, v long"), "last-edges")


def similar(nodes: DataFrame, texts: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, few: int = FEW, part_rows: int = PART_ROWS) -> DataFrame:
    """(u, v): verified pairs that connect all nodes that candidates of ``similarity`` connect.

    ``nodes`` has node, best (with the content of a text), b0-b5 and words; ``texts`` content and
    text. Candidates make up groups, and all pairs of a group are compared by their texts. The first
    quarter of the segments gives groups that are nearly whole; by the others only candidates
    of different groups are looked for, so that a dense group doesn't give all its pairs.
    """
    words, cut = nodes.filter("words"), SEGMENTS // 4
    found = scratch.table(met(segment_keys(words, segments=(0, cut), valued=True), few), "met")
    groups = components(grouping(found, nodes))
    words = words.join(groups, "node", "left")
    found = scratch.table(met(segment_keys(words, "root", segments=(cut, SEGMENTS), valued=True), few), "more-met")
    hubs = groups.select(F.col("root").alias("hub"), "node").unionByName(grouping(found, nodes).toDF("hub", "node"))
    return across_groups(hubs, None, nodes, texts, scratch, similarity, part_rows)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group that pairs of ``similarity`` connect, that of the least id, in its own columns.

    Similarity is that of Jaccard over sets of 5-word shingles, verified on the texts; candidates
    are pairs whose wide fingerprints have a segment that differs in one bit at most. Texts without
    words (null, empty, blank) are alike. Rows that repeat the least id are alike to the group; one
    of them stays. Groups of null ids keep one row. An empty table gives no rows. Columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("content"))
    marked = scratch.table(sketched(texts), "sketches")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content")).alias("best")
    nodes = scratch.table(marked.groupBy("node").agg(best, F.first("words").alias("words"), *[F.first(b).alias(b) for b in _LONGS]), "nodes")
    roots = components(similar(nodes, texts.select("content", "text"), scratch, similarity))
    heads = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    heads = heads.select(F.col("best.id").alias("id"), F.col("best.content").alias("content"))
    rows = marked.groupBy("id", "content").agg(F.count("*").alias("n"))
    same = lambda x, y: (x["content"] == y["content"]) & x["id"].eqNullSafe(y["id"])
    rows = rows.alias("r").join(heads.withColumn("kept", F.lit(True)).alias("h"), same(rows, heads), "left").select("r.id", "r.content", "n", "kept")
    rows = scratch.table(rows.filter("kept IS NULL OR n > 1"), "rows")  # those that go, and those of which one row stays
    scratch.drop("sketches", "nodes", "met", "more-met", "members", "group-texts", "last-edges")
    known = lambda which: _small(rows.filter(which).select(F.col("id").alias("_gone_id"), F.col("content").alias("_gone_content")))
    boxed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("content"), F.struct("*").alias("record"))
    on = lambda: (F.col("content") == F.col("_gone_content")) & F.col("id").eqNullSafe(F.col("_gone_id"))
    once = boxed.join(known(F.lit(True)), on(), "left_anti")
    often = boxed.join(known("kept"), on(), "left_semi").dropDuplicates(["id", "content"])
    return once.unionByName(often).select("record.*")
