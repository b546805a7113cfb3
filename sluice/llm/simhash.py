"""Operator 7: SimHash near-duplicate detection by a binary trie self-join.

Fingerprints. Words of the text, A-Z in lower case, give shingles of four words; a bit of the 64-bit fingerprint is 1
if it is set in over half of the shingles' XXH64 values. Fewer than four words make one shingle; no words, and null,
make fingerprint zero, which links like any other.

Links. Two fingerprints link if at most ``budget`` bits differ. Texts with the same fingerprint are one node from the
start, so copies never make pairs. The 64 bits are laid in blocks: if two fingerprints differ in ``budget`` bits at most,
they agree on ``keep`` of ``budget + keep`` blocks, whatever the bits are. For each choice of ``keep`` blocks those are the
top levels of one binary trie, and a node at that depth is one key of a shuffle: the pairs below a common node are all
the pairs with no differing bit so far. From there the tasks walk down node pairs together, level by level, adding
differing bits, and prune a pair of nodes when the budget is exceeded. A pair of nodes that holds more fingerprints than
``hot_rows`` is expanded before the shuffle: its fingerprints go to pairs of deeper nodes that both exist and are still within the
budget. That is repeated on measured sizes until every pair is small, so no task has to hold a hot one whole. Each task returns a forest of its
links, not all pairs.

Components. Forest edges are contracted by alternating large-star and small-star rounds over written tables, which
survive lost executors; nothing but counts reaches the driver. Fingerprints and roots that many rows share are joined by broadcast.

Defined results: null doc_ids are kept and never decide a component's id unless all ids of it are null; repeated rows
and repeated ids are kept as rows; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import HUBS, forget, free_name, hub_join, map_arrow, texts, written

SEED = 42
SHINGLE = 4
#: Node pairs with fewer comparisons than this are compared at once; comparisons that are made at a time.
LEAF_PAIRS, BLOCK_PAIRS = 1024, 1_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a text."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.zeros(len(words), np.int64)
    np.cumsum(size[:-1] + 1, out=start[1:])
    end = start + size
    first, last = start[:n].tolist(), (end[SHINGLE - 1 :] if len(words) >= SHINGLE else end[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col`` and ``fp`` (bigint: the 64 bits as a signed number)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in texts(batch.column(1))], np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df, [df[id_col].alias(id_col), df[text_col].alias("__text")], run, f"{id_col} {kind}, fp bigint")


def trie_pairs(fp: np.ndarray, a0, a1, b0, b1, budget: int, top: int = 63, right: np.ndarray | None = None):
    """Linked pairs, as positions (i, j), below pairs of trie nodes, in blocks.

    A node is a range of a sorted array whose fingerprints share their bits above ``top``. ``right`` None: both nodes of
    a pair are ranges of ``fp``, and a node paired with itself gives each of its pairs once. All node pairs go down one
    level at a time; a pair whose prefixes differ in more than ``budget`` bits is pruned, a small one is compared.
    """
    other = fp if right is None else right
    spent = np.zeros(len(a0), np.int64)
    for level in range(top, -1, -1):
        small = (a1 - a0) * (b1 - b0) <= LEAF_PAIRS
        yield from _leaves(fp, other, a0[small], a1[small], b0[small], b1[small], right is None, budget)
        a0, a1, b0, b1, spent = (x[~small] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            return
        bit, above = np.uint64(1 << level), np.uint64(((1 << 64) - 1) ^ ((1 << (level + 1)) - 1))
        am = np.clip(np.searchsorted(fp, (fp[a0] & above) | bit), a0, a1)
        bm = np.clip(np.searchsorted(other, (other[b0] & above) | bit), b0, b1)
        two = ~((a0 == b0) & (a1 == b1)) if right is None else np.ones(len(a0), bool)
        parts = [(a0, am, b0, bm, spent), (am, a1, bm, b1, spent), (a0, am, bm, b1, spent + 1), (am[two], a1[two], b0[two], bm[two], spent[two] + 1)]
        a0, a1, b0, b1, spent = (np.concatenate([p[k] for p in parts]) for k in range(5))
        live = (a1 > a0) & (b1 > b0) & (spent <= budget)
        a0, a1, b0, b1, spent = (x[live] for x in (a0, a1, b0, b1, spent))
    yield from _leaves(fp, other, a0, a1, b0, b1, right is None, budget)


def _leaves(left, right, a0, a1, b0, b1, own, budget):
    """Compare the fingerprints below many small node pairs, about a million comparisons at a time."""
    edges = np.cumsum((a1 - a0) * (b1 - b0))
    at = 0
    while at < len(edges):
        to = max(at + 1, int(np.searchsorted(edges, (edges[at - 1] if at else 0) + BLOCK_PAIRS, "right")))
        n = ((a1 - a0) * (b1 - b0))[at:to]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(b1[at:to] - b0[at:to], n)
        i, j = np.repeat(a0[at:to], n) + k // width, np.repeat(b0[at:to], n) + k % width
        near = np.bitwise_count(left[i] ^ right[j]) <= budget
        if own:
            near &= i < j
        if near.any():
            yield i[near], j[near]
        at = to


def contract(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Unite the components of positions i and j; ``root`` points from each position to the smallest of its component."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not ((up := root[root]) == root).all():
            root = up


def _forest(key: np.ndarray, fp: np.ndarray, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked fingerprint to the first one of its component."""
    root = np.arange(len(key))
    for i, j in pairs:
        root = contract(root, i, j)
    at = np.flatnonzero(root != np.arange(len(key)))
    return fp[at], fp[root[at]]


def layout(distinct: int, budget: int) -> tuple[int, int]:
    """Blocks, and how many of them agree: so many that a node has few random fingerprints, whatever their number."""
    keep = 1
    while keep < 4 and 64 // (budget + keep) * keep + 8 < np.log2(max(2, distinct)):
        keep += 1
    return budget + keep, keep


def keyed(nodes: DataFrame, blocks: int, keep: int) -> tuple[DataFrame, int]:
    """Each fingerprint in each bit order: the order ``t``, and the bits in it, ``bits``; the least number of top bits that agree.

    The ``keep`` blocks that are taken as equal come first, so they are the top of that order's trie.
    """
    edge = [64 * i // blocks for i in range(blocks + 1)]
    ways, top = [], 64
    for t, choice in enumerate(combinations(range(blocks), keep)):
        bits = F.lit(0).cast("bigint")
        for i in [*choice, *(x for x in range(blocks) if x not in choice)]:
            width = edge[i + 1] - edge[i]
            block = F.shiftrightunsigned("fp", 64 - edge[i + 1]).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
            bits = F.shiftleft(bits, width).bitwiseOR(block)
        top = min(top, sum(edge[i + 1] - edge[i] for i in choice))
        ways.append(F.struct(F.lit(t).alias("t"), bits.alias("bits")))
    return nodes.select("fp", F.explode(F.array(*ways)).alias("w")).select("fp", "w.t", "w.bits"), top


def deal(rows: DataFrame, budget: int, top: int, hot_rows: int, depth: int) -> DataFrame:
    """Work on node pairs: (``fp``, ``t``, ``bits``, ``size``, ``p``, ``q``): both nodes have ``size`` bits, p <= q, none has more than ``hot_rows``.

    At first each node is paired with itself. What is hot goes down ``depth`` levels, with measured sizes after each step: every fingerprint of
    it goes to the pairs of its own deeper node with those of its partner that exist within the budget.
    """
    node = F.shiftrightunsigned("bits", 64 - top)
    now = rows.select("fp", "t", "bits", F.lit(top).alias("size"), node.alias("p"), node.alias("q"))
    pair, done = ["t", "p", "q"], []
    for size in range(top, 64, depth):
        hot = written(now.groupBy(*pair).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(*pair, F.lit(True).alias("hot")), "hot-nodes")
        n_hot = hot.count()
        if not n_hot:
            break
        # At most one hot pair for each ``hot_rows`` rows.
        flagged = now.join(F.broadcast(hot) if n_hot <= HUBS else hot, pair, "left")
        done.append(flagged.where("hot IS NULL").select(now.columns))
        step = min(depth, 64 - size)
        below = F.shiftrightunsigned("bits", 64 - size - step)
        own = below.bitwiseAND(F.lit((1 << step) - 1).cast("bigint")).cast("int")
        on_left = F.shiftrightunsigned("bits", 64 - size) == F.col("p")
        mine = written(flagged.where("hot").select("fp", "t", "bits", "p", "q", below.alias("below"), own.alias("own"), on_left.alias("on_left")), "hot-rows")
        # The deeper nodes of each hot pair's sides that have rows: 2 to the power of depth at most for a side.
        there = written(mine.select("t", "p", "q", F.when(F.col("on_left"), F.col("p")).otherwise(F.col("q")).alias("side"), F.col("own").alias("other")).distinct(), "deep-nodes")
        side = F.when(F.col("on_left"), F.col("q")).otherwise(F.col("p"))
        out = mine.select("fp", "t", "bits", "p", "q", "below", "own", side.alias("side"))
        within = lambda other: F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) + F.bit_count(F.col("own").bitwiseXOR(other)) <= budget
        if there.count() <= HUBS:
            there = there.toDF("t_", "p_", "q_", "side_", "other")
            on = (F.col("t") == F.col("t_")) & (F.col("p") == F.col("p_")) & (F.col("q") == F.col("q_")) & (F.col("side") == F.col("side_"))
            out = out.join(F.broadcast(there), on & within(F.col("other")))
        else:
            every = F.sequence(F.lit(0), F.lit((1 << step) - 1))
            out = out.withColumn("other", F.explode(F.filter(every, within)))
        theirs = F.shiftleft("side", step).bitwiseOR(F.col("other").cast("bigint"))
        now = out.select("fp", "t", "bits", F.lit(size + step).alias("size"), F.least("below", theirs).alias("p"), F.greatest("below", theirs).alias("q"))
        now = written(now, "dealt")
    for part in done:
        now = now.unionByName(part)
    return now


def links(nodes: DataFrame, budget: int = 4, hot_rows: int = 20_000, depth: int = 8) -> DataFrame:
    """Forest edges (``a``, ``b``) among the distinct fingerprints ``fp`` of ``nodes``; ``budget`` bits may differ.

    ``hot_rows``, ``depth``: a pair of trie nodes with more fingerprints is dealt out as pairs of the nodes so many levels below.
    """
    blocks, keep = layout(nodes.count(), budget)
    rows, top = keyed(nodes, blocks, keep)

    def joined(size: int, p: int, q: int, fp: np.ndarray, bits: np.ndarray) -> pa.RecordBatch | None:
        order = np.argsort(bits, kind="stable")
        fp, bits = fp[order], bits[order]
        if p != q:
            cut = int(np.searchsorted(bits >> np.uint64(64 - size), np.uint64(max(p, q))))
            if cut in (0, len(bits)):
                return None
            found = trie_pairs(bits[:cut], *(np.array([x]) for x in (0, cut, 0, len(bits) - cut)), budget, 63, bits[cut:])
            a, b = _forest(bits, fp, ((i, j + cut) for i, j in found))
        else:
            node = bits >> np.uint64(64 - size) if size < 64 else bits
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            end = np.r_[start[1:], len(bits)]
            start, end = start[end - start > 1], end[end - start > 1]
            a, b = _forest(bits, fp, trie_pairs(bits, start, end, start, end, budget, 63 - size))
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]) if len(a) else None

    def run(batches):
        """Sorted rows of whole nodes; the last node of a batch waits for the next ones, which may hold more of it."""
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            now = [np.asarray(batch.column(n)) for n in ("t", "size", "p", "q", "fp", "bits")]
            changes = np.flatnonzero(np.any([x[1:] != x[:-1] for x in now[:4]], axis=0)) + 1
            if kept and any(x[0] != y[-1] for x, y in zip(now[:4], kept[-1][:4], strict=True)):
                yield from whole([np.concatenate(x) for x in zip(*kept, strict=True)])
                kept = []
            if len(changes):
                cut = int(changes[-1])
                kept.append([x[:cut] for x in now])
                yield from whole([np.concatenate(x) for x in zip(*kept, strict=True)])
                kept = [[x[cut:] for x in now]]
            else:
                kept.append(now)
        if kept:
            yield from whole([np.concatenate(x) for x in zip(*kept, strict=True)])

    def whole(cols: list[np.ndarray]):
        t, size, p, q, fp, bits = cols
        if not len(t):
            return
        # Nodes at the top, paired with themselves, are walked together: their keys need not be told apart here.
        alike = (size == top) & (p == q)
        change = np.any([x[1:] != x[:-1] for x in (t, size)], axis=0) | ((p[1:] != p[:-1]) | (q[1:] != q[:-1])) & ~(alike[1:] & alike[:-1])
        start = np.flatnonzero(np.r_[True, change])
        for i, j in zip(start, np.r_[start[1:], len(t)], strict=True):
            out = joined(int(size[i]), 0 if alike[i] else int(p[i].view(np.uint64)), 0 if alike[i] else int(q[i].view(np.uint64)), fp[i:j].view(np.uint64), bits[i:j].view(np.uint64))
            if out is not None:
                yield out

    dealt = deal(rows, budget, top, hot_rows, depth)
    ready = dealt.repartition("t", "size", "p", "q").sortWithinPartitions("t", "size", "p", "q")
    return ready.mapInArrow(run, "a bigint, b bigint")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star round: (``a``, ``b``) with a > b point towards smaller fingerprints."""
    if large:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "stars")
        out = hub_join(both.where("v > u"), least.select("u", "m"), "u", least.select("u", "n")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "stars")
        out = hub_join(edges, least.select("a", "m"), "a", least.select("a", "n")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``fp``, ``root``): each linked fingerprint and the smallest of its component, that one itself left out."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark or not seen.n:
            return now.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        mark, before = seen, now
        now = written(star(star(now, True), False), "links")
        forget(before)


def _named(docs: DataFrame, budget: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(``fp``, ``component_id``, ``root``) of all fingerprints of ``docs``, and how many rows each has: (``fp``, ``n``)."""
    nodes = written(docs.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), budget))
    linked = written(roots.union(roots.select("root", "root").distinct()).toDF("fp", "root").join(nodes.select("fp", "least"), "fp"), "linked")
    whole = written(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "roots")
    moved = hub_join(linked, whole.select("root", "component_id"), "root", whole.select("root", "n")).select("fp", "component_id", "root")
    named = nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return written(named, "named"), nodes.select("fp", "n")


def near_duplicates(df: DataFrame, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``fp``, ``component_id``: the smallest id that is reachable by links, its own included."""
    docs = written(fingerprints(df, id_col, text_col), "fingerprints")
    named, counts = _named(docs, budget, id_col)
    return hub_join(docs, named.select("fp", "component_id"), "fp", counts).select(id_col, "fp", "component_id")


def keep_one(df: DataFrame, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns of ``df``: that of the smallest id, null last; of rows with that id any one.

    Rows are told apart by a hash of all their columns; the texts are read twice and shuffled once at most.
    """
    key = free_name(df, "row_key")
    rows = df.withColumn(key, F.struct(df[id_col].alias("id"), F.xxhash64(*[df[c] for c in df.columns]).alias("row")))
    marked = rows.select(F.col(key).alias("key"), df[text_col].alias("text"))
    docs = written(fingerprints(marked, "key", "text").select("key", "fp"), "fingerprints")
    named, _ = _named(docs.select("key.id", "fp"), budget, "id")
    rank = F.min(F.struct(F.col("key.id").isNull().alias("no_id"), "key")).alias("best")
    # A fingerprint's rows and a component's fingerprints are added up before they are moved.
    winners = docs.groupBy("fp").agg(rank).join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("best"))
    winners = written(winners.select(F.col("best.key.id").alias("id"), F.col("best.key.row").alias("row"), F.lit(True).alias("won")), "winners")
    # Rows that are the same in all columns, ids too, share a key: one of each is left. Null ids are found by their hash alone.
    mine, theirs = free_name(rows, "row_hash"), free_name(rows, "won")
    rows = rows.withColumn(mine, F.xxhash64(key))
    right = winners.select(F.xxhash64(F.struct("id", "row")).alias(mine), F.col("won").alias(theirs)).distinct()
    counts = docs.groupBy(F.xxhash64("key").alias(mine)).agg(F.count("*").alias("n"))
    kept = hub_join(rows, right, mine, counts).drop(theirs)
    again = written(counts.where("n > 1").select(mine), "repeated")
    if again.isEmpty():
        return kept.drop(key, mine)
    one = kept.join(again, mine, "left_semi").dropDuplicates([mine])
    return kept.join(again, mine, "left_anti").unionByName(one).drop(key, mine).select(df.columns)
