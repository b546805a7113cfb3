import random

import numpy as np
import pytest
import xxhash

from sluice.llm import simhash
from sluice.llm.queries import op7_simhash


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, budget=4):
    fps = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, fps[i] - (1 << 64) if fps[i] >> 63 else fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_rows_against_brute_force(spark):
    r = random.Random(1)
    vocab = ["".join(r.choices("abcdé", k=4)) for _ in range(300)]
    rows = [(1, None), (0, ""), (7, "Ab"), (8, "aB "), (9, " a\tb c"), (None, "xx yy"), (None, "ab")]
    for i in range(120):
        base = r.choices(vocab, k=r.choice([3, 5, 60, 200]))
        rows.append((100 + 10 * i, " ".join(base)))
        for k in range(r.choice([0, 0, 1, 3])):
            base = list(base)
            base[r.randrange(len(base))] = r.choice(vocab)
            rows.append((101 + 10 * i + k, " ".join(base)))
    rows += rows[20:24]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert len({c for _, _, c in got}) < len(rows) - 20


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("hot", [20_000, 50])
@pytest.mark.parametrize("keep", [1, 2])
def test_links_of_any_layout_and_of_hot_nodes(spark, monkeypatch, hot, keep):
    r = np.random.default_rng(3)
    center = r.integers(0, 2**63, 3, np.uint64)
    fp = {int(c) for c in r.integers(0, 2**63, 300, np.uint64)}
    for c in center:
        for _ in range(150):
            fp.add(int(c) ^ sum(1 << int(b) for b in r.integers(0, 64, r.integers(1, 9))))
    fp = sorted(x - (1 << 64) if x >> 63 else x for x in fp)
    monkeypatch.setattr(simhash, "layout", lambda n, budget: (budget + keep, keep))
    edges = simhash.links(spark.createDataFrame([(x,) for x in fp], "fp long"), hot_rows=hot)
    got = {x.fp: x.root for x in simhash.components(edges).collect()}
    root = {x: x for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fp):
        for y in fp[:i]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 4:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    assert {x: got.get(x, x) for x in fp} == {x: find(x) for x in fp}


def test_query_on_the_small_table(spark):
    got = op7_simhash(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    docs = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = sorted((d, f"{f % (1 << 64):016x}", c) for d, f, c in brute(docs))
    assert sorted(map(tuple, got.collect())) == want


def test_deep_hot_nodes_are_split_until_small(spark):
    """Fingerprints that differ in their last 14 bits only: whatever blocks are taken as equal, nodes stay hot for many levels."""
    r = np.random.default_rng(5)
    base = int(r.integers(0, 2**63, dtype=np.uint64)) >> 14 << 14
    fp = sorted({base | int(x) for x in r.integers(0, 1 << 14, 400)} | {(base | int(x)) - (1 << 63) for x in r.integers(0, 1 << 14, 60)})
    nodes = spark.createDataFrame([(x,) for x in fp], "fp long").cache()
    rows, top = simhash.keyed(nodes, 5, 1)
    dealt = simhash.deal(rows, 4, top, 60, 8)
    assert dealt.groupBy("t", "size", "p", "q").count().agg({"count": "max"}).first()[0] <= 60
    pairs = {(x.t, x.size, x.p, x.q): set() for x in dealt.select("t", "size", "p", "q").distinct().collect()}
    for x in dealt.collect():
        pairs[x.t, x.size, x.p, x.q].add(x.fp)
    met = {frozenset((a, b)) for s in pairs.values() for a in s for b in s if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert met == {frozenset((a, b)) for i, a in enumerate(fp) for b in fp[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}


def test_one_node_for_each_pair_at_full_depth(spark):
    fp = [-5, 4, 5, -1, 1 << 62, -(1 << 63), 0]
    rows = spark.createDataFrame([(x, 0, x) for x in fp], "fp long, t int, bits long")
    dealt = simhash.deal(rows, 4, 8, 1, 8)
    assert dealt.groupBy("t", "size", "p", "q").count().agg({"count": "max"}).first()[0] <= 2


def test_hubs_are_joined_by_broadcast(spark):
    from sluice.llm._common import hub_join

    left = spark.createDataFrame([(i % 5 if i % 3 else 7, i) for i in range(300)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(k, f"x{k}") for k in (0, 1, 2, 3, 4, 7, 9)], "k long, name string")
    got = hub_join(left, right, "k", hub_rows=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "__r", "__id", "row_key", "row_hash", "won", "fp", "key", "n", "id"]
    rows = [(i, t, *[f"{n}{i}" for n in names[2:]]) for i, t in [(2, "one two three four five"), (1, "one two three four five"), (3, "quite another text here today"), (None, "and one more text of words"), (None, "and one more text of words")]]
    rows.append(rows[2])
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    kept = simhash.keep_one(df)
    assert kept.columns == names
    got = kept.collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "3", "None"] and tuple(next(x for x in got if x.doc_id == 1)) == rows[1]
    assert simhash.keep_one(df.limit(0)).collect() == []
