import hashlib
import random
import re

import duckdb

from sluice.llm import decontaminate
from sluice.llm.queries import ORACLE, op4_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, text in docs:
        w = split(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    found |= {x for x in got if x is not None}
                    hit |= set(range(i, i + n))
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(5)
    vocab = ["a", "b", "É", "x9", "zz", "Q"]
    items = [(i, r.choice([" ", "-", "\n"]).join(r.choices(vocab, k=r.choice([1, 3, 12, 13, 14, 30]) + 2))) for i in range(40)]
    items += [(50, None), (51, "..."), (7, items[7][1]), (52, items[3][1]), (7, "one more text of its own")]
    docs = [(0, None), (1, ""), (2, items[20][1].upper()), (3, "one more text of its own"), (3, "one more text of its own")]
    docs += [(10 + i, " ".join(r.choices([*vocab, "out"], k=r.choice([5, 40, 400])))) for i in range(60)]
    docs += [(100 + i, " ".join(r.choices(["u", "v"], k=300)) + " , " + items[i][1] + "! w") for i in range(30)]
    a = spark.createDataFrame([(d, t, True) for d, t in docs], "doc_id long, text string, contaminated boolean")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.contamination(a, b).collect()), key=str) == brute(docs, items)
    assert decontaminate.contamination(a.limit(0), b).collect() == []
    assert {x.n_hit for x in decontaminate.contamination(a, b.limit(0)).collect()} == {0}
    kept = decontaminate.remove_contaminated(a, b)
    assert kept.columns == a.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(x[0] for x in brute(docs, items) if not x[5])


def test_query_on_the_small_table(spark):
    at = "/root/testdata/sf0.001"
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{at}/documents.parquet").collect()]
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    got = op4_decontaminate(spark, at)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_sql_states_the_same_result():
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    docs, items = (con.execute(f"SELECT * FROM {n}").fetchall() for n in ("documents", "benchmark"))
    want = brute([x[:2] for x in docs], items)
    assert sorted(con.execute(ORACLE["op4_decontaminate"]).fetchall(), key=str) == want


def test_groups_of_items_give_the_same_rows(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(9)]
    items = [(i % 35, " ".join(r.choices(vocab, k=r.choice([2, 13, 20, 40])))) for i in range(40)]
    docs = [(i, " ".join([*r.choices([*vocab, "out"], k=50), r.choice(items)[1], *r.choices(vocab, k=30), r.choice(items)[1]])) for i in range(40)] + [(99, None)]
    a = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, found string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert len([*decontaminate.automata(b, group_words=100)]) > 4
    got = sorted(map(tuple, decontaminate.contamination(a, b, group_words=100).collect()), key=str)
    assert got == brute(docs, items) == sorted(map(tuple, decontaminate.contamination(a, b).collect()), key=str)
    kept = decontaminate.remove_contaminated(a, b, group_words=100)
    assert kept.columns == a.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, decontaminate.remove_contaminated(a, b).collect()))


def test_arrays_are_small():
    import pickle

    r = random.Random(3)
    own = decontaminate.Automaton(13)
    items = [(i, own.add([b"%d" % r.randrange(20_000) for _ in range(300)])) for i in range(200)]
    own.finish(items)
    flat = sum(len(x) * x.itemsize for x in (own.word, own.to, own.link, own.length, own.ends, own.next_end, own.keys, own.targets, own.start))
    assert not own.more and (flat + len(own.branches)) / own.size < 100
    assert len(pickle.dumps(own)) / own.size < 100


def test_spans_are_removed_by_length_and_coverage(spark):
    item = " ".join(f"q{i}" for i in range(30))
    part = " ".join(f"q{i}" for i in range(13))
    fill = " ".join(f"f{i}" for i in range(900))
    docs = [(1, f"{fill}, {item.upper()}! {fill}"), (2, f"{fill}, {part}! {fill}"), (3, f"One {part.replace(' ', ' - ')}, two."), (4, None), (5, "clean")]
    a = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n int")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {x.doc_id: x.text for x in decontaminate.remove_spans(a, b).collect()}
    assert got == {1: f"{fill}, ! {fill}", 2: docs[1][1], 3: "One , two.", 4: None, 5: "clean"}
