import itertools
import zlib

import numpy as np

from sluice.llm import toxicity
from sluice.llm.queries import op3_toxicity
from sluice.llm.toxicity import Tagger


def some_tagger():
    r = np.random.default_rng(1)
    t = Tagger({"bad": 3, "vile*": 8}, r.normal(size=toxicity.CLASSES), r.normal(size=(2, 2)), r.normal(size=2))
    t.doc = np.array([-2.0, 3, 1, 0])
    return t


def test_marginals_against_all_paths():
    t = some_tagger()
    for seen in ([3], [0, 3], [3, 0, 0, 8, 8, 0], [0, 0, 0, 8], [0, 3, 0, 0, 0, 0, 8, 0, 3]):
        x = np.array(seen)
        total, toxic = 0.0, np.zeros(len(x))
        for y in itertools.product((0, 1), repeat=len(x)):
            z = t.first[y[0]] + sum(t.emit[c] for c, s in zip(x, y, strict=True) if s) + sum(t.move[a, b] for a, b in itertools.pairwise(y))
            total += np.exp(z)
            toxic += np.exp(z) * np.array(y)
        at, p = t.marginals(x)
        assert at.tolist() == [i for i, c in enumerate(seen) if c]
        assert np.allclose(p, (toxic / total)[at])


def test_chain_is_fitted_to_labelled_tokens():
    r = np.random.default_rng(2)
    seen = [r.choice([0, 0, 0, 3, 8], 12) for _ in range(400)]
    labels = [(x == 3).astype(int) for x in seen]
    t = Tagger({"bad": 3, "vile*": 8})
    toxicity._fit_chain(seen, labels, t)
    at, p = t.marginals(np.array([0, 0, 3, 0, 8, 0]))
    assert p[0] > 0.9 and p[1] < 0.1


def test_spans_are_offsets():
    t = some_tagger()
    t.emit[:] = [-9, *[9] * (toxicity.CLASSES - 1)]
    t.move[:], t.first[:] = 0, 0
    text = "A BAD, vilest123 word"
    assert [text[a:b] for a, b, _ in t.spans(text)] == ["BAD", "vilest"]


def test_rows(spark):
    clean, bad = "the quiet river runs by the old mill", "you nasty creep the old mill is a nasty place"
    rows = [(i, f"{bad if i % 3 == 0 else clean} w{i}", 7) for i in range(300)]
    odd = [(1000, None, 7), (1001, "", 7), (1002, "nasty creep " * 30_000, 7), (None, bad, 7), (5, rows[5][1], 7)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _, _ in rows] + [(2, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {x.doc_id: x for x in got}
    assert all(by[i].predicted == (i % 3 == 0) for i, _, _ in rows)
    assert by[1002].predicted == 1 and by[None].predicted == 1 and by[1000].score == by[1001].score < 0.3
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    assert "4:9" in by[0].offsets.split(",")
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() == 203
    assert {x.score for x in toxicity.score(df, toxicity.train(df, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).collect() == []


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    got = op3_toxicity(spark, at)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    label = {x.doc_id: x.toxic for x in spark.read.parquet(f"{at}/labels.parquet").collect()}
    held = [(x.predicted, label[x.doc_id]) for x in got.collect() if x.held_out and x.doc_id in label]
    caught, wrong = sum(p for p, y in held if y == 1), sum(p for p, y in held if y == 0)
    print(len(held), sum(y for _, y in held), caught, wrong)
    assert caught / sum(y for _, y in held) > 0.85
    assert wrong / sum(1 - y for _, y in held) < 0.02


def test_whole_texts_are_learned_from_and_odd_labels_are_defined(spark):
    t = some_tagger()
    assert len(toxicity._windows(t, "bad a b c d e f g h i j " * 100, 1)) == 101
    empty = spark.createDataFrame([(i, "12 34") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert len({x.score for x in toxicity.score(empty, toxicity.train(empty, labels)).collect()}) == 1
    wordless = spark.createDataFrame([(i, f"{i}") for i in range(40)], "doc_id long, text string")
    assert len({x.score for x in toxicity.score(wordless, toxicity.train(wordless, labels)).collect()}) == 1
    # Of conflicting labels the larger counts, for ids and for equal texts, in any order of rows.
    rows = [(i, f"{'vile thing' if i % 2 else 'nice thing'} n{i // 2}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(i, i % 2) for i in range(200)] + [(i, 0) for i in range(1, 200, 2)]
    scores = [sorted(map(tuple, toxicity.score(df, toxicity.train(df, spark.createDataFrame(m, "doc_id long, toxic int"))).collect())) for m in (marks, marks[::-1])]
    assert scores[0] == scores[1] and all(r[3] == r[0] % 2 for r in scores[0])


def test_letters_are_those_of_unicode():
    assert toxicity.letter_runs().findall("ab²½①Ⅷc_d1é ٣я") == ["ab", "c", "d", "é", "я"]


def test_query_against_a_plain_chain(spark):
    """The whole query on a small table: each score from a chain that walks token by token."""
    at = "/root/testdata/sf0.001"
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{at}/documents.parquet").collect()}
    tables = {n: spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels")}
    model = toxicity.train(tables["documents"], tables["labels"])
    got = {x.doc_id: x for x in op3_toxicity(spark, at).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        words = ["".join(w) for ok, w in itertools.groupby(toxicity.lowered(text), str.isalpha) if ok]
        seen = [max((model.classes.get(f, 0) for f in toxicity.features(w)), key=lambda c: ((c - 1) % len(toxicity.EDGES), c) if c else (-1, 0)) for w in words]
        total, top, step = 0.0, 0.0, np.exp(model.move)
        if any(seen):
            w = np.exp(np.c_[np.zeros(len(seen)), model.emit[seen]])
            f, b = [np.exp(model.first) * w[0]], [np.ones(2)]
            for i in range(1, len(seen)):
                f.append((f[-1] / f[-1].sum()) @ step * w[i])
                b.append(step @ (w[-i] * b[-1] / b[-1].sum()))
            p = np.array(f) * np.array(b[::-1])
            p = (p[:, 1] / p.sum(axis=1))[np.flatnonzero(seen)]
            total, top = p.sum(), p.max()
        z = np.array([1, np.log1p(total), top, np.log1p(1000 * total / max(1, len(seen)))]) @ model.doc if model.doc is not None else None
        assert np.isclose(got[k].score, 0 if z is None else 1 / (1 + np.exp(-np.clip(z, -30, 30))), atol=1e-9)
        assert got[k].predicted == (got[k].score >= 0.7)
