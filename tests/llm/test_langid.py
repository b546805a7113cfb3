import zlib

import numpy as np

from sluice.llm import langid
from sluice.llm.queries import op5_langid


def test_back_off_takes_the_longest_known_order():
    two = lambda a, b: np.array([a, b], float)
    m = langid.Model(["aa", "bb"], two(1, 1), {"known": two(9, 0)}, {3: {"xyz": two(0, 8)}, 2: {"qq": two(5, 0)}, 1: {"x": two(7, 0)}})
    assert m.predict("KNOWN")[0] == "aa"
    assert m.predict("axyza")[0] == "bb"
    assert m.predict("qqq")[0] == "aa"
    assert (m.back_off("axyza") == m.grams[3][1][0]).all()
    assert (m.back_off("ßßß") == 0).all()
    assert m.predict("12 _ !") == ("und", 0.0)


def test_model_forgets_unseen_words_without_changing_scores(monkeypatch):
    monkeypatch.setattr(langid, "UNSEEN", 4)
    m = langid.Model(["aa", "bb"], np.ones(2), {"k": np.array([3.0, 1])}, {1: {c: np.array([i + 1.0, 9 - i]) for i, c in enumerate("abcdef")}})
    for text in ["a b c d e f", "aa bb cc", "k a", "a b c d e f k"]:
        want = sum((m.word_rows[0] if w == "k" else m.back_off(w)) for w in text.split())
        assert np.allclose(m.sums(text.split()), want)


def test_rows(spark):
    rows = [(i, t, g, 1.0) for i, (t, g) in enumerate([("the dog and the cat", "en"), ("der hund und die katze", "de")] * 30)]
    rows += [(100, None, "en", 1.0), (101, "", None, 1.0), (102, "123 !?", "de", 1.0), (None, "the dog", None, 1.0), (103, "hund " * 20000, None, 1.0), (103, "hund " * 20000, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert {by[i].lang_pred for i in (100, 101, 102)} == {"und"}
    assert by[None].lang_pred == "en" and not by[None].held_out and by[103].lang_pred == "de"
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert langid.identify(df.limit(0)).collect() == []
    assert {x.lang_pred for x in langid.identify(df.where("lang IS NULL")).collect()} == {"und"}


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    got = op5_langid(spark, at)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    lang = {x.doc_id: x.lang for x in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "lang").collect()}
    held = [x for x in got.collect() if x.held_out and lang[x.doc_id]]
    assert len(held) > 100
    assert sum(x.lang_pred == lang[x.doc_id] for x in held) / len(held) > 0.97
    assert all(0 <= x.score <= 1 for x in held)


def test_many_languages_and_a_large_one(spark):
    """Each of 620 languages keeps its words beside one that has most of the rows."""
    word = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3)) + "o"
    rows = [(i, f"{word(i // 2)} {word(i // 2)}x", f"l{i // 2:03}") for i in range(1, 1240)]
    rows += [(10_000 + i, f"main text {word(i)}q {word(i + 1)}r", "zz") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.identify(df, max_words=50, max_grams=300).collect()}
    learned = [g for i, _, g in rows if not got[i].held_out and i < 10_000]
    asked = [(i, g) for i, _, g in rows if got[i].held_out and g in learned and i < 10_000]
    assert len(set(learned)) > 500 and len(asked) > 100
    assert sum(got[i].lang_pred == g for i, g in asked) > 0.9 * len(asked)
    try:
        langid.identify(df, model_bytes=1 << 18)
        raise AssertionError("a model over the bound was made")
    except ValueError as e:
        assert "model_bytes" in str(e)


def test_no_letters_is_und(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["plain words", "more words", "²½①Ⅷ", "٣٤", "x²"] * 4)], "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang_pred for x in langid.identify(df).collect()}
    assert {got[i] for i in range(20) if i % 5 in (2, 3)} == {"und"} and {got[i] for i in range(20) if i % 5 not in (2, 3)} == {"en"}


def test_query_against_plain_sums(spark):
    """The whole query on a small table, word by word: known words, else the longest known n-grams, and the languages' shares."""
    at = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{at}/documents.parquet")
    docs = {x.doc_id: x for x in df.collect()}
    used = [x for x in docs.values() if x.lang is not None and x.text is not None and zlib.crc32(str(x.doc_id).encode()) % 5]
    names = sorted({x.lang for x in used})
    count = {}
    for x in used:
        for w in langid.words(x.text):
            for n, g in [(0, w), *((n, g) for n in langid.ORDERS for g in langid.grams(w, n))]:
                row = count.setdefault((n, g), [0] * len(names))
                row[names.index(x.lang)] += 1
    total = {n: np.sum([c for (m, _), c in count.items() if m == n], axis=0) + 0.1 * sum(m == n for m, _ in count) for n in range(6)}

    def logs(n, g):
        v = np.log((np.array(count[n, g]) + 0.1) / total[n])
        return v - v.mean()

    prior = np.log(np.array([sum(x.lang == g for x in used) for g in names]) / len(used))
    for x in op5_langid(spark, at).collect():
        found = langid.words(docs[x.doc_id].text or "")
        if not found:
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        z = prior.copy()
        for w in found:
            n = 0 if (0, w) in count else next((n for n in langid.ORDERS if any((n, g) in count for g in langid.grams(w, n))), None)
            if n is not None:
                z += np.mean([logs(n, g) for g in ([w] if n == 0 else langid.grams(w, n)) if (n, g) in count], axis=0)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert x.lang_pred == names[int(np.argmax(p))] and abs(x.score - p.max()) < 1e-3
