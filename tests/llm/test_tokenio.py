import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sluice.llm import tokenio
from sluice.llm.queries import op9_tokenio

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(rows):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    out, at = [], 0
    for d, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        out.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


def test_shard_format():
    docs = [bytes(np.arange(n, dtype="<u4").tobytes()) for n in (1, 500, 3)]
    dictionary = tokenio.train([tokenio.planes(np.arange(i, i + 300, dtype="<u4").tobytes()) for i in range(200)], 4096)
    zipper = tokenio.codec(dictionary)[0]
    data = tokenio.pack_shard(dictionary, [5, None, 7], [1, 500, 3], [zipper.compress(tokenio.planes(d)) for d in docs])
    shard = tokenio.Shard(data, dictionary)
    assert [shard.ids(k) for k in (2, 0, 1)] == [docs[2], docs[0], docs[1]]
    with pytest.raises(ValueError, match="another dictionary"):
        tokenio.Shard(data, b"")


def test_odd_rows(spark, tmp_path):
    rows = [(None, "first"), (-3, "<|endoftext|> a"), (0, None), (1, ""), (2, "  It's 12\n\n x " * 4000), (5, "é 你好 ǅ 😀"), (6, "two"), (6, "two"), (9, "z" * 50)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows[::-1]], "doc_id long, text string, n int").repartition(3)
    got = sorted(map(tuple, tokenio.round_trip(df, PATH).collect()), key=lambda x: x[1])
    assert got == want(rows)
    assert tokenio.round_trip(df.limit(0), PATH).collect() == []
    tokenio.write(df, PATH, str(tmp_path / "out"))
    ids = {x.start: bytes(x.ids) for x in tokenio.read(spark, str(tmp_path / "out")).collect()}
    assert {s: zlib.crc32(x) for s, x in ids.items()} == {s: c for _, s, _, c in want(rows)}


def test_query_on_the_small_table(spark):
    at = "/root/testdata/sf0.001"
    docs = sorted((x.doc_id, x.text) for x in spark.read.parquet(f"{at}/documents.parquet").collect())
    got = op9_tokenio(spark, at)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want(docs)


def test_one_id_with_most_rows_is_spread(spark, tmp_path):
    rows = [(7, f"text {i % 90} again") for i in range(900)] + [(i, "x") for i in range(5)] + [(100, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokenio.write(df, PATH, str(tmp_path / "hot"))
    shards = spark.read.parquet(str(tmp_path / "hot/shards"))
    assert shards.groupBy("part").sum("n_docs").count() > 5
    got = sorted(map(tuple, tokenio.read(spark, str(tmp_path / "hot"), digest=True).collect()), key=lambda x: x[1])
    assert [x[0] for x in got] == sorted(d for d, _ in rows)
    assert [x[1] for x in got[1:]] == [x[1] + x[2] for x in got[:-1]]
    assert sorted(x[3] for x in got) == sorted(x[3] for x in want(rows))


def test_ids_of_all_kinds(spark, tmp_path):
    rows = [(None, "none"), (-(1 << 63), "least"), (0, "zero"), ((1 << 63) - 1, "most")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, tokenio.round_trip(df, PATH).collect()), key=lambda x: x[1]) == want(rows)
    small = spark.createDataFrame([(3, "b"), (1, "a")], "doc_id byte, text string")
    assert sorted(map(tuple, tokenio.round_trip(small, PATH).collect())) == want([(1, "a"), (3, "b")])
    with pytest.raises(TypeError, match="whole number"):
        tokenio.write(spark.createDataFrame([("x", "a")], "doc_id string, text string"), PATH, str(tmp_path / "t"))


def test_tasks_follow_the_bytes(spark, tmp_path):
    rows = [(i, f"text number {i} " * 20) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tokenio.write(df, PATH, str(tmp_path / "many"), range_bytes=2000)
    shards = spark.read.parquet(str(tmp_path / "many/shards"))
    assert shards.groupBy("part").count().count() > 80
    got = sorted(map(tuple, tokenio.read(spark, str(tmp_path / "many"), digest=True).collect()), key=lambda x: x[1])
    assert got == want(rows)


def test_new_words_go_to_the_library_together():
    own, sent = tokenio.LibraryEncoder(PATH), []

    class Told:
        def encode_batch_fast(self, parts, **more):
            sent.extend(parts)
            return library.encode_batch_fast(parts, **more)

    library, own.library = own.library, Told()
    r = np.random.default_rng(4)
    signs = np.array([*"abcdeéñß019'’s.,-_<|>\x1ć你ǅ½ª", "'s", "'ll"])
    every = [" ".join("".join(r.choice(signs, r.integers(1, 9))) for _ in range(200)) for _ in range(20)]
    every += ["", " ", "one", " <|endoftext|> x", "a \n b  c  d", " 's 'll  x "]
    got = own.encode_all(every)
    assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in every]
    sent.clear()
    words = [f"q{k}x{'abc'[k % 3]}" for k in range(1000)] + ["plain" + "".join(r.choice([*"abcdefgh"], 9)) for _ in range(1000)]
    assert own.encode(" ".join(words)) == np.array(library.encode(" ".join(words), add_special_tokens=False).ids, "<u4").tobytes()
    assert len(sent) < 1200


def test_a_stretch_of_many_texts_is_looked_up_once():
    own, asked = tokenio.LibraryEncoder(PATH), []
    library, every = own.library, ["one two two  three\n two", "two three two", "", " two", "x" * 70 + " " + "y z" * 5 + " two " + "w" * 70 + "'s", "é two 你 two,", "　 two", "two \x1e two"] * 30
    look_up = own._stretches.all
    own._stretches.all = lambda keys, make: asked.extend(keys) or look_up(keys, make)
    for _ in range(2):
        asked.clear()
        assert own.encode_all(every) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in every]
        assert len(asked) == len({*asked}) > 5
    ids = np.array([0, 1, 255, 256, 65_535, 65_536, 1 << 24, (1 << 32) - 1], "<u4").tobytes()
    assert tokenio.planes(ids)[:8] == ids[::4] and tokenio.unplanes(tokenio.planes(ids)) == ids and tokenio.planes(b"") == tokenio.unplanes(b"") == b""
