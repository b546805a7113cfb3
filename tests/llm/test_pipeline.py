import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sluice.llm import pii, simhash, toxicity
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_simhash import brute as components

AT = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    labels = spark.read.parquet(f"{AT}/labels.parquet")
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    model = toxicity.train(docs, labels)
    rows = {x.doc_id: x.text for x in docs.collect()}
    rows = {d: t for d, t in rows.items() if model.score(t or "") < 0.7}
    rows = {d: rows[d] for d, _, c in components(list(rows.items())) if c == d}
    rows = {x[0]: rows[x[0]] for x in contaminated(list(rows.items()), items) if not x[5]}
    clean = {d: pii.redact(t or "", pii.find(t or "")[1]) for d, t in rows.items()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, t in clean.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[d] = np.array(ids, "<u4").tobytes()
    got = corpus_pipeline.run(spark, AT)
    assert {x.doc_id: bytes(x.ids) for x in got.collect()} == want
    assert 0 < len(want) < docs.count()
    assert all(x.ids_sha256 == hashlib.sha256(want[x.doc_id]).hexdigest() for x in got.collect())


def test_all_stages_but_the_last_keep_the_columns(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, AT)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, AT).collect() == []


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(3, text, 1), (2, text + " ", 1), (2, text + " ", 1), (2, text, 5), (None, text, 1), (9, "other words that stand alone here", 1), (None, None, 1), (None, None, 1), (None, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    kept = sorted(map(tuple, simhash.keep_one(df).collect()), key=str)
    assert len(kept) == 3 and simhash.keep_one(df).columns == df.columns
    assert {x[0] for x in kept} == {2, 9, None}
