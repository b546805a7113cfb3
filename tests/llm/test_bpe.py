import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sluice.llm import bpe
from sluice.llm.queries import op2_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "",
    " \t\n",
    "It's a DOG; we'll see'd 123 I'M",
    "<|endoftext|>Hi<|startoftext|> x<|ENDOFTEXT|>",
    "x" * 3000,
    "Straße é é İstanbul ΑΣ ΣΑΣ ǅ",
    "क्षि 你好 😀 a\x1cb\x85c\xa0d",
    "³½ªµ ＡＢ ٣٤",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_text_equal_the_library(library):
    own = bpe.encoder(PATH)
    for text in HARD:
        ids = own.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_no_token_spans_a_cut():
    own = bpe.encoder(PATH)
    tokens = [t for t in own.vocab if not t.startswith("<|")]
    assert not any(own.cuts(t.removesuffix("</w>")) for t in tokens if t.endswith("</w>"))
    assert own.cuts("zqxjw")


def test_query_on_odd_rows(spark, library):
    rows = [(i, t, "a") for i, t in enumerate([None, *HARD, HARD[2]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode_decode(df, PATH).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids
    assert bpe.digests(df.limit(0), PATH).collect() == []
    assert {r.n_tokens for r in bpe.digests(df, PATH).where("doc_id < 3").collect()} == {0}


def test_query_on_the_small_table(spark, library):
    at = "/root/testdata/sf0.001"
    got = op2_bpe(spark, at)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{at}/documents.parquet").collect()}
    want = set()
    for d, t in docs.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert set(map(tuple, got.collect())) == want
