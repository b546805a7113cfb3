import hashlib
import random
import re

from sluice.llm import pii
from sluice.llm.queries import op1_pii


def brute(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_against_plain_patterns():
    r = random.Random(2)
    cards = ["4111 1111 1111 1111", "4952935900253052", "5500-0000-0000-0004"]
    bits = ["a", "b.c", "@", ".", "..", "1", "12", "255", "256", "001", " ", "-", "+", "+1 (017) 555-7713", "x@y.z", "@@", "é", *cards, "0000000255.1.2.3"]
    for _ in range(4000):
        text = "".join(r.choices(bits, k=r.choice([2, 6, 20])))
        base, every = pii.find(text)
        assert base == brute(text), text
        assert set(base) <= set(every)


def spans(text):
    return [(k, text[a:b]) for k, a, b in pii.find(text)[1]]


def test_disguises_map_back_to_the_source():
    assert spans("Write to jane [at] mail (dot) example [dot] com today") == [("email", "jane [at] mail (dot) example [dot] com")]
    assert spans("or jane.doe at example dot org.") == [("email", "jane.doe at example dot org")]
    assert ("email", "jоhn@ехample.com") in spans("mail jоhn@ехample.com!")  # Cyrillic letters
    assert spans("ｊｏｅ＠example．com") == [("email", "ｊｏｅ＠example．com")]
    assert spans("bob@exam​ple.com") [-1] == ("email", "bob@exam​ple.com")
    assert spans("call plus one five five five zero one two three four now") == [("phone", "plus one five five five zero one two three four")]
    assert spans("card four one one one 1111 1111 1111") == [("card", "four one one one 1111 1111 1111")]
    assert spans("host one nine two dot one six eight dot zero dot one up") == [("ip", "one nine two dot one six eight dot zero dot one")]
    assert spans("١٩٢.168.0.1") == [("ip", "١٩٢.168.0.1")]
    assert spans("4111 1111 1111 1ll1") == [("card", "4111 1111 1111 1ll1")]
    assert spans("call +1 (O17) 555-77l3") == [("phone", "+1 (O17) 555-77l3")]
    assert spans("1O 2 l 3 and 5 Oo 7") == []


def test_clean_texts_stay_clean():
    for text in ["We met at noon at the dot.", "one two three, go", "uno dos tres cuatro", "the dot com boom at home", "See (a) and [b] at 5. O2 is air", "ratio 1.2 at 3.4"]:
        assert spans(text) == [], text


def test_long_texts_are_linear():
    for text in ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "a@" * 100_000, "+1" * 100_000, "( " * 150_000, "one two " * 40_000, "о" * 200_000, "1." * 100_000]:
        assert pii.find(text)[0] == [] or text[0] == "1"


def test_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "a@b.co and +1 (017) 555-7713", 3), (3, "a@b.co and +1 (017) 555-7713", 3), (None, "joe [at] b [dot] co", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {(x.doc_id, x.n_email, x.n_phone, x.spans, x.n_added) for x in pii.spans(df).collect()}
    assert got == {(1, 0, 0, "", 0), (2, 0, 0, "", 0), (3, 1, 1, "email:0:6,phone:11:28", 0), (None, 0, 0, "email:0:19", 1)}
    clean = pii.redacted(df)
    assert clean.columns == df.columns
    assert sorted(str(x.text) for x in clean.collect()) == ["", "None", "[EMAIL]", "[EMAIL] and [PHONE]", "[EMAIL] and [PHONE]"]
    assert pii.spans(df.limit(0)).collect() == []


def test_query_on_the_small_table(spark):
    at = "/root/testdata/sf0.001"
    got = op1_pii(spark, at)
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{at}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(docs)
    for x in rows:
        base = brute(docs[x.doc_id])
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert x.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


def test_spelled_digits_are_linear():
    import time

    for text in ["one two three x five dot six and " * 60_000, "nine dot " * 220_000, "a @ b.co, " * 200_000, "see @ you and @ me " * 100_000]:
        began = time.time()
        pii.find(text)
        assert time.time() - began < 25, text[:20]


def test_at_signs_in_spaces():
    assert spans("write to joe @ example.com today") == [("email", "joe @ example.com")]
    assert spans("joe@ mail.example.com, or jim @mail.example.org") == [("email", "joe@ mail.example.com"), ("email", "jim @mail.example.org")]
    for text in ["look at example.com now", "5 @ 3.50 each", "meet @ noon.Then go", "we @ home", "x @ y.1"]:
        assert spans(text) == [], text
