import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sluice.llm import pseudolm
from sluice.llm.queries import op6_pseudolm

AT = "/root/testdata/sf0.001"


def plain_score(net, text):
    """Token by token: the class's and the token's share, from embeddings, tanh and two soft maxima."""
    v = net.vocabulary
    ids = [v.numbers.get(w, 1 + pseudolm.bucket(w, v.buckets)) for w in pseudolm.WORDS.findall(text or "")]
    padded, total = [0] * 4 + ids + [0] * 4, 0.0
    for i, t in enumerate(ids):
        near = padded[i : i + 4] + padded[i + 5 : i + 9]
        h = np.tanh(net.bias + sum(net.embed[x].astype(float) * net.weight[p] for p, x in enumerate(near)))
        z = h @ net.cls + net.cls_bias
        u = h @ net.out[v.cls[t]] + net.out_bias[v.cls[t]]
        total += z[v.cls[t]] - np.log(np.exp(z).sum()) + u[v.place[t]] - np.log(np.exp(u).sum())
    return len(ids), total


def small(words=40, buckets=5, width=8, seed=1):
    r = np.random.default_rng(seed)
    counts = np.r_[0, r.integers(1, 50, buckets + words)]
    v = pseudolm.Vocabulary({f"w{k}": 1 + buckets + k for k in range(words)}, buckets, counts)
    return pseudolm.Network.new(v, width, seed)


def test_numbers_classes_and_buckets(spark):
    net = small()
    v = net.vocabulary
    assert len({(c, p) for c, p in zip(v.cls[1:], v.place[1:], strict=True)}) == 45 and v.used.sum() == 45
    assert v.ids("w3, w3 other") == [9, 1 + pseudolm.bucket(",", 5), 9, 1 + pseudolm.bucket("other", 5)]
    got = spark.createDataFrame([("other",), ("é你",), ("x" * 100,)], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(77)).alias("b")).collect()
    assert all(pseudolm.bucket(x.w, 77) == x.b for x in got)


def test_all_tokens_share_probability_one_and_start_as_unigrams():
    net = small()
    r = np.random.default_rng(2)
    x = r.integers(0, 46, (1, 8))
    every = np.arange(1, 46)
    first = net.log_prob(np.repeat(x, 45, axis=0), every)
    assert np.allclose(first, np.log((net.vocabulary.counts[1:] + 0.5) / (net.vocabulary.counts[1:] + 0.5).sum()), atol=1e-4)
    for p in net.parameters()[3:4] + net.parameters()[5:6]:
        p[:] = r.normal(0, 1, p.shape)
    assert np.isclose(np.exp(net.log_prob(np.repeat(x, 45, axis=0), every)).sum(), 1, atol=1e-5)


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(3)
    x, y = r.integers(0, 46, (60, 8)).astype(np.int32), r.integers(1, 46, 60).astype(np.int32)
    net = small()
    for k in (1, 2, 3, 5):
        net.parameters()[k][...] += r.normal(0, 0.3, net.parameters()[k].shape)
    before = [p.copy() for p in net.parameters()]
    learner = pseudolm.Learner(net)
    got = {}
    learner._move = lambda k, grad, rows=...: got.setdefault(k, []).append((rows, grad))
    learner._step(x, y)
    for k, parts in got.items():
        whole = np.zeros_like(before[k], float)
        for rows, grad in parts:
            whole[rows] += grad
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in before[k].shape)
            loss = []
            for e in (1e-2, -1e-2):
                net.parameters()[k][at] = before[k][at] + e
                loss.append(-net.log_prob(x, y).mean())
            net.parameters()[k][at] = before[k][at]
            assert np.isclose(whole[at], (loss[0] - loss[1]) / 2e-2 if np.isfinite(before[k][at]) else 0, atol=2e-3), (k, at)
    del learner._move
    for _ in range(200):
        learner.learn(x, y, 1)
    assert net.log_prob(x, y).mean() > -1.0


def test_networks_are_averaged_by_what_they_have_seen():
    a, b, base = (pseudolm.Learner(small()) for _ in range(3))
    a.net.embed[7], b.net.embed[7] = 1.0, 3.0
    a.seen[7], b.seen[7], a.tokens, b.tokens = 30, 10, 1, 3
    a.net.bias[:], b.net.bias[:] = 4.0, 0.0
    got = pseudolm.averaged(base.net, pseudolm.added([a.state(), b.state()]))
    assert np.allclose(got.embed[7], 1.5) and np.allclose(got.bias, 1.0) and got.learned == 4
    assert np.allclose(got.embed[8], base.net.embed[8]) and (np.isfinite(got.out_bias) == base.net.vocabulary.used).all()


def test_rows(spark):
    rows = [(1, None, 0.0), (2, "", 0.0), (3, "abc abc, abc", 0.0), (3, "abc abc, abc", 0.0), (None, "x", 0.0), (4, "the cat " * 20_000, 0.0), (5, "é 你😀", 0.0), (6, " \n", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, log_prob double")
    assert {x.word: x.n for x in pseudolm.word_counts(df).collect()} == Counter(w for _, t, _ in rows for w in pseudolm.WORDS.findall(t or ""))
    net = pseudolm.train(df, vocabulary=4, buckets=3)
    got = sorted(((x.doc_id or -1, x.n_tokens, x.log_prob, x.mean_log_prob) for x in pseudolm.score(df, net).collect()))
    for g, (d, t, _) in zip(got, sorted(rows, key=lambda r: r[0] or -1), strict=True):
        n, total = plain_score(net, t[:80] if d == 4 else t) if d != 4 else (40_000, g[2])
        assert g[:2] == (d or -1, n) and np.isclose(g[2], total, rtol=1e-4, atol=1e-4) and np.isclose(g[3], total / max(1, n), rtol=1e-4, atol=1e-4)
    assert pseudolm.score(df.limit(0), pseudolm.train(df.limit(0))).collect() == []
    assert pseudolm.score(df, pseudolm.train(df.where("text = ''"))).count() == len(rows)


def test_what_is_learned_grows_with_the_corpus(spark):
    small_corpus = spark.createDataFrame([(i, f"some words of text {i} " * 9) for i in range(100)], "doc_id long, text string")
    large = small_corpus.unionByName(spark.createDataFrame([(i, f"more words of text {i} " * 9) for i in range(300)], "doc_id long, text string"))
    one, two = (pseudolm.train(d, vocabulary=50, buckets=20, rounds=2).learned for d in (small_corpus, large))
    assert 3.5 < two / one < 4.5 and abs(one - 100 * 45 / 8) < 500


def test_query_against_token_by_token_scores(spark):
    got = op6_pseudolm(spark, AT)
    assert got.columns == ["doc_id", "n_tokens", "log_prob", "mean_log_prob"]
    df = spark.read.parquet(f"{AT}/documents.parquet")
    docs = {x.doc_id: x.text for x in df.collect()}
    rows = got.collect()
    assert {x.doc_id: x.n_tokens for x in rows} == {d: len(pseudolm.WORDS.findall(t or "")) for d, t in docs.items()}
    net = pseudolm.train(df)
    again = {x.doc_id: x.log_prob for x in pseudolm.score(df, net).collect()}
    for d in sorted(docs)[:20]:
        assert np.isclose(again[d], plain_score(net, docs[d])[1], rtol=1e-4, atol=1e-3)


def test_held_out_text_in_its_order_beats_shuffled_words_and_unigrams(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    # Copies stay on one side: the side is told by the beginning of the text.
    side = F.pmod(F.xxhash64(F.substring("text", 1, 40)), F.lit(10))
    net = pseudolm.train(df.where(side != 0))
    start = pseudolm.Network.new(net.vocabulary, 32, 7)
    r = np.random.default_rng(1)
    true, mixed, unigram = [], [], []
    for x in df.where(side == 0).limit(60).collect():
        ids, _ = net.vocabulary.stream([x.text])
        where = np.flatnonzero(ids)
        if len(where) < 30:
            continue
        other = ids.copy()
        other[where] = r.permutation(other[where])
        score = lambda n, s, at=where: n.log_prob(pseudolm.around(s, at), s[at]).mean()
        true.append(score(net, ids))
        mixed.append(score(net, other))
        unigram.append(score(start, ids))
    print(np.mean(true), np.mean(mixed), np.mean(unigram))
    assert np.mean(true) > np.mean(unigram) + 0.3
    assert np.mean(true) > np.mean(mixed)


def test_query_learns_from_every_token(spark, monkeypatch):
    nets, train = [], pseudolm.train
    monkeypatch.setattr(pseudolm, "train", lambda *a, **k: nets.append(train(*a, **k)) or nets[-1])
    rows = op6_pseudolm(spark, AT).collect()
    assert nets[0].learned == sum(x.n_tokens for x in rows) > 0


def test_tokens_are_those_of_the_pattern_whatever_stands_between():
    v = small().vocabulary
    every = ["", "w1 w2", " w3,\tw4\r\n\nw5\x0bw6 ", "w7\xa0w8 w9\x1cw10\x85x​y", "\n", "é—w1…w2 " + "x" * 70, "w1"]
    stream, sizes = v.stream(every)
    want = [[v.numbers.get(w, 1 + pseudolm.bucket(w, v.buckets)) for w in pseudolm.WORDS.findall(t)] for t in every]
    assert sizes.tolist() == [*map(len, want)]
    assert stream.tolist() == [0] * 4 + [x for ids in want for x in [*ids, 0, 0, 0, 0]]


def test_classes_are_cut_for_few_outputs():
    counts = np.r_[0, 1e6 / np.arange(1, 8001)]
    v = pseudolm.Vocabulary({}, 8000, counts)
    sizes = np.bincount(v.cls[1:])
    assert sizes.sum() == v.used.sum() == 8000 and len({*zip(v.cls[1:].tolist(), v.place[1:].tolist(), strict=True)}) == 8000
    mean = v.classes + (sizes[v.cls[1:]] * counts[1:]).sum() / counts.sum()
    assert mean < 0.75 * 2 * np.sqrt(8000)


def test_scores_of_numbers_are_those_of_texts(spark):
    rows = [(1, None), (2, ""), (None, "abc x, abc"), (4, "the cat " * 20_000), (4, "é 你😀 " + "y" * 70), (6, " \n"), (7, "abc " + "z" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for buckets in (3, 70_000):  # numbers of two and of four bytes
        found = pseudolm.numbered(df, vocabulary=4, buckets=buckets)
        net = pseudolm.train(found, stride=1)
        assert net.learned == 40_000 + sum(len(pseudolm.WORDS.findall(t or "")) for _, t in rows if t is None or "cat" not in t)
        key = lambda x: (x.doc_id or 0, x.n_tokens)
        got, want = (sorted(pseudolm.score(d, net).collect(), key=key) for d in (found, df))
        assert [key(x) for x in got] == [key(x) for x in want]
        assert np.allclose([x.log_prob for x in got], [x.log_prob for x in want], rtol=1e-5, atol=1e-4)


def test_sums_over_neighbours_and_rows_are_plain_ones_in_less_time():
    r = np.random.default_rng(4)
    reach, segment, width = pseudolm.REACH, pseudolm.SEGMENT, 32
    near, weight = (r.normal(size=s).astype(np.float32) for s in ((64, segment + 2 * reach, width), (2 * reach, width)))

    def plain():
        return sum(near[:, at : at + segment] * w for at, w in zip(pseudolm.NEAR, weight, strict=True))

    def at_once(out=np.empty((64, segment * width), np.float32)):
        pseudolm.summed(near, pseudolm.spread(weight, segment), out)
        return out.reshape(64, segment, width)

    assert np.allclose(at_once(), plain(), atol=1e-4)
    times = {f: [] for f in (plain, at_once)}
    for _ in range(9):
        for f, took in times.items():
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
    assert min(times[at_once]) < 0.75 * min(times[plain])
    for wide in (1, 7, 8):
        rows, first = r.normal(size=(50, wide)).astype(np.float32), np.array([0, 1, 5, 30])
        assert np.allclose(pseudolm.row_sums(rows, first), np.add.reduceat(rows, first), atol=1e-5)


def test_gradient_of_segments_with_some_tokens_masked_is_that_of_the_loss():
    r = np.random.default_rng(5)
    net = small()
    for k in (1, 2, 3, 5):
        net.parameters()[k][...] += r.normal(0, 0.3, net.parameters()[k].shape)
    tokens = r.integers(0, 46, (3, 20 + 2 * pseudolm.REACH)).astype(np.uint16)
    masked = (r.random((3, 20)) < 0.6) & (tokens[:, pseudolm.REACH : -pseudolm.REACH] > 0)
    learner, got = pseudolm.Learner(net), {}
    learner._move = lambda k, grad, rows=...: got.setdefault(k, (rows, grad.copy()))
    learner._step(tokens, masked)
    for k, (rows, grad) in got.items():
        p = net.parameters()[k]
        whole = np.zeros_like(p, float)
        whole[rows] += grad
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in p.shape)
            old, loss = p[at], []
            for e in (1e-2, -1e-2):
                p[at] = old + e
                loss.append(-net.log_probs(tokens, masked).mean())
            p[at] = old
            assert np.isclose(whole[at], (loss[0] - loss[1]) / 2e-2 if np.isfinite(old) else 0, atol=2e-3), (k, at)
