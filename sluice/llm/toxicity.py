"""Operator 3: toxicity by a linear-chain conditional random field.

Labels are of documents. Words and word beginnings that stand in far more of the toxic documents than of others become
features; in the learning sample, a token with a feature is labelled toxic in a toxic document, all other tokens are labelled
clean. A chain with two states (clean, toxic), weights for each class of feature, and weights for transitions and
the start is fitted to these labelled tokens by gradient ascent on the conditional likelihood. Forward-backward gives each
token's marginal probability; the offending spans are the tokens of probability 1/2 or more. The marginals of a whole text are
aggregated (their sum, largest value and density), and a logistic function of these, fitted to the labelled documents, is the score.

Tokens without a feature all have the same weights, so a stretch of them is one power of a 2 x 2 matrix: the chain is
exact over whole texts, and its work follows the number of featured tokens.

The learning sample is bounded by ``sample_docs`` labelled rows, chosen by a hash of the id; equal texts are learned from once. Nothing else
is cut: whole texts of the sample are counted, a feature stands in one toxic document in a hundred at least, so there are at most a hundred
times as many as a document has on average, and the chain is fitted to all windows around featured tokens, equal ones once with their number.

Defined results: null counts as empty; texts without words get the score of a sum of 0; null labels are not learned from; of conflicting
labels of one id, or of equal texts, the larger counts; without a label of either kind every score is 0, and if no labelled text has a word all scores are alike; a null id is not held out and not learned from; repeated rows give
repeated rows; empty tables give empty results; other columns are not looked at, and the filtering form keeps them.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import crc32_text, forget, letter_runs, map_arrow, texts, written

#: Lengths of word beginnings that may be features.
PREFIXES = (4, 5, 6, 7, 8)
#: Feature classes by log odds: below the first edge there is no feature. Words and beginnings have classes of their own.
EDGES = (2.0, 3.0, 4.0, 5.0, 6.0)
CLASSES = 1 + 2 * len(EDGES)
#: Words a worker keeps with their classes; windows the chain is fitted to at a time.
CACHE_ENTRIES, BLOCK_WINDOWS = 400_000, 8_192
#: Featured tokens within so many tokens share a window when learning.
REACH = 4


def lowered(text: str) -> str:
    """Lower case, character by character, so offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join([c if len(d := c.lower()) > 1 else d for c in text])


def features(word: str) -> list[str]:
    """The word, and its beginnings, marked by an asterisk."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


@dataclass
class Tagger:
    """Classes of features and the weights of the chain and of the document score."""

    classes: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))  # of toxic less clean, by class
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))
    doc: np.ndarray | None = None
    _known: dict[str, int] = field(default_factory=dict)

    def class_of(self, word: str) -> int:
        """The strongest class of a word's features; 0 for none."""
        get = self.classes.get
        c = max((get(f, 0) for f in features(word)), key=lambda c: ((c - 1) % len(EDGES), c) if c else (-1, 0))
        if len(self._known) >= CACHE_ENTRIES:
            self._known.clear()
        self._known[word] = c
        return c

    def observe(self, text: str) -> tuple[np.ndarray, list[str]]:
        """The feature class of each token of a text, and the tokens."""
        found = letter_runs().findall(lowered(text))
        known, new = self._known.get, self.class_of
        return np.array([c if (c := known(w)) is not None else new(w) for w in found], np.int64), found

    def marginals(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of featured tokens, and the probability of each to be toxic, by forward-backward over the whole text."""
        at = np.flatnonzero(seen)
        if not len(at):
            return at, np.zeros(0)
        step = np.exp(self.move)
        plain = step * np.exp([0.0, self.emit[0]])
        values, vectors = np.linalg.eig(plain)
        inverse, scale = np.linalg.inv(vectors), np.abs(values).max()

        def run(n: int) -> np.ndarray:
            """n plain tokens, up to a factor."""
            return np.eye(2) if not n else np.maximum(((vectors * (values / scale) ** n) @ inverse).real, 0)

        gap = np.diff(np.r_[-1, at, len(seen)]) - 1
        between = {int(n): run(int(n)) for n in np.unique(gap)}
        weight = np.exp(np.c_[np.zeros(len(at)), self.emit[seen[at]]])
        # Before the first token there is no transition, but the start's weights.
        if at[0] == 0:
            ahead = np.exp(self.first) * weight[0]
        else:
            ahead = (np.exp(self.first) * np.exp([0.0, self.emit[0]])) @ run(int(at[0]) - 1) @ step * weight[0]
        forward = [ahead / ahead.sum()]
        for k in range(1, len(at)):
            ahead = forward[-1] @ between[int(gap[k])] @ step * weight[k]
            forward.append(ahead / ahead.sum())
        back = between[int(gap[-1])] @ np.ones(2)
        backward = [back / back.sum()]
        for k in range(len(at) - 1, 0, -1):
            back = between[int(gap[k])] @ (step @ (weight[k] * backward[-1]))
            backward.append(back / back.sum())
        p = np.array(forward) * np.array(backward[::-1])
        return at, p[:, 1] / p.sum(axis=1)

    def tag(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Featured tokens and their probabilities; of these: 1, log of 1 + their sum, the largest, and the log density."""
        seen, _ = self.observe(text)
        at, p = self.marginals(seen)
        total = float(p.sum())
        return at, p, np.array([1.0, np.log1p(total), float(p.max()) if len(p) else 0.0, np.log1p(1000 * total / max(1, len(seen)))])

    def aggregate(self, text: str) -> np.ndarray:
        return self.tag(text)[2]

    def score(self, text: str) -> float:
        return self.judge(text, 2.0)[0]

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Offending tokens: start, end (code points) and probability."""
        return self._places(text, *self.tag(text)[:2], least)

    def judge(self, text: str, threshold: float) -> tuple[float, list[tuple[int, int, float]]]:
        """The score, and if it reaches ``threshold`` the offending tokens."""
        at, p, sums = self.tag(text)
        score = 0.0 if self.doc is None else float(1 / (1 + np.exp(-np.clip(sums @ self.doc, -30, 30))))
        return score, self._places(text, at, p) if score >= threshold else []

    def _places(self, text: str, at: np.ndarray, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int, float]]:
        places = [m.span() for m in letter_runs().finditer(lowered(text))] if len(at) else []
        return [(*places[i], float(x)) for i, x in zip(at.tolist(), p, strict=True) if x >= least]


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    """By feature, over a batch of (toxic, text): documents that have it, toxic and not."""
    out: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for toxic, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
        for f in {f for w in set(letter_runs().findall(lowered(text))) for f in features(w)}:
            out[f][0 if toxic else 1] += 1
    cols = np.array([*out.values()], np.int64).reshape(len(out), 2)
    return pa.record_batch([pa.array([*out], pa.string()), pa.array(cols[:, 0]), pa.array(cols[:, 1])], names=["f", "td", "nd"])


def _block(seen: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes and labels of some windows, (windows, longest), and which of them are tokens."""
    n = np.array([*map(len, seen)])
    x, y = np.zeros((len(n), n.max()), np.int64), np.zeros((len(n), n.max()), np.int64)
    for k, (a, b) in enumerate(zip(seen, labels, strict=True)):
        x[k, : n[k]], y[k, : n[k]] = a, b
    return x, y, np.arange(n.max()) < n[:, None]


def _expected(x: np.ndarray, live: np.ndarray, times: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of a block: the sums of toxic tokens by class, of transitions and of starts that the chain of weights ``w`` expects."""
    emit, move, first = w[:CLASSES], w[CLASSES : CLASSES + 4].reshape(2, 2), w[CLASSES + 4 :]
    size = x.shape[1]
    weight = np.exp(np.stack([np.zeros(x.shape), emit[x]], axis=-1))
    step = np.exp(move)
    f, b = np.zeros((*x.shape, 2)), np.zeros((*x.shape, 2))
    f[:, 0] = np.exp(first) * weight[:, 0]
    f[:, 0] /= f[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, size):
        now = (f[:, t - 1] @ step) * weight[:, t]
        f[:, t] = np.where(live[:, t, None], now / now.sum(axis=1, keepdims=True), f[:, t - 1])
    b[:, -1] = 0.5
    for t in range(size - 2, -1, -1):
        now = (weight[:, t + 1] * b[:, t + 1]) @ step.T
        b[:, t] = np.where(live[:, t + 1, None], now / now.sum(axis=1, keepdims=True), 0.5)
    p = f * b
    p /= p.sum(axis=2, keepdims=True)
    q = f[:, :-1, :, None] * step * (weight[:, 1:] * b[:, 1:])[:, :, None, :]
    q /= q.sum(axis=(2, 3), keepdims=True)
    moves = (q * (times[:, None] * live[:, 1:])[:, :, None, None]).sum(axis=(0, 1))
    return np.r_[np.bincount(x[live], (p[..., 1] * times[:, None])[live], minlength=CLASSES), moves.ravel(), times @ p[:, 0]]


def _fit_chain(seen: list[np.ndarray], labels: list[np.ndarray], tagger: Tagger, times: list[int] | None = None, rounds: int = 150, rate: float = 0.15) -> None:
    """Gradient ascent (Adam) on the conditional log likelihood of all labelled windows; ``times``: how often each of them comes."""
    if not seen:
        return
    times = np.array(times if times is not None else [1] * len(seen), float)
    order = sorted(range(len(seen)), key=lambda k: len(seen[k]))
    some = [order[at : at + BLOCK_WINDOWS] for at in range(0, len(order), BLOCK_WINDOWS)]
    blocks = [(*_block([seen[k] for k in part], [labels[k] for k in part]), times[part]) for part in some]
    want = np.zeros(CLASSES + 6)
    for x, y, live, n in blocks:
        each = np.broadcast_to(n[:, None], x.shape)
        both = live[:, 1:]
        moves = np.bincount((2 * y[:, :-1] + y[:, 1:])[both], each[:, 1:][both], minlength=4)
        want += np.r_[np.bincount(x[live], (each * y)[live], minlength=CLASSES), moves, np.bincount(y[:, 0], n, minlength=2)]
    w = np.zeros(CLASSES + 6)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        grad = (want - sum(_expected(x, live, n, w) for x, _, live, n in blocks)) / times.sum() - 1e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    tagger.emit, tagger.move, tagger.first = w[:CLASSES].copy(), w[CLASSES : CLASSES + 4].reshape(2, 2).copy(), w[CLASSES + 4 :].copy()


def _windows(tagger: Tagger, text: str, toxic: int) -> list[tuple[bytes, bytes]]:
    """Windows around all featured tokens with their labels, and one from the middle of the text."""
    seen, _ = tagger.observe(text)
    at = np.flatnonzero(seen)
    out, k = [], 0
    if len(seen):
        a = max(0, len(seen) // 2 - REACH)
        out.append((a, min(len(seen), a + 2 * REACH + 1)))
    while k < len(at):
        j = k
        while j + 1 < len(at) and at[j + 1] - at[j] <= REACH and at[j + 1] - at[k] < 48:
            j += 1
        out.append((max(0, at[k] - REACH), min(len(seen), at[j] + REACH + 1)))
        k = j + 1
    return [(seen[a:b].astype(np.uint8).tobytes(), ((seen[a:b] > 0) & (toxic == 1)).astype(np.uint8).tobytes()) for a, b in out]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)]) * len(y) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _share(df: DataFrame, tagger: Tagger):
    """A function that gives tasks the tagger: the features of the bounded sample, and some weights."""
    tagger._known.clear()
    sent, key = df.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(tagger), 1)), uuid.uuid4().hex

    def get() -> Tagger:
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = pickle.loads(zlib.decompress(sent.value))
        return _KEPT[key]

    return get


_KEPT: dict[str, Tagger] = {}


def train(df: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample_docs: int = 12_000, support: float = 0.01, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Tagger:
    """Learn from labelled rows outside the held-out fold, ``sample_docs`` of them at most or little more.

    ``support``: the share of the sample's toxic documents that a feature stands in at least.
    """
    usable = labels.where((crc32_text(labels[id_col]) % folds != held) & labels[label_col].isin(0, 1)).select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic"))
    usable = usable.groupBy("id").agg(F.max("toxic").alias("toxic"))
    part = round(min(1.0, sample_docs / max(1, usable.count())) * 1_000_000)
    chosen = usable.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < part)
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    # The chosen labels are about sample_docs rows of two numbers: small enough to send to every task.
    sample = docs.join(F.broadcast(chosen), "id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = kept = written(sample.select("toxic", "text"), "toxic-sample")
    rows = sample.count()
    if rows > 2 * sample_docs:  # ids that many rows share
        sample = sample.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < round(sample_docs / rows * 1_000_000))
    tagger = Tagger()
    n_docs = {x.toxic: x.n for x in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n_docs.get(0) or not n_docs.get(1):
        return tagger
    counts = map_arrow(sample, [F.col("toxic"), F.col("text")], _count, "f string, td bigint, nd bigint").groupBy("f").agg(F.sum("td").alias("td"), F.sum("nd").alias("nd"))
    odds = F.log((F.col("td") + 0.5) / (n_docs[1] + 1)) - F.log((F.col("nd") + 0.5) / (n_docs[0] + 1))
    best = counts.where(F.col("td") >= max(3, round(support * n_docs[1]))).select("f", odds.alias("odds")).where(F.col("odds") >= EDGES[0]).orderBy("f").collect()
    tagger.classes = {x.f: 1 + int(np.searchsorted(EDGES, x.odds, "right")) - 1 + (len(EDGES) if x.f.endswith("*") else 0) for x in best}
    get = _share(df, tagger)

    def window_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [w for toxic, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True) for w in _windows(get(), text, toxic)]
        return pa.record_batch([pa.array([w[0] for w in got], pa.binary()), pa.array([w[1] for w in got], pa.binary())], names=["x", "y"])

    # Equal windows are one row: the driver gets what differs in the sample.
    found = map_arrow(sample, [F.col("toxic"), F.col("text")], window_rows, "x binary, y binary").groupBy("x", "y").agg(F.count("*").alias("n"))
    windows = sorted((bytes(r.x), bytes(r.y), r.n) for r in found.toLocalIterator())
    _fit_chain([np.frombuffer(x, np.uint8) for x, _, _ in windows], [np.frombuffer(y, np.uint8) for _, y, _ in windows], tagger, [n for _, _, n in windows])
    get = _share(df, tagger)

    def aggregates(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([get().aggregate(t) for t in texts(batch.column(1))]).reshape(batch.num_rows, -1)
        return pa.record_batch([batch.column(0), *(pa.array(got[:, k]) for k in range(got.shape[1]))], names=["toxic", "a", "b", "c", "d"])

    # As many rows as the sample has; they are sorted here, as most are alike and would meet in one task.
    got = sorted(map(tuple, map_arrow(sample, [F.col("toxic"), F.col("text")], aggregates, "toxic int, a double, b double, c double, d double").collect()))
    tagger.doc = _logistic(np.array([x[1:] for x in got]), np.array([x[0] for x in got], float))
    forget(kept)
    return tagger


def score(df: DataFrame, tagger: Tagger, folds: int = 3, held: int = 1, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``held_out``, ``score``, ``predicted``, ``offsets`` (start:end of offending tokens, comma-joined)."""
    get = _share(df, tagger)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, s, spans = get(), [], []
        for t in texts(batch.column(2)):
            value, found = own.judge(t, threshold)
            s.append(value)
            spans.append(",".join(f"{a}:{b}" for a, b, _ in found))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array(spans, pa.string())], names=[id_col, "held_out", "score", "predicted", "offsets"])

    kind = df.schema[id_col].dataType.simpleString()
    out = F.coalesce(crc32_text(df[id_col]) % folds == held, F.lit(False))
    return map_arrow(df, [df[id_col].alias(id_col), out.alias("held_out"), df[text_col].alias("__text")], run, f"{id_col} {kind}, held_out boolean, score double, predicted int, offsets string")


def keep_clean(df: DataFrame, tagger: Tagger, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, with all their columns."""
    get, at = _share(df, tagger), df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([get().score(t) < threshold for t in texts(batch.column(at))], pa.bool_()))

    return map_arrow(df, [df[c] for c in df.columns], run, df.schema)
