"""Operator 6: language-model scores by masked pseudo-likelihood.

Tokens are words, as they are written, and runs of other signs between white space, which is not scored. The ``vocabulary`` most frequent ones of the
whole corpus have a number of their own; any other has that of its bucket, one of ``buckets`` by XXH64, so every text has a number for each
token. A network sees ``REACH`` tokens on either side of a masked one: their embeddings, weighted by position, are added up, and after a tanh
layer give the masked token's class and, within the class, the token. Every token of a document is predicted from both sides, and the logarithms of
the probabilities are summed. Classes are tokens of like frequency, few frequent or many rare ones, cut so that a token has the fewest outputs in the mean:
some twice the root of the vocabulary, not all of it.

Texts are cut into tokens twice, once to count them and once to write their numbers; learning and scores read these.

The network is trained in numpy. All words of all documents are counted, which gives the vocabulary, the classes and the output's first biases: training
begins at the unigram model. Every document is learned from in one of ``rounds`` rounds, by a hash of its text: one masked token in ``stride``, with
``stride`` 1, as the query has it, every token of the corpus once. So the steps grow with the corpus. In a round each task starts from the same network and goes on over its own documents; the networks are
averaged on executors and then on the driver, embeddings and outputs by how often each task has seen them. Tokens that stand together are masked
in one step, as segments of ``SEGMENT`` of them: each embedding is then looked up once and shifted to all its places. The driver gets
``MERGED`` networks a round at most, whatever the corpus, and each is as large as the vocabulary.

Defined results: null and empty texts have no tokens, log probability 0 and mean 0; beyond the ends of a text stands a pad token;
an empty corpus gives an untrained network, by which all tokens are equally likely in their class, and all classes; repeated rows count and are
returned as often as they come; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import chunks, forget, map_arrow, one_thread, texts, written

#: Tokens on either side of a masked one; words a task counts or remembers before it hands them on; tokens learned from or scored at a time.
REACH, HELD, CHUNK = 4, 400_000, 200_000
#: Tokens of a segment; segments scored at a time. Where in a segment's tokens the neighbours of its first masked one stand.
SEGMENT, SCORED = 128, 256
#: Tokens whose neighbours are added up, and rows of a product, at a time, so that they stay in the processor's cache.
BLOCK, ROWS = 1024, 512
#: Tokens of a step where a task has few, and how often these come for each step at most.
FEW, OFTEN = 2048, 64
NEAR = (*range(REACH), *range(REACH + 1, 2 * REACH + 1))
#: Networks that the driver gets after a round.
MERGED = 8
WORDS = re.compile(r"\w+|[^\w\s]+")
#: A sign that no stretch and no token holds, and the pattern of tokens and of this sign.
MARK = "\n"
MARKED = re.compile(rf"{WORDS.pattern}|{MARK}")


def bucket(word: str, buckets: int) -> int:
    """The bucket of a word that has no number; Spark's xxhash64 has the same."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


class Known(dict):
    """Numbers of words; those of other words, by bucket, are kept too, up to HELD of them. The mark has the pad's."""

    def __init__(self, numbers: dict[str, int], buckets: int):
        super().__init__(numbers | {MARK: 0})
        self.numbers, self.buckets = numbers, buckets

    def __missing__(self, word: str) -> int:
        found = 1 + bucket(word, self.buckets)
        if len(word) <= 64:
            self[word] = found
        return found

    def all(self, words: list[str], kind) -> np.ndarray:
        """The numbers of words."""
        if len(self) > len(self.numbers) + HELD:
            self.clear()
            self.update(self.numbers | {MARK: 0})
        return np.fromiter(map(self.__getitem__, words), kind, len(words))


def stretches(every: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """What stands between ASCII white space in some texts: where each text's stretches begin and the last one's end; the stretches.

    No token holds white space, so a text's tokens are those of its stretches.
    """
    lists = pc.ascii_split_whitespace(every.fill_null(""))
    return np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py(), lists.flatten()


def tokens_of(different: pa.Array) -> list[str]:
    """The tokens of some stretches, with a mark after each stretch."""
    if not len(different):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(different)], pa.int32()), different)
    return MARKED.findall(pc.binary_join(whole, MARK)[0].as_py() + MARK)


def class_edges(counts: np.ndarray) -> np.ndarray:
    """Where to cut tokens, by falling frequency, into classes, so that the mean number of outputs for a token is least: all classes, and its class's tokens.

    Frequent tokens get small classes, rare ones large ones. Cuts are looked for at some 300 places.
    """
    size = len(counts)
    upto = np.r_[0, np.cumsum(counts + 0.5)]
    upto /= upto[-1]
    at = np.unique(np.r_[np.arange(0, min(size, 256), 8), np.linspace(0, size, 257).astype(int)])
    best, before = np.zeros(len(at)), np.zeros(len(at), int)
    for j in range(1, len(at)):
        cost = best[:j] + 1 + (upto[at[j]] - upto[at[:j]]) * (at[j] - at[:j])
        before[j] = cost.argmin()
        best[j] = cost[before[j]]
    edges = [len(at) - 1]
    while edges[-1]:
        edges.append(int(before[edges[-1]]))
    return at[edges[::-1]]


@dataclass
class Vocabulary:
    """Numbers of tokens: 0 the pad, then buckets, then words; by number, how often each comes, its class, and its place in the class."""

    numbers: dict[str, int]
    buckets: int
    counts: np.ndarray
    _known: Known | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": None}

    def __post_init__(self) -> None:
        size = max(1, len(self.counts) - 1)
        order = 1 + np.lexsort((np.arange(size), -self.counts[1 : 1 + size]))
        #: Where each class begins among the tokens by frequency, and the last one ends.
        self.edges = class_edges(self.counts[order])
        sizes = np.diff(self.edges)
        self.width, self.classes = int(sizes.max()), len(sizes)
        #: The class and the place of each token by frequency.
        self.ranked = np.repeat(np.arange(self.classes), sizes), np.arange(size) - np.repeat(self.edges[:-1], sizes)
        self.cls, self.place = np.zeros(1 + size, np.int32), np.zeros(1 + size, np.int32)
        self.cls[order], self.place[order] = self.ranked
        self.kind = np.uint16 if len(self.counts) <= 1 << 16 else np.int32
        #: Which places of a class have a token.
        self.used = np.zeros((self.classes, self.width), bool)
        self.used[self.ranked] = True

    def ids(self, text: str) -> list[int]:
        return self.stream([text])[0][REACH:-REACH].tolist()

    def stream(self, every: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of some texts with pads between and around them, and how many each text has."""
        flat, sizes = self.flat(every)
        return padded(flat, sizes), sizes

    def flat(self, every: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of some texts one after another, and how many each text has."""
        if self._known is None:
            self._known = Known(self.numbers, self.buckets)
        edges, found = stretches(pa.array(every, pa.string()) if isinstance(every, list) else every)
        found = found.dictionary_encode()
        flat = self._known.all(tokens_of(found.dictionary), self.kind)
        # Of each different stretch, where its tokens end and how many it has.
        ends = np.flatnonzero(flat == 0)
        count = np.diff(ends, prepend=-1) - 1
        each = np.asarray(found.indices, np.int64)
        n = count[each]
        to = np.r_[0, np.cumsum(n)]
        return flat[np.arange(to[-1]) + np.repeat((ends - count)[each] - to[:-1], n)], np.diff(to[edges])


def padded(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The tokens of some texts with pads between and around them."""
    stream = np.zeros(len(flat) + REACH * (len(sizes) + 1), flat.dtype)
    stream[np.arange(len(flat)) + np.repeat(REACH * np.arange(1, len(sizes) + 1), sizes)] = flat
    return stream


def unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """What ``Vocabulary.flat`` gives, from numbers as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind), np.asarray(pc.binary_length(column), np.int64) // np.dtype(kind).itemsize


def segments(stream: np.ndarray) -> np.ndarray:
    """A stream's tokens in rows of SEGMENT, each with REACH tokens before and after it; the last row is filled with pads."""
    n = max(0, len(stream) - 2 * REACH)
    rows = -(-n // SEGMENT)
    stream = np.r_[stream, np.zeros(rows * SEGMENT - n, stream.dtype)] if rows * SEGMENT > n else stream
    return np.lib.stride_tricks.sliding_window_view(stream, SEGMENT + 2 * REACH)[::SEGMENT] if rows else np.zeros((0, SEGMENT + 2 * REACH), stream.dtype)


def shifted(rows: np.ndarray) -> np.ndarray:
    """A view of segments (segments, tokens and their neighbours, width): for each of 2 * REACH + 1 shifts a segment's tokens as one row (segments, shifts, tokens * width)."""
    n, size, width = rows.shape
    a, b, c = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (n, 2 * REACH + 1, (size - 2 * REACH) * width), (a, b, c), writeable=False)


def spread(weight: np.ndarray, size: int) -> np.ndarray:
    """Weights by position for rows of ``shifted``; a masked token itself, which stands in the middle, has none."""
    return np.tile(np.insert(weight, REACH, 0, axis=0), size)


def summed(rows: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
    """The sums over all shifts of segments times their weights, as ``spread`` has them."""
    step = max(1, BLOCK // max(1, rows.shape[1] - 2 * REACH))
    for a in range(0, len(rows), step):
        np.einsum("sjk,jk->sk", shifted(rows[a : a + step]), weight, out=out[a : a + step])


def row_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of rows from each place in ``first`` to the next one. Two numbers are added at a time, as the parts of a complex one, which takes half as long."""
    return np.add.reduceat(rows.view(np.complex64) if rows.shape[1] % 2 == 0 else rows, first).view(np.float32)


def alone(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Segments of one token: ``y`` between its neighbours ``x``."""
    return np.concatenate([x[:, :REACH], y[:, None], x[:, REACH:]], axis=1)


def around(stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The tokens on both sides of those at ``at``: (masked, 2 * REACH)."""
    return stream[at[:, None] + np.r_[-REACH:0, 1 : REACH + 1]]


def beside(rows: np.ndarray, last: np.ndarray | int) -> np.ndarray:
    """Rows with one more number each. Hidden layers get a one and weights their bias, so that the product of both adds the biases too."""
    out = np.empty((len(rows), rows.shape[1] + 1), np.float32)
    out[:, :-1], out[:, -1] = rows, last
    return out


def shares(h: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of the soft maximum of hidden layers' outputs, at one place of each row; both are as ``beside`` makes them."""
    z = h @ weights.T
    right = z.reshape(-1)[np.arange(len(z)) * z.shape[1] + at]
    np.exp(z, out=z)
    return right - np.log(z @ np.ones(z.shape[1], np.float32))


def by_class(c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of tokens by class, and in it each class's number, begin and end."""
    # Narrow numbers are sorted by their digits.
    order = np.argsort(c.astype(np.uint16) if len(c) and c.max() < 1 << 16 else c, kind="stable")
    edges = np.r_[0, np.flatnonzero(np.diff(c[order])) + 1, len(order)]
    return order, [(int(c[order[a]]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


@dataclass
class Network:
    """Embeddings (tokens, width), weights by position, a bias; the output for classes and, by class, for tokens, with biases."""

    vocabulary: Vocabulary
    embed: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    cls: np.ndarray
    cls_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    learned: int = 0

    @classmethod
    def new(cls, v: Vocabulary, width: int, seed: int) -> Network:
        """A network that knows how often tokens come, and nothing else."""
        r = np.random.default_rng(seed)
        f = np.float32
        n = np.zeros((v.classes, v.width))
        n[v.cls[1:], v.place[1:]] = v.counts[1:]
        share = (n + 0.5 * v.used) / max(1.0, n.sum() + 0.5 * v.used.sum())
        with np.errstate(divide="ignore"):
            each = np.where(v.used, np.log(np.where(v.used, share, 1)), -np.inf)
            whole = np.log(share.sum(axis=1))
        embed = r.normal(0, 0.3, (len(v.counts), width)).astype(f)
        return cls(v, embed, np.ones((2 * REACH, width), f), np.zeros(width, f), np.zeros((width, v.classes), f), whole.astype(f), np.zeros((v.classes, width, v.width), f), (each - whole[:, None]).astype(f))

    def hidden(self, near: np.ndarray) -> np.ndarray:
        """Of the embeddings of segments (segments, tokens and their neighbours, width), the hidden layer (segments, tokens, width)."""
        width, size = near.shape[2], near.shape[1] - 2 * REACH
        out = np.empty((len(near), size * width), np.float32)
        weight, bias, step = spread(self.weight, size), np.tile(self.bias, size), max(1, BLOCK // max(1, size))
        for a in range(0, len(near), step):
            h = out[a : a + step]
            summed(near[a : a + step], weight, h)
            h += bias
            np.tanh(h, out=h)
        return out.reshape(-1, size, width)

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """The outputs for tokens and their biases, by frequency, one after another: those of a class stand together, and none is unused."""
        c, place = self.vocabulary.ranked
        return self.out[c, :, place], self.out_bias[c, place]

    def log_prob(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log probability of each masked token ``y`` in its context ``x``."""
        return self.log_probs(alone(x, y), np.ones((len(y), 1), bool))

    def log_probs(self, tokens: np.ndarray, masked: np.ndarray) -> np.ndarray:
        """Log probability of each token of some segments that is to be masked, in their order."""
        classes, within, edges = beside(self.cls.T, self.cls_bias), beside(*self.ranked()), self.vocabulary.edges
        out, step = [np.zeros(0)], max(1, SCORED * SEGMENT // max(1, masked.shape[1]))
        for at in range(0, len(tokens), step):
            part, which = tokens[at : at + step], np.flatnonzero(masked[at : at + step])
            h = self.hidden(self.embed.take(part, axis=0)).reshape(-1, len(self.bias))
            t = part[:, REACH : part.shape[1] - REACH].ravel()[which]
            c, place = self.vocabulary.cls[t], self.vocabulary.place[t]
            order, groups = by_class(c)
            c, place, h = c[order], place[order], beside(h.take(which[order], axis=0), 1)
            share = np.empty(len(c))
            for a in range(0, len(c), ROWS):
                share[a : a + ROWS] = shares(h[a : a + ROWS], classes, c[a : a + ROWS])
            for g, a, b in groups:
                own = slice(edges[g], edges[g + 1])
                for a in range(a, b, ROWS):
                    to = min(b, a + ROWS)
                    share[a:to] += shares(h[a:to], within[own], place[a:to])
            whole = np.empty(len(c))
            whole[order] = share
            out.append(whole)
        return np.concatenate(out)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.weight, self.bias, self.cls, self.cls_bias, self.out, self.out_bias]


class Learner:
    """Gradient steps (Adagrad) on a network; ``seen`` and ``asked`` count how often embeddings and classes have been trained."""

    def __init__(self, net: Network, rate: float = 0.05, batch: int = 8192, seed: int = 0):
        self.net, self.rate, self.batch, self.random = net, rate, batch, np.random.default_rng(seed)
        #: What is trained: the network's arrays, but outputs for tokens as rows by frequency, which ``study`` puts back.
        self.own = [*net.parameters()[:5], *net.ranked()]
        self.past = [np.full_like(p, 1e-6) for p in self.own]
        self.seen, self.asked, self.tokens = np.zeros(len(net.embed)), np.zeros(len(net.out)), 0

    def learn(self, x: np.ndarray, y: np.ndarray, steps: int) -> None:
        """``study`` of masked tokens ``y`` in contexts ``x``."""
        self.study(alone(x, y), np.ones((len(y), 1), bool), steps)

    def study(self, tokens: np.ndarray, masked: np.ndarray, steps: int) -> None:
        """Whole passes over the masked tokens of some segments, ``steps`` steps in all at least; few tokens come more often, up to OFTEN times a step."""
        n, size = int(masked.sum()), masked.shape[1]
        batch = min(self.batch, max(FEW, n // max(1, steps)))
        passes = max(-(-steps // max(1, n // batch)), min(-(-steps * FEW // max(1, n)), OFTEN * steps))
        each = max(1, batch * len(tokens) // max(1, n))
        for _ in range(passes if n else 0):
            order = self.random.permutation(len(tokens))
            for at in range(0, len(order), each):
                k = order[at : at + each]
                self._step(tokens[k], masked[k])
        c, place = self.net.vocabulary.ranked
        self.net.out[c, :, place], self.net.out_bias[c, place] = self.own[5:]
        # A token is seen as often as a masked one stands near.
        near = np.zeros(tokens.shape, np.float32)
        for at in NEAR:
            near[:, at : at + size] += masked
        self.seen += np.bincount(tokens.ravel(), near.ravel(), len(self.seen))
        self.asked += np.bincount(self.net.vocabulary.cls[tokens[:, REACH : REACH + size][masked]], minlength=len(self.asked))
        self.tokens += n

    def _move(self, k: int, grad: np.ndarray, rows=...) -> None:
        """A step of the network's array ``k`` at ``rows``, which for outputs of tokens are all of them."""
        rows = ... if k > 4 else rows
        own, past = (x.take(rows, axis=0) if isinstance(rows, np.ndarray) else x for x in (self.own[k], self.past[k]))
        step = grad * grad
        past += step
        np.sqrt(past, out=step)
        np.divide(grad, step, out=step)
        step *= self.rate
        own -= step
        if isinstance(rows, np.ndarray):
            self.own[k][rows], self.past[k][rows] = own, past

    def _output(self, h: np.ndarray, c: np.ndarray, place: np.ndarray, groups: list[tuple[int, int, int]]) -> np.ndarray:
        """Train the output on hidden layers and their tokens' classes and places, by class; before the tanh, the gradient of the hidden layers, and a row of zeros."""
        v, n = self.net.vocabulary, np.float32(1 / len(c))
        room, second = np.zeros((len(h) + 1, h.shape[1]), np.float32), np.empty_like(h)
        back, scale = room[:-1], np.empty((2, len(h), 1), np.float32)
        ones, ranks = np.ones(max(v.classes, v.width), np.float32), np.arange(ROWS)
        classes, within, one = np.ascontiguousarray(self.own[3].T), self.own[5], beside(h, 1)

        def train(a, b, weights, both, at, grad, back, scale):
            """Add to the outputs' gradients: probabilities less what was right, over the number of tokens. Rows are scaled where they are short, those of ``back`` at the end."""
            p = one[a:b] @ both.T
            np.exp(p, out=p)
            total = p @ ones[: p.shape[1]]
            p.reshape(-1)[ranks[: b - a] * p.shape[1] + at[a:b]] -= total
            np.divide(n, total, out=scale[a:b, 0])
            np.matmul(p, weights, out=back[a:b])
            grad += p.T @ (one[a:b] * scale[a:b])

        # Weights and biases side by side, and their gradients.
        both, every = beside(classes, self.own[4]), beside(within, self.own[6])
        grad, grads = np.zeros_like(both), np.zeros_like(every)
        for a in range(0, len(h), ROWS):
            train(a, min(len(h), a + ROWS), classes, both, c, grad, back, scale[0])
        for g, first, end in groups:
            own = slice(v.edges[g], v.edges[g + 1])
            for a in range(first, end, ROWS):
                train(a, min(end, a + ROWS), within[own], every[own], place, grads[own], second, scale[1])
        self._move(3, grad[:, :-1].T)
        self._move(4, grad[:, -1])
        self._move(5, np.ascontiguousarray(grads[:, :-1]), (v.ranked[0], slice(None), v.ranked[1]))
        self._move(6, grads[:, -1], v.ranked)
        back *= scale[0]
        second *= scale[1]
        back += second
        back *= 1 - h * h
        return room

    def _step(self, tokens: np.ndarray, masked: np.ndarray) -> None:
        if masked.ndim == 1:
            tokens, masked = alone(tokens, masked), np.ones((len(masked), 1), bool)
        net, v, size, width = self.net, self.net.vocabulary, masked.shape[1], len(self.net.bias)
        which = np.flatnonzero(masked)
        if not len(which):
            return
        near = net.embed.take(tokens, axis=0)
        y = tokens[:, REACH : REACH + size].ravel()[which]
        order, groups = by_class(v.cls[y])
        y = y[order]
        back = self._output(net.hidden(near).reshape(-1, width).take(which[order], axis=0), v.cls[y], v.place[y], groups)
        self._move(2, back.sum(axis=0))
        # The masked tokens' rows in their segments, with zeros for all others, and twice as many neighbours: each embedding's gradient is then a sum over shifts too.
        rank, at = np.empty(len(order), np.int64), np.full((len(tokens), size + 4 * REACH), len(order))
        rank[order] = np.arange(len(order))
        at[:, 2 * REACH : 2 * REACH + size][masked] = rank
        back = back.take(at, axis=0)
        grads = np.empty((len(tokens), (size + 2 * REACH) * width), np.float32)
        summed(back, spread(net.weight[::-1], size + 2 * REACH), grads)
        own = back[:, 2 * REACH : 2 * REACH + size].reshape(len(tokens), -1)
        self._move(1, np.einsum("sk,sjk->jk", own, shifted(near)).reshape(-1, size, width).sum(axis=1)[[*NEAR]])
        rows = tokens.ravel()
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(rows[order].astype(np.int64)) > 0])
        self._move(0, row_sums(grads.reshape(-1, width).take(order, axis=0), first), rows[order[first]])

    def state(self) -> bytes:
        """What is added up over tasks: parameters times how often they were trained, and these numbers."""
        net = self.net
        asked = self.asked[net.vocabulary.ranked[0]]
        by = [self.seen[:, None], self.tokens, self.tokens, self.tokens, self.tokens, asked[:, None], asked]
        parts = [p * np.float32(w) if np.isscalar(w) else p * w.astype(np.float32) for p, w in zip([*net.parameters()[:5], *net.ranked()], by, strict=True)]
        return pickle.dumps([np.float32(self.tokens), self.seen.astype(np.float32), self.asked.astype(np.float32), *parts])


def added(states: list[bytes]) -> bytes:
    """The sum of some states."""
    return pickle.dumps([sum(same[1:], same[0].astype(np.float64)).astype(np.float32) for same in zip(*map(pickle.loads, states), strict=True)]) if len(states) > 1 else states[0]


def averaged(before: Network, state: bytes) -> Network:
    """The mean network of all tasks; what none of them has trained stays."""
    tokens, seen, asked, *parts = pickle.loads(state)
    c, place = before.vocabulary.ranked
    by = [seen[:, None], tokens, tokens, tokens, tokens, asked[c][:, None], asked[c]]
    *new, within, bias = [np.where(w > 0, total / np.maximum(w, 1), old).astype(np.float32) for old, total, w in zip([*before.parameters()[:5], *before.ranked()], parts, by, strict=True)]
    out, out_bias = before.out.copy(), before.out_bias.copy()
    out[c, :, place], out_bias[c, place] = within, bias
    return Network(before.vocabulary, *new, out, out_bias, learned=before.learned + int(tokens))


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(``word``, ``n``): how often each token stands in the whole corpus. Tasks add up their own first."""

    def rows(count: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array([*count], pa.string()), pa.array([*count.values()], pa.int64())], names=["word", "n"])

    def run(batches):
        count: Counter = Counter()
        for batch in batches:
            for part in chunks(batch):
                found = stretches(part.column(0))[1].value_counts()
                # Marks tell which stretch a token is of.
                times = iter(np.asarray(found.field("counts")).tolist())
                n = next(times, 0)
                for w in tokens_of(found.field("values")):
                    if w == MARK:
                        n = next(times, 0)
                    else:
                        count[w] += n
                if len(count) > HELD:
                    yield rows(count)
                    count.clear()
        if count:
            yield rows(count)

    return df.select(df[text_col].alias("__text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(df: DataFrame, text_col: str, vocabulary: int, buckets: int) -> Vocabulary:
    counts = written(word_counts(df, text_col), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    numbers = {x.word: 1 + buckets + k for k, x in enumerate(top)}
    # All counts by bucket, less those of the words that have numbers.
    number = F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("b")
    n = np.zeros(1 + buckets + len(top))
    for x in counts.groupBy(number).agg(F.sum("n").alias("n")).collect():
        n[1 + x.b] = x.n
    for k, x in enumerate(top):
        n[1 + bucket(x.word, buckets)] -= x.n
        n[1 + buckets + k] = x.n
    forget(counts)
    return Vocabulary(numbers, buckets, n)


@dataclass
class Numbered:
    """A corpus in numbers: a written table of the ``id``, the text's ``hash`` and its tokens' ``numbers`` of each row. Training and scores then read no text."""

    vocabulary: Vocabulary
    rows: DataFrame


def numbered(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 6_000, buckets: int = 2_000) -> Numbered:
    """Count the words of a corpus, then write its rows in numbers to the shared folder."""
    found = vocabulary_of(df, text_col, vocabulary, buckets)
    sent, key = df.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(found), 1)), uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, sizes = kept(key, sent).flat(batch.column(1))
        raw, to = flat.tobytes(), (np.r_[0, np.cumsum(sizes)] * flat.itemsize).tolist()
        hashes = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in texts(batch.column(1))]
        each = pa.array([raw[a:b] for a, b in zip(to[:-1], to[1:], strict=True)], pa.binary())
        return pa.record_batch([batch.column(0), pa.array(hashes, pa.int64()), each], names=["id", "hash", "numbers"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = written(map_arrow(df, [df[id_col].alias("id"), df[text_col].alias("__text")], run, f"id {kind}, hash bigint, numbers binary"), "numbers")
    sent.unpersist()
    return Numbered(found, rows)


def train(df: DataFrame | Numbered, text_col: str = "text", vocabulary: int = 6_000, buckets: int = 2_000, width: int = 32, stride: int = 8, rounds: int = 2, steps: int = 60, seed: int = 7) -> Network:
    """The network of a corpus. ``steps``: gradient steps that a task makes over its windows at least; few windows come more often."""
    if isinstance(df, DataFrame):
        corpus = numbered(df, text_col, text_col, vocabulary, buckets)
        try:
            return train(corpus, text_col, vocabulary, buckets, width, stride, rounds, steps, seed)
        finally:
            forget(corpus.rows)
    spark, corpus = df.rows.sparkSession, df.rows.select("hash", "numbers")
    own = Network.new(df.vocabulary, width, seed)
    if not own.vocabulary.counts.sum():
        return own
    for k in range(rounds):
        sent, key = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(own), 1)), uuid.uuid4().hex
        rate = 0.05 * (1 - k / rounds)

        def learn(batches, sent=sent, k=k, rate=rate):
            one_thread()
            learner = None
            held = []
            for part in (p for batch in batches for p in chunks(batch)):
                # A text is learned from in one round, from one token in stride of it, beginning where its hash tells.
                hashes = np.asarray(part.column(0))
                now = hashes // stride % rounds == k
                if not now.any():
                    continue
                learner = learner or Learner(pickle.loads(zlib.decompress(sent.value)), rate, seed=seed + k)
                flat, sizes = unpacked(part.column(1).filter(pa.array(now)), learner.net.vocabulary.kind)
                start = np.cumsum(sizes + REACH) - sizes - REACH
                for found in cut(padded(flat, sizes), [np.arange(f, n, stride) + s for f, n, s in zip(hashes[now] % stride, sizes, start, strict=True)]):
                    held.append(found)
                    if sum(int(masked.sum()) for _, masked in held) >= CHUNK:
                        learner.study(*map(np.concatenate, zip(*held, strict=True)), 1)
                        held = []
            if learner is None:
                return
            if held:
                learner.study(*map(np.concatenate, zip(*held, strict=True)), max(1, steps - learner.tokens // learner.batch))
            if learner.tokens:
                yield pa.record_batch([pa.array([learner.state()], pa.binary())], names=["state"])

        def merge(batches):
            total = None
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    total = s if total is None else added([total, s])
            if total is not None:
                yield pa.record_batch([pa.array([total], pa.binary())], names=["state"])

        states = written(corpus.mapInArrow(learn, "state binary"), "networks")
        # Networks are added up in steps of one task for eight of them, so none adds up all.
        n = states.count()
        while n > MERGED:
            before, parts = states, max(1, -(-n // 8))
            states = written(states.repartition(parts).mapInArrow(merge, "state binary"), "networks")
            forget(before)
            n = states.count()
        got = [bytes(x.state) for x in states.collect()]
        sent.unpersist()
        forget(states)
        if got:
            own = averaged(own, added(got))
    return own


def cut(stream: np.ndarray, where: list[np.ndarray]):
    """Segments of a stream, and which of their tokens stand at ``where``, at most CHUNK tokens at a time; segments without any are left out."""
    if not len(stream) > 2 * REACH or not where:
        return
    tokens = segments(stream)
    masked = np.zeros(len(tokens) * SEGMENT, bool)
    masked[np.concatenate(where).astype(np.int64)] = True
    masked = masked.reshape(-1, SEGMENT)
    some = np.flatnonzero(masked.any(axis=1))
    for at in range(0, len(some), CHUNK // SEGMENT):
        k = some[at : at + CHUNK // SEGMENT]
        yield tokens[k], masked[k]


_KEPT: dict[str, Network | Vocabulary] = {}


def kept(key: str, sent) -> Network | Vocabulary:
    """What was sent to all tasks under a key; a process keeps one."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = pickle.loads(zlib.decompress(sent.value))
    return _KEPT[key]


def score(df: DataFrame | Numbered, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_tokens``, ``log_prob`` (the sum over all tokens) and ``mean_log_prob``. What is ``Numbered`` has the network's vocabulary."""
    rows, text_col, own_id = (df.rows, "numbers", "id") if isinstance(df, Numbered) else (df, text_col, id_col)
    sent, key = rows.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(network), 1)), uuid.uuid4().hex
    packed = isinstance(df, Numbered)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        one_thread()
        net = kept(key, sent)
        flat, sizes = unpacked(batch.column(1), net.vocabulary.kind) if packed else net.vocabulary.flat(batch.column(1))
        tokens = segments(padded(flat, sizes))
        each = net.log_probs(tokens, tokens[:, REACH : REACH + SEGMENT] > 0)
        total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), each, len(sizes)).astype(np.float64)
        return pa.record_batch([batch.column(0), pa.array(sizes), pa.array(total), pa.array(total / np.maximum(sizes, 1))], names=[id_col, "n_tokens", "log_prob", "mean_log_prob"])

    kind = rows.schema[own_id].dataType.simpleString()
    return map_arrow(rows, [rows[own_id].alias(id_col), rows[text_col].alias("__text")], run, f"{id_col} {kind}, n_tokens bigint, log_prob double, mean_log_prob double")
