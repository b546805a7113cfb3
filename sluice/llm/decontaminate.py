"""Operator 4: benchmark decontamination by a generalised suffix automaton.

The items' normalised words are strung into one generalised suffix automaton over word numbers. A document's words are
streamed through it: the state and its match length tell the longest run of words, ending here, that occurs inside an
item. Where that length reaches ``window`` words, the last ``window`` of them are a window of an item, so they are
hit; an item of fewer words is one window of its own, which is found where the longest run is at least as long
and ends with the whole item. Items' windows are found in the automaton too: the state of each window is looked up once, and
items are listed at the states where their windows end.

The automaton holds the items, not the documents. It is made of flat arrays, less than 100 bytes for a word of the items and a little
more for a distinct one, so the ``group_words`` words that one automaton holds at most bound what the driver builds and each worker keeps. A larger
benchmark is split into groups of whole items, and the documents pass by one group's automaton after another, written to the shared folder in
between: an item is in one group, and hit words are united, so the result is that of one automaton. Words that no item has end every match, so
only runs of known words are walked.

Hit spans can be taken out of the texts too: those of at least so many words, and all spans of documents that the share of hit words calls
contaminated.

Defined results: null has no words, and an item without words has no windows; a document without words is not
contaminated; repeated items are listed once by each of their ids; null item ids do not count; repeated rows give repeated
rows; empty tables give empty results or no hits.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sluice.llm._common import forget, free_name, map_arrow, texts, written

#: A-Z in lower case; every other ASCII character that is no digit or letter becomes a space. Bytes above 127 stay.
NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


#: A word in a text as it stands.
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def _ints() -> array:
    return array("i", [0])


@dataclass
class Automaton:
    """A generalised suffix automaton over word numbers, and the windows of the items it was built from.

    A state's first transition is in two arrays. While items are added, states with more have a dictionary for them; ``finish`` lays these out as
    arrays, sorted by state and word, and those of the start by word.
    """

    window: int
    vocab: dict[bytes, int] = field(default_factory=dict)
    word: array = field(default_factory=lambda: array("i", [-1]))
    to: array = field(default_factory=_ints)
    more: dict[int, dict[int, int]] = field(default_factory=dict)
    keys: array = field(default_factory=lambda: array("q"))
    targets: array = field(default_factory=lambda: array("i"))
    start: array = field(default_factory=lambda: array("i"))
    branches: bytes = b""
    link: array = field(default_factory=lambda: array("i", [-1]))
    length: array = field(default_factory=_ints)
    #: By state: which of ``marks`` are the windows that end there (0: none), and the nearest state up its links that has any.
    ends: array = field(default_factory=_ints)
    next_end: array = field(default_factory=_ints)
    #: Windows that end in some state: (words of the window, items that have it).
    marks: list[tuple[tuple[int, tuple[int, ...]], ...]] = field(default_factory=lambda: [()])
    #: Items by number: their ids.
    names: list = field(default_factory=list)
    #: The least words any window has; all words of the items.
    least: int = 1 << 30
    size: int = 0

    def _step(self, s: int, c: int) -> int:
        """Where ``c`` leads from a state; -1: nowhere."""
        if self.word[s] == c:
            return self.to[s]
        more = self.more.get(s)
        return -1 if more is None else more.get(c, -1)

    def _set(self, s: int, c: int, to: int) -> None:
        if self.word[s] in (-1, c):
            self.word[s], self.to[s] = c, to
        else:
            self.more.setdefault(s, {})[c] = to

    def _state(self, length: int, link: int, like: int = -1) -> int:
        new = len(self.link)
        self.link.append(link)
        self.length.append(length)
        self.word.append(-1 if like < 0 else self.word[like])
        self.to.append(0 if like < 0 else self.to[like])
        if like in self.more:
            self.more[new] = dict(self.more[like])
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], q)
        while p >= 0 and self._step(p, c) == q:
            self._set(p, c, copy)
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self._step(last, c)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and (q := self._step(p, c)) < 0:
            self._set(p, c, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, item: list[bytes]) -> array:
        ids = array("i", [self.vocab.setdefault(w, len(self.vocab)) for w in item])
        last = 0
        for c in ids:
            last = self._extend(last, c)
        self.size += len(ids)
        return ids

    def walk(self, ids: list[int] | array) -> Iterator[tuple[int, int]]:
        """After each word: the state of the longest run of words that ends here and occurs in an item, and its words."""
        word, to, link, length, keys, targets, start, branches = self.word, self.to, self.link, self.length, self.keys, self.targets, self.start, self.branches
        state = n = 0
        for c in ids:
            while state:
                if word[state] == c:
                    state = to[state]
                    n += 1
                    break
                if branches[state]:
                    key = state << 32 | c
                    if (k := bisect_left(keys, key)) < len(keys) and keys[k] == key:
                        state = targets[k]
                        n += 1
                        break
                state = link[state]
                n = length[state]
            else:
                state = start[c]
                n = 1 if state else 0
            yield state, n

    def _lay_out(self) -> None:
        self.start = array("i", bytes(4 * len(self.vocab)))
        for c, q in [(self.word[0], self.to[0]), *self.more.pop(0, {}).items()]:
            if c >= 0:
                self.start[c] = q
        branches = bytearray(len(self.link))
        pairs = sorted((s << 32 | c, q) for s, more in self.more.items() for c, q in more.items())
        self.keys, self.targets = array("q", [k for k, _ in pairs]), array("i", [q for _, q in pairs])
        for s in self.more:
            branches[s] = 1
        self.branches, self.more = bytes(branches), {}

    def finish(self, items: list[tuple[object, array]]) -> None:
        """Lay out the transitions, and list each item's windows at the states where they end."""
        self._lay_out()
        numbers: dict[object, int] = {}
        known: dict[tuple[tuple[int, int], ...], int] = {(): 0}
        every: list[tuple[tuple[int, int], ...]] = [()]
        added: dict[tuple[int, int, int], int] = {}
        ends = array("i", bytes(4 * len(self.link)))
        for name, ids in items:
            item = numbers.setdefault(name, len(numbers))
            n = min(self.window, len(ids))
            for k, (state, _) in enumerate(self.walk(ids)):
                if k + 1 >= n:
                    while self.length[self.link[state]] >= n:
                        state = self.link[state]
                    # States with the same windows share a mark; a window more makes another one.
                    key = (ends[state], n, item)
                    if (mark := added.get(key)) is None:
                        whole = tuple(sorted({*every[ends[state]], (n, item)}))
                        mark = added[key] = known.setdefault(whole, len(every))
                        if mark == len(every):
                            every.append(whole)
                    ends[state] = mark
            self.least = min(self.least, n) if n else self.least
        self.ends, self.names = ends, [*numbers]
        self.marks = [tuple((n, tuple(i for m, i in mark if m == n)) for n in sorted({m for m, _ in mark})) for mark in every]
        # A run's state has the shorter windows that end with it among its suffix links.
        self.next_end = array("i", bytes(4 * len(self.link)))
        for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()[1:]:
            up = self.link[s]
            self.next_end[s] = up if ends[up] else self.next_end[up]

    def hits(self, doc: list[bytes]) -> tuple[int, set, list[tuple[int, int]]]:
        """How many of a document's words are hit, the ids of items whose windows occur, and the hit spans of words."""
        ids = np.fromiter((self.vocab.get(w, -1) for w in doc), np.int32, len(doc))
        known = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False]))
        found: set[int] = set()
        spans: list[tuple[int, int]] = []
        ends, next_end, marks, least = self.ends, self.next_end, self.marks, self.least
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a < least:
                continue
            for k, (state, n) in enumerate(self.walk(ids[a:b].tolist()), a + 1):
                if n < least:
                    continue
                s = state if ends[state] else next_end[state]
                best = 0
                while s:
                    for size, who in marks[ends[s]]:
                        if size <= n:
                            found.update(who)
                            best = max(best, size)
                    s = next_end[s]
                if best:
                    start = k - best
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, k))
        return sum(b - a for a, b in spans), {self.names[i] for i in found}, spans


def automata(items: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text", group_words: int = 2_000_000) -> Iterator[Automaton]:
    """Automata that hold all items together, each at most ``group_words`` words or one item; one at least."""
    own, kept = Automaton(window), []
    for item, text in items.select(items[id_col], items[text_col]).where(items[id_col].isNotNull()).toLocalIterator():
        found = words(text or "")
        if own.size and own.size + len(found) > group_words:
            own.finish(kept)
            yield own
            own, kept = Automaton(window), []
        if found:
            kept.append((item, own.add(found)))
    own.finish(kept)
    yield own


def _shared(df: DataFrame, own: Automaton) -> Callable[[], Automaton]:
    """A function that gives tasks the automaton, from a broadcast, which ``group_words`` bounds."""
    sent, key = df.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(own), 1)), uuid.uuid4().hex

    def get() -> Automaton:
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = pickle.loads(zlib.decompress(sent.value))
        return _KEPT[key]

    return get


#: What a worker has unpacked last.
_KEPT: dict[str, Automaton] = {}


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that meet or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


Found = tuple[int, list[tuple[int, int]], list[str]]


def _pass_by(df: DataFrame, text_col: str, groups: Iterator[Automaton], last: Callable[[pa.RecordBatch, list[Found]], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """``last`` of each batch of ``df`` and, for each row, its words, hit spans and items, over the automata of all groups.

    Between groups the rows are written with what was found so far, in a column of JSON.
    """
    at, so_far = df.columns.index(text_col), free_name(df, "found")
    now, next_group = df, next(groups)
    carried = False
    while next_group is not None:
        own, next_group = next_group, next(groups, None)
        shared, final = _shared(df, own), next_group is None

        def run(batch: pa.RecordBatch, shared=shared, carried=carried, final=final) -> pa.RecordBatch:
            before = map(json.loads, batch.column(batch.num_columns - 1).to_pylist()) if carried else [[[], []]] * batch.num_rows
            rows: list[Found] = []
            for t, (spans, items) in zip(texts(batch.column(at)), before, strict=True):
                doc = words(t)
                _, who, new = shared().hits(doc)
                rows.append((len(doc), united([*map(tuple, spans), *new]), sorted({*items, *map(str, who)})))
            batch = batch.drop_columns([so_far]) if carried else batch
            return last(batch, rows) if final else batch.append_column(so_far, pa.array([json.dumps([s, i]) for _, s, i in rows], pa.string()))

        read = now
        now = map_arrow(now, [now[c] for c in now.columns], run, schema if final else T.StructType([*df.schema.fields, T.StructField(so_far, T.StringType())]))
        if not final:
            now = written(now, "group-hits")
            if carried:
                forget(read)
            carried = True
    return now


def hit_words(row: Found) -> int:
    return sum(b - a for a, b in row[1])


def contaminated(row: Found, share: int) -> bool:
    """Whether any word is hit, and at least one in ``share``."""
    return hit_words(row) > 0 and share * hit_words(row) >= row[0]


def contamination(df: DataFrame, items: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", group_words: int = 2_000_000) -> DataFrame:
    """Per row: ``id_col``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` (hits, at least one word in ``share``)."""
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    names = [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def last(batch: pa.RecordBatch, rows: list[Found]) -> pa.RecordBatch:
        sha = [hashlib.sha256(",".join(items).encode()).hexdigest() for _, _, items in rows]
        counts = [[n for n, _, _ in rows], [*map(hit_words, rows)], [len(items) for _, _, items in rows]]
        return pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(sha, pa.string()), pa.array([contaminated(r, share) for r in rows], pa.bool_())], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return _pass_by(docs, "text", automata(items, window, item_id, item_text, group_words), last, schema)


def remove_contaminated(df: DataFrame, items: DataFrame, window: int = 13, share: int = 20, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", group_words: int = 2_000_000) -> DataFrame:
    """The rows of ``df`` that are not contaminated, with all their columns."""

    def last(batch: pa.RecordBatch, rows: list[Found]) -> pa.RecordBatch:
        return batch.filter(pa.array([not contaminated(r, share) for r in rows], pa.bool_()))

    return _pass_by(df, text_col, automata(items, window, item_id, item_text, group_words), last, df.schema)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without some spans of its words, and what stands between these words."""
    places = [m.span() for m in WORD.finditer(text)] if spans else []
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : places[a][0]])
        done = places[b - 1][1]
    return "".join([*out, text[done:]])


def remove_spans(df: DataFrame, items: DataFrame, window: int = 13, least_words: int = 26, share: int = 20, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", group_words: int = 2_000_000) -> DataFrame:
    """``df`` with hit spans taken out of ``text_col``: those of at least ``least_words`` words, and all of contaminated rows; null stays null."""
    at = df.columns.index(text_col)

    def last(batch: pa.RecordBatch, rows: list[Found]) -> pa.RecordBatch:
        cut = [r[1] if contaminated(r, share) else [(a, b) for a, b in r[1] if b - a >= least_words] for r in rows]
        new = [t if t is None else without_spans(t, spans) for t, spans in zip(batch.column(at).to_pylist(), cut, strict=True)]
        return batch.set_column(at, batch.schema.field(at).name, pa.array(new, batch.schema.field(at).type))

    return _pass_by(df, text_col, automata(items, window, item_id, item_text, group_words), last, df.schema)
