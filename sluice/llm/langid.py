"""Operator 5: language identification by words first, then by shorter and shorter character n-grams.

Each known word adds its log frequency in every language. A word that was not learned backs off to its character n-grams
(a mark at both ends), of the longest order of which any was learned, and adds their mean log frequency; if none of any
order is known it adds nothing. The language of the largest sum, with the languages' log shares, is predicted.

The model is learned from a bounded sample of the labelled rows, chosen by a hash of id and text: of each language about
``sample_docs`` divided by the number of languages, more of those that are rare, all of the rarest. Whole texts are counted, on the
executors, in one pass. A language's dictionary is its ``max_words`` most frequent words and ``max_grams`` most frequent n-grams, so a large
language takes no place from a small one; what no dictionary holds backs off, as any unseen word. The model has as many entries as the languages'
dictionaries together and is sent to the tasks only below ``model_bytes``; beyond that learning stops with an error that names the bounds.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the language that comes first by
name; if nothing could be learned all rows are ``und``; rows with a null id are not held out and not learned from; repeated
rows give repeated rows; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm._common import crc32_text, forget, letter_runs, map_arrow, texts, written

#: Orders of character n-grams, tried in this order.
ORDERS = (5, 4, 3, 2, 1)
#: Unseen words a worker keeps with their scores; beyond it they are forgotten and scored anew.
UNSEEN = 200_000


def words(text: str) -> list[str]:
    return letter_runs().findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with a mark at both ends; those of order 1 are its letters."""
    marked = word if n == 1 else f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies by language of words and n-grams."""

    def __init__(self, languages: list[str], prior: np.ndarray, word_counts: dict[str, np.ndarray], gram_counts: dict[int, dict[str, np.ndarray]]):
        self.languages = languages
        self.prior = np.log(prior / prior.sum()) if len(prior) else prior
        self.words, self.word_rows = self._logs(word_counts)
        self.grams = {n: self._logs(c) for n, c in gram_counts.items() if c}
        self.reset()

    def _logs(self, counts: dict[str, np.ndarray]) -> tuple[dict[str, int], np.ndarray]:
        """Smoothed log shares; each row less its mean, so what says nothing adds nothing."""
        if not counts:
            return {}, np.zeros((0, len(self.languages)), np.float32)
        m = np.array([*counts.values()], np.float64).reshape(len(counts), len(self.languages)) + 0.1
        logs = np.log(m / np.maximum(m.sum(axis=0), 1))
        return {k: i for i, k in enumerate(counts)}, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)

    def reset(self) -> None:
        self.row = dict(self.words)
        self.rows = np.concatenate([self.word_rows, np.zeros((UNSEEN, len(self.languages)), np.float32)])

    def back_off(self, word: str) -> np.ndarray:
        """Mean log frequencies of the longest known n-grams of an unseen word."""
        for n in ORDERS:
            known, logs = self.grams.get(n, ({}, None))
            if at := [i for g in grams(word, n) if (i := known.get(g)) is not None]:
                return logs[at].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)

    def sums(self, found: list[str]) -> np.ndarray:
        at = [*map(self.row.get, found)]
        if None in at:
            if len(self.row) + len(found) > len(self.rows):
                self.reset()
                at = [*map(self.row.get, found)]
            for k, i in enumerate(at):
                if i is None:
                    w = found[k]
                    if (i := self.row.get(w)) is None:
                        score = self.back_off(w)
                        i = len(self.row)
                        if i >= len(self.rows):  # one text with more unseen words than are kept
                            self.rows = np.concatenate([self.rows, np.zeros((len(found), len(self.languages)), np.float32)])
                        self.row[w] = i
                        self.rows[i] = score
                    at[k] = i
        return self.rows[at].sum(axis=0, dtype=np.float64)

    def predict(self, text: str) -> tuple[str, float]:
        found = words(text)
        if not found or not self.languages:
            return "und", 0.0
        z = self.sums(found) + self.prior
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.languages[k], float(p[k] / p.sum())


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts of words (order 0) and n-grams by language in a batch of (lang, text, rows)."""
    by: dict[str, Counter] = defaultdict(Counter)
    for lang, text, n in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
        by[lang].update(words(text) if n == 1 else {w: n * c for w, c in Counter(words(text)).items()})
    out: dict[tuple[str, int, str], int] = {}
    for lang, count in by.items():
        small: dict[tuple[str, int, str], int] = defaultdict(int)
        for w, c in count.items():
            out[lang, 0, w] = c
            for n in ORDERS:
                for g in grams(w, n):
                    small[lang, n, g] += c
        out |= small
    keys = [*out]
    return pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([*out.values()], pa.int64())], names=["lang", "n", "gram", "c"])


def train(df: DataFrame, usable: Column, sample_docs: int = 10_000, max_words: int = 40_000, max_grams: int = 60_000, model_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows of ``df`` that are ``usable`` and have a language."""
    rows = df.where(usable & df[lang_col].isNotNull() & df[text_col].isNotNull()).select(df[id_col].alias("id"), df[lang_col].cast("string").alias("lang"), df[text_col].alias("text"))
    languages_most = model_bytes // (64 * 8)
    share = {x.lang: x.n for x in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(languages_most + 1).collect()}
    if len(share) > languages_most:
        raise ValueError(f"more than {languages_most} languages; raise model_bytes ({model_bytes})")
    languages = sorted(share)
    if not languages:
        return Model([], np.zeros(0), {}, {})
    # As many rows of each language as an equal share allows; what small ones leave goes to the others.
    left, quota = sample_docs, {}
    for k, g in enumerate(sorted(languages, key=lambda g: (share[g], g))):
        quota[g] = min(share[g], max(1, left // (len(languages) - k)))
        left -= quota[g]
    parts = df.sparkSession.createDataFrame([(g, -(-quota[g] * 1_000_000 // share[g])) for g in languages], "lang string, part bigint")
    # One number for each language, of which there are ``languages_most`` at most.
    sample = rows.join(F.broadcast(parts), "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < F.col("part"))
    # Copies of a text are added up before they are moved, so that one row's thousand copies stay one.
    sample = sample.groupBy("lang", "text").agg(F.count("*").alias("rows"))
    counts = map_arrow(sample, [F.col("lang"), F.col("text"), F.col("rows")], _count, "lang string, n int, gram string, c bigint").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    counts = written(counts, "lang-counts")
    kind = (F.col("n") > 0).cast("int").alias("kind")
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("c"), "n", "gram"))
    # The top of each language and kind; Spark cuts each partition to it before the shuffle.
    words_top = counts.where("n = 0").select("lang", "n", "gram", "c", kind).withColumn("place", place).where(F.col("place") <= max_words)
    grams_top = counts.where("n > 0").select("lang", "n", "gram", "c", kind).withColumn("place", place).where(F.col("place") <= max_grams)
    chosen = words_top.unionByName(grams_top).select("n", "gram").distinct()
    whole = written(counts.join(chosen, ["n", "gram"]).groupBy("n", "gram").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "c")))).alias("by")), "lang-model")
    size = whole.agg(F.coalesce(F.sum(F.length("gram") + 80 + 4 * len(languages)), F.lit(0)).alias("bytes")).first().bytes
    if size > model_bytes:
        raise ValueError(f"a model of {size} bytes for {len(languages)} languages; lower max_words ({max_words}) and max_grams ({max_grams}) or raise model_bytes ({model_bytes})")
    number = {g: k for k, g in enumerate(languages)}
    by_order: dict[int, dict[str, np.ndarray]] = defaultdict(dict)
    for x in whole.orderBy("n", "gram").toLocalIterator():
        row = np.zeros(len(languages))
        row[[number[g] for g in x.by]] = [*x.by.values()]
        by_order[x.n][x.gram] = row
    forget(counts)
    forget(whole)
    return Model(languages, np.array([share[g] for g in languages], np.float64), by_order.pop(0, {}), dict(by_order))


_KEPT: dict[str, Model] = {}


def predict(df: DataFrame, model: Model, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``held_out``, ``lang_pred``, ``score``."""
    model.rows = model.rows[: len(model.words)]
    state = (model.languages, model.prior, model.words, model.word_rows, model.grams)
    sent, key = df.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(state), 1)), uuid.uuid4().hex

    def get() -> Model:
        if key not in _KEPT:
            _KEPT.clear()
            own = Model.__new__(Model)
            own.languages, own.prior, own.words, own.word_rows, own.grams = pickle.loads(zlib.decompress(sent.value))
            own.reset()
            _KEPT[key] = own
        return _KEPT[key]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = get()
        got = [own.predict(t) for t in texts(batch.column(2))]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    held = F.coalesce(crc32_text(df[id_col]) % folds == 0, F.lit(False))
    return map_arrow(df, [df[id_col].alias(id_col), held.alias("held_out"), df[text_col].alias("__text")], run, f"{id_col} {kind}, held_out boolean, lang_pred string, score double")


def identify(df: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    """Learn from all but the rows of the first fold, and predict every row."""
    model = train(df, F.coalesce(crc32_text(df[id_col]) % folds != 0, F.lit(False)), id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    return predict(df, model, folds, id_col, text_col)
