"""Operator 9: token ids in binary shards, each document compressed on its own with a shared zstandard dictionary.

Ids of each document, with an end id after them, are serialized as little-endian unsigned 32-bit integers, split into
planes of low, middle and high bytes, and compressed as one zstandard frame. The dictionary is trained once on serialized
arrays of a bounded sample of documents, whole ones in pieces; it changes sizes only, never results. A shard holds some thousand consecutive
documents:

    magic, version, dictionary hash, number of documents      fixed header
    doc_id, frame end, number of ids of each document         offset index, three int64 columns; a negative number: no doc_id
    frames                                                    one after another

so a short document is read by a seek to its frame, and a shard that was written with another dictionary is refused by
the hash. Shards are rows of a table that Spark writes, so any store will do, and lost executors only repeat their
tasks.

Order. Quantiles of the ids cut them into ranges, one for each ``range_bytes`` of text, four for each shuffle partition at least and
``MAX_RANGES`` at most, and each range is written in order by one task, which sorts on disk. Where a range's ids begin follows from those of the
ranges before it: one number for each range goes to the driver.

Defined results: ids are whole numbers of up to 64 bits, another type is refused; a null text counts as empty and has the end id alone; null doc_ids come first; rows with the same id are
ordered by their frames, so repeated rows give repeated rows; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sluice.llm._common import map_arrow, narrow, scratch_path, texts

MAGIC, VERSION = b"SLZI", 2
HEADER = struct.Struct("<4sI8sQ")
#: A shard is closed at so many compressed bytes or documents.
SHARD_BYTES, SHARD_DOCS = 4 << 20, 8192
#: Entries of a worker's cache of words; that of stretches has twice as many. Longer stretches than SHORT are put together from words.
CACHE_ENTRIES, SHORT = 300_000, 64
#: New words or stretches that go to the library as one text.
TOGETHER = 500
MAX_RANGES = 100_000
#: Whole arrays of sampled documents come to the dictionary's training in pieces of so many bytes.
PIECE = 16 << 10


class LibraryEncoder:
    """The tokenizers library behind a cache of what stands between single spaces.

    The vocabulary's first step takes at most one space into a word, and only runs of white space join across spaces. So
    where no space has white space beside it, a text's ids are those of its first stretch and of " stretch" for all others; each
    different stretch of some texts is looked up once, and new ones are encoded by the library. Where spaces do have white space beside them, the
    text is first cut before each such run's last space, which is where the library cuts it too.

    New stretches and words that begin with a space go to the library as one text: it cuts it before each space again, and the bytes of its tokens tell
    whose they are.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._bytes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self._bytes[i] = len(token)
        self._stretches, self._words = Cache(2 * CACHE_ENTRIES), Cache(CACHE_ENTRIES)

    def _library(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of words or stretches, those behind a space in one text; a token of a byte-level vocabulary has a sign for each byte."""
        joined = [w for w in words if w[0] == " " and len(w) > 1 and not w[1].isspace()]
        whole = ["".join(joined[at : at + TOGETHER]) for at in range(0, len(joined), TOGETHER)]
        if len(joined) < 2 or any(t in w for t in self.special for w in whole):
            return self._library(words)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(whole, add_special_tokens=False)])
        upto, ends = np.cumsum(self._bytes[ids]), np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in joined])
        to = np.searchsorted(upto, ends, "right")
        if not np.array_equal(upto[to - 1], ends):
            return self._library(words)
        raw, edges = ids.tobytes(), (4 * to).tolist()
        found = [raw[a:b] for a, b in zip([0, *edges], edges, strict=False)]
        if len(joined) == len(words):
            return found
        ids = dict(zip(joined, found, strict=True))
        other = [w for w in words if w not in ids]
        ids |= zip(other, self._library(other), strict=True)
        return [ids[w] for w in words]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, every: list[str]) -> list[bytes]:
        """Ids of some texts; what is new in them goes to the library together."""
        out, plain, spaced = [b""] * len(every), [], []
        for k, text in enumerate(every):
            if any(t in text for t in self.special) or not text.isascii() and BESIDE_WIDE.search(text):
                out[k] = self._library([text])[0]
            else:
                (spaced if any(p in text for p in BESIDE) else plain).append(k)
        cuts = [pc.split_pattern(pa.array([every[k] for k in plain], pa.string()), " "), pa.array([CUT.split(every[k]) for k in spaced], pa.list_(pa.string()))]
        stretches, n = pa.concat_arrays([c.flatten() for c in cuts]), np.concatenate([np.asarray(pc.list_value_length(c), np.int64) for c in cuts])
        if not len(n):
            return out
        # The first stretch of each text, then the others: of each different one its ids, and where they begin and end.
        begin = np.cumsum(n) - n
        first = self._split(stretches.take(pa.array(begin)).to_pylist())
        behind = np.ones(len(stretches), bool)
        behind[begin] = False
        found = stretches.filter(pa.array(behind)).dictionary_encode()
        ids = self._stretches.all(found.dictionary.to_numpy(zero_copy_only=False).tolist(), self._behind)
        sizes, each = np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.asarray(found.indices, np.int64)
        to = np.r_[0, np.cumsum(sizes[each])]
        from_ = (np.cumsum(sizes) - sizes)[each] - to[:-1]
        flat = np.frombuffer(b"".join(ids), np.uint32)[np.arange(to[-1]) + np.repeat(from_, sizes[each])]
        edges = to[np.r_[0, np.cumsum(n - 1)]].tolist()
        for k, start, a, b in zip([*plain, *spaced], first, edges[:-1], edges[1:], strict=True):
            out[k] = start + flat[a:b].tobytes()
        return out

    def _behind(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches behind a space each."""
        if all(len(s) < SHORT for s in stretches):
            return self._spaced([f" {s}" for s in stretches])
        short, long = ([f" {s}" for s in stretches if (len(s) < SHORT) == is_short] for is_short in (True, False))
        ids = dict(zip([*short, *long], [*(self._spaced(short) if short else []), *self._split(long)], strict=True))
        return [ids[f" {s}"] for s in stretches]

    def _split(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches: those that the pattern of common alphabets covers are put together from words."""
        plain = [s for s in stretches if narrow(s)]
        words = [PIECES(s) for s in plain]
        flat = self._words.all([w for ws in words for w in ws], self._spaced)
        ids, at = {}, 0
        for s, ws in zip(plain, words, strict=True):
            to = at + len(ws)
            ids[s] = flat[at] if to == at + 1 else b"".join(flat[at:to])
            at = to
        if len(ids) < len(stretches):
            other = [s for s in stretches if s not in ids]
            ids |= zip(other, self._library(other), strict=True)
        return [ids[s] for s in stretches]


class Cache:
    """Values of keys, kept for the first ``entries`` keys that come: what is frequent comes early."""

    def __init__(self, entries: int):
        self.entries = entries
        self.known: dict[str, bytes] = {}

    def all(self, keys: list[str], make) -> list[bytes]:
        """The values of all keys; ``make`` gives those of a list of new ones."""
        got = [*map(self.known.get, keys)]
        if None in got:
            new = list(dict.fromkeys(k for k, g in zip(keys, got, strict=True) if g is None))
            found = dict(zip(new, make(new), strict=True))
            got = [found[k] if g is None else g for k, g in zip(keys, got, strict=True)]
            room = self.entries - len(self.known)
            if room > 0:
                self.known |= islice(((k, v) for k, v in found.items() if len(k) <= 64), room)
        return got


# White space of ASCII, and what of it stands beside a space; other white space beside one.
BESIDE = tuple(f" {c}" for c in "\t\n\v\f\r ") + tuple(f"{c} " for c in "\t\n\v\f\r")
BESIDE_WIDE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f]")
# The pattern of byte-level vocabularies, for characters below U+0100; words go first, as nothing before them begins alike.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
PIECES = re.compile(rf" ?[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
#: A single space before other than white space: it belongs to what follows.
CUT = re.compile(r" (?![\t-\r ]|\Z)")


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def planes(ids: bytes) -> bytes:
    """Ids as planes: first all low bytes, then the second ones, then the rest, which is mostly zeros."""
    every = np.frombuffer(ids, "<u4")
    return b"".join([(every >> k).astype(np.uint8).tobytes() for k in (0, 8, 16, 24)])


def unplanes(raw: bytes) -> bytes:
    every = np.frombuffer(raw, np.uint8).reshape(4, -1).astype("<u4")
    every <<= np.array([[0], [8], [16], [24]], "<u4")
    return np.bitwise_or.reduce(every).tobytes()


def train(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A shared dictionary; too few samples give none, which the format allows."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_hash(dictionary: bytes) -> bytes:
    import xxhash

    return xxhash.xxh64_digest(dictionary)


_CODECS: dict[bytes, tuple] = {}


def codec(dictionary: bytes, level: int = 3):
    """A compressor and a decompressor with the dictionary; one pair a process."""
    if dictionary not in _CODECS:
        _CODECS.clear()
        made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if made:
            made.precompute_compress(level)
        _CODECS[dictionary] = (zstandard.ZstdCompressor(level=level, dict_data=made, write_dict_id=False), zstandard.ZstdDecompressor(dict_data=made))
    return _CODECS[dictionary]


def pack_shard(dictionary: bytes, doc_ids: list[int | None], sizes: list[int], frames: list[bytes]) -> bytes:
    """One shard in the file format."""
    index = np.empty((3, len(frames)), "<i8")
    index[0] = [0 if d is None else d for d in doc_ids]
    index[1] = np.cumsum([len(f) for f in frames])
    index[2] = [-n if d is None else n for d, n in zip(doc_ids, sizes, strict=True)]
    return HEADER.pack(MAGIC, VERSION, dictionary_hash(dictionary), len(frames)) + index.tobytes() + b"".join(frames)


class Shard:
    """A shard read from bytes; ``ids(k)`` decompresses one document alone."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, made_with, n = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of token ids")
        if made_with != dictionary_hash(dictionary):
            raise ValueError("the shard was written with another dictionary")
        self.doc_ids, self._end, sizes = np.frombuffer(data, "<i8", 3 * n, HEADER.size).reshape(3, n)
        self.sizes, self.unnamed = np.abs(sizes), sizes < 0
        self._data, self._at, self._unzip = data, HEADER.size + 24 * n, codec(dictionary)[1]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> bytes:
        a = self._at + (int(self._end[k - 1]) if k else 0)
        return unplanes(self._unzip.decompress(self._data[a : self._at + int(self._end[k])], max_output_size=4 * int(self.sizes[k])))


def write(df: DataFrame, vocabulary: str, path: str, end_id: int = 2, sample_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = 8 << 20, range_bytes: int = 16 << 20) -> bytes:
    """Write shards of ``df`` to ``path``; the dictionary, which is stored beside them too, is returned.

    ``sample_docs``, ``sample_bytes``: the bounds of the sample the dictionary is trained on, chosen by hashes of ids and pieces.
    """
    spark = df.sparkSession
    if not isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} is {df.schema[id_col].dataType.simpleString()}, not a whole number")
    end = array("I", [end_id]).tobytes()
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = [planes(ids + end) for ids in encoder(vocabulary).encode_all(texts(batch.column(0)))]
        return pa.record_batch([pa.array([e[at : at + PIECE] for e in every for at in range(0, len(e), PIECE)], pa.binary())], names=["raw"])

    size = source.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    share = min(1.0, 1.2 * sample_docs / max(1, size.rows))
    chosen = source.where(F.pmod(F.xxhash64("id", F.col("text")), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(sample_docs)
    found = map_arrow(chosen, [F.col("text")], pieces, "raw binary").orderBy(F.xxhash64("raw"), "raw").limit(sample_bytes // PIECE * 2)
    samples, held = [], 0
    for x in found.collect():
        if held < sample_bytes:
            samples.append(bytes(x.raw))
            held += len(x.raw)
    dictionary = train(samples)
    shared = spark.sparkContext.broadcast(dictionary)  # 64 KB

    # Ranges of ids with about the same number of rows each; an id that fills several ranges is spread over them by a hash.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, min(MAX_RANGES, -(-(size.bytes or 0) // range_bytes)))
    ranges = max(4 * least, tasks)
    edges = source.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], min(100 * ranges, 1_000_000)).alias("e")).first().e
    edges = np.array(edges or [], np.int64)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, zipper = encoder(vocabulary), codec(shared.value)[0]
        sizes, frames = [], []
        for ids in own.encode_all(texts(batch.column(1))):
            ids += end
            sizes.append(len(ids) // 4)
            frames.append(zipper.compress(planes(ids)))
        tie = np.array([zlib.crc32(f) for f in frames], np.int64)
        known = np.asarray(batch.column(0).is_valid())
        doc = np.asarray(batch.column(0).fill_null(0), np.int64)
        low, high = np.searchsorted(edges, doc, "left"), np.searchsorted(edges, doc, "right")
        place = np.where(known, 1 + low + ((high - low + 1) * tie >> 32), 0)
        return pa.record_batch([pa.array(place), batch.column(0), pa.array(tie), pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())], names=["part", "id", "tie", "n", "frame"])

    def shards(batches):
        """Rows in order; a shard holds rows of one range, and its number of ids before it within the range is kept."""
        part, ids, sizes, frames, held, start, seq = None, [], [], [], 0, 0, 0

        def flush():
            nonlocal ids, sizes, frames, held, start, seq
            row = {"part": part, "seq": seq, "first": ids[0], "start": start, "n_docs": len(ids), "n_ids": sum(sizes), "shard": pack_shard(shared.value, ids, sizes, frames)}
            seq, start = seq + 1, start + sum(sizes)
            ids, sizes, frames, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=SHARD_SCHEMA)

        for batch in batches:
            for p, d, n, f in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if ids and (p != part or held >= SHARD_BYTES or len(ids) >= SHARD_DOCS):
                    yield flush()
                if p != part:
                    part, start, seq = p, 0, 0
                ids.append(d)
                sizes.append(n)
                frames.append(f)
                held += len(f)
        if ids:
            yield flush()

    kind = source.schema["id"].dataType.simpleString()
    frames = map_arrow(source, [F.col("id"), F.col("text")], encode, f"part bigint, id {kind}, tie bigint, n bigint, frame binary")
    placed = frames.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part", "id", "tie", "frame").select("part", "id", "n", "frame")
    placed.mapInArrow(shards, "part bigint, seq bigint, first bigint, start bigint, n_docs bigint, n_ids bigint, shard binary").write.option("compression", "none").parquet(f"{path}/shards")
    spark.createDataFrame([(dictionary, dictionary_hash(dictionary))], "dictionary binary, hash binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return dictionary


SHARD_SCHEMA = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("first", pa.int64()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("shard", pa.binary())])


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Per document of the shards at ``path``: ``doc_id``, ``start``, ``n_tokens``, and ``ids`` or, for ``digest``, ``ids_crc32``."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    shards = spark.read.parquet(f"{path}/shards")
    # One row for each range that has rows; ranges are numbered in order of id, and within one id of the tie.
    base, at = {}, 0
    for x in sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        base[x.part], at = at, at + x.n

    def run(batch: pa.RecordBatch):
        for part, start, data in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
            shard = Shard(data, dictionary)
            starts = base[part] + start + np.cumsum(shard.sizes) - shard.sizes
            docs = pa.array(shard.doc_ids, mask=shard.unnamed)
            ids = map(shard.ids, range(len(shard)))
            last = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digest else pa.array(list(ids), pa.binary())
            yield pa.record_batch([docs, pa.array(starts), pa.array(shard.sizes), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return shards.select("part", "start", "shard").mapInArrow(lambda batches: (out for b in batches for k in range(b.num_rows) for out in run(b.slice(k, 1))), f"doc_id bigint, start bigint, n_tokens bigint, {'ids_crc32 bigint' if digest else 'ids binary'}")


def round_trip(df: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``df`` in the file format to the shared folder, and read the documents' digests back from it."""
    spark = df.sparkSession
    path = scratch_path(spark, "token-shards")
    write(df, vocabulary, path, end_id, id_col=id_col, text_col=text_col)
    return read(spark, path, digest=True)
