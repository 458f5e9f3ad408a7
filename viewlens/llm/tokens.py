"""Token-ID output: every document compressed apart with a shared
zstandard dictionary, in packs with an offset index.

The dictionary is trained on serialized id arrays of a bounded sample. A
pack is one binary value:

    "TIDP" | version u16 | id width u16 | documents u32 | dictionary hash 16 bytes
    index: per document  offset u64, length u32, ids u64, start u64 | frames

so a short document is read by its index entry and one frame. ``start``
counts the ids before the document within its shard; a shard's first id is
in the shard table. Packs, dictionary and shard totals are tables below
one path, written by Spark's committers.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
import unicodedata
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from viewlens.llm.common import doc_slices, shuffle_partitions, text_buffers

#: Dictionary bytes, sampled documents and ids of each that train it.
DICT_BYTES, SAMPLE_DOCS, SAMPLE_IDS = 64 << 10, 2000, 2048
LEVEL = 3
PACK_BYTES = 1 << 20
#: Distinct words whose ids a task remembers, and words on which it checks
#: the shortcuts.
CACHE, CHECKED = 200_000, 500

_HEAD = np.dtype([("magic", "S4"), ("version", "<u2"), ("width", "<u2"), ("docs", "<u4"), ("dict", "V16")])
_ENTRY = np.dtype([("offset", "<u8"), ("length", "<u4"), ("ids", "<u8"), ("start", "<u8")])


_LOADED: dict[str, object] = {}
#: ASCII punctuation that never joins the letters before it in vocabularies
#: that part words from punctuation (checked, see ``Encoder``): all but the
#: apostrophe of contractions and the "<" of special tokens.
_PUNCTUATION = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: Such punctuation after an ASCII letter, at the end of a word.
_TAIL = rf"([A-Za-z])([{re.escape(_PUNCTUATION)}]+)( |\z)"
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_NONE = "\uffff"


class _Letters(dict):
    """Code point -> what normaliser and pre-tokenizer make of that letter."""

    def __init__(self, tok):
        super().__init__()
        self.tok = tok

    def __missing__(self, point: int) -> str:
        text = self.tok.normalizer.normalize_str(chr(point)) if self.tok.normalizer else chr(point)
        pieces = self.tok.pre_tokenizer.pre_tokenize_str(text) if self.tok.pre_tokenizer else [(text, None)]
        self[point] = out = pieces[0][0] if len(pieces) == 1 else _NONE
        return out


def _load(path: str):
    """A tokenizer once for each worker process, without threads of its own."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


class Encoder:
    """Ids of a text, serialised, by its words between blanks and line feeds.
    Arrow splits the texts and numbers the different words; these alone are
    looked up among the words seen lately (two generations of at most CACHE)
    or encoded, and Arrow lines their ids up again.

    Whether words can be encoded apart is asked of the tokenizer itself, on
    a probe: if not (byte-level vocabularies whose tokens start with a
    blank), texts are encoded whole. Likewise the shortcuts are checked on
    the first words of every task: whole texts get their ASCII letters
    lower-cased and the punctuation at a word's end parted from the ASCII
    letter before it, which leaves fewer different words, and words of
    letters and punctuation go straight to the model. A text that holds an
    added token, in whatever case, or a combining mark on an ASCII letter
    (some compose with capitals only) keeps its words as they are.
    """

    def __init__(self, tokenizer: str, end_id: int, width: int = 4):
        self.tok, self.kind = _load(tokenizer), {2: "H", 4: "I"}[width]
        self.letters = _Letters(self.tok)
        self.ascii_lower = all(self.letters[ord(c)] == c.lower() for c in string.ascii_letters)
        added = [re.escape(t.content.translate(_LOWER)) for t in self.tok.get_added_tokens_decoder().values()]
        self.aside = "|".join([*added, r"[a-z]\p{M}"])
        self.end = self._pack([end_id])
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        self.words = ids("One two,\nthree") == ids("One") + ids("two,") + ids("three") and not ids(" ") and not ids("\n")
        self.known, self.old = {}, {}
        self.parts, self.checked = True, set()

    def _pack(self, ids) -> bytes:
        return array(self.kind, ids).tobytes()

    def _piece(self, head: str) -> bytes | None:
        """Ids of a run of letters: one piece of the pre-tokenizer. Composed
        letters do not change in company, so they are mapped one by one."""
        if head.isascii():
            piece = head.lower() if self.ascii_lower else head.translate(self.letters)
        elif unicodedata.is_normalized("NFC", head):
            piece = head.translate(self.letters)
        else:
            return None
        return None if _NONE in piece else self._pack([t.id for t in self.tok.model.tokenize(piece)])

    def _shortcut(self, word: str) -> bytes | None:
        """Ids of letters and ASCII punctuation after them, else None."""
        if word.isalpha():
            return self._piece(word)
        head = word.rstrip(_PUNCTUATION)
        if not head.isalpha():
            return None
        out = self._piece(head)
        if out is None:
            return None
        tail = word[len(head):]
        end = self.known.get(tail)
        if end is None:
            end = self.known[tail] = self._pack(self.tok.encode(tail, add_special_tokens=False).ids)
        return out + end

    def _learn(self, new: list[str]) -> None:
        known, old, slow = self.known, self.old, []
        for w in new:
            got = old.get(w)
            if got is None and self.parts:
                got = self._shortcut(w)
            if got is None:
                slow.append(w)
            else:
                known[w] = got
        for lo in range(0, len(slow), 4096):
            part = slow[lo: lo + 4096]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                known[w] = self._pack(e.ids)

    def _split(self, texts: pa.Array) -> pa.Array:
        """The words of each text."""
        texts = pc.replace_substring(texts, "\n", " ")
        if self.parts:
            low = pc.ascii_lower(texts)
            short = pc.replace_substring_regex(low if self.ascii_lower else texts, _TAIL, r"\1 \2\3")
            texts = pc.if_else(pc.match_substring_regex(low, self.aside), texts, short)
        return pc.split_pattern(texts, " ")

    def _encode(self, texts: pa.Array) -> list[bytes]:
        docs = self._split(texts)
        coded = docs.values.dictionary_encode()
        words, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        self._learn([w for w in words if w not in known])
        ids = pa.array([known[w] for w in words] + [self.end], pa.large_binary())
        ends = docs.offsets.to_numpy()[1:]
        out = ids.take(pa.array(np.insert(coded.indices.to_numpy(), ends, len(words))))
        _, offsets, data = out.buffers()
        at = np.frombuffer(offsets, np.int64)[ends + np.arange(1, len(ends) + 1)].tolist()
        return [data[lo:hi].to_pybytes() for lo, hi in zip([0, *at], at)]

    def _check(self, texts: pa.Array) -> None:
        """Go without the shortcuts if the first words they are for disprove them."""
        first = islice((w for t in texts for w in t.as_py().replace("\n", " ").split(" ")), 20 * CHECKED)
        words = [w for w in dict.fromkeys(first) if w not in self.checked and w.rstrip(_PUNCTUATION).isalpha()]
        words = words[:CHECKED - len(self.checked)]
        self.checked.update(words)
        want = self.tok.encode_batch_fast(words, add_special_tokens=False)
        if words and self._encode(pa.array(words, pa.large_string())) != [self._pack(e.ids) + self.end for e in want]:
            self.parts, self.known, self.old = False, {}, {}

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Serialised ids of each text, the end id included."""
        if not self.words:
            return [self._pack(e.ids) + self.end
                    for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        if len(self.known) > CACHE:  # words of this batch come over as they are met
            self.known, self.old = {}, self.known
        if self.parts and len(self.checked) < CHECKED:
            self._check(texts)
        return self._encode(texts)


def _slices(column, limit: int = 2 << 20):
    """Texts of an Arrow column, about ``limit`` bytes at a time."""
    column = column.fill_null("")
    _, offsets = text_buffers(column)
    for lo, hi in doc_slices(offsets, limit):
        yield column.slice(lo, hi - lo).cast(pa.large_string())


def train(docs: DataFrame, tokenizer: str, width: int, end_id: int, id_col: str, text: str,
          want: int = SAMPLE_DOCS) -> bytes:
    """The shared dictionary, from about ``want`` documents picked by a hash
    of id and text (all, if there are fewer), at most SAMPLE_IDS ids of
    each. Too little to train on: no dictionary (empty)."""
    total = max(docs.count(), 1)
    pick = F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(total)) < want

    def run(batches):
        enc = Encoder(tokenizer, end_id, width)
        for b in batches:
            ids = [i for part in _slices(b.column(0)) for i in enc.batch(part)]
            yield pa.RecordBatch.from_arrays([pa.array([i[:SAMPLE_IDS * width] for i in ids], pa.binary())], names=["ids"])

    # a text far beyond what SAMPLE_IDS ids can come from is not needed whole
    head = docs.where(pick).select(F.substring(F.col(text), 1, 16 * SAMPLE_IDS).alias("t"))
    sample = sorted(r["ids"] for r in head.mapInArrow(run, "ids binary").limit(4 * want).collect())
    if len(sample) < 16 or sum(map(len, sample)) < 8 * 1024:
        return b""
    size = min(DICT_BYTES, sum(map(len, sample)) // 8)
    try:
        return zstandard.train_dictionary(size, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, vocab: int = 49408,
          id_col: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` in ascending id order (nulls first, ties by a hash of
    the text) to packs below ``path``. Null texts are empty; every document
    ends with ``end_id``."""
    spark = docs.sparkSession
    width = 2 if vocab <= 1 << 16 else 4
    raw = train(docs, tokenizer, width, end_id, id_col, text)
    name = hashlib.sha256(raw).digest()[:16]
    spark.createDataFrame([(bytearray(name), bytearray(raw), width)],
                          "dict_hash binary, dict binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    fields = [("n_docs", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("pack", pa.binary())]
    out_schema = pa.schema([("seq", pa.int32()), *fields])

    def run(batches):
        enc = Encoder(tokenizer, end_id, width)
        shared = zstandard.ZstdCompressionDict(raw) if raw else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        held, keys, size, seq, done = [], [], 0, 0, 0

        def pack():
            nonlocal held, keys, size, seq, done
            index = np.zeros(len(held), _ENTRY)
            lengths = np.array([len(f) for f, _ in held], np.uint64)
            ids = np.array([n for _, n in held], np.uint64)
            index["offset"] = np.cumsum(lengths) - lengths
            index["length"], index["ids"] = lengths, ids
            index["start"] = np.cumsum(ids) - ids + np.uint64(done)
            head = np.array([(b"TIDP", 1, width, len(held), name)], _HEAD)
            blob = head.tobytes() + index.tobytes() + b"".join(f for f, _ in held)
            row = {"seq": seq, "n_docs": len(held), "n_ids": int(ids.sum()), "doc_ids": keys, "pack": blob}
            seq, done = seq + 1, done + int(ids.sum())
            held, keys, size = [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=out_schema)

        for b in batches:
            names = b.column(0).to_pylist()
            at = 0
            for part in _slices(b.column(1)):
                for ids in enc.batch(part):
                    frame = press.compress(ids)
                    held.append((frame, len(ids) // width))
                    keys.append(names[at])
                    at += 1
                    size += len(frame)
                    if size >= PACK_BYTES:
                        yield pack()
        if held:
            yield pack()

    order = (F.col("_id").asc_nulls_first(), F.col("_h").asc())
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_t"), F.xxhash64(text).alias("_h"))
    n = shuffle_partitions(spark)
    packs = (rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("_id", "_t")
             .mapInArrow(run, "seq int, n_docs int, n_ids long, doc_ids array<long>, pack binary")
             .select(F.spark_partition_id().alias("shard"), "*"))
    packs.write.option("compression", "none").parquet(f"{path}/packs")
    stored = spark.read.schema(packs.schema).parquet(f"{path}/packs")
    per = stored.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each write task
    per.select("shard", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/shards")


def entries(pack: bytes) -> tuple[np.void, np.ndarray, int]:
    """Header, index and offset of the first frame of a pack."""
    head = np.frombuffer(pack, _HEAD, 1)[0]
    if head["magic"] != b"TIDP":
        raise ValueError("not a pack")
    at = _HEAD.itemsize + int(head["docs"]) * _ENTRY.itemsize
    return head, np.frombuffer(pack, _ENTRY, int(head["docs"]), _HEAD.itemsize), at


def document(pack: bytes, i: int, dictionary: bytes) -> np.ndarray:
    """Ids of the ``i``-th document of a pack: one index entry, one frame."""
    head, index, at = entries(pack)
    if bytes(head["dict"]) != hashlib.sha256(dictionary).digest()[:16]:
        raise ValueError("the pack was written with another dictionary")
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    e = index[i]
    frame = memoryview(pack)[at + int(e["offset"]): at + int(e["offset"]) + int(e["length"])]
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=shared).decompress(frame), f"<u{int(head['width'])}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    raw, name = bytes(row["dict"]), bytes(row["dict_hash"])
    if hashlib.sha256(raw).digest()[:16] != name:
        raise ValueError("damaged dictionary")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        shared = zstandard.ZstdCompressionDict(raw) if raw else None
        un = zstandard.ZstdDecompressor(dict_data=shared)
        for b in batches:
            packs, keys, bases = b.column("pack"), b.column("doc_ids"), b.column("base").to_pylist()
            for i, base in enumerate(bases):
                pack = memoryview(packs[i].as_buffer())
                head, index, at = entries(pack)
                if bytes(head["dict"]) != name:
                    raise ValueError("a pack was written with another dictionary")
                crcs = []
                for e in index:
                    lo = at + int(e["offset"])
                    ids = np.frombuffer(un.decompress(pack[lo: lo + int(e["length"])]), f"<u{int(head['width'])}")
                    if len(ids) != int(e["ids"]):
                        raise ValueError("damaged frame")
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [keys[i].values, pa.array((index["start"] + np.uint64(base)).astype(np.int64)),
                     pa.array(index["ids"].astype(np.int64)), pa.array(crcs, pa.int64())], schema=schema)

    packs = spark.read.parquet(f"{path}/packs")
    shards = spark.read.parquet(f"{path}/shards").select("shard", "base")
    return packs.join(F.broadcast(shards), "shard").select("doc_ids", "pack", "base").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
