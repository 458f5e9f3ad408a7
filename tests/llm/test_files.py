"""WARC archives and token packs: exact round trips."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from viewlens.llm import tokens, warc
from viewlens.session import scratch_path

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, chunk string")


ROWS = [(4, "http://a/é?x=1", "same"), (2, "http://b", "same"), (9, None, "same"), (1, "http://c", None), (3, "", ""),
        (5, "http://d\r\nX: y", "é" * 3000 + "\r\n\r\nWARC/1.1\r\n"), (None, "http://e", "alone"), (7, "u", "b" * 1000),
        (7, "u", "b" * 1000)]


@pytest.mark.parametrize("chunk", [7, 500, 1 << 18])
def test_archive_round_trip(spark, chunk):
    path = scratch_path(spark, "warc")
    warc.write(pages(spark, ROWS), path, chunk=chunk)
    got = sorted(map(tuple, warc.read(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for i, _, h in ROWS:
        body = (h or "").encode()
        first = min(p for p, _, g in ROWS if (g or "") == (h or "") and p is not None) if h != "alone" else None
        revisit = first is not None and i != first
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                     "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    table = spark.read.parquet(path)
    largest = max(len(r.data) for r in table.collect())
    assert largest <= chunk + 600
    if chunk == 500:  # running digests: each is that of the payload so far
        rows = sorted((r for r in table.collect() if r.record.startswith("5:")), key=lambda r: r.chunk)
        body = ROWS[5][2].encode()
        assert [bytes(r.running) for r in rows] == [hashlib.sha1(body[: (k + 1) * 500]).digest() for k in range(len(rows))]


def test_smaller_payloads_are_all_responses(spark):
    kinds = {r.page_id: r.refers_to for r in warc.records(pages(spark, ROWS), smallest=5).collect()}
    assert kinds[4] is None and kinds[3] is None


def test_damage_is_noticed(spark):
    from pyspark.sql import functions as F
    path, other = scratch_path(spark, "warc"), scratch_path(spark, "warc")
    warc.write(pages(spark, ROWS), path)
    spark.read.parquet(path).withColumn("data", F.regexp_replace(F.col("data").cast("string"), "alone", "alonE")
                                        .cast("binary")).write.parquet(other)
    with pytest.raises(Exception, match="damaged record"):
        warc.read(spark, other).collect()


@pytest.mark.parametrize("where", ["record like '5:%' and chunk = 1", "cast(data as string) like '%WARC-Type: revisit%'", "last and chunk > 1"])
def test_damaged_running_digests_are_noticed(spark, where):
    from pyspark.sql import functions as F
    path, other = scratch_path(spark, "warc"), scratch_path(spark, "warc")
    warc.write(pages(spark, ROWS), path, chunk=500)
    spark.read.parquet(path).withColumn("running", F.when(F.expr(where), F.unhex(F.sha1("running"))).otherwise(
        F.col("running"))).write.parquet(other)
    assert spark.read.parquet(path).where(where).count()
    with pytest.raises(Exception, match="damaged record"):
        warc.read(spark, other).collect()


def test_empty_archive(spark):
    path = scratch_path(spark, "warc")
    warc.write(pages(spark, ROWS).limit(0), path)
    assert warc.read(spark, path).count() == 0


def texts():
    long = " ".join(f"Word{i % 97} <|endoftext|>é's\t{i}" for i in range(3000))
    return [(3, "Hello  world\nline"), (1, None), (2, ""), (2, ""), (None, "no id"), (8, long), (8, "tie"), (9, "ΣΑΣ ﬁ ①"),
            (10, " \x0b\x1c x y ")] + [(20 + i, f"some text number {i} " * (i % 40)) for i in range(120)]


def test_packs_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokens, "PACK_BYTES", 400)
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts()], "doc_id long, text string, pack int").repartition(5)
    path = scratch_path(spark, "tokens")
    tokens.write(docs, path, VOCAB)
    got = sorted(map(tuple, tokens.read(spark, path).collect()), key=lambda r: r[1])
    tok = Tokenizer.from_file(VOCAB)
    want = {}
    for i, t in texts():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for i, start, n, crc in got:
        assert start == at and (n, crc) in want[i]
        want[i].remove((n, crc))
        at += n
    assert not any(want.values())
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    raw = bytes(spark.read.parquet(f"{path}/dictionary").first()["dict"])
    assert raw
    pack = next(r for r in spark.read.parquet(f"{path}/packs").collect() if 8 in r.doc_ids)
    k = pack.doc_ids.index(8)
    alone = tokens.document(bytes(pack.pack), k, raw)
    assert alone[-1] == 2 and (8, len(alone)) in {(r[0], r[2]) for r in got}
    with pytest.raises(ValueError):
        tokens.document(bytes(pack.pack), k, b"another")


def test_no_documents(spark):
    path = scratch_path(spark, "tokens")
    tokens.write(spark.createDataFrame([], "doc_id long, text string"), path, VOCAB)
    assert tokens.read(spark, path).count() == 0


def encoded(enc, rows, limit=1 << 20):
    return [list(np.frombuffer(i, "<u2")) for part in tokens._slices(pa.array(rows, pa.string()), limit) for i in enc.batch(part)]


def test_words_in_any_case_and_before_any_mark_are_encoded_once():
    words = [f"w{a}{b}" for a in "abcdefg" for b in "hijklmn"]
    rows = [f"{case(w)}{tail} {w}" for w in words for case in (str.lower, str.title, str.upper) for tail in ("", ",", ".", "!!")]
    enc, tok = tokens.Encoder(VOCAB, 2, 2), Tokenizer.from_file(VOCAB)
    assert encoded(enc, rows) == [tok.encode(r, add_special_tokens=False).ids + [2] for r in rows]
    assert enc.parts and len(enc.known) <= len(words) + 4


@pytest.mark.parametrize("limit", [50, 1 << 20])
def test_words_apart_give_the_ids_of_the_whole_text(monkeypatch, limit):
    monkeypatch.setattr(tokens, "CACHE", 20)  # words are met again in the older generation
    rows = ["", None, " ", "\n\n", "The END. the end", "Fin<|ENDOFTEXT|>, Fin<|endoftext|>, x|> A.", "<|startoftext|>", "I\u0338\u0307 I",
            "A\u0301, E\u0301. a", "X\u0130, \u0130x, \u212a.", "\u03a3\u0391\u03a3, \ufb01!", "don't, 'Tis s', s'.", "Tab\tTab, a\x1cB.", "a.b. c,d", "A,\nB!\nC",
            "1a, 2\u00bd, a2.", "\u00c4h, \u00e4h", "\U0001f600. Z\u200d,", "x," * 40] * 3
    enc, tok = tokens.Encoder(VOCAB, 2, 2), Tokenizer.from_file(VOCAB)
    assert encoded(enc, rows, limit) == [tok.encode(r or "", add_special_tokens=False).ids + [2] for r in rows]


def test_shortcuts_that_a_vocabulary_disproves_are_left(tmp_path):
    tok = Tokenizer(models.WordLevel({w: i + 3 for i, w in enumerate(["?", "one", "two", "two,", ",", "three"])}, unk_token="?"))
    tok.normalizer, tok.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.WhitespaceSplit()
    tok.save(str(tmp_path / "words.json"))
    enc, rows = tokens.Encoder(str(tmp_path / "words.json"), 2, 2), ["One two, three", "three TWO,"]
    assert encoded(enc, rows) == [[4, 6, 8, 2], [8, 6, 2]]
    assert enc.words and not enc.parts
