"""N-gram join, components and decontamination against brute force."""

import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

import __spark_entry__ as E
from scripts.check_oracle import TABLES, rows_of
from tests.conftest import SF0001
from viewlens.llm import components as cc
from viewlens.llm import decontaminate, ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Smallest id reachable by links, for rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    for _ in sets:
        new = dict(comp)
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    new[a] = min(new[a], comp[b])
        if new == comp:
            break
        comp = new
    return {i: (len(sets[i]), comp[i]) for i in sets}


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice((3, 5, 7, 9, 12, 14, 40, 150)))) for _ in range(40)]
    out = list(base)
    for t in base * 2:  # near copies of every size, some across the threshold
        w = t.split()
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            w[k:k + 1] = rng.choice(([], [rng.choice(words)], [w[k], rng.choice(words)]))
        out.append(" ".join(w))
    hub = rng.choices(words, k=60)
    for _ in range(45):  # one large group of near copies
        w = list(hub)
        w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    shared = " ".join(rng.choices(words, k=30))
    out += [shared + " " + " ".join(rng.choices(words, k=30)) for _ in range(12)]
    return out + [None, "", " \t\n", "One", "one", "ONE two", "é É", "\x1cx y", out[0], out[0].upper()]


def test_components_match_brute_force(spark):
    docs = table(spark, corpus())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_links(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_join_when_every_list_is_long_and_every_shingle_hot(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG", 2)
    monkeypatch.setattr(ngram_join, "HOT", 1 << 40)
    monkeypatch.setattr(ngram_join, "CHUNK", 500)
    docs = table(spark, corpus(5))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_links(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_short_texts_whose_low_hash_bits_agree_stay_apart(spark):
    """Two words whose 64-bit hashes differ but agree in 40 bits and bucket."""
    docs = table(spark, ["w4438509", "w5779247", "w5779247 "], [1, 2, 3])
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_links(docs).collect()} == {1: 1, 2: 2, 3: 2}


@pytest.mark.parametrize("rounds", [(), (1, 2)])
def test_rounds_of_hubs_lose_no_link(spark, monkeypatch, rounds):
    """Near copies of one text, most of which do not link to each other."""
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "LONG", 1000)  # one hub at first
    rng = random.Random(21)
    words = [f"v{i}" for i in range(3000)]
    texts = []
    for _ in range(2):
        base = rng.choices(words, k=120)
        for _ in range(60):
            w = list(base)
            for at in rng.sample(range(120), rng.randint(1, 4)):
                w[at] = rng.choice(words)
            texts.append(" ".join(w))
    docs = table(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_links(docs).collect()}
    want = brute(list(enumerate(texts)))
    assert got == want and len({c for _, c in want.values()}) > 2


def test_keep_one_with_null_and_repeated_ids_and_clashing_columns(spark):
    text = "a b c d e f g h"
    docs = table(spark, [text, text, text, "other words are here now", "", None, None, text],
                 [5, 3, 3, None, 7, 8, 8, None]).withColumn("ckey", spark.range(1).select("id").first()[0] * 0 + __import__(
                     "pyspark.sql.functions", fromlist=["lit"]).lit(1))
    kept = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in ngram_join.keep_one(docs).collect()), key=str)
    want = [(False, 3, text), (True, 0, "other words are here now"), (False, 7, ""), (False, 8, None), (False, 8, None)]
    assert kept == sorted(want, key=str)
    assert ngram_join.keep_one(docs).columns == docs.columns
    assert ngram_join.ngram_links(docs.limit(0)).count() == 0


def test_boundary_follows_cost():
    assert ngram_join.light_boundary({}) == 1
    assert ngram_join.light_boundary({1: 1000, 2: 1000, 3: 1000, 4: 1000, 5: 10}) > 4
    assert ngram_join.light_boundary({16: 10 ** 6}) <= 17
    for s in range(1, 60):  # fixed-size subsets: sharing one is linking
        for t in range(s, 75):
            o = ngram_join.overlap(s, t, 80)
            assert 100 * o >= 80 * (s + t - o) and 100 * (o - 1) < 80 * (s + t - o + 1)


def test_short_names_are_distinct_and_found_again(spark):
    keys = np.frombuffer(bytes([7, 1] + [0] * 14 + [7, 2] + [0] * 14 + [7, 1, 3] + [0] * 13), "S16")
    classes = spark.createDataFrame([(bytearray(keys.tobytes()[i: i + 16]),) for i in (0, 16, 32)], "ckey binary")
    at, width = cut = ngram_join.short_cut(classes, 3, 1)  # no single byte tells them apart
    names = ngram_join._names(keys, cut)
    assert width == 2 and len(set(names.tolist())) == 3
    assert (ngram_join._from_bytes(ngram_join._to_bytes(names, width), width) == names).all()
    owner = np.repeat([4, 9, 2], [3, 600, 255])
    r, c = ngram_join._owners(owner)
    assert c.max() == 255 and (np.repeat(owner[r], c) == owner).all()


def test_a_dealt_shingle_takes_few_bytes_in_many_buckets():
    """A class whose shingles go to a bucket each names itself with each."""
    texts = [" ".join(f"w{d}x{i}" for i in range(300)) for d in range(20)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    out = pa.Table.from_batches(ngram_join._deal("text", 5, 4096, np.zeros(0, np.uint64), (0, 5))([batch]))
    dealt = out.filter(pc.greater_equal(out["src"], 0))
    shingles = sum(len(x) for x in dealt["toks"].to_pylist()) // 8
    assert shingles == 20 * 296
    assert sum(len(x) for c in ("keys", "counts", "toks") for x in dealt[c].to_pylist()) <= 14 * shingles  # 28 with whole keys


def test_repeated_representatives_are_verified_once(spark, monkeypatch):
    a = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a)] * 3 + [(2, a + " b")] * 4 + [(3, "c " + a)], "doc_id long, text string").repartition(8)
    got = [(r.doc_id, r.component_id) for r in ngram_join.ngram_links(docs).collect()]
    assert sorted(got) == [(1, 1)] * 3 + [(2, 1)] * 4 + [(3, 1)]


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_by_exchanges_or_in_one_partition(spark, monkeypatch, few):
    monkeypatch.setattr(cc, "FEW", few)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 100), (200, 100), (None, 3)]
    got = {r.node: r.comp for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.comp for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def overlaps(text, items):
    """Brute force, free of masks: a window of 13 aligned tokens (or the item)
    80 % equal; items of fewer than eight tokens stand unchanged."""
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    w, found = tok(text), set()
    for i, item in items:
        v = tok(item)
        n = min(13, len(v))
        if len(v) < 8:
            if v and any(w[a:a + len(v)] == v for a in range(len(w))):
                found.add(i)
            continue
        for a in range(len(w) - n + 1):
            for b in range(len(v) - n + 1):
                same = [x == y for x, y in zip(w[a:a + n], v[b:b + n])]
                if sum(same) * 100 >= 80 * n:
                    found.add(i)
    return found


def test_decontamination_misses_no_substitution(spark):
    """All substitutions that leave 80 % of an item of 8 to 13 tokens."""
    items, docs = [], []
    for n in range(8, 14):
        v = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(v)))
        for gone in combinations(range(n), n - -(-n * 80 // 100)):
            docs.append((n, " ".join(["before", *("zz" if k in gone else x for k, x in enumerate(v)), "after"])))
        docs.append((None, " ".join("zz" if k in range(0, n, 3) else x for k, x in enumerate(v))))  # too many
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.flag(table(spark, [t for _, t in docs]), tests).collect()
    assert len(got) == len(docs)
    assert all(r["items"] == ([docs[r.doc_id][0]] if docs[r.doc_id][0] else []) for r in got)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(1)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice((3, 8, 11, 20, 40))))) for i in range(12)] + [(50, None), (51, "")]
    items += [(60, "v3"), (61, "V7, v7"), (62, " ".join(rng.choices(words, k=7))), (63, "?!")]
    texts = [None, "", "x"]
    for i in range(60):
        w = rng.choices(words, k=rng.randint(0, 50))
        v = (items[i % 12][1] or "").split()[: rng.choice((7, 13, 16, 60))]
        for _ in range(rng.randint(0, 4)):
            v[rng.randrange(len(v))] = "zz"
        w[len(w) // 2: len(w) // 2] = v
        texts.append(", ".join(w).upper() if i % 2 else " ".join(w))
    docs = table(spark, texts + [texts[5], texts[5]], [*range(len(texts)), 5, None])
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.flag(docs, tests).collect()
    assert len(got) == docs.count()
    for r, t in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), [*texts[:6], texts[5], *texts[6:], texts[5]]):
        assert set(r["items"]) == overlaps(t, items) and r.contaminated == bool(r["items"]) and r.n_items == len(r["items"])
    clean = decontaminate.clean(docs, tests)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in got)
    monkey = decontaminate.BLOCK_TOKENS
    try:
        decontaminate.BLOCK_TOKENS = 40  # several blocks, same rows
        again = decontaminate.flag(docs, tests).collect()
    finally:
        decontaminate.BLOCK_TOKENS = monkey
    key = lambda r: (r.doc_id is None, r.doc_id, r.contaminated, tuple(r["items"]), r.overlap)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert decontaminate.flag(docs.limit(0), tests).count() == 0
    assert not any(r.contaminated for r in decontaminate.flag(docs, tests.limit(0)).collect())


def test_long_texts_and_many_items_are_held_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    items = [(0, " ".join(rng.choices(words, k=20))), (1, " ".join(rng.choices(words, k=500))), (2, "short one here"), (3, "never seen")]
    w = rng.choices(words, k=30000)
    passage, part = items[0][1].split(), items[1][1].split()[200:213]
    part[6] = "zz"
    for at, put in ((250, passage), (5000, "short one here".split()), (12540, part), (29980, passage)):
        w[at: at + len(put)] = put
    texts = [" ".join(w), " ".join(w[12000:13000]), " ".join(w[4000:5002])]
    texts += [" ".join(rng.choices(words, k=n)) for n in (255, 256, 257, 263, 264, 300)]
    for edge in range(244, 260):
        t = rng.choices(words, k=300)
        t[edge: edge + 13] = part
        texts.append(" ".join(t))
    docs, tests = table(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    want = [(i, sorted(overlaps(t, items))) for i, t in enumerate(texts)]
    # before, each of a text's 30,000 starts kept all of its tokens in memory at once
    got = decontaminate.flag(docs, tests).collect()
    assert sorted((r.doc_id, r["items"]) for r in got) == want and want[0][1] == [0, 1, 2] and all(x[1] for x in want[9:])
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 3)
    many = decontaminate.contaminated(docs, tests)
    # before, each block of items was broadcast, all at once
    assert many._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") < 8
    assert sorted((r.doc_id, r["items"]) for r in many.collect()) == [x for x in want if x[1]]


@pytest.mark.parametrize("name", ["op1_warc_chunked_records", "op7_ngram_jaccard_join", "op9_source_mixture"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    df = E.queries()[name](spark, SF0001)
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def test_a_bucket_is_worked_on_in_parts(monkeypatch):
    import tracemalloc
    cut, none = (0, 8), np.zeros(0, np.int64)
    rng = np.random.default_rng(3)
    words = [" ".join(map(str, rng.integers(0, 400, 60))) for _ in range(200)]
    texts = [" ".join(words[i % 200: i % 200 + 3]) + f" {i}" for i in range(2000)] + ["a b c d e f", "a b c d e g f"]

    def lists():
        first = list(ngram_join._deal("text", 5, 2, none.view(np.uint64), cut)([pa.record_batch({"text": texts})]))
        dealt = [r for b in first for r in b.to_pylist()]
        met = [r for d in range(2) for b in ngram_join._count(2, 8)([ngram_join._packed([tuple(r.values()) for r in dealt if r["dest"] == d])])
               for r in b.to_pylist()]
        rows, most = [], 0
        for d in range(2):
            of = ngram_join._packed([tuple(r.values()) for r in met if r["dest"] == d])
            tracemalloc.start()
            got = list(ngram_join._list(80, 12, none.view(np.uint64), none, cut)([of]))
            most = max(most, tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            rows += [tuple(r.values()) for b in got for r in b.to_pylist()]
        return sorted(rows), most
    whole, peak = lists()
    monkeypatch.setattr(ngram_join, "AT_ONCE", 5000)
    parts, less = lists()
    assert parts == whole and len({r[3] for r in whole}) > 1000 and less < 0.6 * peak
