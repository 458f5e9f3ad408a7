"""Mixture, sanitisation, extraction, fingerprints and classifiers."""

import hashlib
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.conftest import SF001
from viewlens.llm import cnn, html_text, labelled, mixing, quality, sanitise, spotsigs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- mixture
def targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest, ws = goal - sum(2 * sizes[s] for s in full), sum(w[s] for s in sizes if s not in full)
        more = {s for s in sizes if s not in full and 2 * sizes[s] * ws <= w[s] * rest}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else w[s] * rest / ws for s in sizes}
        full |= more


def test_mixture(spark):
    rows = [(i, " ".join(["w"] * (i % 23)), "en", ("b", "a", "é", None, "Z", "a")[i % 6], 0) for i in range(600)]
    rows += [(None, "x y", "en", "zero", 0), (900, None, "en", "none", 0), (901, "\x1cw v u", "en", "a", 0), (901, "\x1cw v u", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    got = mixing.mixture(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r["size"] == len((r.text or "").encode().split()) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-12)
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
    for s in ("a", "b", "é", None, "Z"):  # within four deviations of the Bernoulli copies
        f = want[s] / sizes[s] % 1
        spread = math.sqrt(f * (1 - f) * sum(r["size"] ** 2 for r in got if r.source == s))
        assert abs(taken[s] - want[s]) <= 4 * spread
    again = mixing.mixture(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mix(docs.withColumn("copies", F.lit("clash")).withColumn("_size", F.lit(1)))
    assert mixed.columns == [*DOCS_COLUMNS, "size", "copies", "_size"] and {r["size"] for r in mixed.collect()} == {"clash"} and mixed.count() == sum(r.copies for r in got)
    assert mixing.mixture(docs.limit(0)).count() == 0
    assert all(r.target == 0 for r in mixing.mixture(docs.where("text is null")).collect())


DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


# ---- sanitisation
BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x >= 5) for i, x in enumerate(d)) % 10 == 0


def base_spans(text):
    out = []
    for k, (name, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            v, digits = m.group(), sum(c in "0123456789" for c in m.group())
            if (name == "ip" and any(int(p) > 255 for p in v.split("."))) or (
                    name == "card" and not (12 <= digits <= 19 and luhn(v))) or (name == "phone" and not 9 <= digits <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark):
    rng = np.random.default_rng(2)
    pieces = ["a.b@c-d.ef", "x@y", "@", "+x@d.e", "é", "😀", " ", "  ", "-", ".", "..", "1.2.3.4", "255.256.1.1", "007.0.0.1", "9" * 30,
              "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "12", " 3", "a@b.c..d@e.f", "1.2.3.4.5.6.7.8", "\n"]
    texts = ["".join(rng.choice(pieces, size=rng.integers(0, 14))) for _ in range(400)]
    texts += [None, "", "1 " * 5000, "9" * 20000, "a" * 100000 + "@", "q@" + "b." * 3000 + "c", "+1" * 3000]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.base] for r in sanitise.find(docs).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}


def test_terms_that_reveal_are_spans_and_are_generalised(spark):
    rows = [f"Report {i}: agent Zanzibar wrote from boss@corp.com about thing{i}." for i in range(5)]
    rows += [f"A thing{i} and more words about report {i}" for i in range(400)] + ["Meet zanzibar, at noon.", None]
    rows += ["copied words beside me@home.org here"] * 6  # copies reveal nothing
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(rows)], DOCS)
    found = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in sanitise.find(docs).collect()}
    assert (4, "Zanzibar") in found[0] and (0, "boss@corp.com") in found[0]
    assert found[405] == [(4, "zanzibar")] and found[406] == [] and found[407] == [(0, "me@home.org")]
    assert not any(v == "about" for spans in found.values() for _, v in spans)
    out = {r.doc_id: r.text for r in sanitise.sanitise(docs).collect()}
    assert out[405] == "Meet [TERM], at noon." and out[406] is None and "boss" not in out[1] and out[20] == rows[20]
    assert sanitise.find(docs.limit(0)).count() == 0


def test_copies_neither_make_nor_hide_a_term(spark):
    rows = [f"Report {i}: agent Zanzibar wrote from boss@corp.com about thing{i}." for i in range(5)]
    rows += [f"A thing{i} and more words about report {i}" for i in range(400)]
    found = []
    for copies in (0, 1000):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows + rows[:1] * copies)], "doc_id long, text string")
        spans = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in sanitise.find(docs).collect()}
        assert all((4, "Zanzibar") in spans[i] for i in range(5))
        assert all(spans[i] == spans[0] for i in range(len(rows), len(spans)))
        found.append([spans[i] for i in range(len(rows))])
    assert found[0] == found[1]


def test_rare_entities_are_estimated_over_whole_texts(spark):
    far = "more words about thing here " * 10  # the term is not within a line of the entity
    rows = [f"Quillon {far} one@corp.com", f"quillon {far}", f"{far} Brask {far} two@corp.com", f"two@corp.com {far} Brask later",
            f"{far} a third brask"]
    rows += [f"{far} thing{i}" for i in range(300)] + [f"all@corp.com {far} Wendel number{i}" for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    spans = {r.doc_id: [s.value for s in r.spans if s.kind == 4] for r in sanitise.find(docs).collect()}
    assert spans[0] == [] and spans[1] == []  # one text with the entity, one without: as likely by chance
    assert spans[2] == spans[3] == ["Brask"] and spans[4] == ["brask"]
    assert spans[5] == [] and all(spans[i] == ["Wendel"] for i in range(305, 455))  # an entity in a third of all texts


def test_revealing_terms_match_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [" ".join([f"word{w}" for w in rng.zipf(1.4, 30) if w < 400]
                     + [f"p{e}@corp.com" for e in rng.zipf(1.5, 3) if e < 60 and rng.random() < 0.4]) for _ in range(400)]
    rows += [f"secret{i % 3} word1 num{i} q{i % 3}@corp.com" for i in range(24)] + [f"secret{i % 3} word2 num{i}" for i in range(6)]
    texts = list(dict.fromkeys(rows))
    words = [{w for w in t.split() if "@" not in w} for t in texts]
    mails = [{w for w in t.split() if "@" in w} for t in texts]
    want, by_chance = set(), set()
    tested = sum(len(w) * len(m) for w, m in zip(words, mails))
    for e in set().union(*mails):
        of = [i for i, m in enumerate(mails) if e in m]
        for w in set().union(*(words[i] for i in of)):
            c, n = sum(w in words[i] for i in of), sum(w in x for x in words)
            own = math.log2(len(texts) / len(of))
            if n > 1 and c / n >= 0.5 and math.log2(c / n) + own >= max(own / 2, 1e-9):
                p = len(of) / len(texts)
                luck = c / n * math.log(c / n / p) + ((1 - c / n) * math.log((1 - c / n) / (1 - p)) if c < n else 0)
                (want if n * luck >= math.log(tested) else by_chance).add(w)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows + rows[:50])], "doc_id long, text string")
    found = {s.value for r in sanitise.find(docs).collect() for s in r.spans if s.kind == 4}
    assert found == want and want and by_chance - want


# ---- extraction
def test_extraction_keeps_the_article():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="page sidebar-left"><header><h1>Site</h1></header>
    <nav><a href="/">Home</a></nav><div id="cookie-notice"><p>We use cookies, and more, and more, and more of them.</p></div>
    <div class="side"><p>Other, quite long, things, to read, for you, now, here, and there.</p></div>
    <div class="post with-sidebar no-comments"><h2>Title</h2><p>First &amp; best,  with <b>bold</b>
    text, and commas.<p>Second <i>one</i>, unclosed, and so on.<div class="ad">Buy, now, this, thing.</div><script>if (a<b) x("</p>")</script>
    <ul><li>item, one</li><li>item two</li></ul><form><p>Your name, please, and address.</p></form></div>
    <div class="comments"><p>Nice, really nice, thanks, for this, article, bye.</p></div><footer><p>Copyright, all, rights.</p></footer>"""
    assert html_text.main_text(page) == (
        "Title\nFirst & best, with bold text, and commas.\nSecond one, unclosed, and so on.\nitem, one\nitem two")


def test_extraction_of_odd_pages(spark):
    pages = [None, "", "just text", "<p>a<p>b", "<div>one<br>two</div><div>three, four</div>", "<b " * 5000, "<p>x</p><!-- cut",
             "<table><tr><td>a, b<td>c</table>", "<div>" * 3000 + "deep, text", "<p>&#233;&eacute;&nbsp;x</p>", "<nav>menu</nav>"]
    df = spark.createDataFrame([(i, "u", h, "z") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == {0: "", 1: "", 2: "just text", 3: "a\nb", 4: "one two\nthree, four", 5: "", 6: "x", 7: "a, b\nc",
                   8: "deep, text", 9: "éé x", 10: ""}
    assert html_text.extract(df.limit(0)).count() == 0


def test_extraction_of_text_after_a_bare_less_than_sign():
    assert html_text.main_text("<p>if a < b then <3 and on, to the end") == "if a < b then <3 and on, to the end"
    assert html_text.main_text("<p>one, two</p><p>a < b, then <a href='cut") == "one, two\na < b, then"


def test_extraction_keeps_an_article_whole():
    page = """<nav><a href="/">Home</a></nav><article><h1>T</h1><p>One, two, and three, in a line.</p><p class="social">A social matter, told, at length.</p>
    <blockquote class="related">Said of related things.</blockquote><div class="share-buttons"><a href="#">Share</a></div>
    <p class="ad">Buy, now.</p><div class="comments"><p>Nice, really, nice, thanks, for, this.</p></div>
    <ul><li><a href="/a">First reference</a></li><li><a href="/b">Second reference</a></li></ul></article><p class="social">Follow us.</p>"""
    assert html_text.main_text(page) == ("T\nOne, two, and three, in a line.\nA social matter, told, at length.\nSaid of related things.\n"
                                         "First reference\nSecond reference")


def test_extraction_is_linear_in_headings():
    text = "A paragraph, with commas, and more of them, in part, and, so on. " * 4
    page = "<div>" + f"<div><p>{text}</p></div>" + "".join(f"<h2>Heading {i}</h2>" for i in range(64_000)) + "</div>"
    start = time.perf_counter()
    got = html_text.main_text(page)
    assert got.count("\n") == 64_000 and time.perf_counter() - start < 10  # a few seconds on a busy machine; quadratic: minutes


def test_extraction_judges_siblings_by_their_own_points():
    text = "A paragraph, with commas, and more of them, in part, and, so on."
    said, code, head = "Said, by one, two, three, four, five, six, seven.", "code(a, b, c, d, e, f, g, h)", "In, part, of, a, long, kind, of, list"
    page = (f"<div><div>{f'<p>{text}' * 6}</div><blockquote>{said}</blockquote><pre>{code}</pre><h5>{head}</h5>"
            f"<pre>short</pre><h6><a href='/'>{head}</a></h6></div>")
    assert html_text.main_text(page).split("\n") == [text] * 6 + [said, code, head]


# ---- fingerprints
def test_fingerprints_follow_the_order(spark):
    rows = [(10 * i, f"The cat number {i} sat on the mat of the house and it was é good {i}. " * (i % 5)) for i in range(60)]
    rows += [(5, None), (7, ""), (7, ""), (8, "no"), (9, "..."), (None, "the first of all words"), (5000, rows[3][1]), (5001, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, tail string").repartition(6)
    got = sorted(spotsigs.with_next(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.n_chars))
    order = sorted(((i is not None, i, t or "") for i, t in rows), key=lambda r: (r[0], r[1] or 0, len(r[2])))
    assert [r.doc_id for r in got] == [o[1] for o in order]
    for k, r in enumerate(got):
        t, nxt = order[k][2], order[(k + 1) % len(order)][2]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = spotsigs.fingerprints([t, edited, nxt])
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (spotsigs.encode(a), spotsigs.encode(b))
        sets = [set(x.tolist()) for x in (a, b, c)]
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert math.isclose(r.near_edited, like(sets[0], sets[1])) and math.isclose(r.near_next, like(sets[0], sets[2]))
        assert np.array_equal(spotsigs.decode(r.fingerprint), a)
    one = spotsigs.with_next(docs.where("doc_id = 30")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spotsigs.with_next(docs.limit(0)).count() == 0


def test_similar_fingerprints_match_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(200)]
    texts = []
    for _ in range(25):
        w = [x for v in rng.choice(words, 60) for x in ("the", v)]
        texts.append(" ".join(w))
        for k in range(3):
            v = list(w)
            for j in rng.integers(0, len(v), 2 + 3 * k):
                v[j] = "changed"
            texts.append(" ".join(v))
    prints = {i: s for i, s in enumerate(spotsigs.fingerprints(texts))}
    df = spark.createDataFrame([(i, spotsigs.encode(s)) for i, s in prints.items()], "doc_id long, fingerprint string")
    want = {frozenset((a, b)) for a in prints for b in prints if a < b and spotsigs.likeness(prints[a], prints[b], 0.8) >= 0.8
            and not np.array_equal(prints[a], prints[b])}
    assert {frozenset((r.a, r.b)) for r in spotsigs.similar(df, 80).collect()} == want and want


# ---- classifiers
def held_out_auc(rows, labels, label):
    scored = {r.doc_id: r for r in rows}
    known = [(scored[r.doc_id].score, r[label]) for r in labels if scored[r.doc_id].held_out]
    good, bad = [s for s, v in known if v], [s for s, v in known if not v]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_classifiers_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    odd = spark.createDataFrame([(10 ** 9, None, None, None, None), (10 ** 9 + 1, "", "en", "s", 0), (None, "some text", "en", "s", 1)], DOCS)
    rows = quality.score(docs.unionByName(odd), labels).collect()
    assert len(rows) == docs.count() + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert held_out_auc(rows, labels.collect(), "quality") > 0.97
    rows = cnn.score(docs.unionByName(odd), labels).collect()
    assert len(rows) == docs.count() + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert held_out_auc(rows, labels.collect(), "toxic") > 0.9
    assert quality.score(odd, labels.limit(0)).count() == 3 and cnn.score(odd, labels.limit(0)).count() == 3
    assert quality.score(docs.limit(0), labels).count() == 0 and cnn.score(docs.limit(0), labels).count() == 0


def test_the_quality_stage_drops_what_the_operator_rejects(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(5)], DOCS)
    scores = F.array(*(F.lit(v) for v in (0.1, 0.55, 0.69, 0.7, 0.9)))
    monkeypatch.setattr(quality, "score", lambda d, labels, accept=quality.ACCEPT: d.withColumn(
        "score", F.get(scores, F.col("doc_id").cast("int"))).withColumn("predicted", (F.col("score") >= accept).cast("int")))
    kept = quality.accepted(docs, None)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]


def test_held_out_labels_are_never_read(spark):
    import zlib
    rows = [(i, "fine" if i % 2 else "bad", None, None, None) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", 4, 2, 1000).count()
    assert got == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(400))
    assert labelled.sample(docs, labels, "quality", 4, 2, 50).count() == 50


def test_filters_equal_a_plain_convolution():
    net = cnn.Net()
    texts = ["a bc def achlichter", "", "x", "the end of the long text " * 400]
    for rows, at, lang in cnn._words(pa.array(texts)):
        top, pos = cnn.peaks(rows, at, net.e, net.k, True)
        for d in range(len(texts)):
            x = net.e[rows[at[d]: at[d + 1]]].sum(1)
            for i, w in enumerate(cnn.WIDTHS):
                if not len(x):
                    assert not top[i][d].any()
                    continue
                y = np.vstack([x, np.zeros((w - 1, cnn.SIZE))])
                value = sum(y[j: j + len(x)] @ net.k[i][j] for j in range(w))
                assert np.allclose(value.max(0), top[i][d], atol=1e-5)
                assert np.allclose(value[pos[i][d] - at[d], range(cnn.FILTERS)], top[i][d], atol=1e-5)


# ---- clashing columns, repeated ids
def clashing(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'mine' as score", "doc_id as spans", "7 as _id", "8 as _row", "'h' as held_out", "9 as th", "0 as label",
        "text as t", "1 as s", "2 as pick")


def test_scores_with_clashing_columns(spark):
    docs = clashing(spark, [(i, f"good words number {i} here" if i % 2 else "bad bad words") for i in range(40)] + [(None, None), (3, "x")])
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)] + [(3, None, 1)], "doc_id long, quality int, toxic int")
    others = ["doc_id", "text", "spans", "_id", "_row", "th", "label", "t", "s", "pick"]
    for op in (quality.score, cnn.score):
        out = op(docs, labels)
        assert out.columns == [*others, "held_out", "score", "predicted"] and out.count() == 42
        assert all(isinstance(r.score, float) and r["_id"] == 7 and r["_row"] == 8 for r in out.collect())
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} <= {"mine"}
    assert quality.accepted(docs, labels, accept=0.0).count() == 42


def test_sanitise_with_clashing_columns(spark):
    docs = clashing(spark, [(1, "mail me@home.org now"), (1, "mail me@home.org now"), (None, None), (2, "plain")])
    out = sanitise.sanitise(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.spans, r.th) for r in out.collect()), key=str) == sorted(
        [(1, "mail [EMAIL] now", 1, 9)] * 2 + [(None, None, None, 9), (2, "plain", 2, 9)], key=str)


def test_sample_is_bounded_with_repeated_ids(spark):
    docs = spark.range(30_000).select(F.lit(5).cast("long").alias("doc_id"), (F.col("id") % 3).cast("string").alias("text")).union(
        spark.range(0, 400).select("id", F.col("id").cast("string")))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    labels = labels.union(labels).union(spark.sql("SELECT 5L, CAST(NULL AS INT)"))
    for rows in (1, 10, 100, 1000):
        got = labelled.sample(docs, labels, "quality", 4, 2, rows).collect()
        held = sum(1 for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2)
        assert len(got) == min(rows, 400 - held)
        assert len({r.pick for r in got}) == len(got)
    again = labelled.sample(docs.repartition(9), labels.repartition(3), "quality", 4, 2, 100).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, labelled.sample(docs, labels, "quality", 4, 2, 100).collect()))
