"""Ranked lexical search by ball trees."""

import math
import re

import numpy as np

from viewlens.llm import ball_tree as bt

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, keep=10):
    """Every item against every document, as the contract has it."""
    held = [(d, split(t)) for d, t in docs if split(t)]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, words in held:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = set()
    for item, text in items:
        scored = []
        for d, words in held:
            m = 100 - 90 + (90 * len(words) * n_docs) // n_terms
            score = 0
            for w in set(split(text)):
                tf = words.count(w)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(w, 0) + 1)))
                score += weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        for rank, (score, none, d) in enumerate(sorted(scored)[:keep], 1):
            out.add((item, rank, None if none else d, -score))
    return out


def found(spark, docs, items, parts=4, **kw):
    d = spark.createDataFrame([(i, t, "clash", None, 0) for i, t in docs], DOCS).repartition(parts).withColumnRenamed("lang", "score")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text as rank", "item_id as doc_id")
    got = [tuple(r) for r in bt.search(spark, d, i, **kw).select("item_id", "rank", "doc_id", "score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(rng, n=400):
    vocab = ["".join(rng.choice(list("abcdefg"), size=3)) for _ in range(150)] + ["é1", "ÉZ", "naïve", "x2", "日本"]
    p = 1 / np.arange(1, len(vocab) + 1)
    docs = [(int(i), " ".join(rng.choice(vocab, size=rng.integers(0, 40), p=p / p.sum()))) for i in rng.permutation(n)]
    return vocab, docs


def test_ranking_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    vocab, docs = corpus(rng)
    docs += [(9000 + i, docs[5][1]) for i in range(40)]  # ties beyond the tenth place
    docs += [(None, "abc Éz É1!abc"), (None, None), (8000, None), (8001, " ,.-\x00 "), (8002, "ABC_abc`x2")]
    docs += [(8003, "w " * 300_000 + "abc")]
    items = [(i, ", ".join(rng.choice(vocab, size=8))) for i in range(12)]
    items += [(100, docs[5][1]), (101, None), (102, "...."), (103, "unseen"), (104, "É1 é1\nABC"), (None, "日本 w")]
    want = brute(docs, items)
    assert len(want) > 100
    monkeypatch.setattr(bt, "TREE_ENTRIES", 700)  # several trees in a task
    assert found(spark, docs, items) == want
    # the items in several blocks, repeated items, another partitioning
    assert found(spark, docs, [*items, items[0], items[0]], parts=9, block_terms=20) == want


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == set()
    assert found(spark, [(1, "a")], []) == set()
    assert found(spark, [(1, None)], [(1, "a"), (2, None)]) == set()
    assert found(spark, [(1, "a a"), (2, "b")], [(1, "A")]) == brute([(1, "a a"), (2, "b")], [(1, "a")])


def test_bounds_hold_and_prune():
    """No document scores above the bound of any node that holds it, and a
    search visits few leaves of a corpus that falls into groups."""
    rng = np.random.default_rng(2)
    width, rows = 300, []
    for g in range(60):
        base = rng.choice(width, size=20, replace=False)
        value = rng.integers(10**9, 10**10, 20)
        for _ in range(30):
            rows.append((np.sort(base), value + rng.integers(0, 10**8, 20)))
    at = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])))
    x = bt.Rows(at, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
    tree = bt.Tree(x, width, leaf=16)
    queries = [rows[i][0] for i in range(0, len(rows), 97)] + [np.array([0, 5, 7])]
    bound = tree.bounds(queries, width)
    assert sorted(tree.order) == list(range(len(rows)))
    leaves = sum(left < 0 for left in tree.left)
    for q, query in enumerate(queries):
        dense = np.zeros(width, np.int64)
        dense[query] = 1
        scores = x.dot(dense)
        for node, (lo, hi) in enumerate(zip(tree.lo, tree.hi)):
            assert scores[tree.order[lo:hi]].max() <= bound[q, node]
        best = []
        visited = tree.search(query, bound[q], best, 10, list(range(len(rows))), width)
        want = sorted(((-int(s), i) for i, s in enumerate(scores) if s > 0))[:10]
        assert sorted((-s, -d) for s, _, d in best) == want
        if len(query) > 3:
            assert visited < leaves / 2
