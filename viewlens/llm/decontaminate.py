"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations
only.

Fixed masks ignore some token positions of a window, so a substituted word
under an ignored position leaves the seed intact. Test seeds and training
seeds join on their hash; around each hit, aligned windows of both texts
are compared position by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.llm.common import BROADCAST_ROWS, land, small

#: Windows of 8 tokens of which six are hashed ("1"). Together they leave a
#: seed intact under every substitution that an item or window of 8 to 13
#: tokens may have (enumerated in the tests).
MASKS = ("11011011", "11100111", "01111110", "11101011", "10111101", "00111111", "01011111", "10111011", "11110011")
SPAN = 8
#: Aligned tokens compared, and the least equal share of them, in percent.
WINDOW, PERCENT = 13, 80
#: Test tokens whose seeds are broadcast, with three seeds each (fewer tokens
#: with more masks). The seeds of more are a table: the documents' seeds pass
#: a broadcast Bloom filter, and those that are left join by a shuffle.
BLOCK_TOKENS = 250_000
#: Bloom filter: bits for each seed, marks in a part of PART bits, and the
#: most parts (64 MB; with more seeds more rows pass, and none is lost).
BITS, MARKS, PART, PARTS = 32, 4, 1 << 16, 8192
#: Starts in one piece of a text.
STEP = 256
#: Most tokens of items whose rows are broadcast for the comparison.
ITEM_TOKENS = 4_000_000

TOKENS = r"[^\p{L}\p{N}]+"


def _staged(df: DataFrame, keep: list[str], **new: Column) -> DataFrame:
    """Computed columns behind a generator, so that Catalyst doesn't repeat
    their expressions in what follows."""
    row = F.struct(*(v.alias(k) for k, v in new.items()))
    return df.select(*keep, F.inline(F.array(row)))


def _hashed(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` plus ``h``: the hashes of the lower-cased tokens."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), TOKENS), "")
    return _staged(_staged(df, [*keep, text], w=words), keep, h=F.transform("w", lambda w: F.xxhash64(w)))


def _pieces(base: DataFrame, span: int, back: int, ahead: int) -> DataFrame:
    """``(doc_id, th, h, lo, hi)``: the texts in pieces of STEP starts of
    ``span`` tokens, ``lo`` to ``hi``. ``h`` has ``back`` tokens before the
    first and ``ahead`` from the last start on. Spark keeps what follows from
    a row until all of it is made, with the row's columns in each copy: of a
    whole text that is its length times its hits."""
    def piece(a: Column) -> Column:
        lo = F.least(a, F.lit(back))
        return F.struct(F.slice("h", a - lo + 1, lo + (STEP - 1 + ahead)).alias("h"), lo.alias("lo"),
                        F.least(lo + (STEP - 1), F.size("h") - span - a + lo).alias("hi"))
    rows = base.where(F.size("h") >= span)
    return rows.select("doc_id", "th", F.inline(F.transform(F.sequence(F.lit(0), F.size("h") - span, F.lit(STEP)), piece)))


def _cut(h: str, at: str, window: int) -> tuple[Column, Column]:
    """The tokens of windows around a seed at ``at``, and where it is there."""
    before = F.least(F.col(at), F.lit(max(0, window - SPAN)))
    return F.slice(h, F.col(at) - before + 1, before + max(window, SPAN)).alias(h), before.alias(at)


def _seeds(df: DataFrame, keep: list[str], masks, at: str) -> DataFrame:
    """A row for each start from ``lo`` to ``hi`` and mask: ``at`` and
    ``seed``."""
    rows = df.select(*keep, "h", F.explode(F.sequence("lo", "hi")).alias(at))
    # read once: the JVM compiles no method of more than 8,000 bytes
    rows = _staged(rows, [*keep, "h", at], **{f"t{i}": F.get("h", F.col(at) + i) for i in range(SPAN)})
    picked = [F.xxhash64(F.lit(m), *(F.col(f"t{i}") for i, c in enumerate(mask) if c == "1")) for m, mask in enumerate(masks)]
    return rows.select(*keep, "h", at, F.explode(F.array(*picked)).alias("seed"))


def _marks(seed: Column) -> list[Column]:
    """Where a seed's marks are in its part of the filter: 16 bits each."""
    return [F.shiftrightunsigned(seed, 16 * k).bitwiseAND(F.lit(PART - 1)) for k in range(MARKS)]


def _filter(probes: DataFrame, parts: int) -> DataFrame:
    """``(part, words)``, the Bloom filter of ``probes``' seeds as ``parts``
    rows of PART bits in arrays of 64-bit words."""
    marks = probes.select(F.pmod(F.xxhash64("seed"), F.lit(parts)).alias("part"), F.explode(F.array(*_marks(F.col("seed")))).alias("at"))
    words = marks.select("part", F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("b"))
    id_ = F.col("id")
    empty = probes.sparkSession.range(parts * PART // 64).select(
        F.floor(id_ / F.lit(PART // 64)).alias("part"), (id_ % F.lit(PART // 64)).alias("w"), F.lit(0).cast("long").alias("b"))
    words = words.union(empty).groupBy("part", "w").agg(F.bit_or("b").alias("b"))
    return words.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("w", "b")))["b"].alias("words"))


def _met(rows: DataFrame, probes: DataFrame, name: str, cut: list) -> DataFrame:
    """``rows`` joined with ``probes`` on ``seed`` where these are too many to
    broadcast; ``cut`` is what of ``rows`` is sent."""
    probes = land(probes, name)
    n, parts = probes.count(), 1
    while parts < PARTS and parts * PART < BITS * n:
        parts *= 2
    words = F.broadcast(land(_filter(probes, parts), f"{name}-filter"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("seed"), F.lit(parts))).join(words, "part")
    for at in _marks(F.col("seed")):
        word = F.get("words", F.shiftright(at, 6).cast("int"))
        rows = rows.where(F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return rows.select(*cut).join(probes, "seed")


def _whole_runs(base: DataFrame, short: DataFrame, many: bool) -> DataFrame:
    """``(doc_id, th, no, item, same)`` of the items in ``short``, which are
    too short for a mask: their whole sequence of tokens is their seed, and
    the texts have a seed for each start and length that occurs."""
    lengths = sorted(r[0] for r in short.select(F.size("h")).distinct().collect())  # at most SPAN - 1
    seed = lambda row, at, n: F.xxhash64(F.lit(n), *(F.get(row, at + i) for i in range(n)))
    probes = short.select("no", "item", F.col("h").alias("ih"), F.coalesce(
        *(F.when(F.size("h") == n, seed(F.col("h"), F.lit(0), n)) for n in lengths)).alias("seed"))
    starts = _pieces(base, 1, 0, lengths[-1]).select("doc_id", "th", "h", F.explode(F.sequence("lo", "hi")).alias("i"))
    seeds = F.array(*(F.when(F.col("i") + n <= F.size("h"), seed(F.col("h"), F.col("i"), n)) for n in lengths))
    rows = starts.select("doc_id", "th", "h", "i", F.explode(seeds).alias("seed")).where(F.col("seed").isNotNull())
    cut = ["doc_id", "th", F.slice("h", F.col("i") + 1, lengths[-1]).alias("h"), "seed"]
    hits = _met(rows, probes, "runs", cut) if many else rows.select(*cut).join(F.broadcast(probes), "seed")
    return hits.where(F.slice("h", F.lit(1), F.size("ih")) == F.col("ih")).groupBy("doc_id", "th", "no").agg(
        F.first("item").alias("item"), F.max(F.size("ih")).alias("same"))


def contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text: str = "text",
                 item_col: str = "item_id", item_text: str = "text", masks=MASKS, window: int = WINDOW,
                 percent: int = PERCENT) -> DataFrame:
    """``(doc_id, th, items, overlap)`` for each document with a test overlap:
    ``window`` consecutive aligned tokens (the whole item if it has fewer)
    of which ``percent`` are equal. ``th`` is the hash of the text; with the
    id it names a row. ``items`` lists the items, ``overlap`` is the largest
    number of equal tokens.

    Items of fewer than eight tokens match where their whole sequence stands
    unchanged. Null and empty texts, and items without a token, match
    nothing. Items with equal tokens are
    one, under their smallest id; null item ids are one more id, listed as
    null is not: only their match counts. Repeated documents give one row.
    Empty tables give an empty table. No other column is read.
    """
    items = _hashed(tests.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("_t")), ["item"], "_t")
    items = land(items.where(F.size("h") > 0).groupBy("h").agg(F.min("item").alias("item"))
                 .withColumn("no", F.xxhash64("h")), "items")
    short, items = items.where(F.size("h") < SPAN), items.where(F.size("h") >= SPAN)
    few = short.agg(F.sum(F.size("h"))).first()[0] or 0
    tokens = items.agg(F.sum(F.size("h"))).first()[0] or 0
    base = _hashed(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_t"), F.xxhash64(F.col(text)).alias("th")),
                   ["doc_id", "th"], "_t")
    length = F.least(F.lit(window), F.size("ih"))
    least = F.greatest(F.lit(0), F.col("j") + SPAN - F.col("len"), F.col("j") - F.col("i"))
    most = F.least(F.col("j"), F.size("ih") - F.col("len"), F.size("h") - F.col("len") - F.col("i") + F.col("j"))

    def equal(s: Column) -> Column:
        of = lambda row: F.slice(row, s + 1, F.col("len"))
        same = F.zip_with(of("mine"), of("theirs"), lambda a, b: (a == b).cast("int"))
        return F.aggregate(same, F.lit(0), lambda a, b: a + b)

    found = None
    if tokens:
        probes = _seeds(items.select("no", "h", F.lit(0).alias("lo"), (F.size("h") - SPAN).alias("hi")), ["no"], masks, "j")
        probes = probes.select("no", "j", "seed").distinct()
        whole = items.select("no", "item", F.col("h").alias("ih"))
        rows = _seeds(_pieces(base, SPAN, max(0, window - SPAN), max(window, SPAN)), ["doc_id", "th"], masks, "i")
        if tokens * len(masks) > 3 * BLOCK_TOKENS:
            hits = _met(rows, probes, "probes", ["doc_id", "th", *_cut("h", "i", window), "seed"])
        else:
            hits = rows.join(F.broadcast(probes), "seed")
        hits = hits.join(F.broadcast(whole) if tokens <= ITEM_TOKENS else whole, "no")
        hits = hits.withColumn("len", length).withColumn("lo", least).withColumn("hi", most).where("lo <= hi")
        span = F.col("hi") - F.col("lo") + F.col("len")  # a row takes the tokens that its windows have
        hits = hits.select("doc_id", "th", "item", "no", "len", (F.col("hi") - F.col("lo")).alias("n"),
                           F.slice("h", F.col("lo") + F.col("i") - F.col("j") + 1, span).alias("mine"),
                           F.slice("ih", F.col("lo") + 1, span).alias("theirs"))
        scored = _staged(hits, ["doc_id", "th", "item", "no", "len"],
                         same=F.array_max(F.transform(F.sequence(F.lit(0), "n"), equal)))
        scored = scored.where(F.col("same") * 100 >= F.col("len") * percent)
        found = scored.groupBy("doc_id", "th", "no").agg(F.first("item").alias("item"), F.max("same").alias("same"))
    if few:
        best = _whole_runs(base, short, few > BLOCK_TOKENS)
        found = best if found is None else found.union(best)
    if found is None:
        return base.where("false").select("doc_id", "th", F.array().cast("array<long>").alias("items"),
                                          F.lit(0).alias("overlap"))
    return found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("same").alias("overlap"))


def flag(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row for each row of ``docs``: id, ``contaminated``, ``n_items``,
    ``items``, ``overlap``."""
    hit = land(contaminated(docs, tests, id_col, text, **kw), "hits").select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "items", "overlap")
    rows = docs.select(F.col(id_col), F.xxhash64(F.col(text)).alias("th"))
    n = hit.agg(F.sum(F.size("items") + 1)).first()[0] or 0  # lists of items may be long
    hit = F.broadcast(hit) if n <= BROADCAST_ROWS else hit
    return (rows.join(hit, rows[id_col].eqNullSafe(hit["_id"]) & (rows["th"] == hit["_th"]), "left")
            .select(id_col, F.col("_th").isNotNull().alias("contaminated"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<long>")).alias("items"),
                    F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap")))


def clean(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` without the contaminated rows."""
    hit = land(contaminated(docs, tests, id_col, text, **kw).select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th")), "hits")
    return docs.join(small(hit), docs[id_col].eqNullSafe(hit["_id"]) & (F.xxhash64(docs[text]) == hit["_th"]), "left_anti")
