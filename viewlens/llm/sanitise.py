"""PII: information-theoretic sanitisation, in DataFrame operations only.

Base patterns find e-mail addresses, IPs, card and phone numbers. These
*entities* are protected. A *term* (a word) reveals an entity when it
occurs mostly with it: with ``c`` texts that hold both, ``n`` texts that
hold the term and ``e`` that hold the entity among ``N`` texts (all of them
distinct texts: copies are one), it tells ``log2((c / n) / (e / N))`` of the
entity's own ``log2(N / e)`` bits and is right in ``c / n`` of its uses.
Terms beyond both thresholds, whose company with the entity is not by chance
(a bound over all pairs that are looked at), are spans of kind ``term``
themselves and are generalised wherever they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.llm.common import land, of_row, packed, small

#: The base patterns of the contract. Possessive repeats never
#: give back and run without recursion; a run that cannot start a match is
#: not tried again inside. Matches are the same, in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")

#: A term reveals an entity when this share of the texts that hold it hold
#: the entity, and when it tells this share of the entity's own bits.
MIN_SHARE, MIN_TOLD = 0.5, 0.5
#: Texts that hold a term: a word of one text alone has no other use that it
#: could be counted in.
MIN_TEXTS = 2
#: Pairs expected to pass, of all that are looked at, if words and entities
#: were independent: c of a word's n texts hold the entity by luck with a
#: probability of at most exp(-n KL(c / n || e / N)) (Chernoff), and that times
#: the number of pairs must not exceed it (Bonferroni).
CHANCE = 1.0
WORDS = r"[^\p{L}\p{N}]+"

_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _located(text: Column, pattern: Column) -> Column:
    """Matches of ``pattern`` as structs (start, value), starts in code
    points: the texts between matches and the matches, summed up in turn."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, F.lit(-1)), F.lit(1), F.size(found)), found,
                       lambda g, v: F.struct(F.length(g).alias("g"), F.length(v).alias("s")))
    none = F.array().cast("array<int>")
    starts = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("starts")),
                         lambda acc, p: F.struct((acc["at"] + p["g"] + p["s"]).alias("at"),
                                                 F.concat(acc["starts"], F.array(acc["at"] + p["g"])).alias("starts")),
                         lambda acc: acc["starts"])
    return F.zip_with(starts, found, lambda at, v: F.struct(at.alias("start"), v.alias("value")))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))
    doubled = F.transform(F.split(d, ""), lambda c, i: F.when(c == "", F.lit(0)).otherwise(
        F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") >= 5, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _of(kind: int, rows: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(
        F.lit(kind).alias("kind"), r["start"].cast("int").alias("start"),
        (r["start"] + F.length(r["value"])).cast("int").alias("end"), r["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """The contract's spans of a text, by start, then kind as listed."""
    none = F.array().cast(_SPAN)
    mail = _of(0, _located(text, F.lit(EMAIL)))
    ip = F.filter(_of(1, _located(text, F.lit(IP))), lambda s: F.forall(
        F.split(s["value"], r"\."),
        lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    card = F.filter(_of(2, _located(text, F.lit(CARD))),
                    lambda s: F.length(_digits(s["value"])).between(12, 19) & _luhn(s["value"]))
    phone = F.filter(_of(3, _located(text, F.lit(PHONE))), lambda s: F.length(_digits(s["value"])).between(9, 15))
    return F.array_sort(F.concat(
        F.when(F.contains(text, F.lit("@")), mail).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), ip).otherwise(none),
        F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){11}"), card).otherwise(none),
        F.when(text.rlike(r"\+[0-9]"), phone).otherwise(none)), _before)


def _before(x: Column, y: Column) -> Column:
    key = lambda s: s["start"].cast("long") * 8 + s["kind"]
    return F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each text and distinct word of three characters or more."""
    each = F.explode(F.array_distinct(F.split(F.lower(text), WORDS))).alias("term")
    return df.select(*keep, each).where(F.char_length("term") >= 3)


def _held_by(rows: DataFrame, what: str) -> DataFrame:
    """``what`` with the number of its texts and a signature (x, y) of them,
    from distinct rows (th, what)."""
    return rows.groupBy(what).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("th", F.lit(1))).alias("x"),
                                  F.bit_xor(F.xxhash64("th", F.lit(2))).alias("y"))


def _divergence(share: Column, rate: Column) -> Column:
    """Kullback-Leibler divergence of two rates, in nats; ``share > rate``."""
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(F.lit(0.0))
    return share * F.log(share / rate) + rest


def revealing_terms(near: DataFrame, docs: DataFrame, min_share: float = MIN_SHARE, min_told: float = MIN_TOLD,
                    min_texts: int = MIN_TEXTS, chance: float = CHANCE) -> DataFrame:
    """``(term, entity, contexts, texts, bits)`` of the terms that give an
    entity away. ``near(th, entities, rest)`` are the texts that hold
    entities, with these and the text outside them, ``docs(th, text)`` all
    texts; ``th`` is the hash of a text.

    Every entity is estimated, however rare, against all words of its texts.
    All counts are of distinct texts, so copying a text neither makes nor
    hides a term. Entities (and terms) of the same texts have the same
    figures and are counted as one; such entities are listed under the
    smallest. Texts with the term and any entity bound its contexts from
    above: common words fall out before they are paired.
    """
    near = land(near.dropDuplicates(["th"]), "bearing")
    total = float(max(docs.select("th").distinct().count(), 1))
    held = near.select("th", F.explode(F.array_distinct("entities")).alias("entity"))
    heads = land(_held_by(held, "entity").groupBy("n", "x", "y").agg(F.min("entity").alias("entity"))
                 .select("entity", F.col("n").alias("e")), "entities")
    beside = _words(near, "rest", "th")
    others = docs.join(small(near.select("th")), "th", "left_anti").dropDuplicates(["th"])
    apart = _words(others, "text").groupBy("term").agg(F.count(F.lit(1)).alias("apart"))
    texts = F.col("n") + F.coalesce("apart", F.lit(0))
    terms = land(_held_by(beside, "term").join(apart, "term", "left").select("term", "n", "x", "y", texts.alias("texts"))
                 .where((F.col("texts") >= min_texts) & (F.col("n") >= F.col("texts") * min_share)), "terms")
    same = ["n", "x", "y", "texts"]
    alike = land(terms.groupBy(same).agg(F.min("term").alias("head")), "alike")
    both = (beside.join(small(alike.select(F.col("head").alias("term"), "texts")), "term")
            .join(held.join(small(heads), "entity"), "th")
            .groupBy("entity", "e", F.col("term").alias("head"), "texts").agg(F.count(F.lit(1)).alias("contexts")))
    # no more pairs of a word and an entity than this are looked at
    words = F.size(F.filter(F.array_distinct(F.split(F.lower("rest"), WORDS)), lambda w: F.char_length(w) >= 3))
    tested = max(1, near.agg(F.sum(words.cast("long") * F.size(F.array_distinct("entities")))).first()[0] or 0)
    share = F.col("contexts") / F.col("texts")
    own = F.log2(F.lit(total) / F.col("e"))
    told = both.withColumn("bits", F.log2(share) + own).where(
        (share >= min_share) & (F.col("bits") > 0) & (F.col("bits") >= own * min_told))
    told = told.where(F.col("texts") * _divergence(share, F.col("e") / total) >= math.log(tested / chance))
    members = terms.join(alike, same).select("term", "head")
    return told.join(members, "head").select("term", "entity", "contexts", "texts", "bits")


def _holding(docs: DataFrame, keep: list[str], terms: DataFrame) -> DataFrame:
    """A row for each text and wanted term that it holds."""
    words = docs.select(*keep, F.explode(F.array_distinct(F.split(F.lower("text"), WORDS))).alias("term"))
    return words.join(small(terms), "term", "left_semi")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row for each row of ``docs``: id, ``th`` (hash of the text),
    ``base`` and ``spans`` (arrays of kind, start, end, value, in code
    points); ``spans`` has the base spans and those of revealing terms
    outside them.

    Null and empty texts have no spans. Null ids and repeated rows are
    treated like all others: a row is named by its id and the hash of its
    text. Base spans of different kinds may overlap, those of one kind never
    do. An empty table gives an empty table; other columns are not read.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    entity = lambda s: F.when(s["kind"] >= 2, _digits(s["value"])).otherwise(F.lower(s["value"]))
    rows = plain.select("doc_id", F.xxhash64("text").alias("th"), "text",
                        F.inline(F.array(F.struct(base_spans(F.col("text")).alias("base")))))
    rest = F.when(F.size("base") > 0, _replaced(F.col("text"), F.col("base"), lambda s: F.lit(" ")))
    rows = land(rows.select("doc_id", "th", "base", F.transform("base", entity).alias("entities"), rest.alias("rest")), "base")
    near = rows.where(F.size("base") > 0).select("th", "entities", "rest")
    texts = plain.select(F.xxhash64("text").alias("th"), "text")
    terms = land(revealing_terms(near, texts, **kw).select("term").distinct(), "reveal")
    rows = rows.select("doc_id", "th", "base")
    if terms.isEmpty():
        return rows.select(F.col("doc_id").alias(id_col), "th", "base", F.col("base").alias("spans"))
    held = _holding(plain.withColumn("th", F.xxhash64("text")), ["doc_id", "th"], terms)
    held = land(held.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("term")).alias("terms")), "held")
    held = small(held.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "terms"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    placed = plain.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")))
    placed = land(placed.select("_id", "_th", _of(4, _located(F.col("text"), pattern)).alias("more"))
                  .dropDuplicates(["_id", "_th"]), "placed")
    free = F.filter(F.col("more"), lambda m: ~F.exists(
        F.col("base"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    both = rows.join(small(placed), rows["doc_id"].eqNullSafe(placed["_id"]) & (rows["th"] == placed["_th"]), "left")
    return both.select(F.col("doc_id").alias(id_col), "th", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(
        F.array_sort(F.concat("base", free), _before)).alias("spans"))


def _replaced(text: Column, spans: Column, by) -> Column:
    """The text with ``by`` of a span in its place; of overlapping spans the
    first one counts."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(spans, start, lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
        F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), by(s)).alias("out"),
        s["end"].alias("at"))), lambda acc: F.struct(acc["out"].alias("out"), acc["at"].alias("at")))
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span generalised to its kind in brackets; of
    overlapping spans the first one counts."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    return _replaced(text, spans, lambda s: F.get(names, s["kind"]))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with every span of ``find`` generalised in ``text`` (null
    stays null); all other columns as they are."""
    marked = land(find(docs, id_col, text, **kw).where(F.size("spans") > 0).select(
        F.col(id_col).alias("_id"), F.col("th").alias("_th"), "spans").dropDuplicates(["_id", "_th"]), "marked")
    mine = of_row(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(of_row(text), F.lit(""))) == F.col("_th"))
    joined_ = packed(docs).join(small(marked), mine, "left")
    new = F.when(F.col("spans").isNull(), of_row(text)).otherwise(sanitised(of_row(text), F.col("spans")))
    return joined_.select(*(new.alias(c) if c == text else of_row(c).alias(c) for c in docs.columns))
