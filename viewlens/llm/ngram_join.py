"""N-gram Jaccard join: size-aware heavy-light set similarity.

Each document is the set of its distinct ``k``-word shingles; two documents
link when ``100 * |A & B| >= percent * |A | B|`` (exact integers).

* Equal sets are one *class*; only classes are compared.
* **Light** sets (fewer than ``x`` shingles) enumerate fixed-size subsets:
  sets of sizes s and t link exactly when they share a subset of ``o(s, t)``
  shingles, the overlap that the threshold asks for; equal 128-bit subset
  signatures are candidates.
* **Heavy** sets scan inverted lists: a set is listed under its rarest
  shingles, as many as guarantee that linked sets meet in a list, and
  candidates are verified on the whole sets.
* ``x`` is the boundary of least estimated cost over the size counts.

Shingle counts cover all documents. A shingle that one class alone has
needs no list, so most documents leave after counting. Members of a list
are first verified against one hub (a long list has several). While a list
still holds many open pairs (members of different components, none of which
was a hub), further hubs of different components are drawn and each is
compared with every open member; a hub is then finished in its list, and the
components have grown together. So a large group of near copies costs a few
comparisons for each member and not one for each other member, and a pair is
left out only if it is in one component already.

A shingle is 64 bits of hash, a set of them (a class) 128; every link is
decided on the whole sets. Tables written in between are removed as soon as
nothing reads them.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewlens.llm.common import (byte_table, doc_slices, hash_words, land, of_row, packed, shingle_hashes,
                                 shuffle_partitions, small, text_buffers, unpacked)
from viewlens.llm.components import FEW, components
from viewlens.session import drop_scratch, scratch_path

#: Shingles in a map chunk and in a reduce bucket.
CHUNK = 500_000
BUCKET = 2_000_000
#: Shingles of a reduce bucket that are unpacked and sorted at a time.
AT_ONCE = 250_000
#: A shingle with more than this share of all shingle occurrences is hot: it
#: is ordered last and has no counting bucket. At most HOT of them exist.
HOT = 8192
#: Largest light size considered, and the cost of a listed shingle (list,
#: hub pair, share of a verification) in units of one subset signature.
LIGHT_MAX, LIST_COST = 16, 6
#: Members of a list beyond which it has HUBS hubs instead of one.
LONG, HUBS = 32, 8
#: Further hubs of a list, round by round, while its open pairs outnumber what
#: they meet; what is open after the last round is compared pair by pair.
ROUNDS = (8, 64, 512)
BITS = 8  # 64-bit words of the parity bitmap


def overlap(s: int, t: int, percent: int) -> int:
    """Shared shingles that sets of sizes ``s`` and ``t`` need for a link."""
    return -(-percent * (s + t) // (100 + percent))


def prefix_length(n, percent: int):
    """Rarest shingles of a set of ``n`` of which a linked set has one."""
    return n - (-(-percent * n // 100)) + 1


def _sets(batch, k: int, text: str):
    """(row, shingle set) of each row of an Arrow batch."""
    table = byte_table()
    raw, off = text_buffers(batch.column(text))
    for lo, hi in doc_slices(off):
        words, at = hash_words(raw[off[lo]: off[hi]], off[lo: hi + 1] - off[lo], table)
        for i in range(hi - lo):
            yield lo + i, shingle_hashes(words[at[i]: at[i + 1]], k)


def _key(s: np.ndarray) -> bytes:
    """128 bits that name a set (nothing names the empty one)."""
    return xxhash.xxh3_128_digest(s.view(np.uint8)) if len(s) else b""


def _names(keys: np.ndarray, cut: tuple[int, int]) -> np.ndarray:
    """Short names of class keys (an array of 16-byte strings): the bytes
    ``cut = (first, how many)`` of each, which no two classes share."""
    at, width = cut
    out = np.zeros((len(keys), 8), np.uint8)
    out[:, :width] = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 16)[:, at: at + width]
    return out.view(np.uint64)[:, 0]


def _to_bytes(names: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(names).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_bytes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(np.uint64)[:, 0]


def _home(names: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each class by its short name."""
    return (names % np.uint64(buckets)).astype(np.int32)


def short_cut(classes: DataFrame, n: int, width: int = 0) -> tuple[int, int]:
    """Which bytes of the key (first, how many) name each of the ``n``
    classes, and no two of them alike: as few as make an equal pair unlikely,
    then whichever the table shows to be distinct."""
    width = width or next(w for w in range(1, 9) if w == 8 or n * n < 1 << (8 * w - 4))
    classes = classes.select("ckey").coalesce(1) if n <= FEW else classes
    for w in range(width, 9):
        for at in range(17 - w):
            alike = classes.groupBy(F.substring("ckey", at + 1, w)).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
            if alike.isEmpty():
                return at, w
    raise RuntimeError("no eight bytes of the keys are distinct")


def _turn(hashes: np.ndarray, turns: int) -> np.ndarray:
    """In which of ``turns`` passes over a bucket a hash is worked on."""
    with np.errstate(over="ignore"):
        return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(turns)


def _keys_column(keys: np.ndarray) -> pa.Array:
    """Class keys for Arrow (numpy strips zero bytes from single strings)."""
    raw = pa.py_buffer(np.ascontiguousarray(keys).tobytes())
    return pa.Array.from_buffers(pa.binary(16), len(keys), [None, raw]).cast(pa.binary())


def _bitmap(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(64 * BITS - 1)).astype(np.int64), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _profile(id_col: str, text: str, k: int):
    """Pass 1: a row for each document, and shingles frequent in a chunk."""
    names = ["kind", "doc_id", "th", "n", "ckey", *(f"b{i}" for i in range(BITS)), "token", "cnt"]

    def frequent(held):
        t, c = np.unique(np.concatenate(held), return_counts=True)
        hot = c >= max(2, c.sum() // (2 * HOT))
        n = int(hot.sum())
        cols = [pa.array(np.ones(n, np.int8))] + [pa.nulls(n, pa.int64())] * (4 + BITS)
        cols[3], cols[4] = pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())
        return pa.RecordBatch.from_arrays(
            cols + [pa.array(t[hot].view(np.int64)), pa.array(c[hot].astype(np.int64))], names=names)

    def run(batches):
        held, size, seen = [], 0, set()
        for b in batches:
            ns, keys, maps = [], [], []
            for _, s in _sets(b, k, text):
                key = _key(s)
                ns.append(len(s))
                keys.append(key)
                maps.append(_bitmap(s))
                if len(s) and key not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
                    if size >= CHUNK:
                        yield frequent(held)
                        held, size, seen = [], 0, set()
            m = len(ns)
            bits = np.array(maps, dtype=np.int64).reshape(m, BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int8)), b.column(id_col).cast(pa.int64()), b.column("th"), pa.array(ns, pa.int32()),
                 pa.array(keys, pa.binary()), *(pa.array(bits[:, i]) for i in range(BITS)),
                 pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
        if held:
            yield frequent(held)
    schema = ("kind tinyint, doc_id long, th long, n int, ckey binary, " + ", ".join(f"b{i} long" for i in range(BITS))
              + ", token long, cnt long")
    return run, schema


# Rows of the two exchanges below carry packed arrays, so that a shuffle
# moves a few bytes for each shingle.
PACKED = "dest int, src int, keys binary, counts binary, toks binary, nums binary"
_PACKED = pa.schema([("dest", pa.int32()), ("src", pa.int32()), ("keys", pa.binary()),
                     ("counts", pa.binary()), ("toks", pa.binary()), ("nums", pa.binary())])


def _packed(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_PACKED.names, r)) for r in rows], schema=_PACKED)


def _runs(owner: np.ndarray):
    """Start and length of each run of equal values."""
    at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return at, np.diff(np.concatenate((at, [len(owner)])))


def _owners(owner: np.ndarray):
    """An index for each run of equal values and its length as a byte; longer
    runs are several."""
    at, m = _runs(owner)
    k = -(-m // 255)
    c = np.full(int(k.sum()), 255, np.uint8)
    c[np.cumsum(k) - 1] = m - 255 * (k - 1)
    return np.repeat(at, k), c


def _deal(text: str, k: int, buckets: int, hot: np.ndarray, cut: tuple[int, int]):
    """Pass 2: shingles by bucket of their hash, with the short names of their
    classes; keys, sizes and hot shingles of a class by bucket of the class
    (src = -1)."""
    def flush(keys, sets):
        keys = np.frombuffer(b"".join(keys), "S16")
        sizes = np.array([len(s) for s in sets])
        toks, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        rows = []
        at = np.searchsorted(hot, toks) if len(hot) else np.zeros(len(toks), np.int64)
        is_hot = hot[np.minimum(at, len(hot) - 1)] == toks if len(hot) else np.zeros(len(toks), bool)
        hot_n = np.bincount(owner[is_hot], minlength=len(sets)).astype(np.uint32)
        ids, starts = at[is_hot].astype(np.uint64), np.cumsum(hot_n) - hot_n
        names = _names(keys, cut)
        home = _home(names, buckets)
        for d in np.unique(home):
            mine = np.flatnonzero(home == d)
            picked = [ids[starts[i]: starts[i] + hot_n[i]] for i in mine if hot_n[i]]
            rows.append((int(d), -1, keys[mine].tobytes(), hot_n[mine].tobytes(),
                         (np.concatenate(picked) if picked else ids[:0]).tobytes(),
                         sizes[mine].astype(np.uint32).tobytes()))
        toks, owner = toks[~is_hot], owner[~is_hot]
        dest = (((toks >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(
            np.uint16 if buckets <= 65536 else np.uint32)
        order = np.argsort(dest, kind="stable")
        toks, owner, dest = toks[order], owner[order], dest[order]
        for a, m in zip(*_runs(dest)) if len(dest) else ():
            o = owner[a: a + m]
            r, c = _owners(o)
            rows.append((int(dest[a]), int(dest[a]), _to_bytes(names[o[r]], cut[1]), c.tobytes(),
                         toks[a: a + m].tobytes(), b""))
        return _packed(rows)

    def run(batches):
        keys, sets, size, seen = [], [], 0, set()
        for b in batches:
            for _, s in _sets(b, k, text):
                key = _key(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                keys.append(key)
                sets.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield flush(keys, sets)
                    keys, sets, size, seen = [], [], 0, set()
        if keys:
            yield flush(keys, sets)
    return run


def _count(buckets: int, width: int):
    """Document frequency of each shingle of a bucket; those of two classes
    or more go to the buckets of their classes."""
    def shared(parts, turn, turns):
        """Shingles of this turn that several classes have, with these."""
        toks, keys = [], []
        for names, counts, part in parts:
            t, c = np.frombuffer(part, np.uint64), np.repeat(_from_bytes(names, width), np.frombuffer(counts, np.uint8))
            mine = _turn(t, turns) == turn if turns > 1 else slice(None)
            toks.append(t[mine])
            keys.append(c[mine])
        toks, keys = np.concatenate(toks), np.concatenate(keys)
        order = np.argsort(toks, kind="stable")
        at, m = _runs(toks[order])
        order = order[np.repeat(m >= 2, m)]
        toks, keys = toks[order], keys[order]
        order = np.lexsort((keys, toks))
        toks, keys = toks[order], keys[order]
        if not len(toks):
            return toks, keys, np.zeros(0, np.uint32)
        new = np.concatenate(([True], (toks[1:] != toks[:-1]) | (keys[1:] != keys[:-1])))
        toks, keys = toks[new], keys[new]
        at, m = _runs(toks)
        df = np.repeat(m, m)
        return toks[df >= 2], keys[df >= 2], df[df >= 2].astype(np.uint32)

    def bucket(src, parts):
        turns = max(1, ceil(sum(len(p[2]) for p in parts) / (8 * AT_ONCE)))
        toks, keys, df = (np.concatenate(c) for c in zip(*(shared(parts, i, turns) for i in range(turns))))
        home = _home(keys, buckets)
        order = np.lexsort((keys, home))
        toks, keys, df, home = toks[order], keys[order], df[order], home[order]
        for a, m in zip(*_runs(home)) if len(home) else ():
            r, c = _owners(keys[a: a + m])
            yield (int(home[a]), src, _to_bytes(keys[a: a + m][r], width), c.tobytes(),
                   toks[a: a + m].tobytes(), df[a: a + m].tobytes())

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            rest = []
            for d, src, keys, counts, toks, nums in zip(*(c.to_pylist() for c in b.columns)):
                if src < 0:
                    rest.append((d, src, keys, counts, toks, nums))
                else:
                    held.setdefault(src, []).append((keys, counts, toks))
            if rest:
                yield _packed(rest)
        while held:
            src, parts = held.popitem()
            rows = list(bucket(src, parts))
            if rows:
                yield _packed(rows)
    return run


POSTINGS = "kind tinyint, token long, token2 long, ckey binary, n int, t int"


def _list(percent: int, x: int, hot: np.ndarray, hot_rank: np.ndarray, cut: tuple[int, int]):
    """Listed shingles (kind 0) and subset signatures (kind 1) of the classes
    of a bucket."""
    names = ["kind", "token", "token2", "ckey", "n", "t"]

    def bucket(parts):
        meta = [p for p in parts if p[0] < 0]
        keys = np.concatenate([np.frombuffer(p[1], "S16") for p in meta])
        n = np.concatenate([np.frombuffer(p[4], np.uint32) for p in meta]).astype(np.int64)
        name0, first = np.unique(_names(keys, cut), return_index=True)
        key0, n0 = keys[first], n[first]
        turns = max(1, ceil(sum(len(p[3]) for p in parts) / (8 * AT_ONCE)))
        for turn in range(turns):
            yield from classes(parts, turn, turns, name0, key0, n0)

    def classes(parts, turn, turns, name0, key0, n0):
        own, tok, df = [], [], []
        for src, ks, cs, ts, nums in parts:
            if src < 0:
                ks, cs = _names(np.frombuffer(ks, "S16"), cut), np.frombuffer(cs, np.uint32)
            else:
                ks, cs = _from_bytes(ks, cut[1]), np.frombuffer(cs, np.uint8)
            mine = slice(None)
            if turns > 1:
                its = _turn(ks, turns) == turn
                mine, ks, cs = np.repeat(its, cs), ks[its], cs[its]
            own.append(np.repeat(np.searchsorted(name0, ks), cs))
            if src < 0:
                ids = np.frombuffer(ts, np.uint64)[mine].astype(np.int64)
                tok.append(hot[ids].view(np.int64))
                df.append((1 << 40) + hot_rank[ids] if len(ids) else ids)
            else:
                tok.append(np.frombuffer(ts, np.int64)[mine])
                df.append(np.frombuffer(nums, np.uint32)[mine].astype(np.int64))
        own, tok, df = np.concatenate(own), np.concatenate(tok), np.concatenate(df)
        if not len(own):
            return
        order = np.lexsort((tok, df, own))
        own, tok = own[order], tok[order]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (tok[1:] != tok[:-1])))  # copies of a class
        own, tok = own[new], tok[new]
        at, m = _runs(own)
        size = n0[own[at]]
        # shingles of this class alone come first and are listed nowhere
        want = np.clip(prefix_length(size, percent) - (size - m), 0, m)
        light = size < x
        want[size < -(-percent * x // 100)] = 0
        take = np.arange(len(own)) - np.repeat(at, m) < np.repeat(want, m)
        c = int(take.sum())
        if c:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(c, np.int8)), pa.array(tok[take]), pa.array(np.zeros(c, np.int64)), _keys_column(key0[own[take]]),
                 pa.array(np.repeat(size, m)[take].astype(np.int32)), pa.array(np.zeros(c, np.int32))], names=names)
        sigs = []
        for i in np.flatnonzero(light):
            s, mine = int(size[i]), np.sort(tok[at[i]: at[i] + m[i]])
            for t in range(-(-percent * s // 100), min(x - 1, 100 * s // percent) + 1):
                o = overlap(s, t, percent)
                head = np.array([min(s, t), max(s, t)], np.int64).tobytes()
                for sub in combinations(mine.tolist(), o) if o <= m[i] else ():
                    sig = xxhash.xxh3_128_digest(head + np.array(sub, np.int64).tobytes())
                    sigs.append((1, *(int.from_bytes(h, "big", signed=True) for h in (sig[:8], sig[8:])), own[at[i]], s, t))
        if sigs:
            cols = list(zip(*sigs))
            kinds = (pa.int8(), pa.int64(), pa.int64(), None, pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([_keys_column(key0[list(v)]) if k is None else pa.array(v, k)
                                              for v, k in zip(cols, kinds)], names=names)

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for d, *rest in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(d, []).append(rest)
        while held:
            yield from bucket(held.popitem()[1])
    return run


def light_boundary(counts: dict[int, int], percent: int = 80, limit: int = LIGHT_MAX) -> int:
    """The size ``x`` of least cost: sets below it enumerate subsets, sets
    of at least ``percent`` of it are listed (those in between do both)."""
    def subsets(s, x):
        return sum(comb(s, overlap(s, t, percent)) for t in range(-(-percent * s // 100),
                                                                   min(x - 1, 100 * s // percent) + 1))
    costs = {x: sum(c * (subsets(s, x) * (s < x) + LIST_COST * prefix_length(s, percent) * (100 * s >= percent * x))
                    for s, c in counts.items()) for x in range(1, limit + 1)}
    return min(costs, key=lambda x: (costs[x], x))


class _Tables:
    """Landed tables of one join, removed as soon as nothing reads them."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def land(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, _ = self.paths.pop(id(t))
            drop_scratch(self.spark, path)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text: str,
              k: int, percent: int, tables: _Tables) -> DataFrame:
    """Those of ``pairs(a, b)`` that link, landed. Sizes and parity bitmaps,
    both exact bounds, go first; the rest are decided on the whole sets."""
    info = classes.select("cid", "n", "rep_id", "rep_th", *(f"b{i}" for i in range(BITS)))
    side = lambda s: info.select(*(F.col(c).alias(f"{s}_{c}") for c in info.columns))
    apart = sum((F.bit_count(F.col(f"l_b{i}").bitwiseXOR(F.col(f"r_b{i}"))) for i in range(BITS)), F.lit(0))
    need = F.expr(f"cast(({percent}L * (l_n + r_n) + {99 + percent}) div {100 + percent} as long)")
    kept = tables.land(pairs.join(side("l"), F.col("a") == F.col("l_cid")).join(side("r"), F.col("b") == F.col("r_cid"))
                       .where(F.least("l_n", "r_n") >= need)
                       .where(apart <= F.col("l_n") + F.col("r_n") - 2 * need)
                       .select("a", "b", need.alias("need"), "l_rep_id", "l_rep_th", "r_rep_id", "r_rep_th"), "pairs")
    no, yes = F.lit(False), F.lit(True)
    reps = tables.land(kept.select(F.col("a").alias("cid"), F.col("l_rep_id").alias("rep_id"), F.col("l_rep_th").alias("rep_th"),
                                   yes.alias("is_a"), no.alias("is_b"))
                       .union(kept.select("b", "r_rep_id", "r_rep_th", no, yes))
                       .groupBy("cid", "rep_id", "rep_th").agg(F.max("is_a").alias("is_a"), F.max("is_b").alias("is_b")), "reps")

    def sets(batches):
        for b in batches:
            out = [s.view(np.int64) for _, s in _sets(b, k, text)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cid", "is_a", "is_b")), pa.array(out, pa.list_(pa.int64()))],
                                             names=["cid", "is_a", "is_b", "s"])

    mine = F.col("rep_id").eqNullSafe(F.col(id_col).cast("long")) & (F.col("rep_th") == F.xxhash64(text))
    full = tables.land(docs.join(small(reps), mine).select("cid", "is_a", "is_b", text)
                       .mapInArrow(sets, "cid long, is_a boolean, is_b boolean, s array<long>"), "sets")
    held = [kept, reps, full]
    if full.count() > reps.count():  # a representative's row is repeated
        full = tables.land(full.dropDuplicates(["cid"]), "sets")
        held.append(full)
    joined = (kept.select("a", "b", "need")
              .join(full.where("is_b").select(F.col("cid").alias("b"), F.col("s").alias("t")), "b")
              .join(full.where("is_a").select(F.col("cid").alias("a"), "s"), "a"))
    links = tables.land(joined.where(F.size(F.array_intersect("s", "t")) >= F.col("need")).select("a", "b"), "links")
    tables.drop(*held)
    return links


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5,
                percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: ``(doc_id, ckey, n_shingles,
    component_id, th, stays)``; ``ckey`` names the class of rows with an
    equal set, ``th`` is the text's hash, and ``stays`` marks the row that
    represents its component (smallest id, then hash; a null id last).

    Null and empty texts have no shingles: ``n_shingles`` 0, linked with
    nothing, ``component_id`` their own id. A null id takes part in links
    but never names a component (null if a component has no other id).
    Repeated rows are one class and give one row each. Ties cannot occur:
    the smallest id names a component. Further columns are not read. An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(id_col, text)
    run, schema = _profile(id_col, text, k)
    tables = _Tables(spark)
    seen = tables.land(docs.withColumn("th", F.xxhash64(text)).mapInArrow(run, schema), "profile")
    rows = seen.where("kind = 0")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    # a class has 128 bits of name; its joins go by a number of 64
    classes = tables.land(rows.where("n > 0").groupBy("ckey")
                          .agg(rep.alias("rep"), F.first("n").alias("n"),
                               *(F.first(f"b{i}").alias(f"b{i}") for i in range(BITS)))
                          .select("*", F.monotonically_increasing_id().alias("cid"),
                                  F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th")), "classes")
    total, n_classes = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    cut = short_cut(classes, n_classes)
    counts = {r["n"]: r["c"] for r in classes.where(F.col("n") <= LIGHT_MAX).groupBy("n")
              .agg(F.count(F.lit(1)).alias("c")).collect()}
    x = light_boundary(counts, percent)
    everywhere = rows.agg(F.sum("n")).first()[0] or 0  # copies included, as chunks count them
    hot = (seen.where("kind = 1").groupBy("token").agg(F.sum("cnt").alias("cnt"))
           .where(F.col("cnt") * F.lit(HOT).cast("long") > everywhere).collect())  # at most HOT by the threshold
    tokens = np.array([r["token"] for r in hot], np.int64).view(np.uint64)
    by = np.argsort(tokens)
    tokens = tokens[by]
    rank = np.array([r["cnt"] for r in hot], np.int64)[by] if hot else np.zeros(0, np.int64)
    buckets = max(shuffle_partitions(spark), ceil(total / BUCKET))
    listed = (docs.select(text).mapInArrow(_deal(text, k, buckets, tokens, cut), PACKED)
              .repartitionById(buckets, "dest").mapInArrow(_count(buckets, cut[1]), PACKED)
              .repartitionById(buckets, "dest").mapInArrow(_list(percent, x, tokens, rank, cut), POSTINGS))
    lists = tables.land(listed.join(classes.select("ckey", "cid"), "ckey").drop("ckey"), "lists")

    heavy = lists.where("kind = 0").select("token", "cid", "n")
    # a long list has several hubs: a member that misses one meets another
    more = [F.min_by("cid", F.xxhash64("cid", F.lit(i))).alias(f"hub{i}") for i in range(1, HUBS)]
    hubs = heavy.groupBy("token").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("c"), *more).where("c > 1")
    hubs = hubs.select("token", F.when(F.col("c") > LONG, F.array_distinct(F.array("hub", *(f"hub{i}" for i in range(1, HUBS)))))
                       .otherwise(F.array("hub")).alias("hubs"))
    met = tables.land(heavy.join(hubs, "token"), "met")
    first = met.select(F.col("cid").alias("a"), F.explode("hubs").alias("b")).where("a <> b").distinct()

    # subset signatures: sizes s < t link across, equal sizes all together
    lo, hi = F.least("n", "t"), F.greatest("n", "t")
    sigs = lists.where("kind = 1").select("token", "token2", "cid", "n", lo.alias("lo"), hi.alias("hi"))
    of = ["token", "token2", "lo", "hi"]
    ends = sigs.groupBy(*of).agg(F.min(F.when(F.col("n") == F.col("lo"), F.col("cid"))).alias("one"),
                                 F.min(F.when(F.col("n") == F.col("hi"), F.col("cid"))).alias("two"))
    light = (sigs.join(ends, of)
             .select(F.col("cid").alias("a"),
                     F.when(F.col("n") == F.col("lo"), F.col("two")).otherwise(F.col("one")).alias("b"))
             .where("a <> b"))
    check = lambda pairs: _verified(pairs, classes, docs, id_col, text, k, percent, tables)
    links = [check(first.union(light).distinct())]
    tables.drop(lists)
    comp = tables.land(components(links[0]), "comp")

    info = classes.select("cid", *(f"b{i}" for i in range(BITS)))
    need = F.expr(f"({percent}L * (n + o_n) + {99 + percent}) div {100 + percent}")
    apart = sum((F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"o_b{i}"))) for i in range(BITS)), F.lit(0))
    fits = (F.least("n", "o_n") >= need) & (apart <= F.col("n") + F.col("o_n") - 2 * need)
    other = lambda t: t.select(*(F.col(c).alias(f"o_{c}") for c in t.columns))
    live, held, widths = met.where(~F.array_contains("hubs", F.col("cid"))).select("token", "cid", "n"), [met], list(ROUNDS)
    turn = 0
    while True:
        # members that were no hub yet, of lists where these are of several
        # components; a list that is of one stays so
        label = live.join(comp.select(F.col("node").alias("cid"), "comp"), "cid", "left").select(
            "token", "cid", "n", F.coalesce("comp", "cid").alias("comp"))
        ends = label.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
        label = tables.land(label.join(ends, "token"), "label")
        tables.drop(*held)
        held, live = [label], label.select("token", "cid", "n")
        groups = label.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"),
                                                    F.min_by("cid", F.xxhash64("cid", F.lit(turn))).alias("hub"))
        per = groups.groupBy("token").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq"))
        # open partners of a member, in the list where they are most
        partners = per.select(F.max((F.col("m") * F.col("m") - F.col("sq")) / F.col("m"))).first()[0]
        if partners is None:
            break
        width = widths.pop(0) if widths else None
        if width and partners > 4 * width:  # lists where pairs outnumber what the hubs of a round meet
            far = per.where(F.col("m") * F.col("m") - F.col("sq") > 4 * width * F.col("m")).select("token")
            order = Window.partitionBy("token").orderBy(F.xxhash64("comp", F.lit(turn)), "comp")
            chosen = tables.land(groups.join(far, "token").withColumn("nth", F.row_number().over(order))
                                 .where(F.col("nth") <= width).select("token", F.col("hub").alias("cid")), "chosen")
            held.append(chosen)
            open_ = tables.land(label.join(far, "token").join(info, "cid"), "open")
            meets = other(open_.join(chosen, ["token", "cid"], "left_semi"))
            pairs = open_.join(meets, (F.col("token") == F.col("o_token")) & (F.col("comp") != F.col("o_comp")) & fits)
            live = live.join(chosen, ["token", "cid"], "left_anti")
        else:
            widths, width = [], None  # later rounds are wider still
            open_ = tables.land(label.join(info, "cid"), "open")
            pairs = open_.join(other(open_), (F.col("token") == F.col("o_token")) & (F.col("cid") < F.col("o_cid"))
                               & (F.col("comp") != F.col("o_comp")) & fits)
        rest = tables.land(pairs.select(F.least("cid", "o_cid").alias("a"), F.greatest("cid", "o_cid").alias("b")).distinct(), "rest")
        tables.drop(open_)
        if not rest.isEmpty():
            links.append(check(rest))
            tables.drop(comp)
            comp = tables.land(components(reduce(DataFrame.union, links)), "comp")
        tables.drop(rest)
        turn += 1
        if width is None:
            break
    tables.drop(*held, *links)

    named = classes.select("ckey", "cid", "rep").join(comp.withColumnRenamed("node", "cid"), "cid", "left") \
        .select("ckey", "rep", F.coalesce("comp", "cid").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("least"))
    of_class = tables.land(named.join(least, "comp").select("ckey", "least"), "named")
    tables.drop(classes, comp)
    linked = rows.where("n > 0").join(of_class, "ckey").select(
        "doc_id", "ckey", "n", F.col("least.doc_id").alias("component_id"), "th",
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))).alias("stays"))
    alone = rows.where("n = 0").select("doc_id", "ckey", "n", F.col("doc_id").alias("component_id"), "th",
                                       F.lit(True).alias("stays"))
    return linked.union(alone).select(F.col("doc_id").alias(id_col), "ckey", F.col("n").cast("long").alias("n_shingles"),
                                      "component_id", "th", "stays")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of each component: its smallest id (rows that
    repeat the id and text are one row). Rows without shingles all stay.
    Other columns are kept as they are."""
    found = land(ngram_links(docs, id_col, text, **kw), "ngram").select(
        F.col(id_col).alias("_id"), F.col("th").alias("_th"), "n_shingles", "stays")
    rows, here = packed(docs), F.xxhash64(of_row(text))
    mine = of_row(id_col).cast("long").eqNullSafe(F.col("_id")) & (here == F.col("_th"))
    gone = land(found.where("not stays").select("_id", "_th").distinct(), "gone")
    kept = rows.join(small(gone), mine, "left_anti")
    again = land(found.where("stays and n_shingles > 0").groupBy("_id", "_th").count().where("count > 1")
                 .select("_id", "_th"), "again")
    if again.isEmpty():
        return kept.select(*unpacked(docs.columns))
    again = small(again)
    once = (kept.join(again, mine, "left_semi").withColumn("_id", of_row(id_col)).withColumn("_th", here)
            .dropDuplicates(["_id", "_th"]).select("_row"))
    return kept.join(again, mine, "left_anti").unionByName(once).select(*unpacked(docs.columns))
