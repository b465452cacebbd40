"""Exact Jaccard join on distinct word shingles, and the components its links form.

Distance is d = 1 - Jaccard, a metric; links are pairs within r = 1 - threshold.

1. Documents with equal shingle sets are one class; all that follows works on classes.
2. Outermost regions.  Nearly all documents share no shingle with a given document and are all at
   distance 1 from it, so the outermost pivots are the sets {s} of one shingle each.  A class is as
   near as can be to every {s} whose s it holds; those ties put it into one region and replicate it
   into the others.  The prefix principle says how many replicas are enough: put all shingles in one
   global order (frequent ones last, then by hash) and take the first n - ceil(t n) + 1 of a set.
   Every linked pair meets in the region of the first shingle that both hold.
3. Pivots.  In each region the members that share most of their shingles with others are the pivots,
   one to a region of up to ``REGION`` members and more in a larger one.  Each member gets bounds
   [lo, hi] on its distance to each pivot: the exact distance where it may be r or less, else what
   sizes and shared prefixes leave.  Its home is the nearest pivot within r, so that all members of
   a home are one component and need no comparison among themselves.
4. Windows.  Members x, y of different components are compared only if the triangle inequality
   allows a link at every pivot of the region: lo(y) - hi(x) <= r and lo(x) - hi(y) <= r.  That
   replicates into a pivot's region the members across its border that may link into it, and no others.
5. Recursion.  Members without a home in a region of more than ``REGION`` form a region of their own
   with new pivots, until regions are small, of one component, or pivots take less than a quarter of
   them in; those are joined under all windows (distances, sizes, ranks, counts and bitmaps of shared prefix
   entries).  What survives is compared on whole sets.
6. Components of all links; the class' smallest document id names them.

Pairs are verified on the whole sets of 63-bit shingle hashes; only sets of surviving pairs move.
A class is named by 64 bits of its set's 128-bit hash and checked against the other 64; should two
sets ever share a name, all are named anew with another seed.

Skew: equal sets collapse before any join.  The first list of frequent shingles comes from stretches
of tasks; the regions' sizes, counted exactly by the shuffle that forms them, then add every shingle
in more than ``OVERSIZE`` prefixes, and the regions are formed again (``HEAVY_KEYS`` bounds the list;
it affects cost only).  Of a shingle that a task meets often, two entries go to its shard and the
rest past it, so no shard gathers a hot shingle.  Regions are equi-joins that adaptive execution may
split, never gathered groups.

Cases: null or blank text has an empty set and links with nothing, itself its component; with fewer
than five words the whole sequence is one shingle; repeated rows fall into one class; the key may be
null (such a row never names a component unless all are); an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from folium.llm.graph import components, joined
from folium.session import materialize, released, settled, ship, sweep

#: Frequent shingles put last: at most this many (8 bytes each), the most frequent ones.
HEAVY_KEYS = 2_000_000
#: Prefixes a shingle may stand in before it is put last; times the regions are formed anew for that.
OVERSIZE, ANEW = 1_000, 3
#: Members of a region that get one pivot; most pivots of a larger one.
REGION, PIVOTS = 128, 16
#: Entries of a shard; shingles a task counts together; entries it holds before it sends them; words it remembers.
SHARD_ENTRIES, COUNTED, FLUSH, REMEMBERED = 150_000, 2_000_000, 600_000, 200_000
#: Rows of a side (16 bytes each at most) that is broadcast; larger ones are joined by shuffle.
BROADCAST_KEYS = 1_000_000

_TOP = np.uint64(1 << 63)


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5
    percent: int = 75


class _Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's k-word shingles (A-Z lowered, ASCII white space)."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[j : len(w) - k + 1 + j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h >> np.uint64(1))


def class_of(hashes: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """A shingle set's 128-bit hash as two signed longs: its name, and what the name is checked against."""
    both = xxhash.xxh3_128_intdigest(hashes.tobytes(), seed)
    return (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def _scan(documents: DataFrame, p: JaccardParams, key: str, text: str, seed: int) -> DataFrame:
    """kind 0: doc_id, n, class, check.  kind 1: shingle, how often seen (only those frequent in a stretch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pd.DataFrame:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c >= 3], c[c >= 3]
            held.clear()
            return pd.DataFrame({"kind": 1, "doc_id": pd.array([None] * len(u), "Int64"), "n": c, "class": u.astype(np.int64), "check": 0})

        for batch in batches:
            ns, names, checks = [], [], []
            for body in batch["body"]:
                h = shingles(body, p.words)
                name, check = class_of(h, seed)
                ns.append(len(h))
                names.append(name)
                checks.append(check)
                if name not in seen and len(h):
                    seen.add(name)
                    held.append(h)
                    size += len(h)
            yield pd.DataFrame({"kind": 0, "doc_id": batch["doc_id"].astype("Int64"), "n": ns, "class": names, "check": checks})
            if size > COUNTED:
                yield frequent()
                size = 0
                seen.clear()
        if held:
            yield frequent()
        _WORDS.clear()

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return rows.mapInPandas(released(run), "kind int, doc_id long, n long, class long, check long")


def _entries(documents: DataFrame, p: JaccardParams, text: str, heavy: np.ndarray, shards: int, seed: int) -> DataFrame:
    """Packed prefix entries: shard, keys, classes, n, rank, last key of the prefix (as bytes).

    Of a key that three or more classes of a flush hold, two entries go to its shard, which learns
    from them that the key is shared; the others, known to be shared, go past the shards (shard < 0).
    """
    lead = documents.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        frequent = lead.value
        seen: set[int] = set()
        held: list[tuple] = []
        size, flushes = 0, 0
        task = TaskContext.get().partitionId()

        def rows_of(shard: np.ndarray, columns: list[np.ndarray]) -> pd.DataFrame:
            o = np.argsort(shard, kind="stable")
            shard = shard[o]
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            parts = [[c[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for c in (c[o] for c in columns)]
            return pd.DataFrame({"shard": shard[cut[:-1]], **dict(zip(("keys", "classes", "n", "ranks", "ends"), parts, strict=True))})

        def flush() -> Iterator[pd.DataFrame]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            o = np.argsort(columns[0], kind="stable")
            columns = [c[o] for c in columns]
            k = columns[0]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            past = np.arange(len(k)) - np.repeat(first, np.diff(np.r_[first, len(k)])) >= 2
            yield rows_of((k[~past] % np.uint64(shards)).astype(np.int64), [c[~past] for c in columns])
            if past.any():
                slot = -1 - (task * 1_000_003 + flushes)
                yield rows_of(np.full(int(past.sum()), slot, np.int64), [c[past] for c in columns])

        for batch in batches:
            for body in batch["body"]:
                h = shingles(body, p.words)
                if not len(h):
                    continue
                c, _ = class_of(h, seed)
                if c in seen:
                    continue
                seen.add(c)
                if len(frequent):
                    late = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
                    h = np.concatenate([h[~late], h[late] | _TOP])
                m = prefix_length(len(h), p.percent)
                held.append((h[:m], np.full(m, c, np.int64), np.full(m, len(h), np.int32), np.arange(m, dtype=np.int32), np.full(m, h[m - 1], np.uint64)))
                size += m
                if size > FLUSH:
                    yield from flush()
                    size, flushes = 0, flushes + 1
        if held:
            yield from flush()
        _WORDS.clear()

    rows = documents.select(F.coalesce(F.col(text), F.lit("")).alias("body"))
    return rows.mapInPandas(released(run), "shard long, keys binary, classes binary, n binary, ranks binary, ends binary")


def _shared(entries: DataFrame) -> DataFrame:
    """Entries of shingles that at least two classes hold in their prefix: key, class, n, rank, end.

    ``end`` is the prefix' last key with its top bit turned, so that signed order is the global order.
    An entry may come twice when its class comes from several tasks.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["keys"]])
        c = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["classes"]])
        n = np.concatenate([np.frombuffer(b, np.int32) for b in pdf["n"]])
        r = np.concatenate([np.frombuffer(b, np.int32) for b in pdf["ranks"]])
        e = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["ends"]])
        known = pdf["shard"].iloc[0] < 0
        del pdf
        o = np.lexsort((c, k))
        k, c, n, r, e = k[o], c[o], n[o], r[o], e[o]
        new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]  # a class may come from several tasks
        if not known:
            k, c, n, r, e = k[new], c[new], n[new], r[new], e[new]
            same = k[1:] == k[:-1]
            new = np.r_[False, same] | np.r_[same, False]
        return pd.DataFrame({"key": k[new].view(np.int64), "class": c[new], "n": n[new], "rank": r[new], "end": (e[new] ^ _TOP).view(np.int64)})

    return entries.groupBy("shard").applyInPandas(run, "key long, class long, n int, rank int, end long")


def _linked(a: int, b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _side(small: DataFrame) -> DataFrame:
    """A materialized side, broadcast if its counted size allows."""
    return F.broadcast(small) if small.count() <= BROADCAST_KEYS else small


def _sets(documents: DataFrame, classes: DataFrame, wanted: DataFrame, p: JaccardParams, key: str, text: str, seed: int) -> DataFrame:
    """class, hashes of the wanted classes, recomputed from one document of each."""
    side = _side(materialize(wanted.join(classes, "class").select(F.col("rep").alias("_id")).distinct()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(body, p.words) for body in batch["body"]]
            yield pd.DataFrame({"class": pd.Series([class_of(h, seed)[0] for h in sets], dtype="int64"), "hashes": [h.tobytes() for h in sets]})
        _WORDS.clear()

    rows = documents.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    held = rows.join(side, rows["_key"].eqNullSafe(side["_id"])).select("body").mapInPandas(released(run), "class long, hashes binary")
    # A key may stand for several rows: keep one row of each class, and only wanted ones.
    return materialize(held.join(wanted, "class", "left_semi").groupBy("class").agg(F.first("hashes").alias("hashes")))


def _measured(pairs: DataFrame, sets: DataFrame, p: JaccardParams) -> DataFrame:
    """The pairs a, b with their exact distance and whether they are linked, from their whole sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            distance, hit = [], []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                distance.append(1 - common / (len(x) + len(y) - common))
                hit.append(_linked(len(x), len(y), common, p.percent))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "d": distance, "linked": hit})

    wide = pairs.join(sets.select(F.col("class").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("class").alias("b"), F.col("hashes").alias("y")), "b"
    )
    return wide.select("a", "b", "x", "y").mapInPandas(released(run), "a long, b long, d double, linked boolean")


def _may_link(na: int, ka: np.ndarray, ra: np.ndarray, ea: int, nb: int, kb: np.ndarray, rb: np.ndarray, eb: int, percent: int) -> bool:
    """Whether sizes and ordered prefixes leave room for a link.

    Up to v, the nearer end of the two prefixes, all common shingles are known; beyond it at most
    the rest of either set can be common.  Signed order equals the global order shifted by the top
    bit, so keys are compared as unsigned.
    """
    ea, eb = (np.int64(e).view(np.uint64) ^ _TOP for e in (ea, eb))
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    v = min(ea, eb)
    ia, ib = int(np.searchsorted(ka, v, side="right")), int(np.searchsorted(kb, v, side="right"))
    known = len(np.intersect1d(ka[:ia], kb[:ib], assume_unique=True))
    used_a = prefix_length(na, percent) if ea <= eb else (int(ra[ia - 1]) + 1 if ia else 0)
    used_b = prefix_length(nb, percent) if eb <= ea else (int(rb[ib - 1]) + 1 if ib else 0)
    return _linked(na, nb, min(known + min(na - used_a, nb - used_b), na, nb), percent)


def _most(a: str, b: str, percent: int, first: bool) -> Column:
    """Column: at most how many shingles two classes have in common, by their entries in one region.

    ``a`` and ``b`` name entries (class, n, end, cnt, rank, at, m0, m1) of one shingle; ``at`` is an
    entry's place among the ``cnt`` shared ones of its class, ``m0`` and ``m1`` are a bitmap of them:
    an entry whose bit the other side lacks is not in common.  With ``first`` the shingle is taken as
    the first the two have in common, as it is in one region of every linked pair: nothing before it
    is common, so at most what follows it in either set is, and of the prefixes at most the lesser
    number of shared entries from it on; beyond the nearer end at most the rest of that set.
    """
    col = lambda side, c: F.col(f"{side}.{c}")
    rest = lambda side: F.floor((F.lit(percent) * col(side, "n") + 99) / 100) - 1
    nearer = F.when(col(a, "end") < col(b, "end"), rest(a)).when(col(a, "end") > col(b, "end"), rest(b)).otherwise(F.least(rest(a), rest(b)))
    lacks = lambda x, y: sum(F.bit_count(col(x, m).bitwiseAND(F.bitwise_not(col(y, m)))) for m in ("m0", "m1"))
    left = lambda side: col(side, "cnt") - (col(side, "at") if first else F.lit(0))
    known = F.least(left(a), left(b), col(a, "cnt") - lacks(a, b), col(b, "cnt") - lacks(b, a))
    most = F.least(known + nearer, col(a, "n"), col(b, "n"))
    if first:
        most = F.least(most, col(a, "n") - col(a, "rank"), col(b, "n") - col(b, "rank"))
    return most


def _roomy(a: str, b: str, percent: int, first: bool) -> Column:
    """Column: whether sizes, ranks and shared prefix entries leave room for a link."""
    small, large = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    most = _most(a, b, percent, first)
    return (small * 100 >= large * percent) & (most * 100 >= (small + large - most) * percent)


#: What an entry says of its class, in this order.
_ENTRY = ("class", "n", "end", "cnt", "m0", "m1")


def _prefixes(shared: DataFrame) -> DataFrame:
    """class, n, end and its shared prefix keys with ranks, in order."""
    # Unsigned order of the keys is the order of their ranks.
    listed = F.array_sort(F.collect_set(F.struct("rank", "key")))
    return shared.groupBy("class").agg(F.first("n").alias("n"), F.first("end").alias("end"), listed.alias("p")).select(
        "class", "n", "end", F.col("p.key").alias("keys"), F.col("p.rank").alias("ranks")
    )


def _members(prefixes: DataFrame) -> DataFrame:
    """cell (the region's shingle) and e, the entry of a class in it."""
    bits = lambda word: F.aggregate(
        "keys", F.lit(0).cast("long"),
        lambda acc, k: F.when(F.floor(F.pmod(k, F.lit(128)) / 64) == word, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(64)).cast("int")))).otherwise(acc),
    )
    listed = F.arrays_zip("keys", "ranks")
    marked = prefixes.select("class", "n", "end", F.size("keys").alias("cnt"), bits(0).alias("m0"), bits(1).alias("m1"), listed.alias("l"))
    wide = marked.select(*_ENTRY, F.posexplode("l").alias("at", "l"))
    return wide.select(F.col("l.keys").alias("cell"), F.struct(*_ENTRY, F.col("l.ranks").alias("rank"), "at").alias("e"))


def _bounded(pairs: DataFrame, prefixes: DataFrame, p: JaccardParams) -> DataFrame:
    """Pairs a, b that the prefix bound leaves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = [
                _may_link(na, np.asarray(ka, np.int64).view(np.uint64), np.asarray(ra), ea,
                          nb, np.asarray(kb, np.int64).view(np.uint64), np.asarray(rb), eb, p.percent)
                for na, ka, ra, ea, nb, kb, rb, eb in zip(
                    *(batch[c] for c in ("a_n", "a_keys", "a_ranks", "a_end", "b_n", "b_keys", "b_ranks", "b_end")), strict=True
                )
            ]
            yield batch.loc[hit, ["a", "b"]]

    named = lambda s: prefixes.select(F.col("class").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "end", "keys", "ranks")])
    return pairs.join(named("a"), "a").join(named("b"), "b").mapInPandas(released(run), "a long, b long")


# --- regions: pivots, windows, recursion --------------------------------------------------------


def _pivots(cells: DataFrame, large: DataFrame, level: int) -> DataFrame:
    """cell, a: the most central member of each cell; of a large one, of each of its ``k`` lots."""
    lot = F.pmod(F.xxhash64("e.class", F.lit(level)), F.coalesce("k", F.lit(1)))
    dealt = cells.join(_side(large), "cell", "left").select("cell", lot.alias("lot"), "e")
    return dealt.groupBy("cell", "lot").agg(F.max(F.struct((F.col("e.cnt") / F.col("e.n")).alias("central"), "e")).alias("p")).select("cell", F.col("p.e").alias("a"))


def _open_members(cells: DataFrame, pivots: DataFrame, roots: DataFrame, measured: DataFrame, p: JaccardParams) -> DataFrame:
    """cell, size, e, root, w, home: members of cells whose members beside the pivots are not of one component.

    ``w`` holds for each pivot of the cell, in order of their classes, the bounds lo, hi on the
    member's distance; ``home`` is whether one of these distances is r or less.
    """
    r = (100 - p.percent) / 100
    placed = cells.join(roots, F.col("e.class") == F.col("node"), "left").select("cell", "e", F.coalesce("root", "e.class").alias("root"))
    spans = placed.groupBy("cell").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("size"))
    # A pivot has been compared with all: a cell of two, or of one component, has nothing left to compare.
    open_cells = materialize(spans.where("least <> most AND size > 2").select("cell", "size"))
    held = placed.join(open_cells, "cell").join(pivots, "cell")
    exact = measured.select(F.col("a").alias("p_class"), F.col("b").alias("m_class"), "d")
    both = held.join(_side(exact), (F.col("a.class") == F.col("p_class")) & (F.col("e.class") == F.col("m_class")), "left")
    most = _most("a", "e", p.percent, False)
    least = F.lit(1.0) - most / (F.col("a.n") + F.col("e.n") - most)
    itself = F.col("a.class") == F.col("e.class")
    # Pairs not measured are further apart than r.
    lo = F.when(itself, 0.0).otherwise(F.coalesce("d", F.greatest(least, F.lit(r))))
    hi = F.when(itself, 0.0).otherwise(F.coalesce("d", F.lit(1.0)))
    bounds = F.struct(F.col("a.class").alias("pivot"), lo.alias("lo"), hi.alias("hi"))
    return both.groupBy("cell", "e.class").agg(
        F.first("size").alias("size"), F.first("e").alias("e"), F.first("root").alias("root"), F.array_sort(F.collect_list(bounds)).alias("w")
    ).select("cell", "size", "e", "root", F.transform("w", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("w"),
             (F.array_min(F.transform("w", lambda x: x["hi"])) <= r).alias("home"), (F.array_min(F.transform("w", lambda x: x["hi"])) == 0).alias("is_pivot"))


def _window(p: JaccardParams) -> Column:
    """Whether the triangle inequality allows x and y a link at every pivot of their cell."""
    r = (100 - p.percent) / 100 + 1e-9
    apart = lambda u, v: (u["lo"] - v["hi"] > r) | (v["lo"] - u["hi"] > r)
    one = apart(F.col("x.w")[0], F.col("y.w")[0])
    several = F.exists(F.zip_with("x.w", "y.w", apart), lambda far: far)
    return ~F.when(F.size("x.w") == 1, one).otherwise(several)


def _boundary(members: DataFrame, p: JaccardParams) -> DataFrame:
    """Pairs a, b of different components that the windows of their cell leave; each pair in one order.

    Members of the component that most of a cell belongs to are compared with the others only; two
    members without a home are left to the next level where ``again`` says so.  Pivots are done.
    """
    counts = members.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("m"))
    major = counts.groupBy("cell").agg(F.max(F.struct("m", "root")).alias("most")).select("cell", F.col("most.root").alias("major"))
    full = members.where("NOT is_pivot").join(major, "cell").select("cell", "major", F.struct("e", "root", "w", "home", "again").alias("m"))
    x = full.where("m.root <> major").select("cell", "major", F.col("m").alias("x"))
    y = full.select("cell", F.col("m").alias("y"))
    different = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("major")) | (F.col("x.e.class") < F.col("y.e.class")))
    later = F.col("x.again") & ~F.col("x.home") & ~F.col("y.home")
    met = x.join(y, "cell").where(different & ~later & _roomy("x.e", "y.e", p.percent, True) & _window(p))
    return met.select(F.least("x.e.class", "y.e.class").alias("a"), F.greatest("x.e.class", "y.e.class").alias("b")).distinct()


def links(documents: DataFrame, p: JaccardParams = JaccardParams(), key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n, class; links between classes: a, b) - links enough to connect every component."""
    rows, edges, _, _ = _join(documents, p, key, text)
    return rows, edges


def _scanned(documents: DataFrame, p: JaccardParams, key: str, text: str) -> tuple[DataFrame, int]:
    """``_scan`` with the first seed under which no two sets share a name."""
    seed = 0
    while True:
        scanned = materialize(_scan(documents, p, key, text, seed))
        sets = scanned.where("kind = 0").groupBy("class").agg(F.min("check").alias("least"), F.max("check").alias("most"))
        if sets.where("least <> most").isEmpty():
            return scanned, seed
        seed += 1


def _most_frequent(counted: DataFrame, room: int, total: int) -> np.ndarray:
    """At most ``room`` keys of (class, n), those of the greatest n; no count is split by the bound."""
    least = total // HEAVY_KEYS + 8
    # Counts add up to ``total`` at most, so few are above the level where all are counted together.
    levels = counted.groupBy(F.least(F.col("n"), F.lit(least)).alias("n")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.col("n").desc()).collect()
    for level in levels:  # at most total / HEAVY_KEYS + 1 rows
        if level["m"] > room:
            break
        least, room = level["n"], room - level["m"]
    return counted.where(F.col("n") >= least).select("class").toPandas()["class"].to_numpy(np.int64).view(np.uint64)


def _regions(documents: DataFrame, scanned: DataFrame, p: JaccardParams, text: str, seed: int) -> DataFrame:
    """The shared prefix entries, formed anew while a shingle not yet put last is in too many prefixes."""
    total = scanned.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    counted = scanned.where("kind = 1").groupBy("class").agg(F.sum("n").alias("n")).where("n >= 8")
    heavy = np.sort(_most_frequent(counted, HEAVY_KEYS, total))
    shards = max(64, -(-total * (100 - p.percent) // 100 // SHARD_ENTRIES))
    for _ in range(ANEW):
        entries = materialize(_shared(_entries(documents, p, text, heavy, shards, seed)))
        sweep(documents.sparkSession)  # the entries as they were exchanged
        # Keys put last have their top bit set, and so are negative here.
        sizes = entries.where("key >= 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OVERSIZE)
        more = _most_frequent(sizes.select(F.col("key").alias("class"), "n"), HEAVY_KEYS - len(heavy), total)
        if not len(more):
            break
        heavy = np.union1d(heavy, more)
    return entries


def _join(documents: DataFrame, p: JaccardParams, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows, links, node and root of the components, and the seed of the classes' names."""
    ship(documents.sparkSession)
    scanned, seed = _scanned(documents, p, key, text)
    rows = scanned.where("kind = 0").select("doc_id", "n", "class")
    classes = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"))
    prefixes = settled(_prefixes(_regions(documents, scanned, p, text, seed)))
    cells = settled(_members(prefixes))

    def measured(pairs: DataFrame) -> DataFrame:
        left = materialize(_bounded(pairs, prefixes, p))
        wanted = materialize(left.select(F.explode(F.array("a", "b")).alias("class")).distinct())
        return settled(_measured(left, _sets(documents, classes, wanted, p, key, text, seed), p))

    edges, boundary, level = None, None, 0
    while True:
        large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REGION)
        large = materialize(large.select("cell", F.least(F.ceil(F.col("n") / REGION), F.lit(PIVOTS)).alias("k")))
        pivots = materialize(_pivots(cells, large, level))
        star = cells.join(pivots, "cell").where(F.col("a.class") != F.col("e.class")).where(_roomy("a", "e", p.percent, False))
        found = measured(materialize(star.select(F.col("a.class").alias("a"), F.col("e.class").alias("b")).distinct()))
        linked = found.where("linked").select("a", "b")
        edges = linked if edges is None else edges.unionByName(linked)
        roots = components(linked) if level == 0 else joined(roots, linked)
        members = _open_members(cells, pivots, roots, found, p)
        # A cell goes on to the next level if it is large and its pivots took a quarter of it in.
        kept = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("int")).alias("taken"))
        on = F.col("n") - F.col("taken") > REGION
        going = materialize(kept.where(on & (F.col("taken") * 4 > F.col("n"))).select(F.col("cell").alias("going")))
        members = settled(members.join(_side(going), F.col("cell") == F.col("going"), "left").withColumn("again", F.col("going").isNotNull()).drop("going"))
        pairs = _boundary(members, p)
        boundary = pairs if boundary is None else boundary.unionByName(pairs)
        cells = settled(members.where("again AND NOT home").select("cell", "e"))
        level += 1
        if cells.isEmpty():
            break
    pairs = settled(boundary.distinct())
    if not pairs.isEmpty():
        linked = measured(pairs).where("linked").select("a", "b")
        edges, roots = edges.unionByName(linked), joined(roots, linked)
    return rows, edges, roots, seed


def rows_of_components(documents: DataFrame, p: JaccardParams = JaccardParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest key of all documents reachable by links), class, keeper, seed.

    ``keeper`` is the component's least class of those that hold its smallest key; null without shingles.
    Two components may have the same key, or none, but not the same keeper.  ``seed`` is the same in
    all rows: ``with_class`` names classes alike under it.
    """
    rows, _, roots, seed = _join(documents, p, key, text)
    classes = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots, F.col("class") == F.col("node"), "left").select(
        "class", "least", F.coalesce("root", "class").alias("root")
    )
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "class")).alias("f")
    named = materialize(rooted.groupBy("root").agg(first).select("root", F.col("f.least").alias("component_id"), F.col("f.class").alias("keeper")))
    of_class = materialize(rooted.select("class", "root").join(named, "root").select("class", "component_id", "keeper"))
    return rows.join(of_class, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class", "keeper", F.lit(seed).alias("seed"),
    )


def join_components(documents: DataFrame, p: JaccardParams = JaccardParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest key of all documents reachable by links), class."""
    return rows_of_components(documents, p, key, text).drop("keeper", "seed")


def with_class(documents: DataFrame, name: str, p: JaccardParams = JaccardParams(), text: str = "text", seed: int = 0) -> DataFrame:
    """The documents and, as ``name``, the class of each one's text."""
    ship(documents.sparkSession)

    @F.pandas_udf("long")
    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series([class_of(shingles(body, p.words), seed)[0] for body in bodies], dtype="int64")

    return documents.withColumn(name, run(F.coalesce(F.col(text), F.lit(""))))
