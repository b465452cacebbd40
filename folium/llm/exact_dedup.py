"""Exact deduplication against immutable snapshots, screened by static binary-fuse filters.

A snapshot is a stored table of digest groups that never changes once written (``write_snapshot``).
Its digests are dealt to hash buckets and each bucket gets one binary-fuse filter (8-bit fingerprints,
about 9 bits a key), stored beside it; later batches read both and hash nothing of the snapshot again.
An incoming batch is first grouped by itself, so its own duplicates never touch a snapshot; one
digest of each group is screened.  Negatives are certainly new.  Positives join the exact bucket
of the snapshot and the texts of the two representatives are compared byte by byte.

Digest: SHA-256 of the UTF-8 text.  Screening key: its first 8 bytes.

Skew: groups are formed by partial aggregation, filters see distinct digests only, a filter bucket that
meets more incoming digests than it holds is met by several copies of its filter, and rows meet
their group in a plain equi-join that adaptive execution may split; no window or collected group.

Cases: null text counts as empty; rows repeated with the same key and text are one group of which a
single row stays; the key may be null (it then loses to any other); an empty batch or snapshot is
fine; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folium.session import materialize, shared_folder, ship

#: Digests a filter bucket is meant to hold; buckets are as many as the snapshot needs.
BUCKET_KEYS = 20_000
#: Rows below which the representatives to compare are broadcast (16 bytes each); beyond, a shuffle join.
BROADCAST_REPS = 500_000


# --- binary-fuse filter -------------------------------------------------------------------------


def _mix64(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (murmur3 constants) of key + seed."""
    h = keys + np.uint64(seed)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass(frozen=True)
class FuseFilter:
    """Three-segment binary-fuse filter over a fixed set of 64-bit keys."""

    seed: int
    segment_length: int
    segment_count: int
    table: bytes

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _slots(h, self.segment_length, self.segment_count)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not self.table:
            return np.zeros(len(keys), bool)
        h = _mix64(keys, self.seed)
        slots, print8 = self._slots(h)
        t = np.frombuffer(self.table, np.uint8)
        return (t[slots[0]] ^ t[slots[1]] ^ t[slots[2]]) == print8


def _slots(h: np.ndarray, length: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in consecutive segments, and the 8-bit fingerprint."""
    window = (h >> np.uint64(32)) % np.uint64(count * length)
    at = window.astype(np.int64)
    mask = length - 1
    second = at + length
    third = at + 2 * length
    second ^= ((h >> np.uint64(18)).astype(np.int64)) & mask
    third ^= h.astype(np.int64) & mask
    return np.stack([at, second, third]), ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> FuseFilter:
    """Construct by peeling in rounds: every slot held by one key releases that key.

    All slots of degree one are taken at once, so a round is a few numpy passes; a seed whose
    graph does not peel is replaced.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if n == 0:
        return FuseFilter(0, 4, 1, b"")
    length = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) if n > 1 else 4.0
    count = max(1, int(np.ceil(n * factor / length)) - 2)
    size = (count + 2) * length
    for attempt in range(1, 1000):
        seed = (attempt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        slots, prints = _slots(_mix64(keys, seed), length, count)
        degree = np.bincount(slots.ravel(), minlength=size)
        ids = np.zeros(size, np.int64)  # xor of the keys (by position) in a slot
        for row in slots:
            np.bitwise_xor.at(ids, row, np.arange(n))
        alive, rounds = np.ones(n, bool), []
        while True:
            single = np.flatnonzero(degree == 1)
            if not len(single):
                break
            owner = ids[single]
            owner, first = np.unique(owner, return_index=True)  # a key may be alone in two slots
            place = single[first]
            rounds.append((owner, place))
            alive[owner] = False
            for row in slots[:, owner]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(ids, row, owner)
        if alive.any():
            if attempt % 10 == 0:  # graphs of few keys may need more room
                count += 1
                size = (count + 2) * length
            continue
        table = np.zeros(size, np.uint8)
        for owner, place in reversed(rounds):
            three = slots[:, owner]
            table[place] = 0
            table[place] = prints[owner] ^ table[three[0]] ^ table[three[1]] ^ table[three[2]]
        return FuseFilter(seed, length, count, table.tobytes())
    raise RuntimeError("no binary-fuse filter found")


# --- tables -------------------------------------------------------------------------------------

def digest_rows(documents: DataFrame, part: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, part, row (tells repeated rows apart), digest (binary), length in bytes; written once."""
    body = F.coalesce(F.col(text), F.lit(""))
    return materialize(
        documents.select(
            F.col(key).alias("doc_id"),
            F.col(part).alias("part"),
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(body, 256)).alias("digest"),
            F.octet_length(body).cast("long").alias("length"),
        )
    )


def group_rows(rows: DataFrame) -> DataFrame:
    """One row per part and digest: how many, and the row that stays (largest key, then first row)."""
    best = F.max(F.struct(F.col("doc_id"), (-F.col("row")).alias("back")))
    return (
        rows.groupBy("part", "digest")
        .agg(F.count(F.lit(1)).alias("n_rows"), best.alias("best"), F.max("length").alias("length"))
        .select("part", "digest", "n_rows", F.col("best.doc_id").alias("keep_id"), (-F.col("best.back")).alias("keep_row"), "length")
    )


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    key = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    return groups.withColumn("screen", key).withColumn("bucket", F.pmod(F.xxhash64("screen"), F.lit(buckets)).cast("int"))


def build_snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """bucket, seed, segment_length, segment_count, bits: one filter row per bucket."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = build_filter(pdf["screen"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame(
            {"bucket": [pdf["bucket"].iloc[0]], "seed": [np.uint64(f.seed).view(np.int64)], "segment_length": [f.segment_length],
             "segment_count": [f.segment_count], "bits": [f.table]}
        )

    return (
        _bucketed(groups, buckets).select("bucket", "screen").groupBy("bucket")
        .applyInPandas(build, "bucket int, seed long, segment_length int, segment_count int, bits binary")
    )


@dataclass(frozen=True)
class Snapshot:
    """A stored snapshot: its groups with their buckets, the filter of each bucket, and the texts it was made of."""

    groups: DataFrame
    filters: DataFrame
    buckets: int
    documents: DataFrame


def store_snapshot(groups: DataFrame, path: str) -> None:
    """Write groups (see ``group_rows``) and their filters below ``path``, which must not exist."""
    buckets = max(1, -(-groups.count() // BUCKET_KEYS))
    _bucketed(groups, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/groups")
    stored = groups.sparkSession.read.parquet(f"{path}/groups")
    build_snapshot_filters(stored, buckets).write.parquet(f"{path}/filters")


def open_snapshot(path: str, documents: DataFrame) -> Snapshot:
    """A stored snapshot; ``documents`` is the table it was made of, read for byte checks only."""
    spark = documents.sparkSession
    groups = spark.read.parquet(f"{path}/groups")
    first = groups.select("buckets").first()
    return Snapshot(groups, spark.read.parquet(f"{path}/filters"), first["buckets"] if first else 1, documents)


def write_snapshot(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> Snapshot:
    """Make a snapshot of a table and store it below ``path``."""
    ship(documents.sparkSession)
    rows = digest_rows(documents.withColumns({"part": F.lit(1)}), "part", key, text)
    store_snapshot(group_rows(rows), path)
    return open_snapshot(path, documents)


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Incoming digest groups plus ``maybe_known``; filters and digests meet by bucket and lot.

    A bucket's incoming digests are dealt to lots of about ``BUCKET_KEYS``, each with its copy of the filter.
    """

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(left), bool)
        if len(right) and len(left):
            r = right.iloc[0]
            f = FuseFilter(int(np.int64(r["seed"]).view(np.uint64)), int(r["segment_length"]), int(r["segment_count"]), r["bits"])
            hit = f.contains(left["screen"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"digest": left["digest"], "maybe_known": hit})

    lots = max(1, -(-incoming.count() // (buckets * BUCKET_KEYS)))
    keyed = _bucketed(incoming, buckets).select("bucket", F.pmod(F.hash("digest"), F.lit(lots)).alias("lot"), "screen", "digest")
    copies = filters.select("*", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
    return keyed.groupBy("bucket", "lot").cogroup(copies.groupBy("bucket", "lot")).applyInPandas(probe, "digest binary, maybe_known boolean")


def same_bytes(left: DataFrame, right: DataFrame, pairs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """digest of the pairs whose two representatives, one of each table, hold the same bytes.

    ``pairs``: digest, left_id, right_id.  Only representatives' texts are moved.
    """
    def held(documents: DataFrame, name: str) -> DataFrame:
        wanted = pairs.select("digest", F.col(name).alias("id"))
        body = F.coalesce(F.col(text), F.lit("")).cast("binary")
        texts = documents.select(F.col(key).alias("key"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("sha"))
        side = F.broadcast(wanted) if small else wanted
        return texts.join(side, texts["key"].eqNullSafe(side["id"]) & (texts["sha"] == side["digest"])).select("digest", "body")

    small = pairs.count() <= BROADCAST_REPS
    return (
        held(left, "left_id").unionByName(held(right, "right_id")).groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most"))
        .where(F.col("least") == F.col("most")).select("digest")
    )


def known_digests(groups: DataFrame, documents: DataFrame, snapshot: Snapshot, key: str = "doc_id", text: str = "text") -> DataFrame:
    """digest of those groups of ``documents`` whose text the snapshot holds: screened, joined, compared."""
    maybe = screen(groups.select("digest").distinct(), snapshot.filters, snapshot.buckets).where("maybe_known").select("digest")
    exact = (
        maybe.join(groups.groupBy("digest").agg(F.max("keep_id").alias("left_id")), "digest")
        .join(snapshot.groups.select("digest", F.col("keep_id").alias("right_id")), "digest")
    )
    return same_bytes(documents, snapshot.documents, materialize(exact), key, text)


def _settled_groups(groups: DataFrame, known: DataFrame) -> DataFrame:
    """Groups of all parts, those of one known text merged: digest, group_size, keep_id, keep_part, keep_row, known."""
    best = F.max(F.struct(F.col("keep_id"), (-F.col("part")).alias("part"), (-F.col("keep_row")).alias("back")))
    # Only groups of several parts are merged; the others are final as their own part formed them.
    merged = (
        groups.join(known, "digest", "left_semi").groupBy("digest")
        .agg(F.sum("n_rows").alias("group_size"), best.alias("best"))
        .select("digest", "group_size", F.col("best.keep_id").alias("keep_id"), (-F.col("best.part")).alias("keep_part"),
                (-F.col("best.back")).alias("keep_row"), F.lit(True).alias("known"))
    )
    alone = groups.join(known, "digest", "left_anti").select(
        "digest", F.col("n_rows").alias("group_size"), "keep_id", F.col("part").alias("keep_part"), "keep_row", F.lit(False).alias("known")
    )
    return materialize(merged.unionByName(alone))


def _told(rows: DataFrame, final: DataFrame) -> DataFrame:
    return rows.join(final, "digest").select(
        "doc_id", "row", "part", "digest", "length", "keep_id", "group_size",
        ((F.col("row") == F.col("keep_row")) & (F.col("part") == F.col("keep_part"))).alias("kept"), "known",
    )


def dedup_against(incoming: DataFrame, snapshots: list, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of a new batch (part 0), against earlier snapshots; columns as of ``dedup``.

    A snapshot is a ``Snapshot``, or a table, which is stored as one first.  Group sizes and the row that
    stays are over the batch and all snapshots; what a snapshot stored is not hashed again.
    """
    spark = incoming.sparkSession
    ship(spark)
    folder = shared_folder(spark)
    stored = [x if isinstance(x, Snapshot) else write_snapshot(x, f"{folder}/{i}", key, text) for i, x in enumerate(snapshots)]
    rows = digest_rows(incoming.withColumns({"part": F.lit(0)}), "part", key, text)
    own = materialize(group_rows(rows))
    groups, known = own, own.select("digest").limit(0)
    for at, snapshot in enumerate(stored, 1):
        found = materialize(known_digests(own, incoming, snapshot, key, text))
        known = known.unionByName(found)
        there = snapshot.groups.join(found, "digest", "left_semi").withColumn("part", F.lit(at)).select(*own.columns)
        groups = groups.unionByName(there)
    return _told(rows, _settled_groups(groups, materialize(known.distinct())))


def dedup(documents: DataFrame, part: str, parts: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of all parts with the group it belongs to.

    ``part`` is 0 for the incoming batch and 1, 2, ... for ever older snapshots, each of which is stored
    and read back to be met by what came after it.  Returns doc_id, row, part, digest, length, keep_id,
    group_size, kept, known (the text is in several parts).
    """
    spark = documents.sparkSession
    ship(spark)
    folder = shared_folder(spark)
    rows = digest_rows(documents, part, key, text)
    groups = materialize(group_rows(rows))
    known = groups.select("digest").limit(0)
    for at in range(parts - 1, 0, -1):
        store_snapshot(groups.where(F.col("part") == at), f"{folder}/{at}")
        newer = groups.where(F.col("part") < at)
        known = known.unionByName(known_digests(newer, documents, open_snapshot(f"{folder}/{at}", documents), key, text))
    return _told(rows, _settled_groups(groups, materialize(known.distinct())))
