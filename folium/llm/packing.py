"""Best-fit packing of tokenised documents, planned over a histogram of lengths.

A document is its token ids plus one end id.  Documents longer than a sequence are cut from the
back into full sequences, so only the first piece may be shorter.  What is planned is not the
pieces but the counts of each length: at most ``capacity`` numbers reach the driver, best-fit
decreasing runs over whole runs of equal lengths, and the plan (a few rows a length, whatever the
input) is broadcast.  A piece then takes the slot that equals its rank among pieces of its length.

Rank without a hot task: a length with n pieces is dealt to about sqrt(n) hash buckets; bucket
counts are prefix-summed and pieces are ranked inside their bucket.

Cases: null text counts as empty (a single end id); the key may be null or repeated (pieces are
told apart by a row number); an empty table gives no sequences; other columns are ignored.  Texts
that hold a special token's string are ordinary text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from folium.session import materialize, released, ship

#: Words whose ids a Python worker remembers at most; the memo is then begun anew.
MEMO_WORDS = 300_000
PIECE_SCHEMA = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids of byte-level BPE by memoised words.

    The pre-tokeniser never joins characters across a single space that stands between two
    non-space characters, so ``" word"`` can be encoded once and reused.  Words that start or end
    with other white space, or are empty (runs of spaces), send the whole text to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.full_stop = self._ids(".")
        self.comma = self._ids(",")
        # Bytes as the characters byte-level vocabularies are written in: printable ones stand
        # for themselves, the others for code points from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.as_char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.latin = str.maketrans({b: c for b, c in self.as_char.items()})
        self.memo: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a space and a word of letters; anything else goes through the whole pipeline."""
        tail = b""
        letters = word
        if word[-1] == "." or word[-1] == ",":
            letters = word[:-1]
            tail = self.full_stop if word[-1] == "." else self.comma
        if letters.isalpha():
            if letters.isascii():
                mapped = "Ġ" + letters
            else:
                mapped = (" " + letters).encode("utf-8").decode("latin-1").translate(self.latin)
            return np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes() + tail
        return self._ids(" " + word)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        words = text.split(" ")
        if len(words) < 3:
            return self._ids(text)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out = [self._ids(words[0])]
        if not words[0] or words[0][-1].isspace():
            return self._ids(text)
        for word in words[1:]:
            ids = memo.get(word)
            if ids is None:
                if not word or word[0].isspace() or word[-1].isspace():
                    return self._ids(text)
                ids = memo[word] = self._word(word)
            out.append(ids)
        return b"".join(out)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones at the end, a shorter one in front."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    starts = ([0] if head else []) + list(range(head, length, capacity))
    return [(s, head if head and s == 0 else capacity) for s in starts]


def tokenize_pieces(
    documents: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, key: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """One row per piece; with ``keep_ids`` also its token ids."""
    ship(documents.sparkSession)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, row, body in zip(batch["doc_id"], batch["row"], batch["body"], strict=True):
                ids = encode(body) + end
                for number, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, row, number, start, length, zlib.crc32(part), part))
            out = pd.DataFrame(rows, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            if keep_ids:
                out["ids"] = [np.frombuffer(b, "<u4").astype(np.int32) for b in out["ids"]]
            yield out if keep_ids else out.drop(columns="ids")

    rows = documents.select(
        F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body")
    )
    return rows.mapInPandas(released(pieces), PIECE_SCHEMA + (", ids array<int>" if keep_ids else ""))


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Bins that look alike are one class: (free space, first sequence, how many).  A run of n equal
    lengths fills the fullest class that has room, as best-fit would one by one: a bin takes as
    many as fit before the next bin is touched.  Returns rows (length, first rank, last rank + 1,
    first sequence, pieces per sequence, offset of the first of them).
    """
    import bisect

    free: dict[int, list[tuple[int, int]]] = {}  # free space -> runs of sequences (first, how many)
    spaces: list[int] = []
    plan = []
    sequences = 0

    def give_back(space: int, first: int, many: int) -> None:
        if many and space:
            if space not in free:
                bisect.insort(spaces, space)
                free[space] = []
            free[space].append((first, many))

    def fill(length: int, rank: int, n: int, space: int, first: int, many: int) -> tuple[int, int]:
        """Put up to n pieces into a run of like sequences; returns the next rank and what is left of n."""
        each = space // length
        whole = min(many, n // each)
        offset = capacity - space
        if whole:
            plan.append((length, rank, rank + whole * each, first, each, offset))
            rank, n = rank + whole * each, n - whole * each
            give_back(space - each * length, first, whole)
        if n and whole < many:
            plan.append((length, rank, rank + n, first + whole, n, offset))
            give_back(space - n * length, first + whole, 1)
            rank, n, whole = rank + n, 0, whole + 1
        give_back(space, first + whole, many - whole)
        return rank, n

    for length in sorted(histogram, reverse=True):
        rank, n = 0, histogram[length]
        while n:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                break
            space = spaces[at]
            runs = free[space]
            first, many = runs.pop()
            if not runs:
                del free[space]
                spaces.pop(at)
            rank, n = fill(length, rank, n, space, first, many)
        if n:
            many = -(-n // (capacity // length))
            fill(length, rank, n, capacity, sequences, many)
            sequences += many
    return plan


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Pieces (see ``tokenize_pieces``) plus sequence_id and offset.

    The histogram collected has at most ``capacity`` rows; the plan broadcast is a function of it
    alone and stays within a few rows per length and class of sequences.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(histogram, capacity)
    slots = spark.createDataFrame(
        plan or [(0, 0, 0, 0, 1, 0)], "p_length long, first_rank long, last_rank long, first_sequence long, each long, first_offset long"
    )
    buckets = F.array(*[F.lit(max(1, int(histogram.get(n, 0) ** 0.5))) for n in range(1, capacity + 1)])
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "row"), F.element_at(buckets, F.col("length").cast("int"))).cast("int")
    dealt = pieces.withColumn("bucket", bucket)
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("m"))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("m").over(ahead), F.lit(0))).drop("m")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row")
    ranked = (
        dealt.withColumn("place", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("place"))
    )
    s = F.broadcast(slots)
    step = F.col("rank") - F.col("first_rank")
    return ranked.join(
        s, (ranked["length"] == s["p_length"]) & (ranked["rank"] >= s["first_rank"]) & (ranked["rank"] < s["last_rank"])
    ).select(
        *[c for c in pieces.columns],
        (F.col("first_sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (step % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from pieces packed with ``keep_ids``: ids, and where each document starts."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"])).alias("parts"),
    )
