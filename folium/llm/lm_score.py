"""Language-model scoring by logistic context mixing, with counts of the whole corpus behind it.

A text is its tokens: words with A-Z lowered, split at ASCII white space, then one end.  A token is
coded in binary decisions, each predicted from counts hashed by contexts:

1. Hit or miss.  The context is the two tokens before.  Every training token is counted under its
   context (the hash of a context has as many bits as the corpus needs, so this table grows with it),
   and the decision is whether the token is the context's most frequent successor.  Three predictors
   (how often and how surely the successor came; how many hits stand before this one; both) give
   logits that are mixed by weights gated by the run of hits, learned online, and refined by an
   adaptive map.  A document is scored as if it had not been counted itself, so a text that occurs
   twice is told from one that occurs once.
2. A miss, or a token after an unknown context, is coded by itself.  Its bytes (and the space that ends
   it) are predicted bit by bit by tables hashed by the byte's position and the last 1, 2, 3, 4 and 6
   bytes of the word, mixed by gated weights and refined; distinct training tokens teach these tables,
   whose job is tokens not seen before.  Expert (l, u) starts from  P(w) = l * c(w)/N + (1 - l) * P_mix(w)
   and adapts as it reads: after t tokens, n of them w, it gives w the probability (u * P(w) + n) / (u + t),
   a Polya urn, whose product over the document has a closed form.  The Bayesian mixture of the experts
   is the same as weighing them online by how well each has done so far.

``score`` is the sum in log10, ``bits_per_byte`` and ``bits_per_token`` are the same total in bits.

Why decisions on tokens carry the contexts across words: a bit of a byte would need 8 counts for each
byte and predictor in tables that grow with the corpus, dozens of bytes shuffled for each byte read;
a token needs one.

Flow: stretches of documents reduce their tokens and contexts to sorted lists; lists meet by a hash of
the token and by ranges of context hashes (shards), once; what a stretch asked for travels back.  Counts
are whole numbers and mixers learn from them in a fixed order, so results do not depend on partitions.

Sizes: byte tables are fixed (``SLOTS``) and broadcast; all other counts stay with their shards.  Skew:
a stretch sends each token and context once, so a word in every document weighs as much as there are
stretches; a stretch is bounded in bytes.

Cases: null text counts as empty (its one token is the end); repeated rows are scored alike; a null
key counts as the text '' when rows are held out; no training rows give zero counts and probability
2^-bits of an untrained model; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from folium.session import materialize, released, ship, sweep

#: Text bytes of a stretch, its documents at most, and text bytes whose lists a shard is meant to get.
STRETCH_BYTES, STRETCH_DOCS, SHARD_BYTES = 6_000_000, 4_000, 8_000_000
#: Bits of a context's hash beyond those that number the contexts; levels of a hit-or-miss decision's cell.
SPARE_BITS = 10
SEEN, SURE, RUN = 6, 8, 8
CELLS = SEEN * SURE * RUN * 2
#: log2 of slots per context table; contexts: bytes of history each predictor hashes (0: position only).
SLOT_BITS = 19
SLOTS = 1 << SLOT_BITS
ORDERS = (0, 1, 2, 3, 4, 6)
GATES = 8 * 7
STEPS = 24  # quantised logits of the refinement
LAMBDAS = (0.1, 0.5, 0.8, 0.92, 0.98)
#: How strongly a document's own tokens so far sway the next one (Polya urn; None: not at all).
URNS = (None, 3000.0, 300.0)
#: Bits mixed at once, so that a shard's memory does not follow its size.
WORDS_AT_ONCE = 20_000
LONGEST = 64  # bytes of a token that keep their own context; longer tokens are coded in such pieces


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(key: str, folds: int = 7, remainder: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds)) == remainder


def shard_of(token: bytes, shards: int) -> int:
    return zlib.crc32(token) % shards


def _pack(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _unpack(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(x))


def _planes(x: np.ndarray) -> bytes:
    """An array of whole numbers, packed byte place by byte place: high places are mostly zero."""
    return _pack(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b"")


def _unplaned(blob: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(_unpack(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


# --- contexts -----------------------------------------------------------------------------------


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    """48-bit hashes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)) >> np.uint64(16)


def contexts_of(ids: np.ndarray, first: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token: the hash of the two tokens before it, in ``bits`` bits, and its own 16-bit print.

    ``first`` is where documents begin; places before a document count as two tokens of their own.
    """
    own = hashes[ids]
    one, two = np.empty_like(own), np.empty_like(own)
    one[1:], two[2:] = own[:-1], own[:-2]
    one[first], two[first] = np.uint64(1), np.uint64(2)
    second = first + 1
    second = second[second < len(ids)]
    second = second[~np.isin(second, first)]
    two[second] = np.uint64(1)
    h = one * np.uint64(0x9E3779B97F4A7C15) + ((two << np.uint64(23)) | (two >> np.uint64(41)))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h >> np.uint64(64 - bits), (own >> np.uint64(32)).astype(np.uint16)


def _counted(q: np.ndarray, f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, print) in order, with the sum of their n."""
    if not len(q):
        return q, f, n
    if int(q.max()) >> 48:
        o = np.lexsort((f, q))
    else:  # both in one word
        o = np.argsort((q << np.uint64(16)) | f)
    q, f, n = q[o], f[o], n[o]
    at = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (f[1:] != f[:-1])])
    return q[at], f[at], np.add.reduceat(n, at)


def successors(q: np.ndarray, f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of counted (context, print) in order: contexts, totals, and the two most frequent prints with their counts.

    The smaller print goes first among equals; a missing second has count 0.
    """
    if not len(q):
        return q, n, f, n, f, n
    at = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    size = np.diff(np.r_[at, len(q)])
    q_of, total, f1, n1 = q[at], np.add.reduceat(n, at), f[at].copy(), n[at].copy()
    f2, n2 = f1.copy(), np.zeros_like(n1)
    several = np.flatnonzero(size > 1)
    if len(several):  # most contexts have one successor
        inside = np.repeat(size > 1, size)
        group = np.repeat(np.arange(len(several)), size[several])
        f, n = f[inside], n[inside]
        o = np.lexsort((f, -n, group))
        f, n = f[o], n[o]
        first = np.cumsum(size[several]) - size[several]
        f1[several], n1[several], f2[several], n2[several] = f[first], n[first], f[first + 1], n[first + 1]
    return q_of, total, f1, n1, f2, n2


# --- stage 1: stretches -------------------------------------------------------------------------


def _stretches(documents: DataFrame, shards: int, bits: int, key: str, text: str) -> DataFrame:
    """Rows (slot, stretch, tokens, counts, contexts) for each shard, and (-1 - stretch, ..., documents).

    Tokens of a shard are joined by newlines in the order in which the stretch numbers them; contexts
    are the distinct (context, print) of the shard's range with their training counts; the documents of
    a stretch are kept as sequences over that numbering.
    """
    from pyspark import TaskContext

    width = -(-(1 << bits) // shards)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        number = 0
        ids: list = []
        outs: list = []
        sizes: list[int] = []
        docs: list[list[bytes]] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal number, size
            vocabulary = sorted(set(chain.from_iterable(docs)))
            by_shard: list[list[bytes]] = [[] for _ in range(shards)]
            for t in vocabulary:
                by_shard[zlib.crc32(t) % shards].append(t)
            numbered = list(chain.from_iterable(by_shard))
            place = {t: i for i, t in enumerate(numbered)}
            lengths = np.fromiter(map(len, docs), np.int64, len(docs))
            sequence = np.fromiter(map(place.__getitem__, chain.from_iterable(docs)), np.uint32, lengths.sum())
            first = np.cumsum(lengths) - lengths
            trained = np.repeat(~np.array(outs, bool), lengths)
            counts = np.bincount(sequence[trained], minlength=len(numbered)).astype(np.uint32)
            q, f = contexts_of(sequence, first, token_hashes(numbered), bits)
            q, f, n = _counted(q, f, trained.astype(np.uint32))
            cut = np.searchsorted(q, np.arange(shards + 1, dtype=np.uint64) * np.uint64(width))
            stretch = (task << 31) | number
            number += 1
            rows, at = [], 0
            for s, tokens in enumerate(by_shard):
                a, b = cut[s], cut[s + 1]
                if tokens or b > a:
                    own = counts[at : at + len(tokens)]
                    at += len(tokens)
                    steps = np.diff(q[a:b], prepend=np.uint64(0)) if b > a else q[a:b]
                    asked = b"".join(_framed(_planes(x)) for x in (steps, f[a:b], n[a:b].astype(np.uint32)))
                    rows.append((s, stretch, _pack(b"\n".join(tokens)), _planes(own), asked, len(tokens)))
            keys = np.array([k if k is not None else 0 for k in ids], np.int64)
            bundle = b"".join(_framed(x) for x in (
                _planes(keys), _planes(np.array([k is None for k in ids], np.uint8)), _planes(np.array(outs, np.uint8)),
                _planes(np.array(sizes, np.int64)), _planes(lengths), _planes(sequence),
            ))
            rows.append((-1 - stretch, stretch, None, None, bundle, 0))
            for held in (ids, outs, sizes, docs):
                held.clear()
            size = 0
            return pd.DataFrame(rows, columns=["slot", "stretch", "tokens", "counts", "asked", "n"])

        for batch in batches:
            for doc_id, out, body in zip(batch["doc_id"], batch["held_out"], batch["body"], strict=True):
                words = tokens_of(body)
                words.append(b"")  # the end: no word is empty
                docs.append(words)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                outs.append(bool(out))
                sizes.append(len(body.encode("utf-8", "surrogatepass")))
                size += sizes[-1]
                if size >= STRETCH_BYTES or len(docs) >= STRETCH_DOCS:
                    yield flush()
        if docs:
            yield flush()

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return rows.mapInPandas(released(run), "slot long, stretch long, tokens binary, counts binary, asked binary, n long")


def _framed(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + x


def _frames(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


# --- stage 2: shards ----------------------------------------------------------------------------


def _gathered(lists: DataFrame) -> DataFrame:
    """One exchange of all lists by shard.

    kind 0: a stretch's documents, passed on.  kind 1: for a stretch and shard, which of the shard's
    tokens it asked for (a) and what is known of its contexts (b).  kind 2: a shard's tokens (a) with
    their training counts (b; 0 for tokens of held-out documents only), n_distinct and n_all.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        slot = int(pdf["slot"].iloc[0])
        if slot < 0:
            return pd.DataFrame({"kind": 0, "stretch": pdf["stretch"], "shard": -1, "a": pdf["asked"], "b": None, "n_distinct": 0, "n_all": 0})
        pdf = pdf.sort_values("stretch")
        lists = [_unpack(blob).split(b"\n") if n else [] for blob, n in zip(pdf["tokens"], pdf["n"], strict=True)]
        total: dict[bytes, int] = {}
        for tokens, blob in zip(lists, pdf["counts"], strict=True):
            for t, c in zip(tokens, _unplaned(blob, "<u4").tolist(), strict=True):
                total[t] = total.get(t, 0) + c
        tokens = sorted(total)
        place = {t: i for i, t in enumerate(tokens)}
        counts = np.fromiter(map(total.__getitem__, tokens), np.int64, len(tokens))
        asked = []
        for blob in pdf["asked"]:
            steps, f, n = _frames(blob)
            asked.append((np.cumsum(_unplaned(steps, "<u8"), dtype=np.uint64), _unplaned(f, "<u2"), _unplaned(n, "<u4").astype(np.int64)))
        known = successors(*_counted(*(np.concatenate(x) for x in zip(*asked, strict=True))))
        rows = []
        for stretch, words, (q, f, n) in zip(pdf["stretch"], lists, asked, strict=True):
            which = np.fromiter(map(place.__getitem__, words), np.uint32, len(words))
            rows.append((1, stretch, slot, _planes(which), _answer(known, q, n), 0, 0))
        rows.append((2, -1, slot, _pack(b"\n".join(tokens)), _planes(counts), int((counts > 0).sum()), int(counts.sum())))
        return pd.DataFrame(rows, columns=["kind", "stretch", "shard", "a", "b", "n_distinct", "n_all"])

    return lists.groupBy("slot").applyInPandas(run, "kind int, stretch long, shard int, a binary, b binary, n_distinct long, n_all long")


def _answer(known: tuple[np.ndarray, ...], q: np.ndarray, n: np.ndarray) -> bytes:
    """For each distinct context of a list: what is known of it, or 0 where the list itself is all there is."""
    if not len(q):
        return b""
    at = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    own = np.add.reduceat(n, at)
    place = np.searchsorted(known[0], q[at])
    total = known[1][place]
    wide = total > own
    place = place[wide]
    parts = [np.where(wide, total, 0).astype(np.uint32), known[2][place], known[3][place].astype(np.uint32), known[4][place], known[5][place].astype(np.uint32)]
    return b"".join(_framed(_planes(x)) for x in parts)


def _open_vocabulary(tokens: bytes, counts: bytes) -> tuple[list[bytes], np.ndarray]:
    c = _unplaned(counts, "<i8")
    return (_unpack(tokens).split(b"\n") if len(c) else []), c


def _trained_vocabulary(tokens: bytes, counts: bytes) -> list[bytes]:
    every, c = _open_vocabulary(tokens, counts)
    return [t for t, n in zip(every, c.tolist(), strict=True) if n]


# --- the context-mixing model -------------------------------------------------------------------


def bit_contexts(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bits of all tokens: (which token, slots per predictor, bit, place of the bit in its byte).

    A token of more than LONGEST bytes continues with the context of a fresh word; every token ends
    with a space.
    """
    ended = [t + b" " for t in tokens]
    length = np.fromiter(map(len, ended), np.int64, len(ended))
    data = np.frombuffer(b"".join(ended), np.uint8)
    owner = np.repeat(np.arange(len(ended)), length)
    position = (np.arange(len(data)) - np.repeat(np.cumsum(length) - length, length)) % LONGEST
    history = np.zeros(len(data), np.uint64)  # the last 8 bytes of the word, newest lowest
    for back in range(min(8, LONGEST), 0, -1):
        has = position >= back
        shifted = np.zeros(len(data), np.uint64)
        shifted[back:] = data[:-back] if back < len(data) else 0
        history |= np.where(has, shifted << np.uint64(8 * (back - 1)), np.uint64(0))
    slots = []
    bits = np.unpackbits(data).reshape(-1, 8)
    node = np.ones((len(data), 8), np.uint64)
    for b in range(1, 8):
        node[:, b] = (node[:, b - 1] << np.uint64(1)) | bits[:, b - 1]
    for order in ORDERS:
        if order == 0:
            context = np.minimum(position, 12).astype(np.uint64)
        else:
            seen = np.minimum(position, order).astype(np.uint64)
            context = (history & np.uint64((1 << (8 * order)) - 1)) ^ (seen << np.uint64(60))
        h = (context + np.uint64(order + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        x = (h[:, None] + node * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
        slots.append((x >> np.uint64(64 - SLOT_BITS)).astype(np.int32).ravel())
    place = np.tile(np.arange(8, dtype=np.int64), len(data))
    return np.repeat(owner, 8), np.stack(slots), bits.ravel(), place


def _tables(vocabulary: DataFrame) -> np.ndarray:
    """[predictor, bit, slot] counts of all distinct training tokens: partial tables meet by predictor and bit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((len(ORDERS), 2, SLOTS), np.float64)
        for batch in batches:
            for blob, c in zip(batch["a"], batch["b"], strict=True):
                tokens = _trained_vocabulary(blob, c)
                for a in range(0, len(tokens), WORDS_AT_ONCE):
                    _, slots, bits, _ = bit_contexts(tokens[a : a + WORDS_AT_ONCE])
                    for k in range(len(ORDERS)):
                        both = np.bincount(slots[k].astype(np.int64) * 2 + bits, minlength=2 * SLOTS)
                        table[k, 0] += both[0::2]
                        table[k, 1] += both[1::2]
        rows = [(k, b, _pack(table[k, b].astype("<f4").tobytes())) for k in range(len(ORDERS)) for b in range(2) if table[k, b].any()]
        yield pd.DataFrame(rows, columns=["predictor", "bit", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLOTS, np.float64)
        for part in pdf["part"]:
            total += np.frombuffer(_unpack(part), "<f4")
        return pd.DataFrame({"predictor": pdf["predictor"].iloc[:1], "bit": pdf["bit"].iloc[:1], "part": [_pack(total.astype("<f4").tobytes())]})

    schema = "predictor int, bit int, part binary"
    out = np.zeros((len(ORDERS), 2, SLOTS), np.float32)
    for r in vocabulary.mapInPandas(released(run), schema).groupBy("predictor", "bit").applyInPandas(add, schema).collect():
        out[r["predictor"], r["bit"]] = np.frombuffer(_unpack(r["part"]), "<f4")
    return out


def predictions(table: np.ndarray, slots: np.ndarray, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Logits per predictor and the gate's count of known contexts; with ``bits``, as if one sighting less."""
    logits = np.empty((len(ORDERS) + 1, slots.shape[1]), np.float32)
    known = np.zeros(slots.shape[1], np.int64)
    for k in range(len(ORDERS)):
        n0, n1 = table[k, 0][slots[k]], table[k, 1][slots[k]]
        if bits is not None:
            n1 = np.maximum(n1 - bits, 0)
            n0 = np.maximum(n0 - (1 - bits), 0)
        logits[k] = np.log((n1 + np.float32(0.02)) / (n0 + np.float32(0.02)))
        known += n0 + n1 > 0
    np.clip(logits[:-1], -9, 9, out=logits[:-1])
    logits[-1] = 0.3  # a bias
    return logits, known


class Mixer:
    """Gated weights and the refinement map, both learned online."""

    def __init__(self) -> None:
        self.weights = np.full((GATES, len(ORDERS) + 1), 1.0 / len(ORDERS))
        self.weights[:, -1] = 0.0
        self.hits = np.ones((8, STEPS + 1)) * 0.5
        self.seen = np.ones((8, STEPS + 1))

    @staticmethod
    def gate(known: np.ndarray, place: np.ndarray) -> np.ndarray:
        return known * 8 + place

    @staticmethod
    def step(logit: np.ndarray) -> np.ndarray:
        return np.clip(np.round(logit + STEPS // 2), 0, STEPS).astype(np.int64)

    def mix(self, logits: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.zeros(logits.shape[1])
        for k in range(logits.shape[0]):
            z += self.weights[gate, k] * logits[k]
        return np.clip(z, -12, 12)

    def refine(self, z: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Probability of a one: halfway between the mix and what came of mixes like it."""
        s = self.step(z)
        p = 0.5 / (1 + np.exp(-z)) + 0.5 * self.hits[place, s] / self.seen[place, s]
        return np.clip(p, 1e-6, 1 - 1e-6)

    def learn(self, logits: np.ndarray, known: np.ndarray, place: np.ndarray, bits: np.ndarray, rate: float) -> None:
        """One online step over a short run of bits."""
        gate = self.gate(known, place)
        z = self.mix(logits, gate)
        err = bits - 1 / (1 + np.exp(-z))
        n = np.maximum(np.bincount(gate, minlength=GATES), 1)
        for k in range(logits.shape[0]):
            self.weights[:, k] += rate * np.bincount(gate, err * logits[k], GATES) / n
        cell = place * (STEPS + 1) + self.step(z)
        self.hits += np.bincount(cell, bits, 8 * (STEPS + 1)).reshape(8, -1)
        self.seen += np.bincount(cell, minlength=8 * (STEPS + 1)).reshape(8, -1)


def _mixer(vocabulary: DataFrame, table_of) -> Mixer:
    """Each shard is run through online, in order; states are averaged by tokens seen.

    The averaging is an aggregation over array positions, in decimals, so the driver gets one state that
    does not depend on the order of shards.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = table_of()
        mixer, tokens_seen = Mixer(), 0
        tokens = _trained_vocabulary(pdf["a"].iloc[0], pdf["b"].iloc[0])
        for a in range(0, len(tokens), 500):
            _, slots, bits, place = bit_contexts(tokens[a : a + 500])
            logits, known = predictions(table, slots, bits)
            mixer.learn(logits, known, place, bits, 0.3 / (1 + tokens_seen / 5_000))
            tokens_seen += len(tokens[a : a + 500])
        if not tokens_seen:
            return pd.DataFrame({"weight": pd.Series([], dtype=float), "state": pd.Series([], dtype=object)})
        state = np.concatenate([mixer.weights.ravel(), mixer.hits.ravel() / tokens_seen, mixer.seen.ravel() / tokens_seen])
        return pd.DataFrame({"weight": [float(tokens_seen)], "state": [state]})

    states = vocabulary.groupBy("shard").applyInPandas(run, "weight double, state array<double>")
    part = F.sum((F.col("x") * F.col("weight")).cast("decimal(28,10)")).cast("double")
    mean = states.select("weight", F.posexplode("state").alias("i", "x")).groupBy("i").agg((part / F.sum("weight")).alias("x"))
    rows = mean.collect()
    mixer = Mixer()
    if rows:
        state = np.zeros(len(rows))
        for r in rows:
            state[r["i"]] = r["x"]
        w, h = mixer.weights.size, mixer.hits.size
        mixer.weights = state[:w].reshape(mixer.weights.shape)
        mixer.hits, mixer.seen = state[w : w + h].reshape(mixer.hits.shape), np.maximum(state[w + h :], 1e-9).reshape(mixer.seen.shape)
    return mixer


def token_bits(tokens: list[bytes], table: np.ndarray, mixer: Mixer) -> np.ndarray:
    """log2 of each token's probability under the mixed predictors."""
    out = np.zeros(len(tokens))
    for a in range(0, len(tokens), WORDS_AT_ONCE):
        part = tokens[a : a + WORDS_AT_ONCE]
        owner, slots, bits, place = bit_contexts(part)
        logits, known = predictions(table, slots)
        p = mixer.refine(mixer.mix(logits, mixer.gate(known, place)), place)
        out[a : a + len(part)] = np.bincount(owner, np.log2(np.where(bits == 1, p, 1 - p)), len(part))
    return out


# --- stage 3: hits and misses ---------------------------------------------------------------------


def decisions(ids: np.ndarray, lengths: np.ndarray, trained: np.ndarray, q: np.ndarray, f: np.ndarray, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each token: the cell of its hit-or-miss decision (-1 after an unknown context), and whether it is a hit.

    ``trained`` tells for each document whether it was counted; what it was counted for is taken off.
    ``answers`` are those of the shards in order, for the stretch's distinct contexts in order.
    """
    doc = np.repeat(np.arange(len(lengths)), lengths)
    counted = trained[doc]
    own_q, own_total, f1, n1, f2, n2 = successors(*_counted(q, f, counted.astype(np.int64)))
    total, f1, n1, f2, n2 = own_total.copy(), f1.copy(), n1.copy(), f2.copy(), n2.copy()
    frames = [_frames(bytes(b)) for b in answers if b]
    if frames:
        wider = np.concatenate([_unplaned(x[0], "<u4") for x in frames]).astype(np.int64)
        at = np.flatnonzero(wider)
        total[at] = wider[at]
        for target, k, dtype in ((f1, 1, "<u2"), (n1, 2, "<u4"), (f2, 3, "<u2"), (n2, 4, "<u4")):
            target[at] = np.concatenate([_unplaned(x[k], dtype) for x in frames])
    which = np.searchsorted(own_q, q)
    # Only tokens whose context was counted elsewhere: all places of a document's context are among them, or none is.
    at = np.flatnonzero(total[which] > counted)
    there, own, print_ = which[at], counted[at], f[at].astype(np.int64)
    place = doc[at] * np.int64(len(own_q)) + there
    # What the document itself was counted for: under the context, and for the context's two successors.
    keys, often = np.unique((place << np.int64(16)) | print_, return_counts=True)
    _, back, under = np.unique(place, return_inverse=True, return_counts=True)

    def less_own(successor: np.ndarray, count: np.ndarray) -> np.ndarray:
        key = (place << np.int64(16)) | successor[there].astype(np.int64)
        found = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        return count[there] - own * np.where(keys[found] == key, often[found], 0) if len(keys) else count[there]

    t_at = total[there] - own * under[back]
    c1, c2 = less_own(f1, n1), less_own(f2, n2)
    first_leads = c1 >= c2
    t, best = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    known, hit = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    t[at], best[at] = t_at, np.where(first_leads, c1, c2)
    known[at] = (t_at > 0) & (best[at] > 0)
    hit[at] = known[at] & (np.where(first_leads, f1[there], f2[there]) == print_)
    index = np.arange(len(ids))
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    # The last token before this one that was no hit; the place before a document counts as one.
    miss = np.maximum.accumulate(np.where(hit, -1, index))
    before = np.r_[-1, miss[:-1]]
    run = index - 1 - np.maximum(before, start - 1)
    strange = np.r_[True, ~known[:-1]] | (index == start)
    seen = np.minimum(np.ceil(np.log2(np.maximum(t, 1))).astype(np.int64), SEEN - 1)
    sure = np.where(best >= t, SURE - 1, np.minimum(best * (SURE - 1) // np.maximum(t, 1), SURE - 2))
    runs = np.minimum(np.ceil(np.log2(run + 1)).astype(np.int64), RUN - 1)
    cell = ((seen * SURE + sure) * RUN + runs) * 2 + strange
    return np.where(known, cell, -1), hit


class HitMixer:
    """Probability of a hit in every cell, by predictors, gated logistic mixing and refinement."""

    EPOCHS, RATE, TRUST = 60, 0.5, 30.0

    def __init__(self, tally: np.ndarray):
        """``tally``: [cell, miss or hit] counts over the training documents."""
        miss, hit = (tally.reshape(SEEN, SURE, RUN, 2, 2)[..., k].astype(np.float64) for k in (0, 1))

        def predictor(*axes: int) -> np.ndarray:
            h, m = (x.sum(axis=axes, keepdims=True) for x in (hit, miss))
            return np.broadcast_to(np.log((h + 0.4) / (m + 0.4)), hit.shape).ravel()

        # Contexts: (seen, sure), (run, strange), (seen, run); and a bias.
        self.logits = np.clip(np.stack([predictor(2, 3), predictor(0, 1), predictor(1, 3), np.full(hit.size, 0.3)]), -8, 8)
        gate = np.broadcast_to(np.arange(RUN)[None, None, :, None], hit.shape).ravel()
        hit, miss = hit.ravel(), miss.ravel()
        self.weights = np.full((RUN, 4), 1 / 3.0)
        self.weights[:, 3] = 0.0
        n = hit + miss
        for epoch in range(self.EPOCHS):
            for g in range(RUN):
                at = np.flatnonzero((gate == g) & (n > 0))
                if len(at):
                    x = self.logits[:, at]
                    p = 1 / (1 + np.exp(-(self.weights[g] @ x)))
                    self.weights[g] += self.RATE / (1 + epoch / 10) * (x @ (hit[at] - n[at] * p)) / n[at].sum() / 8
        z = np.einsum("ck,kc->c", self.weights[gate], self.logits)
        mixed = 1 / (1 + np.exp(-np.clip(z, -9, 9)))
        self.hit = np.clip((mixed * self.TRUST + hit) / (self.TRUST + n), 1e-5, 1 - 1e-5)

    def log10(self) -> np.ndarray:
        """[cell * 2 + hit]."""
        return np.log10(np.stack([1 - self.hit, self.hit], axis=1)).ravel()


# --- stage 4: scores ----------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive x: Stirling's series after eight steps up."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - np.log(shift)


def document_scores(share: np.ndarray, mixed: np.ndarray, which: np.ndarray, often: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 probability of each document from its (token, times) list.

    ``share`` and ``mixed`` are c/N and P_mix of the stretch's tokens; ``first`` is where documents begin.
    """
    again = np.flatnonzero(often > 1)
    owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(which)]))[again]
    experts = []
    for weight in LAMBDAS:
        p = weight * share + (1 - weight) * mixed + 1e-300
        ln = np.log(p)[which]
        once, times = np.add.reduceat(ln, first), np.add.reduceat(ln * often, first)
        distinct = np.diff(np.r_[first, len(which)])
        for urn in URNS:
            if urn is None:
                experts.append(times)
                continue
            a = urn * p[which[again]]
            more = np.bincount(owner, log_gamma(a + often[again]) - log_gamma(a + 1), len(first))
            size = n.astype(np.float64)
            experts.append(once + distinct * np.log(urn) + more - (log_gamma(size + urn) - log_gamma(np.full_like(size, urn))))
    stacked = np.stack(experts)
    top = stacked.max(0)
    return (top + np.log(np.exp(stacked - top).mean(0))) / np.log(10.0)


_DOCUMENT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, rest double, codes binary, tally array<long>"
)


def _documents(pdf: pd.DataFrame, bits: int, distinct: int, everything: int) -> pd.DataFrame:
    """All of one stretch: a row per document, and one of its training documents' tally (doc columns null)."""
    kept = pdf[pdf["kind"] == 0]
    if not len(kept):
        return pd.DataFrame({c.split()[0]: [] for c in _DOCUMENT.split(", ")})
    keys, nulls, outs, sizes, lengths, sequence = _frames(kept["a"].iloc[0])
    keys, nulls, outs, sizes, lengths = _unplaned(keys, "<i8"), _unplaned(nulls, "u1"), _unplaned(outs, "u1"), _unplaned(sizes, "<i8"), _unplaned(lengths, "<i8")
    ids = _unplaned(sequence, "<u4").astype(np.int64)
    first = np.cumsum(lengths) - lengths
    of = lambda kind: pdf[pdf["kind"] == kind].sort_values("shard")
    c = np.concatenate([_unplaned(b, "<i8") for b in of(3)["a"]]).astype(np.float64)
    parts = [_frames(b) for b in of(3)["b"]]
    mixed = 10.0 ** (np.concatenate([np.frombuffer(_unpack(x[0]), "<f4") for x in parts]).astype(np.float64) * np.log10(2.0))
    hashes = np.concatenate([_unplaned(x[1], "<u8") for x in parts])
    q, f = contexts_of(ids, first, hashes, bits)
    cell, hit = decisions(ids, lengths, outs == 0, q, f, list(of(1)["b"]))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    # The tokens that are not hits, as (which, how often) of each document; every document has a group.
    left = doc[~hit] * np.int64(len(c)) + ids[~hit]
    pairs, often = np.unique(left, return_counts=True)
    owner, which = pairs // len(c), pairs % len(c)
    rest = np.zeros(len(lengths))
    have, begin = np.unique(owner, return_index=True)
    if len(have):
        sizes_left = np.bincount(owner, often, len(lengths))[have]
        rest[have] = document_scores(c / max(everything, 1), mixed, which, often.astype(np.float64), begin, sizes_left)
    base = np.log10((c + 1) / (everything + 1 * (distinct + 1)))
    told = cell >= 0
    codes, many = np.unique(doc[told] * np.int64(2 * CELLS) + cell[told] * 2 + hit[told], return_counts=True)
    cut = np.searchsorted(codes, np.arange(len(lengths) + 1) * np.int64(2 * CELLS))
    packed = [_framed((codes[a:b] % (2 * CELLS)).astype("<u2").tobytes()) + many[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    taught = told & (outs == 0)[doc]
    tally = np.bincount(cell[taught] * 2 + hit[taught], minlength=2 * CELLS)
    rows = pd.DataFrame({
        "doc_id": pd.array(np.where(nulls == 1, None, keys), "Int64"), "held_out": outs.astype(bool), "n_tokens": lengths,
        "n_known": np.add.reduceat((c > 0)[ids].astype(np.int64), first), "n_bytes": sizes, "base_score": np.add.reduceat(base[ids], first),
        "rest": rest, "codes": packed, "tally": None,
    })
    told_row = pd.DataFrame({"doc_id": pd.array([None], "Int64"), "held_out": [None], "n_tokens": [0], "n_known": [0], "n_bytes": [0],
                             "base_score": [0.0], "rest": [0.0], "codes": [None], "tally": [tally]})
    return pd.concat([rows.astype({"held_out": object}), told_row], ignore_index=True)


def score(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_token, bits_per_byte."""
    spark = documents.sparkSession
    ship(spark)
    size = documents.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    shards = max(32, -(-size // SHARD_BYTES))
    bits = min(62, SPARE_BITS + max(8, (size // 4).bit_length()))
    gathered = materialize(_gathered(_stretches(documents, shards, bits, key, text)))
    sweep(spark)  # the lists as they were exchanged
    vocabulary = gathered.where("kind = 2").select("shard", "a", "b")
    totals = gathered.where("kind = 2").agg(F.sum("n_distinct"), F.sum("n_all")).first()
    distinct, everything = int(totals[0] or 0), int(totals[1] or 0)
    # The byte model is of fixed size: SLOTS x predictors x 2 counts of 4 bytes, and a few gates.
    table = spark.sparkContext.broadcast(_tables(vocabulary))
    mixer = _mixer(vocabulary, lambda: table.value)

    def answer(asked: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        """For each list of a shard: the counts, mixed log2 probabilities and hashes of its tokens."""
        tokens, counts = _open_vocabulary(words["a"].iloc[0], words["b"].iloc[0]) if len(words) else ([], np.zeros(0, np.int64))
        value, hashes = token_bits(tokens, table.value, mixer).astype("<f4"), token_hashes(tokens)
        lists = [_unplaned(b, "<u4") for b in asked["a"]]
        return pd.DataFrame({"kind": 3, "stretch": asked["stretch"], "shard": asked["shard"], "a": [_planes(counts[x]) for x in lists], "b": [_framed(_pack(value[x].tobytes())) + _framed(_planes(hashes[x])) for x in lists]})

    columns = ("kind", "stretch", "shard", "a", "b")
    schema = "kind int, stretch long, shard int, a binary, b binary"
    answers = gathered.where("kind = 1").select("stretch", "shard", "a").groupBy("shard").cogroup(vocabulary.groupBy("shard")).applyInPandas(answer, schema)
    kept = gathered.where("kind = 0").select(*columns).unionByName(gathered.where("kind = 1").select("kind", "stretch", "shard", F.lit(None).cast("binary").alias("a"), "b"))
    met = kept.unionByName(answers).groupBy("stretch").applyInPandas(lambda pdf: _documents(pdf, bits, distinct, everything), _DOCUMENT)
    found = materialize(met)
    tally = np.zeros(2 * CELLS, np.int64)
    for r in found.where("tally IS NOT NULL").select(F.posexplode("tally").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
        tally[r["i"]] = r["n"]  # at most 2 * CELLS rows
    table.destroy()
    bit = HitMixer(tally).log10()

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = batch["rest"].to_numpy(np.float64, copy=True)
            for i, blob in enumerate(batch["codes"]):
                blob = bytes(blob)
                n = int.from_bytes(blob[:8], "little")
                if n:
                    total[i] += bit[np.frombuffer(blob, "<u2", n // 2, 8)] @ np.frombuffer(blob, "<u4", -1, 8 + n).astype(np.float64)
            in_bits = -total / np.log10(2.0)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"].astype(bool), "n_tokens": batch["n_tokens"], "n_known": batch["n_known"],
                "train_tokens": everything, "base_score": batch["base_score"], "score": total,
                "bits_per_token": in_bits / batch["n_tokens"], "bits_per_byte": in_bits / (batch["n_bytes"] + 1),
            })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_token double, bits_per_byte double"
    return found.where("tally IS NULL").drop("tally").mapInPandas(finish, schema)
