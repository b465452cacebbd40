"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are shares and ratios that do not depend on language: character classes, word shapes,
repetition of words, word pairs and lines, and compressibility.  Trees are grown level by level on
quantile-binned statistics with logistic loss and second-order gains, then flattened into arrays
(complete binary layout), so scoring a batch is ``depth`` numpy gathers per tree.

Training takes a bounded sample: at most ``SAMPLE`` labelled rows, the first by a hash of their
key, so their keys can be broadcast and their statistics fit the driver.  Scoring is a map over
all rows: no shuffle, so no key can be hot.

Cases: null text counts as empty (all statistics 0, scored like any other); labels that are null
are left out, several labels of a key vote; no labels or one class only gives a constant score;
extra columns pass through or are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folium.session import released, ship, tidy

#: Labelled rows used for fitting at most (12 bytes each when broadcast, 200 when collected).
SAMPLE = 20_000

FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "punct", "symbol", "bar", "bang", "non_ascii", "space",
    "distinct_words", "top_word", "repeat_next", "distinct_pairs", "distinct_lines", "words_per_line", "decorated", "shouted",
    "longest_run", "compress", "capitalised", "stops", "lone_bars",
)

_CLASS = np.zeros((256, 8), np.float64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [
        _c.isascii() and _c.isupper(), _c.isascii() and _c.isdigit(), _c in ".,;:?'\"-()", _c in "#$%&*@^~<>{}[]\\/=+_`",
        _c == "|", _c == "!", _b >= 128, _c in " \t\n\r\x0b\x0c",
    ]


def statistics(text: str | None) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "replace")
    words = (text or "").split()
    n, m = len(raw), len(words)
    if not m:
        return [float(np.log1p(n))] + [0.0] * (len(FEATURES) - 1)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / n
    counts = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    lines = [line for line in text.split("\n") if line.strip()]
    same = run = longest = 0
    for a, b in zip(words, words[1:], strict=False):
        if a == b:
            same += 1
            run += 1
            longest = max(longest, run)
        else:
            run = 0
    decorated = shouted = capital = stops = 0
    for word, k in counts.items():
        if len(word) > 2 and word[-3:] == word[-1] * 3 and not word[-1].isalnum():
            decorated += k
        if len(word) > 1 and word.isupper():
            shouted += k
        elif word[0].isupper():
            capital += k
        if word[-1] == ".":
            stops += k
    return [
        float(np.log1p(n)), float(np.log1p(m)), n / m, *(float(s) for s in shares[[0, 1, 2, 3, 4, 5, 6, 7]]),
        len(counts) / m, max(counts.values()) / m, same / m, (len(pairs) + 1) / m, len(set(lines)) / max(1, len(lines)),
        float(np.log1p(m / max(1, len(lines)))), decorated / m, shouted / m, float(np.log1p(longest)),
        len(zlib.compress(raw, 1)) / (n + 20), capital / m, stops / m, counts.get("|", 0) / m,
    ]


def statistics_matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


# --- trees --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class BoostParams:
    trees: int = 120
    depth: int = 4
    bins: int = 64
    rate: float = 0.1
    l2: float = 1.0
    min_rows: int = 10


@dataclass(frozen=True)
class Forest:
    """All trees in complete layout: node i of a tree has children 2i + 1 and 2i + 2."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        rows = np.arange(len(x))
        margin = np.full(len(x), self.base)
        inner = 2**self.depth - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += value[node - inner]
        return 1.0 / (1.0 + np.exp(-margin))


def fit_forest(x: np.ndarray, y: np.ndarray, p: BoostParams = BoostParams()) -> Forest:
    """Grow trees on histograms of gradients; nothing random, ties go to the first feature and bin."""
    positive = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(positive / (1 - positive)))
    inner, leaves = 2**p.depth - 1, 2**p.depth
    if len(y) < 2 or y.min() == y.max():
        return Forest(base, p.depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    features = x.shape[1]
    offset = np.arange(features) * p.bins
    margin = np.full(len(y), base)
    out_f, out_t, out_v = [], [], []
    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = q - y, q * (1 - q)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(p.depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first) * features * p.bins)[:, None] + offset + binned
            size = width * features * p.bins
            shape = (width, features, p.bins)
            flat = cell.ravel()
            g = np.bincount(flat, np.repeat(grad, features), size).reshape(shape)
            h = np.bincount(flat, np.repeat(hess, features), size).reshape(shape)
            c = np.bincount(flat, minlength=size).reshape(shape)
            gl, hl, cl = g.cumsum(2), h.cumsum(2), c.cumsum(2)
            gt, ht, ct = gl[:, :, -1:], hl[:, :, -1:], cl[:, :, -1:]
            gain = gl**2 / (hl + p.l2) + (gt - gl) ** 2 / (ht - hl + p.l2) - gt**2 / (ht + p.l2)
            gain[(cl < p.min_rows) | (ct - cl < p.min_rows)] = -np.inf
            best = gain.reshape(width, -1).argmax(1)
            worth = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            cut = np.full(width, p.bins)
            for k in range(width):
                if worth[k]:
                    j, b = divmod(int(best[k]), p.bins)
                    if b < len(edges[j]):
                        feature[first + k], threshold[first + k], cut[k] = j, edges[j][b], b
            at = node - first
            right = binned[np.arange(len(y)), feature[node]] > cut[at]
            node = 2 * node + 1 + right
        leaf = node - inner
        g = np.bincount(leaf, grad, leaves)
        h = np.bincount(leaf, hess, leaves)
        value = -p.rate * g / (h + p.l2)
        margin += value[leaf]
        out_f.append(feature)
        out_t.append(threshold)
        out_v.append(value)
    return Forest(base, p.depth, np.array(out_f), np.array(out_t), np.array(out_v))


# --- on tables ----------------------------------------------------------------------------------


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          allowed: Column | None = None, params: BoostParams = BoostParams(), sample: int = SAMPLE) -> Forest:
    """Fit on at most ``sample`` labelled keys among ``allowed`` (a condition on the key)."""
    ship(documents.sparkSession)
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    if allowed is not None:
        usable = usable.where(allowed)
    votes = usable.groupBy(F.col(key).cast("string").alias("_key")).agg(F.avg(F.col(label).cast("double")).alias("_label"))
    chosen = votes.orderBy(F.xxhash64("_key"), "_key").limit(sample)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = statistics_matrix(batch["body"])
            yield pd.DataFrame({"_key": batch["_key"], "y": (batch["_label"] >= 0.5).astype(float), "x": list(x)})

    # At most ``sample`` keys of 20 bytes: safe to broadcast at any size of input.
    rows = (
        documents.select(F.col(key).cast("string").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
        .join(F.broadcast(chosen), "_key")
        .mapInPandas(released(describe), "_key string, y double, x array<double>")
        # Rows that share a key are more than keys: what is collected is bounded again.
        .orderBy(F.xxhash64("_key", "x"), "_key").limit(sample)
    )
    found = rows.toPandas()
    if not len(found):
        return fit_forest(np.zeros((0, len(FEATURES))), np.zeros(0), params)
    x = np.array(found["x"].tolist())
    order = np.lexsort([*x.T, found["_key"].to_numpy()])  # the fit does not depend on partitioning
    return fit_forest(x[order], found["y"].to_numpy()[order], params)


def scorer(forest: Forest):
    """A pandas UDF from text to the probability of label 1."""

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series(forest.score(statistics_matrix(texts)), index=texts.index)
        finally:
            tidy()

    return quality


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """Rows whose crc32 of the key as text leaves remainder 0; a null key counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds)) == 0


def score(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``documents`` plus held_out, score, predicted, which take the place of columns so named.

    The key may be of any type that has a text form.
    """
    forest = train(documents, labels, key, text, allowed=~held_out(key))
    likely = scorer(forest)(F.col(text))
    scored = documents.withColumns({"held_out": held_out(key), "score": likely})
    return scored.withColumns({"predicted": (F.col("score") >= threshold).cast("int")})
