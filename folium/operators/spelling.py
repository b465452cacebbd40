"""Spell correction: distinct words are corrected once and joined back to the texts.

Candidates come from deletion variants (both the word and the dictionary entry lose up to two
characters), which turns edit distance into an equi-join; ``levenshtein`` verifies them.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from folium.functions import fixed
from folium.functions.text import col, let
from folium.session import materialize

#: Corrections that are broadcast: up to this many.
BROADCAST_WORDS = 200_000
LETTERS = "a-zA-ZàèéìòùÀÈÉÌÒÙáíóúÁÍÓÚ"


def tokens(text: Column | str) -> Column:
    """Alternating runs of letters and of anything else; joined they are the text."""
    return F.regexp_extract_all(col(text), F.lit(f"([{LETTERS}]+|[^{LETTERS}]+)"), F.lit(1))


def eligible(word: Column | str, shortest: int = 3) -> Column:
    """Words of letters, long enough, not in title or mixed case, not skipped."""
    w = col(word)
    skip = sorted({v for t in fixed.SKIP_TERMS for v in (t, t.capitalize(), t.upper())})
    plain = (w == F.lower(w)) | (w == F.upper(w))
    return (F.char_length(w) >= shortest) & F.regexp_like(w, F.lit(f"^[{LETTERS}]+$")) & plain & ~w.isin(*skip)


def deletions(word: Column, distance: int = 2) -> Column:
    """The word and what is left of it after taking out up to ``distance`` characters."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w))))
    out, layer = F.array(word), F.array(word)
    for _ in range(distance):
        layer = F.array_distinct(F.flatten(F.transform(F.filter(layer, lambda w: F.char_length(w) > 1), once)))
        out = F.array_union(out, layer)
    return out


def corrections(words: DataFrame, dictionary: DataFrame, distance: int = 2, prefer: str = "frequency") -> DataFrame:
    """``word`` (lower case) and ``term, frequency`` -> word, correction for words the dictionary lacks.

    ``prefer`` frequency: the most frequent term within the distance; distance: the nearest, then
    the most frequent.  Ties go to the first term.
    """
    unknown = words.select("word").distinct().join(dictionary.select(F.col("term").alias("word")), "word", "left_anti")
    left = unknown.select("word", F.explode(deletions(F.col("word"), distance)).alias("variant"))
    right = dictionary.select("term", "frequency", F.explode(deletions(F.col("term"), distance)).alias("variant"))
    pairs = left.join(right, "variant").select("word", "term", "frequency").distinct().withColumn("d", F.levenshtein("word", "term"))
    near = pairs.where(F.col("d") <= distance)
    order = ["d", F.col("frequency").desc(), "term"] if prefer == "distance" else [F.col("frequency").desc(), "d", "term"]
    return near.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(*order))).where("r = 1").select("word", F.col("term").alias("correction"))


def scan_candidates(word: Column | str) -> Column:
    """Words a scan may have mistaken: one position replaced after the table of scan errors, three casings of each."""
    w = col(word)
    table = F.create_map(*[x for k, v in fixed.SCAN_ERRORS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    at = lambda i: F.substring(w, i, F.lit(1))
    swapped = lambda i: F.transform(
        F.coalesce(F.try_element_at(table, at(i)), F.array().cast("array<string>")),
        lambda s: F.concat(F.substring(w, F.lit(1), i - 1), s, F.substring(w, i + 1, F.char_length(w))),
    )
    found = F.flatten(F.transform(F.sequence(F.lit(1), F.char_length(w)), swapped))
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.char_length(x))))
    plain = lambda x: F.translate(x, "àèéìòùáíóú", "aeeiouaiou")
    return F.array_distinct(F.concat(F.array(w, F.lower(w), cap(w), plain(w)), found))


def frequent_candidates(words: DataFrame, dictionary: DataFrame, rare: float = 1e-6) -> DataFrame:
    """Rare words and the scan candidate that is more frequent than they are."""
    total = dictionary.agg(F.sum("frequency").alias("total"))
    share = dictionary.join(F.broadcast(total)).select("term", (F.col("frequency") / F.col("total")).alias("share"))
    own = words.select("word").distinct().join(share, F.col("word") == F.col("term"), "left").select("word", F.coalesce("share", F.lit(0.0)).alias("own"))
    tried = own.where(F.col("own") <= rare).select("word", "own", F.explode(scan_candidates("word")).alias("term")).join(share, "term").where("share > own")
    return tried.groupBy("word").agg(F.max_by("term", F.struct("share", "term")).alias("correction"))


def restore_case(original: Column, corrected: Column) -> Column:
    """Capitals and initial capitals of the original word."""
    first = F.substring(original, 1, 1)
    capital = F.concat(F.upper(F.substring(corrected, 1, 1)), F.substring(corrected, F.lit(2), F.char_length(corrected)))
    return F.when((F.char_length(original) > 1) & (original == F.upper(original)), F.upper(corrected)).when(first != F.lower(first), capital).otherwise(corrected)


def correct_documents(documents: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 2,
                      prefer: str = "frequency") -> DataFrame:
    """key, original_text, text, correction_count, correction_percentage."""
    # Texts are named by a hash: a word has one correction wherever it stands, so texts that share one lose nothing.
    name = F.xxhash64(F.col(text))
    words = F.array_distinct(F.transform(F.filter(tokens(text), lambda w: eligible(w)), F.lower))
    rows = documents.select(name.alias("_name"), F.explode(words).alias("word"))
    fixes = materialize(corrections(rows, dictionary, distance, prefer))
    side = F.broadcast(fixes) if fixes.count() <= BROADCAST_WORDS else fixes
    of_text = rows.join(side, "word").groupBy("_name").agg(F.collect_set(F.struct("word", "correction")).alias("_fixes"))
    fix_of = lambda t: F.get(F.filter("_fixes", lambda f: f["word"] == F.lower(t)), F.lit(0))["correction"]
    fixed_token = lambda t: F.when(eligible(t), let(fix_of(t), lambda c: F.coalesce(restore_case(t, c), t))).otherwise(t)
    new = F.when(F.col("_fixes").isNull(), F.col(text)).otherwise(F.array_join(F.transform(tokens(text), fixed_token), ""))
    whole = documents.withColumn("_name", name).join(of_text, "_name", "left").select(key, F.col(text).alias("original_text"), new.alias("_new"))
    change = whole.withColumn("_d", difference(F.col("original_text"), F.col("_new")))
    return change.select(key, "original_text", F.col("_new").alias("text"), F.col("_d.count").alias("correction_count"), F.col("_d.percent").alias("correction_percentage"))


def difference(a: Column, b: Column) -> Column:
    """struct<count, percent>: positions at which two texts differ, over their common length; null if either text is.

    Characters are compared as arrays of code points, an Arrow batch at a time.  The percentage is rounded as
    SQL's round of a double is: the hundredfold to a whole number, and back.
    """

    @F.pandas_udf("int")
    def differing(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> int | None:
            if x is None or y is None:
                return None
            n = min(len(x), len(y))
            points = lambda t: np.frombuffer(t[:n].encode("utf-32-le"), np.uint32)
            return 0 if x == y else int(np.count_nonzero(points(x) != points(y)))

        return pd.Series([one(x, y) for x, y in zip(left, right, strict=True)], index=left.index, dtype="Int32")

    count, size = differing(a, b), F.char_length(a)
    share = lambda n: F.when(size > 0, F.round(n * F.lit(100.0) / size * 100) / 100).when(n.isNotNull(), F.lit(0.0))
    return let(count, lambda n: F.struct(n.alias("count"), share(n).alias("percent")))


def apply_provider(words: DataFrame, provider) -> DataFrame:
    """word, correction by an injected corrector (word to word), a batch of distinct words at a time."""
    @F.pandas_udf(StringType())
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(provider).astype(object)

    return words.select("word").distinct().withColumn("correction", run("word")).where("correction IS NOT NULL AND correction <> word")


#: Correctors by name; the first of a preference that can run is taken.
BACKENDS = {
    "standard": lambda words, dictionary, **o: corrections(words, dictionary, o.get("distance", 2), "frequency"),
    "closest": lambda words, dictionary, **o: corrections(words, dictionary, o.get("distance", 2), "distance"),
    "scan": lambda words, dictionary, **o: frequent_candidates(words, dictionary, o.get("rare", 1e-6)),
}


#: Which correctors are tried after one that fails, in order.
FALLBACKS = {"standard": ("closest", "scan"), "closest": ("standard", "scan"), "scan": ("standard", "closest")}


def backend(*preference: str):
    """The first known corrector of a preference, else the standard one."""
    return next((BACKENDS[p] for p in preference if p in BACKENDS), BACKENDS["standard"])


def corrected_words(words: DataFrame, dictionary: DataFrame, *preference: str, **options) -> DataFrame:
    """word, correction by the first corrector of a preference that can be set up, then by its fallbacks.

    A corrector that does not exist, whose library is missing or whose dictionary lacks its columns is passed
    over with a warning; if none is left, nothing is corrected.
    """
    names = [*(preference or ("standard",))]
    for name in [*names, *(f for n in names for f in FALLBACKS.get(n, ()) if f not in names), *(n for n in ("standard",) if n not in names)]:
        try:
            found = BACKENDS[name](words, dictionary, **options).select("word", "correction")
            found.schema  # noqa: B018  a plan that cannot be made fails here, before any row is read
            return found
        except (KeyError, ImportError, AnalysisException) as e:
            warnings.warn(f"spelling backend {name} is passed over: {str(e)[:200]}", stacklevel=2)
    return words.select("word", F.lit(None).cast("string").alias("correction")).limit(0)
