"""Each stage against what it must keep, on a small corpus with planted copies."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import ODD, brute_components, corpus, words


def test_stages(spark, tmp_path):
    clean = [words(80, i) + "." for i in range(60)]
    near = [t.replace(" ", " ", 1) + " tail" for t in clean[:10]]
    junk = [" ".join([w] * 40) for w in words(60, 5).split()]
    texts = clean + clean[:15] + near + junk + [t for t in ODD if t]
    d = corpus(spark, texts)
    labels = [(i, 1, 0) for i in range(60)] + [(85 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    sf, at, kept = str(tmp_path), d, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = at
        stage(spark, at, sf).write.parquet(str(tmp_path / f"out{i}"))
        at = spark.read.parquet(str(tmp_path / f"out{i}"))
        if i < 4:
            assert at.columns == d.columns, name
        kept[i] = [(r["doc_id"], r["text"]) for r in at.collect()] if i < 4 else at.collect()
        if i == 1:
            texts_before = Counter(r["text"] for r in before.collect())
            assert Counter(t for _, t in kept[1]) == Counter(set(texts_before))
        if i == 2:
            pairs = [(r["doc_id"], r["text"]) for r in before.collect()]
            brute = brute_components([t for _, t in pairs], [k for k, _ in pairs])
            assert sorted(k for k, _ in kept[2]) == sorted(a for a, _, c in brute if a == c)
    assert {t for _, t in kept[0]} >= set(clean) and not {t for _, t in kept[0]} & set(junk)
    assert max(Counter(k for k, _ in kept[3]).values()) <= 2
    places = {}
    for r in kept[4]:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 1024 for p in places.values())
    assert corpus_pipeline.run(spark, sf).count() == len(kept[4])


def test_stages_on_nothing(spark, tmp_path):
    d = corpus(spark, ["x"]).limit(0)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, str(tmp_path)).count() == 0, name


def test_repeated_rows(spark):
    d = corpus(spark, ["a b c", "a b c", None, None, "z"], [1, 1, None, None, 2]).withColumn("text", F.col("text"))
    out = corpus_pipeline.drop_copies(spark, d, "")
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == [(-1, ""), (1, "a b c"), (2, "z")]


def test_near_copies_go_by_row(spark):
    """Null and repeated keys: a near copy takes no unrelated row of its key with it, and none escapes by its key."""
    t = [words(80, i) for i in range(9)]
    texts = [t[0], t[0] + " tail", t[1], t[2], t[3], t[3] + " tail", t[4], t[5], t[5] + " tail", t[6], t[6].upper(), t[7], t[7] + " tail", None, ""]
    ids = [1, None, None, 2, 2, 3, 3, None, None, 4, 4, 5, 5, None, 1]
    out = corpus_pipeline.drop_near_copies(spark, corpus(spark, texts, ids), "").collect()
    kept = Counter((r["doc_id"], r["text"]) for r in out)
    sure = [(1, t[0]), (None, t[1]), (2, t[2]), (2, t[3]), (3, t[4]), (None, None), (1, "")]
    assert all(kept[row] == 1 for row in sure)
    for i, key in ((5, None), (6, 4), (7, 5)):  # one row of each component, which one is open
        assert sum(n for (k, x), n in kept.items() if k == key and x and x.lower().startswith(t[i].lower())) == 1
    assert sum(kept.values()) == len(sure) + 3


def test_copies_go_by_row(spark):
    """Rows of one key are taken as often as the mixture takes each of them."""
    texts = [words(3 + i * i % 90, i) for i in range(60)] + ["same text here"] * 7
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(60)] + [7] * 7
    d = corpus(spark, texts, ids, ["a" if i % 5 else "b" for i in range(60)] + ["a"] * 7)
    want = Counter()
    for r in corpus_pipeline.mixing.mix(d).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in corpus_pipeline.mix_sources(spark, d, "").collect())
    assert got == +want


#: Names that operators and stages use for their results or for themselves, and one with a dot.
NAMES = [
    "score", "held_out", "predicted", "kept", "keep_id", "known", "digest", "_digest", "_sha", "sha", "row", "part", "class", "keeper", "seed", "id", "_id",
    "odd", "stays", "copies", "_copies", "copy", "key", "_key", "main_text", "license", "own_license", "inherited_from", "size", "target", "taken", "e", "cell",
    "root", "node", "bucket", "piece", "sequence_id", "offset", "length", "n", "at", "dir", "_dir", "body", "media", "shard", "slot", "stretch", "component_id", "a.b",
]


def odd_corpus(spark):
    """Null, empty, blank, tied, repeated and very long texts, with every clashing name as a column."""
    long_text = " ".join(words(2000, 3).split() * 130)  # about a million characters
    texts = [*ODD, long_text, words(80, 1) + ".", words(80, 1) + ".", words(80, 2) + ".", words(80, 2) + " tail."]
    d = corpus(spark, texts, [*range(len(texts) - 1), None]).select("doc_id", "text", "lang", "source", "n_chars")
    return texts, d.withColumns({n: F.concat(F.lit(n + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in NAMES})


def test_stages_bear_any_columns(spark, tmp_path):
    texts, at = odd_corpus(spark)
    spark.createDataFrame([(i, 1, 0) for i in range(14)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    columns = at.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        at = spark.read.parquet(str(tmp_path / f"out{i}"))
        if i < 4:
            assert at.columns == columns, name
            for r in at.select("doc_id", "score", "`a.b`").collect():
                own = "none" if r["doc_id"] is None else r["doc_id"]
                assert (r["score"], r["a.b"]) == (f"score:{own}", f"a.b:{own}"), name
    assert at.count() > 0


def test_operators_bear_any_columns(spark):
    from folium.llm import exact_dedup, flac, html_extract, jaccard, licenses, lm_score, mixing, packing, preference, quality
    from folium.llm.queries import tokenizer_path

    texts, d = odd_corpus(spark)
    n = len(texts)
    labels = spark.createDataFrame([(i, int(i > 8), 0) for i in range(14)], "doc_id long, quality int, toxic int")
    got = quality.score(d, labels)
    assert got.columns.count("score") == 1 and got.count() == n and dict(got.dtypes)["score"] == "double"
    assert quality.score(d.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")), labels.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))).count() == n
    assert jaccard.join_components(d).count() == n
    files = licenses.scan(d.withColumn("path", F.concat("source", F.lit("/LICENSE"))))
    assert files.columns.count("license") == 1 and files.count() == n
    assert files.where("score = concat('score:', doc_id)").count() == n - 1
    assert flac.round_trip(d).count() == n
    pages = html_extract.extract(d.withColumn("page_id", F.col("doc_id")).withColumn("html", F.col("text")))
    assert pages.columns.count("main_text") == 1 and pages.count() == n
    assert lm_score.score(d).count() == n
    assert packing.pack(packing.tokenize_pieces(d, tokenizer_path())).select("doc_id").distinct().count() == n
    assert mixing.mix(d).count() == n
    assert exact_dedup.dedup(d.withColumn("part", F.lit(0)), "part", 1).count() == n
    turns = d.withColumns({"pair_id": F.lit(1).cast("long"), "turn": F.col("doc_id"), "role": F.lit("user")})
    assert preference.format_preferences(turns, turns).count() == 1
