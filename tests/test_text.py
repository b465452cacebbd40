from pyspark.sql import functions as F

from folium.functions import classify, metadata, segments as S, text as T


def one(spark, column, value, ddl="string"):
    return spark.createDataFrame([(value,)], f"x {ddl}").select(column.alias("y")).first()["y"]


def test_clean(spark):
    assert one(spark, T.clean("x"), "Page 1 of 9\nab\n Hello   world \nDRAFT\nBye now") == "Hello world Bye now"
    assert one(spark, T.clean("x"), "") == "" and one(spark, T.clean("x"), None) is None
    assert one(spark, T.clean("x", collapse_newlines=False), "One  line\n\ttwo\x00 lines\n7") == "One line\ntwo lines"


def test_paragraph_dedup(spark):
    given = "short\n\nThis is a paragraph.\n\nthis  IS a paragraph.\n\nshort"
    assert one(spark, T.drop_duplicate_paragraphs("x"), given) == "short\n\nThis is a paragraph.\n\nshort"


def test_unicode(spark):
    assert one(spark, T.display("x"), "“é” — ok… €5​") == '"é" - ok... EUR5'
    assert one(spark, T.to_ascii("x"), "naïve “日”") == 'naive "?"'
    assert one(spark, T.safe_filename("x"), 'a b/c:"é"') == "a_bce" and one(spark, T.safe_filename("x"), "") == "unnamed"
    assert one(spark, T.escape_non_ascii("x"), "aé😀") == "a\\u00e9\\u1f600"
    assert one(spark, T.unescape("x"), "a\\u00e9 é") == "aé é"
    assert one(spark, T.is_ascii("x"), "abc") and not one(spark, T.is_ascii("x"), "é")
    assert one(spark, T.problem_characters("x"), "a—¿é—") == ["¿", "—"]


def test_small_functions(spark):
    assert one(spark, T.word_count("x"), "  two words ") == 2 and one(spark, T.word_count("x"), " ") == 0
    assert one(spark, T.slices("x", 3), "abcdefgh") == ["abc", "def", "gh"] and one(spark, T.slices("x", 3), "") == []
    assert one(spark, T.first_sentences("x", 12), "One. Two two. Three") == "One."
    assert one(spark, T.replace_patterns("x", [r"(a)b"], [r"\1c"]), "abab") == "acac"


def test_header_levels(spark):
    given = ["1.2.3 X", "1.2 X", "3 X", "Chapter IV: A", "Part II", "ALL CAPS", "Title Case", "plain words"]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(given)], "i int, x string").select("i", S.header_level("x").alias("y")).orderBy("i").collect()
    assert [r["y"] for r in rows] == [3, 2, 1, 1, 2, 1, 2, 3]
    assert one(spark, S.is_header("x"), "1. Very long body text. And more.") and not one(spark, S.is_header("x"), "plain words here, with commas")


def test_sentences_and_summary(spark):
    assert one(spark, S.sentences("x"), "A. B! C? d. E") == ["A.", "B!", "C? d.", "E."]
    short = "x" * 60
    assert one(spark, S.summary("x"), short) == short
    text = "Spark reads parquet files quickly. Something else entirely happens here today. Parquet files and parquet readers help parquet users. End of it."
    assert one(spark, S.summary("x", 400), text) == "Spark reads parquet files quickly. Parquet files and parquet readers help parquet users."


def pack_reference(segs, longest, overlap):
    out, cur, size = [], [], 0
    for i, (kind, n) in enumerate(segs):
        if n < 5:
            continue
        if kind != "header" and size + n > longest and cur:
            out.append(cur)
            kept, got = [], 0
            for j in reversed(cur):
                if got >= overlap:
                    break
                if segs[j][0] != "header":
                    kept.insert(0, j)
                    got += segs[j][1]
            cur = kept + [i]
            size = sum(segs[j][1] + 2 for j in cur)
        else:
            cur = cur + [i]
            size += n + 2
    return out + ([cur] if cur else [])


def test_packing_matches_restatement(spark):
    import random

    random.seed(5)
    docs = [[(random.choice(["header", "paragraph", "paragraph"]), random.randint(1, 120)) for _ in range(random.randint(0, 25))] for _ in range(60)]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, s array<struct<type:string,length:int>>")
    got = {r["i"]: r["p"] for r in rows.select("i", S.pack_positions(F.col("s"), 200, 60).alias("p")).collect()}
    for i, d in enumerate(docs):
        assert got[i] == pack_reference(d, 200, 60)


def test_segments_sections_and_rebalance(spark):
    d = spark.createDataFrame([(1, "Chapter I: Start\n\nfirst body text here, long\n\nsecond body, also\n\nChapter II: More\n\nthird body, then")], "doc_id long, text string")
    rows = S.segment_rows(d).orderBy("pos").collect()
    assert [r["type"] for r in rows] == ["header", "paragraph", "paragraph", "section", "header", "paragraph", "section"]
    assert rows[1]["section"] == "Chapter I: Start" and rows[3]["text"] == "first body text here, long\nsecond body, also"
    long = " ".join(f"Sentence number {i} is here." for i in range(60))
    chunks = spark.createDataFrame([(1, 1, long, [0], ["a"], len(long)), (1, 2, "x" * 900, [1], ["b"], 900)], "doc_id long, chunk_no int, text string, segment_pos array<int>, sections array<string>, length int")
    out = S.rebalance(chunks).orderBy("chunk_no").collect()
    assert [r["chunk_no"] for r in out] == list(range(1, len(out) + 1))
    assert " ".join(r["text"] for r in out if r["segment_pos"] == [0]) == long


def test_classification(spark):
    m = lambda name: one(spark, classify.classify_metadata("x", F.lit("PDF document")), name)
    assert (m("technical_manual.pdf")["category"], m("technical_manual.pdf")["confidence"]) == ("technical", 0.8)
    assert (m("contract.pdf")["category"], m("contract.pdf")["confidence"]) == ("unknown", 0.4)
    c = one(spark, classify.classify_content("x"), "law " * 12)
    assert c["category"] in ("legal", "unknown") and 0.4 <= c["confidence"] <= 1
    row = spark.range(1).select(*[classify.combine(*map(F.lit, v)).alias(n) for n, v in {
        "a": ("legal", 0.4, "legal", 0.8), "b": ("legal", 0.4, "technical", 0.7), "c": ("legal", 0.7, "technical", 0.7)}.items()]).first()
    assert (row["a"]["category"], round(row["a"]["confidence"], 6), row["a"]["method"]) == ("legal", 0.6, "combined")
    assert row["b"]["category"] == "technical" and row["b"]["method"] == "content" and row["c"]["method"] == "metadata"
    sizes = spark.createDataFrame([(0.05,), (0.5,), (5.0,), (20.0,), (80.0,)], "mb double").select(classify.size_class(F.col("mb") * 1048576).alias("s")).collect()
    assert [r["s"] for r in sizes] == ["very_small", "small", "medium", "large", "very_large"]
    pairs = [("A b c", "a B C "), ("one two three", "one two"), ("x" * 100, "y" * 79), ("find this", "please find this thing")]
    got = spark.createDataFrame(pairs, "q string, r string").select(classify.accept_rewrite(F.col("q"), F.col("r")).alias("y")).collect()
    assert [r["y"] for r in got] == [False, False, False, True]


def test_metadata(spark):
    text = "TITLE: The Book\nBy: Jane Roe\nPublished by: Some Press\nJanuary 5, 2001\nISBN 978-0-306-40615-7\nSecond edition\nSee figure 3 at https://a.b"
    m = one(spark, metadata.extract_metadata("x", F.lit("2020-01-01").cast("date")), text)
    assert m["title"] == "The Book" and m["author"] == "Jane Roe" and str(m["date"]) == "2001-01-05" and m["isbn"] == "9780306406157"
    assert m["edition"] == "Second edition" and m["publisher"] == "Some Press" and m["multimedia"]["figures"] == 1 and "book" in m["topics"]
    assert one(spark, metadata.language("x"), "the cat and the dog of the house in the garden with the mouse") == "en"
    assert one(spark, metadata.language("x"), "kurz") is None
    empty = one(spark, metadata.extract_metadata("x", F.lit("2020-01-01").cast("date")), "")
    assert empty["title"] == "Unnamed Document" and empty["author"] is None


def test_editions_series_titles_authors(spark):
    """Every listed pattern, in order."""
    from folium.functions import metadata

    editions = {"see v. 2.1 now": "v. 2.1", "an Updated Edition": "Updated Edition", "Edition: 3": "Edition: 3", "the 3 edition": "3 edition", "version2.5": "version2.5",
                "version 3.": "version 3", "fifth edition": "fifth edition", "seventh edition": "seventh edition", "version 2.0, 4th edition": "4th edition", "none": None}
    series = {"Collection: Old Maps, more": "Old Maps", "It is. The Dark Sea series, volume 3": "Dark Sea", "vol. 2 of the Long War, here": "Long War",
              "part of the Big Idea series": "Big Idea", "none": None}
    for column, cases in ((metadata.edition("t"), editions), (metadata.series("t"), series)):
        rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", column.alias("x")).collect()
        assert {r["t"]: r["x"] for r in rows} == cases
    row = spark.createDataFrame([("on rivers:\nMaria Luisa Rossi\nand so on, 2 of 3.",)], "t string").select(metadata.author("t").alias("a")).first()
    assert row["a"] == "Maria Luisa Rossi"
    row = spark.createDataFrame([("12) x\n5) y\n\n   J. R. Roe\n12 rivers",)], "t string").select(metadata.author("t").alias("a")).first()
    assert row["a"] == "J. R. Roe"
    row = spark.createDataFrame([("x1\nA History of Small Rivers:\n by Jane Roe\nmore (text)",)], "t string").select(metadata.title("t").alias("a")).first()
    assert row["a"] == "A History of Small Rivers"
