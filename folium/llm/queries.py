"""Registered queries of this subpackage: thin digests over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folium.llm import exact_dedup, flac, html_extract, jaccard, licenses, lm_score, mixing, packing, preference, quality
from folium.session import table


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and the rejected side of pair k."""
    turns = table(spark, sf_dir, "conversations").withColumn("pair_id", F.floor(F.col("conv_id") / 2).cast("long"))
    pairs = preference.format_preferences(turns.where("conv_id % 2 = 0 OR conv_id IS NULL"), turns.where("conv_id % 2 <> 0"))
    return pairs.select(
        "pair_id", "prompt_turns", "prompt", "chosen", "rejected", preference.spans_text(F.col("chosen_spans")).alias("chosen_spans"),
        preference.spans_text(F.col("rejected_spans")).alias("rejected_spans"), "complete", "same",
    )


OP1_SQL = """
WITH t AS (SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, CASE WHEN conv_id % 2 <> 0 THEN 1 ELSE 0 END AS side,
                  turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
same AS (SELECT pair_id, i, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS eq FROM n GROUP BY pair_id, i),
lcp AS (SELECT pair_id, coalesce(min(i) FILTER (NOT eq) - 1, max(i)) AS shared FROM same GROUP BY pair_id),
r AS (SELECT n.*, shared, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS whole FROM n JOIN lcp USING (pair_id)),
o AS (SELECT *, sum(CASE WHEN i > shared THEN length(whole) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY i)
             - length(whole) + length(role) + 5 AS start FROM r)
SELECT pair_id, CAST(max(shared) AS BIGINT) AS prompt_turns,
       coalesce(string_agg(whole, '' ORDER BY i) FILTER (side = 0 AND i <= shared), '') AS prompt,
       coalesce(string_agg(whole, '' ORDER BY i) FILTER (side = 0 AND i > shared), '') AS chosen,
       coalesce(string_agg(whole, '' ORDER BY i) FILTER (side = 1 AND i > shared), '') AS rejected,
       coalesce(string_agg(start || '-' || (start + length(text) + 7), ',' ORDER BY i)
                FILTER (side = 0 AND i > shared AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(start || '-' || (start + length(text) + 7), ',' ORDER BY i)
                FILTER (side = 1 AND i > shared AND role = 'assistant'), '') AS rejected_spans,
       count(*) FILTER (side = 0) > 0 AND count(*) FILTER (side = 1) > 0 AS complete,
       count(*) FILTER (i > shared) = 0 AS same
FROM o GROUP BY pair_id
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: every 16th of a folder is its LICENSE, every 256th one level up, every 4096th two."""
    n = F.col("doc_id")
    level = lambda size: F.floor(n / size).cast("string")
    path = (
        F.when(n % 4096 == 0, F.concat_ws("/", "source", F.lit("LICENSE")))
        .when(n % 256 == 0, F.concat_ws("/", "source", level(256), F.lit("LICENSE")))
        .when(n % 16 == 0, F.concat_ws("/", "source", level(256), level(16), F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", F.col("source"), level(256), level(16), F.concat(n.cast("string"), F.lit(".txt"))))
    )
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(files).drop("text")


OP4_SQL = licenses.oracle("""
SELECT doc_id, text, concat_ws('/', source,
       CASE WHEN doc_id % 4096 = 0 THEN 'LICENSE'
            WHEN doc_id % 256 = 0 THEN (doc_id // 256) || '/LICENSE'
            WHEN doc_id % 16 = 0 THEN (doc_id // 256) || '/' || (doc_id // 16) || '/LICENSE'
            ELSE (doc_id // 256) || '/' || (doc_id // 16) || '/' || doc_id || '.txt' END) AS path
FROM documents""")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: All pairs that share a shingle, by a join on the shingle, and what is reached over links.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
              ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM c JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(x, y) AS (SELECT r, r FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM w JOIN reach ON reach.x = w.r JOIN w o ON o.r = reach.y LEFT JOIN n ON n.r = w.r GROUP BY w.r, w.doc_id
"""


def op5_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.round_trip(table(spark, sf_dir, "documents"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extract(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents as two batches (by a hash of doc_id): a snapshot, and what came in later."""
    documents = table(spark, sf_dir, "documents").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    return exact_dedup.dedup(documents, "part", 2).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(pieces).drop("row")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def preference_shared_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its last turn's text turned round: the turns before it are the prompt."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = turns.groupBy("pair_id").agg(F.max("turn").alias("last"))
    other = turns.join(last, "pair_id").withColumn("text", F.when(F.col("turn") == F.col("last"), F.reverse("text")).otherwise(F.col("text"))).drop("last")
    pairs = preference.format_preferences(turns, other)
    return pairs.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", preference.spans_text(F.col("chosen_spans")).alias("chosen_spans"))


PREFERENCE_SHARED_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS whole,
             '<|' || role || '|>' || chr(10) || reverse(text) || '<|end|>' || chr(10) AS turned, i < n OR text = reverse(text) AS shared FROM t)
SELECT conv_id AS pair_id, CAST(count(*) FILTER (shared) AS BIGINT) AS prompt_turns, coalesce(string_agg(whole, '' ORDER BY i) FILTER (shared), '') AS prompt,
       coalesce(string_agg(whole, '') FILTER (NOT shared), '') AS chosen, coalesce(string_agg(turned, '') FILTER (NOT shared), '') AS rejected,
       coalesce(string_agg((length(role) + 5) || '-' || (length(role) + 5 + length(text) + 7), '') FILTER (NOT shared AND role = 'assistant'), '') AS chosen_spans
FROM r GROUP BY conv_id
"""


def _license_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, eight to a folder two levels deep; a folder's first that speaks of a licence is its LICENSE."""
    d = table(spark, sf_dir, "documents")
    top, folder = F.floor(F.col("doc_id") / 64).cast("string"), F.floor(F.col("doc_id") / 8).cast("string")
    speaks = F.when(F.contains(F.lower("text"), F.lit("licen")), F.col("doc_id"))
    first = lambda size: F.min("speaks").over(Window.partitionBy(F.floor(F.col("doc_id") / size)))
    told = d.select("doc_id", "text", speaks.alias("speaks")).select("doc_id", "text", first(64).alias("of_top"), first(8).alias("of_folder"))
    path = (
        F.when(F.col("doc_id") == F.col("of_top"), F.concat(top, F.lit("/LICENSE")))
        .when(F.col("doc_id") == F.col("of_folder"), F.concat_ws("/", top, folder, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", top, folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    )
    return told.select("doc_id", path.alias("path"), "text")


def license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who inherits what from where, in a tree where most files have a licence above them."""
    return licenses.scan(_license_tree(spark, sf_dir)).select("doc_id", "path", "own_license", "license", "inherited_from")


LICENSE_INHERITANCE_SQL = "SELECT doc_id, path, own_license, license, inherited_from FROM (" + licenses.oracle("""
SELECT doc_id, text, CASE WHEN doc_id = of_top THEN (doc_id // 64) || '/LICENSE' WHEN doc_id = of_folder THEN (doc_id // 64) || '/' || (doc_id // 8) || '/LICENSE'
            ELSE (doc_id // 64) || '/' || (doc_id // 8) || '/' || doc_id || '.txt' END AS path
FROM (SELECT doc_id, text, min(CASE WHEN contains(lower(text), 'licen') THEN doc_id END) OVER (PARTITION BY doc_id // 64) AS of_top,
             min(CASE WHEN contains(lower(text), 'licen') THEN doc_id END) OVER (PARTITION BY doc_id // 8) AS of_folder FROM documents)""") + ")"


def payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 stores and reads back, without the stored form."""
    return op5_flac(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOAD_SQL = r"""
WITH p AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, encode(coalesce(text, '')) AS raw FROM documents),
q AS (SELECT *, CASE WHEN n_bytes = 0 THEN 64 ELSE (64 - n_bytes % 64) % 64 END AS pad FROM p)
SELECT doc_id, n_bytes, n_bytes + pad AS payload_bytes, sha256(raw || unhex(repeat('00', CAST(pad AS INTEGER)))) AS payload_sha256 FROM q
"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's words and target, and whether what is taken comes within two of its longest documents of it."""
    mixed = op9_mix_sources(spark, sf_dir)
    near = F.abs(F.sum("taken") - F.max("target")) <= 2 * F.max("size")
    return mixed.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.round(F.max("target"), 3).alias("target"), near.alias("near"), (F.max(F.col("taken") - 2 * F.col("size")) <= 0).alias("bounded")
    )


#: Sources fill up one after another, the tightest first: a prefix sum over cap by weight.
MIX_TARGETS_SQL = r"""
WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight, 2.0 * size AS cap FROM s),
l AS (SELECT *, ((SELECT sum(size) FROM s) * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT max(level) FILTER (cap / weight >= level) AS water FROM l)
SELECT source, size AS source_size, round(CAST(least(cap, coalesce(water * weight, cap)) AS DOUBLE), 3) AS target, true AS near, true AS bounded FROM l, f
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_exact_dedup": op10_exact_dedup,
    "pipeline": pipeline,
    "op1_preference_format": op1_preference_format,
    "op4_license_scan": op4_license_scan,
    "op2_quality": op2_quality,
    "op6_html_main_text": op6_html_main_text,
    "op3_jaccard_join": op3_jaccard_join,
    "op5_flac": op5_flac,
    "op7_lm_score": op7_lm_score,
    "op8_pack_sequences": op8_pack_sequences,
    "op9_mix_sources": op9_mix_sources,
    "preference_shared_turns": preference_shared_turns,
    "license_inheritance": license_inheritance,
    "payload_digests": payload_digests,
    "mix_targets": mix_targets,
}

ORACLE_SQL: dict[str, str] = {
    "op1_preference_format": OP1_SQL,
    "op4_license_scan": OP4_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op3_jaccard_join": OP3_SQL,
    "preference_shared_turns": PREFERENCE_SHARED_SQL,
    "license_inheritance": LICENSE_INHERITANCE_SQL,
    "payload_digests": PAYLOAD_SQL,
    "mix_targets": MIX_TARGETS_SQL,
}
