"""The registered queries: each operator over its whole table, reduced to comparable columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm import (
    bpe,
    chat,
    fim,
    lexical,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    spotsigs,
    substring_dedup,
    suffix_tree,
    warc,
)
from flowmill.llm.columns import words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words(F.col("text")), " "), 256).alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    saying = "</s>[INST] ok [/INST]"
    more = [(-7, 0, "user", saying), (-7, 1, "assistant", saying)]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(more, "conv_id long, turn long, role string, text string"))
    return chat.digest(chat.read_examples(chat.expand(chat.render(turns))))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["ord"] < len(secret_scan.BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = suffix_tree.suffix_tree_scores(docs, _remainder(5) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _remainder(4) == 2
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spotsigs.compare_edits(table(spark, sf_dir, "documents"))
    own = F.col("signatures")
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(own).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        spotsigs.jaccard(own, F.col("edited_signatures")).alias("near_edited"),
        spotsigs.jaccard(own, F.col("next_signatures")).alias("near_next"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    full = F.col("record_type") == "response"
    return found.select(
        warc.key_of(F.col("record_id")).cast("long").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(full, warc.base32_sha1(F.col("payload"))).otherwise(F.regexp_extract("payload_digest", "^sha1:(.*)$", 1)).alias("payload_digest"),
        "record_type",
        warc.key_of(F.col("refers_to")).cast("long").alias("refers_to"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_chat_format,
        op3_secret_scan,
        op4_suffix_tree,
        op5_bpe,
        op6_near_dedup,
        op7_quality_classifier,
        op8_quality_rules,
        op9_packing,
        op10_spotsigs,
        op11_lexical_search,
        op12_warc,
        op13_fill_in_middle,
        pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op11_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
 s AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
 tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY ALL),
 w AS (SELECT t, CAST(floor(1000*ln(CAST(2*n_docs+2 AS DOUBLE)/(2*count(*)+1))) AS BIGINT) AS w FROM tf, s GROUP BY t, n_docs),
 m AS (SELECT r, doc_id, 100-75+((75*len(ts)*n_docs) // n_terms) AS m FROM d, s WHERE len(ts) > 0),
 i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark WHERE text IS NOT NULL),
 q AS (SELECT i, item_id, t, count(*) AS c FROM (SELECT i, item_id, unnest(ts) AS t FROM i) GROUP BY ALL),
 x AS (SELECT i, item_id, r, doc_id, CAST(sum(c*w*((1000000000*tf) // (1000*tf+8*m))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 10""",
    "op12_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS largest FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(x, 5*(i // 4)+1, 5) AS BIGINT) >> (15 - 5*(i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to FROM q""",
    "op13_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS s FROM documents),
 e AS (SELECT *, string_split(t, chr(10)) AS lines, CASE WHEN t = '' THEN 0 ELSE len(t) - len(replace(t, chr(10), '')) + CASE WHEN ends_with(t, chr(10)) THEN 0 ELSE 1 END END AS n,
    CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
 f AS (SELECT *, least(h1 % (n+1), h2 % (n+1)) AS x, greatest(h1 % (n+1), h2 % (n+1)) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e),
 g AS (SELECT *, CASE WHEN x = n THEN t ELSE array_to_string(lines[1:x], chr(10)) || CASE WHEN x > 0 THEN chr(10) ELSE '' END END AS a,
    CASE WHEN y = n THEN t ELSE array_to_string(lines[1:y], chr(10)) || CASE WHEN y > 0 THEN chr(10) ELSE '' END END AS b FROM f),
 h AS (SELECT *, a AS pre, substr(b, len(a)+1) AS mid, substr(t, len(b)+1) AS suf FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM h""",
}
