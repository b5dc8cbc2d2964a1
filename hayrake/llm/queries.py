"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrake.llm import decontam, langid, linededup, media, neardup, packing, pii, quality, urlfilter, warc
from hayrake.session import table, work_path


RULES = [urlfilter.rule(*x.split()) for x in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return linededup.remove_boilerplate(docs, "source", counts=True).drop("source")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), work_path(spark, "warc"))
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    return warc.read_archives(spark, manifest).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "source", "lang")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    said = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.filter("spans", lambda s: s["kind"] != pii.TERM)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    digest = F.sha2(F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), 256)
    return found.select("doc_id", *map(count, pii.KINDS), digest.alias("base_sha256"), F.array_join(said, ",").alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_media(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, similarity=0.8)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_best_fit_packing, op3_language_id, op4_line_dedup, op5_warc,
        op6_quality_classifier, op7_pii, op8_decontamination, op9_media_columns, op10_minhash_near_dedup,
    )
}

ORACLE_SQL = {
    "op4_line_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS site, text FROM documents),
l AS (SELECT doc_id, site, unnest(str_split(text, chr(10))) AS line, unnest(range(len(str_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
spread AS (SELECT line, min(doc_id) AS owner FROM l WHERE strlen(line) >= {linededup.MIN_BYTES} GROUP BY line HAVING count(DISTINCT site) >= {linededup.MIN_SITES}),
marked AS (SELECT l.doc_id, l.line, pos, spread.line IS NOT NULL AND NOT (l.doc_id = owner AND pos = min(pos) OVER (PARTITION BY l.doc_id, l.line)) AS gone
           FROM l LEFT JOIN spread ON l.line = spread.line)
SELECT d.doc_id, CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') END AS text,
       count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM d LEFT JOIN marked USING (doc_id) GROUP BY d.doc_id""",
    "op8_decontamination": r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS g
          FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, grams.m AS m, p FROM grams JOIN win ON grams.m = win.m AND grams.g = win.g),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
}
