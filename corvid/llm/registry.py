"""The queries opN_<name> over the whole tables, and their SQL where SQL can state them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import common, cotraining, decision_list, decontaminate, lattice, lbl, simhash, token_rollup, toxicity, url_rules, wrappers
from corvid.llm.common import read


def op1_lbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    found = lbl.scores(read(spark, sf_dir, "documents"), common.remainder(F.col("id"), 7) == 2, F.pmod(F.floor(crc / 7), F.lit(8)))
    return found.withColumnRenamed("id", "doc_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_rules.judge(read(spark, sf_dir, "pages"), url_rules.HOST_RULES + url_rules.PATTERN_RULES)
    return found.withColumnRenamed("id", "page_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.encode(read(spark, sf_dir, "documents"), lattice.load()).withColumnRenamed("id", "doc_id")


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = decision_list.fit(docs, read(spark, sf_dir, "labels"))
    rows, stats, kept = decision_list.judged(docs.select("doc_id", "text"), rules)
    s = F.col(stats)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *(s[k].alias(k) for k in base), decision_list.base_failed(s).alias("base_failed"), kept.alias("kept"))


def op6_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.texts(read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_sha256(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _toxicity_model(spark: SparkSession, sf_dir: str):
    return toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), common.remainder(F.col("id"), 3) != 1)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scores(read(spark, sf_dir, "documents"), _toxicity_model(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), (common.remainder(F.col("id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = cotraining.fit(docs, read(spark, sf_dir, "labels"), common.remainder(F.col("id"), 5) != 1)
    found = cotraining.scores(docs, model)
    return found.select(F.col("id").alias("doc_id"), (common.remainder(F.col("id"), 5) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).alias("kept"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted with their words as a first count, then revised to token counts. They are
    inserted once more and deleted again, which cancels out. Each batch is sent twice, the second time in vain, with a
    compaction between the two."""
    docs = read(spark, sf_dir, "documents")
    rollup = token_rollup.Rollup(spark, f"{common.folder(spark)}/rollup-{uuid.uuid4().hex}")
    words = docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.lit("ascii_words").alias("tokenizer_version"), F.size(common.words_of(F.col("text"))).cast("long").alias("n_tokens"))
    counted = token_rollup.token_counts(docs)
    revised = counted.withColumns({"old_version": F.lit("ascii_words"), "old_tokens": F.col("n_words")})
    for _ in range(2):
        rollup.commit("load", token_rollup.inserts(words))
        rollup.commit("revise", token_rollup.revisions(revised))
        rollup.compact()
        rollup.commit("load-again", token_rollup.inserts(words))
        rollup.commit("delete", token_rollup.deletes(words))
    return rollup.totals()


QUERIES = {
    "op1_lbl": op1_lbl,
    "op2_simhash": op2_simhash,
    "op3_url_rules": op3_url_rules,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decision_list": op5_decision_list,
    "op6_wrappers": op6_wrappers,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_cotraining": op9_cotraining,
    "op10_token_rollup": op10_token_rollup,
}

_BLOCKED = "ads|adserver|ads-track|banner|doubleclick|tracker|casino|casino-win|free-bets|gambling|poker|adult|adult-x|porn|xxx|spam|spam-farm|cheap-pills|viagra|malware|phishing|warez"

ORACLES: dict[str, str] = {
    "op3_url_rules": f"""
        WITH cut AS (SELECT page_id, lower(coalesce(url, '')) AS low, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        rules(rule, rhost, rpath, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'block'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
        fits AS (SELECT page_id, host, path, low, (SELECT arg_max(r, length(r.rule)) FROM rules r WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)) AS best FROM parts p)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN regexp_matches(low, '(?:^|[^a-z0-9])(?:{_BLOCKED})(?:[^a-z0-9_%.-]|[.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict FROM fits""",
    "op7_decontaminate": """
        WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        long_w AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, 10 AS n FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM item WHERE len(w) >= 10)),
        short_w AS (SELECT DISTINCT item_id, array_to_string(w, ' ') AS win, len(w) AS n FROM item WHERE len(w) BETWEEN 1 AND 9),
        win AS (SELECT * FROM long_w UNION ALL SELECT * FROM short_w),
        sizes AS (SELECT DISTINCT n FROM win),
        place AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
        hit AS (SELECT rid, place.n, i, item_id FROM place JOIN win ON place.win = win.win AND place.n = win.n),
        per AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY rid),
        its AS (SELECT rid, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN per USING (rid) LEFT JOIN its USING (rid)""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
