"""One query for each corpus operator, with production parameters, over whole tables; and its DuckDB SQL where there is one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cueloom.llm import bpe, chat, exact_dedup, mixing, pii, secret_scan, simhash, telephony, toxicity, url_filter
from cueloom.llm.common import LOWER, UPPER, table

def vocabulary() -> str:
    """The vocabulary file of op4: CUELOOM_VOCABULARY, or the word_bpe_49k.json of the installed public_tokenizers."""
    if path := os.environ.get("CUELOOM_VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]
#: Hosts that are blocked where no rule fits.
DENIED = ["cheap-pills.example.com", "spam-farm.example.org"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, RULES, DENIED).select("page_id", "host", "path", "rule", "verdict")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), ids=False)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    saying = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", saying), (-7, 1, "assistant", saying)], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    read = made.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.summarise(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_pii": op5_pii,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_chat_format": op8_chat_format,
    "op9_secret_scan": op9_secret_scan,
    "op10_telephony": op10_telephony,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": rf"""
        WITH u AS (SELECT page_id,
                          translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
             r AS (SELECT *, CASE
                          WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
                          WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
                          WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
                          WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
                          WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM u)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                    WHEN ('.' || host) LIKE '%.cheap-pills.example.com' OR ('.' || host) LIKE '%.spam-farm.example.org' THEN 'block'
                    ELSE 'allow' END AS verdict FROM r""",
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
             g AS (SELECT *, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op6_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                          substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 16) AS mix_key FROM documents),
             s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
             w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
             o AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS whole, sum(weight) OVER () AS weights,
                          coalesce(sum(2 * source_size) OVER b, 0) AS caps, coalesce(sum(weight) OVER b, 0) AS gone
                   FROM w WINDOW b AS (ORDER BY 2 * source_size / weight::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
             c AS (SELECT *, (whole - caps) * weight / (weights - gone) > 2 * source_size AS above FROM o),
             t AS (SELECT source, source_size, CASE WHEN above THEN 2.0::DOUBLE * source_size
                          ELSE (whole - sum(CASE WHEN above THEN 2 * source_size ELSE 0 END) OVER ()) * weight::DOUBLE
                               / (weights - sum(CASE WHEN above THEN weight ELSE 0 END) OVER ()) END AS target FROM c),
             p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
                          coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mix_key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
                          CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
                   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - ahead)) AS BIGINT) AS taken FROM p""",
    "op8_chat_format": r"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
             e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS body, length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS name,
                          lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens FROM r)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
               CAST(sum(body) + sum(CASE WHEN opens THEN 24 + name ELSE 8 END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
}
