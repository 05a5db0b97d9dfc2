"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.llm import chat, langid
from lumensift.llm.common import UPPER, table
from lumensift.llm.decontaminate import leaks
from lumensift.llm.exact_dedup import exact_dedup
from lumensift.llm.html_extract import HOST, extract
from lumensift.llm.licenses import scan_licenses
from lumensift.llm.mixing import Targets, mix, mix_sql
from lumensift.llm.oracles import HTML_SQL, LEAKS_SQL, language_sql
from lumensift.llm.simhash import near_duplicates
from lumensift.llm.substring_dedup import dedup_substrings
from lumensift.llm.token_counts import count_tokens

#: Production weights: three domains, four languages, one source played down; twice-read leaves at most four times.
TARGETS = Targets(
    domains={"web": 50, "books": 30, "code": 20}, languages={"en": 50, "de": 20, "fr": 15, "es": 15}, sources={"src0": 5, "src7": 20},
    domain_of={f"src{k}": ("books" if k < 12 else "code") for k in range(6, 20)},
)

_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], rows.schema)
    return chat.read_back(chat.format_chats(rows.union(extra)))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hamming")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs, "text", "lang", "doc_id"), host=F.col("source"), declared=F.col("lang"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where markup, address and host speak: the main texts of pages, with the text model of the documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    texts = extract(pages.select("page_id", "url", "html", langid.declared_in_markup(F.col("html")).alias("declared")), keep=["declared"])
    host = F.lower(F.regexp_extract("url", HOST, 1))
    return langid.identify(texts, langid.train(docs, "text", "lang", "doc_id"), "page_id", host=host, declared=F.col("declared"), url=F.col("url"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), TARGETS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_language_id": op5_language_id,
        "page_languages": page_languages,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_html_extraction": op8_html_extraction,
        "op9_license_scans": op9_license_scans,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_formatting": rf"""
            WITH c AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
            ), e AS (SELECT *, regexp_replace(text, '{chat.CONTROL}', '\1\\\2\3', 'g') AS et, regexp_replace(role, '{chat.CONTROL}', '\1\\\2\3', 'g') AS er FROM c)
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   sum(length(er) + length(et) + {len(chat.TURN + chat.TEXT + chat.END)})::BIGINT AS formatted_chars
            FROM e GROUP BY conv_id""",
        "op3_benchmark_decontamination": LEAKS_SQL,
        "op5_language_id": language_sql(langid.Settings()),
        "page_languages": language_sql(langid.Settings(), pages=True),
        "op8_html_extraction": HTML_SQL,
        "op6_exact_dedup": f"""
            WITH d AS (SELECT doc_id, sha256({_LOWER}) AS s FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
            FROM d""",
        "op7_substring_dedup": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            tok AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
            win AS (SELECT *, string_agg(t, ' ') OVER x AS g, count(*) OVER x AS c FROM tok WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
            late AS (SELECT *, c = 13 AND min(doc_id) OVER (PARTITION BY g, c) < doc_id AS late FROM win),
            cov AS (SELECT doc_id, i, t, max(CASE WHEN late THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM late),
            s AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(t, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM cov GROUP BY doc_id)
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
        "op10_mixing": mix_sql(TARGETS),
    }
