"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kiln.llm import bpe
from kiln.llm.common import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@register("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.llm.token_count import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), bpe.vocabulary("byte_bpe_50k.json"))


@register("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), bpe.vocabulary("byte_bpe_50k.json"), length=1024, end_id=2)


@register("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.llm.secrets import scan
    return scan(table(spark, sf_dir, "documents"), bpe.vocabulary("byte_bpe_50k.tiktoken"))


@register("op7_token_matrix")
def op7_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.llm.matrices import token_matrix
    return token_matrix(table(spark, sf_dir, "documents"), bpe.vocabulary("byte_bpe_50k.json"))


@register("op3_pu_quality")
def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.llm import pu_quality
    docs = table(spark, sf_dir, "documents")
    return pu_quality.score(docs, pu_quality.train(docs, table(spark, sf_dir, "labels")))


@register("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.llm import quality_rules
    docs = table(spark, sf_dir, "documents")
    return quality_rules.score(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


@register("op6_document_fingerprints")
def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.llm.fingerprint import edited_likeness
    return edited_likeness(table(spark, sf_dir, "documents"))


@register("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.llm import language
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


@register("op8_jaccard_join")
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.llm.jaccard import link_components
    return link_components(table(spark, sf_dir, "documents"))


@register("op1_bpe_roundtrip")
def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.llm.chunk_bpe import encode_decode
    return encode_decode(table(spark, sf_dir, "documents"), bpe.vocabulary("word_bpe_49k.json"))


@register("op11_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.llm.exact_dedup import group_copies
    return group_copies(table(spark, sf_dir, "documents"))


@register("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.llm import conversation_repair
    return conversation_repair.repair_report(conversation_repair.damage(table(spark, sf_dir, "conversations")))


@register("op13_lexical_search", """
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
tot AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM len),
norm AS (SELECT doc_id, 25 + (75 * n * nd) // l AS m FROM len, tot),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, tot GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN norm USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.llm.lexical_search import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
