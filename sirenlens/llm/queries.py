"""The registered queries: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenlens.llm import chat, decontaminate, html, jaccard, langid, lines, mixing, tokenids, tokens, trie, vectors, warc, whitening
from sirenlens.llm.common import prepared, table
from sirenlens.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(prepared(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own: the figures of a run are those of an empty cache."""
    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    return tokens.count_tokens(table(spark, sf_dir, "documents"), cache)


@query("op4_line_dedup", lines.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(table(spark, sf_dir, "documents"), host="source")
    return out.select("doc_id", "text", "n_lines", "n_dropped")


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_to_targets(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op7_ngram_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, benchmark)


@query("op10_near_vectors")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op1_main_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


@query("op5_chat_format")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


@query("op8_warc")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = warc.write_archives(pages, warc.archive_folder(pages))
    return warc.read_archives(files)


@query("op13_token_ids")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    files = tokenids.write_ids(table(spark, sf_dir, "documents"), folder)
    return tokenids.read_digests(files)


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null where a long is too narrow for the deviation, which the operator gives in 38 digits."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query("op11_prefix_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
