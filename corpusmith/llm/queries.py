"""The queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmith.functions.shared import drop_written, written

from . import bpe, decontaminate, hmm, language_id, quality_rules, quotes, simhash, suffix_array, url_filter, zip_warc


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def abuse_terms(spark: SparkSession, sf_dir: str) -> list[str]:
    return [*quality_rules.INSULTS, *quality_rules.toxic_terms(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered_urls(_t(spark, sf_dir, "pages"))


#: The ledger that an application stored last, by directory.
_LEDGERS: dict[tuple[str, str], DataFrame] = {}


def stored_ledger(spark: SparkSession, sf_dir: str, anew: bool = False) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if anew or key not in _LEDGERS:
        if key in _LEDGERS:
            drop_written(_LEDGERS[key])
        _LEDGERS[key] = written(quality_rules.ledger(_t(spark, sf_dir, "documents"), abuse_terms(spark, sf_dir)), "ledger")
    return _LEDGERS[key]


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policies(stored_ledger(spark, sf_dir, anew=True))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablation(stored_ledger(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return language_id.identified(docs, language_id.train(docs))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_t(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model_scores(_t(spark, sf_dir, "documents"))


def lm_training_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.training_history(_t(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_passages(_t(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(_t(spark, sf_dir, "conversations"))


def chat_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(quotes.quoting(_t(spark, sf_dir, "conversations")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_t(spark, sf_dir, "documents"))


def op10_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_warc.round_trip(_t(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_url_filter, op2_quality_rules, quality_ablation, op3_lm_scoring, lm_training_history, op4_decontamination, op5_language_id, op6_simhash, op7_suffix_array, op8_chat_formatting, chat_quotation_links, op9_bpe, op10_zip_warc)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.policies_sql(),
        "quality_ablation": quality_rules.ablation_sql(),
        "op4_decontamination": decontaminate.contaminated_sql(),
        "op7_suffix_array": suffix_array.runs_sql(),
        "op8_chat_formatting": quotes.reply_ordered_sql(),
        "chat_quotation_links": quotes.quoting_sql(),
        "op10_zip_warc": zip_warc.RECORDS_SQL,
    }
