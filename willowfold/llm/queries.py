"""The queries of the corpus operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from willowfold.llm import byte_bpe, conversation, exact_dedup, langid, license_scan, multi_index, packing, pitman_yor, reshard, simhash, spelling, warc, wavelet
from willowfold.sources.tables import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout has a shard for each hash of the source, so that one holds a third of the rows or more."""
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(reshard.OLD_SHARDS))
    found = reshard.reshard(_table(spark, sf_dir, "documents"), old)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks), ranks)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    segments = wavelet.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return wavelet.read_digests(segments)


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(_table(spark, sf_dir, "pages")))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(_table(spark, sf_dir, "documents"))


def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.log_probabilities(_table(spark, sf_dir, "documents"), ~pitman_yor.held_out())


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return conversation.reported(conversations, conversation.damage(conversations))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.of_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_language_id, op3_exact_dedup, op4_reshard, op5_byte_bpe, op6_wavelet, op7_multi_index, op8_warc_derivatives, op9_best_fit, op10_license_scan, op11_pitman_yor, op12_conversation_repair, op13_spelling_variants)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.ORACLE, "op7_multi_index": multi_index.ORACLE, "op8_warc_derivatives": warc.oracle(), "op12_conversation_repair": conversation.ORACLE, "op13_spelling_variants": spelling.ORACLE}
