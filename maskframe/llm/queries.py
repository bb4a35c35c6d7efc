"""The contracts' queries: thin applications of the operators to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..workers import reach
from . import bpe, embed_dedup, fim, html_extract, langid, license_scan, lm_score, mixing, neardup, packing, quality, variants, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than there are cores (a single small file) is dealt out once."""
    df = reach(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def tokenizer_path() -> str:
    """The default of the tokenizer parameter: the installed public vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), spans=False)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op6_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", *quality.STATS, "base_failed", "kept", "score"]
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*cols)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.folder_for(spark)
    packages = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(packages, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def ranks_path() -> str:
    """The default of the rank file: the installed public vocabulary for many languages."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), ranks_path())


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def queries() -> dict:
    named = [op1_html_extract, op2_license_scan, op3_minhash_neardup, op4_language_id, op5_lm_score, op6_bestfit_packing, op7_quality_rules, op8_warc, op9_embedding_neardup, op10_source_mixing, op11_byte_bpe, op12_spelling_variants, op13_fill_in_middle]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op13_fill_in_middle": fim.SQL}
