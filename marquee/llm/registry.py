"""Registered queries of the corpus operators, each over its whole table, and their SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.media import describe_texts

    return describe_texts(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marquee.llm.bpe import encode_digests

    return encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.lines import dedup_lines

    kept = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.iblt import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.substrings import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents")).drop("kept")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.secret_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.toxicity import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.runs import run_digests

    return run_digests(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marquee.llm.align import alignments

    return alignments(_table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marquee.llm.idfiles import pack_ids

    return pack_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_bpe": op2_bpe,
    "op3_licenses": op3_licenses,
    "op4_line_dedup": op4_line_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_secrets": op7_secrets,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_runs": op11_runs,
    "op12_alignment": op12_alignment,
    "op13_token_files": op13_token_files,
}


def _sql() -> dict[str, str]:
    from marquee.llm.licenses import scan_sql

    return {"op3_licenses": scan_sql()}


SQL: dict[str, str] = _sql()
