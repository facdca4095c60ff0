"""The registered queries of the corpus operators: each applies one operator to its whole table and digests what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocate, decontaminate, language, pages, personal, pieces, resample, simhash, sketch, substrings, toxicity, warc, wavelet
from .common import bucket_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_model(path: str | None = None) -> bytes:
    with open(path or _public("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@query
def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = pieces.encode(docs, piece_model(), decoded=True)
    return got.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.element_at("ends", -1).cast("long").alias("n_bytes"),
    )


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    net = toxicity.train(docs, labels.where(bucket_of(F.col("doc_id"), 4) != 2))
    return toxicity.score(docs, net).select(
        "doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal.find(docs, personal.train(docs))
    counts = [F.regexp_count("base_spans", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in personal.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(index).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "fits")


@query
def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compared(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = language.scores(docs, bucket_of(F.col("doc_id"), 5) != 1, piece_model())
    return got.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(_public("byte_bpe_50k.json"), encoding="utf-8") as f:
        index = wavelet.write(table(spark, sf_dir, "documents").select("doc_id", "text"), f.read(), end=2)
    return wavelet.read(index)


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocate.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


@query
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = resample.draw(docs, table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")
