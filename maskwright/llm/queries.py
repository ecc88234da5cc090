"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, importance, language_id, near_dedup, neighbours, packing, quality, sampling, secrets, substring_dedup, token_count, toxicity, warc
from .scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 35 words that occur more than once are removed; digest of what is kept."""
    out = substring_dedup.remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the documents at four-word shingles and similarity 0.8."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op3_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens; a digest of each piece's ids."""
    out = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of all documents, decoded again; digests of the pieces and of both texts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    out = sampling.decode_pieces(sampling.encode_sampled(docs, keep=("text_sha256",)))
    ids = F.coalesce("pieces", F.array().cast("array<int>"))
    return out.select("doc_id", F.size(ids).cast("long").alias("n_pieces"), F.xxhash64(ids).alias("pieces_hash"), "text_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule votes weighed by expectation-maximisation over all documents."""
    out = quality.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in the documents: each distinct content is scanned once for each rule and its findings joined back.

    A first scan knows the base rules only; the second, with all rules, scans the new ones alone
    (second_pairs counts its blobs and rules) and has the rest from the ledger.
    """
    docs, ledger = _table(spark, sf_dir, "documents"), Scratch(spark).path("ledger")
    secrets.scan_versions(docs, ledger, rules=secrets.BASE_RULES)
    first = secrets.pairs_scanned(spark, ledger)
    out = secrets.scan_versions(docs, ledger)
    second = secrets.pairs_scanned(spark, ledger) - first
    base = F.filter("_spans", lambda s: s["rank"] < len(secrets.BASE_RULES))

    def count(kind: str):
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(r.kind) for r in secrets.BASE_RULES]
    pairs = [F.lit(first).cast("long").alias("first_pairs"), F.lit(second).cast("long").alias("second_pairs")]
    return out.select("doc_id", *n, F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("_spans")).alias("spans"), *pairs)


def op7_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest by inner product to each vector whose id is divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op8_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages written as WARC archives and read back, one row per capture with what its request and metadata records say."""
    path = Scratch(spark).path("warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    c = F.col("capture")
    kind = c["kind"]
    out = warc.read_captures(spark, path, with_payload=False)
    told = F.col("metadata.fields")
    return out.select(
        warc.page_id_of(c["record_id"]).alias("page_id"), c["payload_bytes"].alias("payload_bytes"), c["payload_digest"].alias("payload_digest"), kind.alias("record_type"),
        warc.page_id_of(c["refers_to"]).alias("refers_to"), F.sha2(F.substring_index(F.col("request.fields")["message"], "\r\n", 1), 256).alias("request_line_sha256"),
        told["page-id"].cast("long").alias("metadata_page_id"), told["payload-length"].cast("long").alias("metadata_payload_bytes"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_count.count_tokens(_table(spark, sf_dir, "documents"))


def op11_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by the dictionaries learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers aligned over all documents, with the corpus-wide counts of each document's links."""
    return alignment.Alignment(_table(spark, sf_dir, "documents")).documents


def op13_importance_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of documents by hashed n-grams towards the texts of benchmark; every document's weight and rank."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_minhash_dedup, op3_cost_packing, op4_sampled_pieces, op5_quality_votes, op6_secret_ledger, op7_prefix_forest, op8_toxicity_trees, op9_warc_transactions, op10_token_counts, op11_compression_language, op12_token_alignment, op13_importance_ring)}
