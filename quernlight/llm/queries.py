"""The contract queries: thin layers over the operators, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annulus, licenses, minhash, projections, secrets, vector_codes
from .shared import read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_vectors(read(spark, sf_dir, "embeddings"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import shared_passages

    return shared_passages(read(spark, sf_dir, "documents"))


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_encode

    return bpe_encode(
        read(spark, sf_dir, "documents"),
        tokenizer_path("word_bpe_49k.json"),
        emit=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens, load_pieces

    return count_tokens(read(spark, sf_dir, "documents"), load_pieces(tokenizer_path("piece_bpe_32k.model")))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_digests, store_texts

    return media_digests(store_texts(read(spark, sf_dir, "documents")), "doc_id", "media", more=("n_bytes",))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, letter_pieces

    return identify(read(spark, sf_dir, "documents"), letter_pieces(tokenizer_path("piece_bpe_32k.model")))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.cluster(read(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings")).drop("label")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_digests, write_tokens

    return token_digests(spark, write_tokens(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


# --- what SQL can say of op9 and op10 ------------------------------------------------
def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 reads back from its containers, as far as SQL can tell it."""
    return op9_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 by source: its target, and whether the words taken meet it to one word."""
    from .mixing import mix

    by = mix(read(spark, sf_dir, "documents")).groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return by.select("source", "source_size", F.round("target", 6).alias("target"), (F.abs(F.col("taken") - F.col("target")) <= 1).alias("met"))


PAYLOADS = """
SELECT doc_id, strlen(t) AS n_bytes, strlen(p) AS payload_bytes, sha256(p) AS payload_sha256
FROM (SELECT doc_id, t, t || repeat(' ', (greatest(1, (strlen(t) + 191) // 192) * 192 - strlen(t))::BIGINT) AS p FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""
#: Targets as one water level over the sources, sorted by cap over weight.
TARGETS = r"""
WITH s AS (SELECT source, sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS n FROM documents GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, n * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place,
  (sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT min_by(level, place) AS v FROM l WHERE cap / w >= level)
SELECT source, n::BIGINT AS source_size, round(least(cap, coalesce(w * v, cap)), 6)::DOUBLE AS target, true AS met FROM l, v
"""

QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_embedding_near_dedup, op3_license_scans, op4_minhash_near_dedup, op5_substring_dedup, op6_bpe_encoding, op7_language_id, op8_token_counts, op9_media_columns, op10_source_mixing, op11_centroid_clustering, op12_vector_codes, op13_token_files, media_payloads, mixing_targets)}
ORACLE_SQL: dict[str, str] = {
    "op1_secret_scans": secrets.ORACLE,
    "op2_embedding_near_dedup": projections.ORACLE,
    "op3_license_scans": licenses.oracle(),
    "op4_minhash_near_dedup": minhash.ORACLE,
    "op11_centroid_clustering": annulus.oracle(),
    "op12_vector_codes": vector_codes.oracle(),
    "media_payloads": PAYLOADS,
    "mixing_targets": TARGETS,
}
