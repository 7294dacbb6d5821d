"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from parapet.llm import byte_bpe, langid, lloyd, mixing, neighbours, packing, passages, pseudonyms, quality, sharding, simhash, turns, wrappers
from parapet.llm.common import table

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pseudonym_key(spark) -> bytes:
    """The key set for the session, or the example key."""
    key = spark.conf.get("parapet.pseudonym.key", None)
    return key.encode() if key else pseudonyms.EXAMPLE_KEY


def op1_hyperdimensional_languages(spark, folder):
    return langid.predict(table(spark, folder, "documents"))


def op2_wrapper_text(spark, folder):
    return wrappers.extract(table(spark, folder, "pages"))


def op3_ring_shards(spark, folder):
    placed = sharding.shard(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_robust_outliers(spark, folder):
    return quality.judged(table(spark, folder, "documents")).drop("distance")


def op5_simhash_groups(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op6_source_mix(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


def op8_best_fit_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op10_feistel_pseudonyms(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, pseudonym_key(spark), count="n_values")


def op7_projected_neighbours(spark, folder):
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_repeated_passages(spark, folder):
    return passages.deduplicated(table(spark, folder, "documents"))


def op11_streamed_repair(spark, folder):
    given = table(spark, folder, "conversations")
    return turns.repaired_conversations(turns.damaged(given), of=given)


def op12_prefix_byte_bpe(spark, folder):
    from public_tokenizers import PATTERN

    path = tokenizer_path(RANKS)
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, folder, "documents"), path, PATTERN), path)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op13_sharded_lloyd(spark, folder):
    found, centroids = lloyd.cluster(table(spark, folder, "embeddings"), dimension=64)
    return lloyd.report(found, centroids)


QUERIES = {
    f.__name__: f
    for f in (
        op1_hyperdimensional_languages, op2_wrapper_text, op3_ring_shards, op4_robust_outliers,
        op5_simhash_groups, op6_source_mix, op7_projected_neighbours, op8_best_fit_packing,
        op9_repeated_passages, op10_feistel_pseudonyms, op11_streamed_repair,
        op12_prefix_byte_bpe, op13_sharded_lloyd,
    )
}
