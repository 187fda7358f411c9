"""One query per operator, applied with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, decontaminate, filter_audit, hnsw, language_id, merkle, odd_sketch, packing, sharding, simhash, substring_dedup, suffix_dedup, token_output
from quarry.llm.tokenizing import byte_bpe_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def held_out(doc_id):
    """Documents that language models never learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    models = language_id.train(docs.where(~held_out(F.col("doc_id"))))
    found = language_id.classify(docs, models)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "nats_per_char", "rejected")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("spans").cast("long").alias("n_spans"),
        F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)").alias("n_repeated"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), " ").alias("spans"),
    )


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_output.write_tokens(_table(spark, sf_dir, "documents"), token_output.new_folder(spark), vocabulary=byte_bpe_path())
    return token_output.read_index(written)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens", "group_pieces")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_index(_table(spark, sf_dir, "documents"), vocabulary=byte_bpe_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    done = chat.format_chats(turns.unionByName(more)).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.read_loss(F.col("segments")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "in_order",
    )


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("bits")).alias("fingerprint"), "component_id")


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return hnsw.search(hnsw.build_index(vectors), vectors.where("vec_id % 100 = 0"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = merkle.leaf(*parts[:3], parts[3] + 1, parts[4])
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, tampered)
    found = merkle.manifest(docs, carry={"changed": changed})
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("path"))
    found = found.withColumns({"proof_sha256": merkle.proof_digest(F.col("path")), "folded_root": folded})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = odd_sketch.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", odd_sketch.kept(F.col("doc_id"), F.col("component_id")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = filter_audit.cells(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return filter_audit.audit(cells, "ABCDE")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_language_id,
        op3_suffix_array_dedup,
        op4_token_output,
        op5_decontamination,
        op6_sharding,
        op7_packing,
        op8_chat_formatting,
        op9_simhash_near_dedup,
        op10_hnsw,
        op11_merkle_manifest,
        op12_odd_sketch_near_dedup,
        op13_filter_audit,
    )
}
