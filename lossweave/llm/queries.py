"""The operators over the given tables with their production parameters: one query each, and SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bottomk, fertility, infill, jaccard, licenses, lm, mixing, nbsvm, packing, secrets, sharding, simhash
from .common import remainder, table

SHARDS = 40


def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assignments(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op2_simhash_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op3_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = nbsvm.scored(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "fallback_share", "token_entropy", "rejected_by",
    )


def op5_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bottomk.with_next(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", bottomk.edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_sketch", bottomk.sketch(F.col("edited")))
    own, new = F.col("sketch"), F.col("edited_sketch")
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        bottomk.encoded(own).alias("fingerprint"), bottomk.encoded(new).alias("edited_fingerprint"),
        bottomk.resemblance(own, new).alias("near_edited"), bottomk.resemblance(own, F.col("next_sketch")).alias("near_next"),
        bottomk.containment(own, new).alias("contained_in_edited"), bottomk.distinct_shingles(own).alias("distinct_shingles"),
    )


def op6_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), F.col("draws.shard").alias("shards")
    )


def op7_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op8_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("certain", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(secrets.joined_text(F.col("certain")), 256).alias("base_sha256"), secrets.joined_text(F.col("spans")).alias("spans"),
    )


def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), with_groups=False).withColumn("doc_id", F.col("doc_id").cast("long"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.restored(infill.transformed(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (
    op1_jump_shards, op2_simhash_tries, op3_nbsvm_quality, op4_tokeniser_fertility, op5_bottom_k,
    op6_mixing_tree, op7_gru_scores, op8_linked_secrets, op9_license_digests, op10_best_fit_packing,
    op11_token_alignment, op12_fill_in_middle, op13_jaccard_join,
)}

ORACLE: dict[str, str] = {
    "op12_fill_in_middle": r"""
        with texts as (
            select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h,
                regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
            from documents
        ),
        drawn as (
            select *, len(u) as n, [cast('0x' || substr(h, 1 + 8 * k, 8) as bigint) for k in range(4)] as d from texts
        ),
        formed as (
            select *, least(d[1] % (n + 1), d[2] % (n + 1)) as lo, greatest(d[1] % (n + 1), d[2] % (n + 1)) as hi,
                case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or d[3] % 100 >= 50 then 'plain'
                    when d[4] % 100 < 80 then 'spm' else 'psm' end as form
            from drawn
        ),
        cut as (
            select *, array_to_string(u[1:lo], '') as p, array_to_string(u[lo + 1:hi], '') as m, array_to_string(u[hi + 1:], '') as s from formed
        )
        select doc_id, n, form,
            case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
            sha256(t) as restored_sha256
        from cut
    """,
}
