"""The registered queries of the subpackage: each operator over its whole table, and the pipeline."""

from pyspark.sql import functions as F

from linesieve.llm import (bpe, chat, decontaminate, html_text, lm, negatives, packing, quality, secret_scan, simhash, substring, topk,
                           variants)
from linesieve.llm.common import read_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_html_extraction(spark, sf_dir):
    return html_text.extract(read_table(spark, sf_dir, "pages"), "html", ["page_id", "url"])


def op2_byte_bpe(spark, sf_dir):
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"),
                                  "text", ["doc_id"])


def op3_secret_scan(spark, sf_dir):
    return secret_scan.scan(read_table(spark, sf_dir, "documents"), "text", ["doc_id"])


def op4_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")).drop("uid")


def op5_quality_rules(spark, sf_dir):
    return quality.judge(read_table(spark, sf_dir, "documents"), "text", ["doc_id"])


def op6_lm_scoring(spark, sf_dir):
    return lm.score(read_table(spark, sf_dir, "documents"))


def op7_chat_format(spark, sf_dir):
    planted = spark.sql("""SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text
                           FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)""")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    made = chat.conversations(chat.chain(rows)).withColumn("turns", chat.read_turns(F.col("formatted")))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    return made.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op8_simhash(spark, sf_dir):
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_exact_top_k(spark, sf_dir):
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op10_substring_dedup(spark, sf_dir):
    cut = substring.deduplicate(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    left = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    return cut.select("doc_id", "_cut.n_words", "_cut.n_removed", F.sha2(F.trim(left), 256).alias("kept_sha256"))


def op11_hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0",
                                    "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")


def op12_decontamination(spark, sf_dir):
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


def op13_spelling_variants(spark, sf_dir):
    return variants.variants(read_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def registry():
    return {f.__name__: f for f in (
        op1_html_extraction, op2_byte_bpe, op3_secret_scan, op4_packing, op5_quality_rules, op6_lm_scoring, op7_chat_format,
        op8_simhash, op9_exact_top_k, op10_substring_dedup, op11_hard_negatives, op12_decontamination, op13_spelling_variants, pipeline)}
