"""The registered queries opN_<name> of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import licences, lm, minhash, packing, pieces, records, rules, secrets, simhash, toolcalls
from quarry.llm.common import documents, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the documents labelled as of good quality."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return lm.cross_entropy_difference(documents(spark, sf_dir), good)


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, null ones as empty, as ids in record files, and what these hold by their index."""
    folder = records.write(documents(spark, sf_dir), tokenizer())

    ids = F.col("ids")
    return records.read(spark, folder).select("doc_id", "start", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best licence match of every whole text, its place, and the number of segments that match."""
    rows = licences.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "licence", "dice", "line", "n_matches")


def op4_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness; null texts count as empty."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = minhash.with_next(minhash.fingerprints(docs), ["text", "signature"])
    both = rows.withColumn("edited", minhash.edited(F.col("text"), F.col("next_text"))).withColumn("edited_signature", minhash.signature(F.col("edited")))
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        minhash.packed(F.col("edited_signature")).alias("edited_fingerprint"),
        minhash.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        minhash.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text, and the least doc_id that links of 3 bits lead to."""
    rows = simhash.near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every whole text: their number, a checksum, and whether decoding gives the text back."""
    import public_tokenizers

    rows = pieces.encode(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), verify=True)
    ids = F.col("piece_ids")
    return rows.select("doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_pieces"), F.crc32(ids).alias("ids_crc32"), "lossless")


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn is taken as a call of a tool, with turn and text as arguments; what the assistant says next is its result.

    By (3 conv_id + turn) modulo 10, a call needs that of the user turn after it (0, 1, 3, 6 to 9) or before it
    (2, which closes a circle with 0), or nothing. Every fourth turn is called twice over. Some arguments
    lack the text, have a turn of the wrong type or one argument too many.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = lambda turn: F.concat_ws("-", F.lit("call"), "conv_id", turn)
    turn, kind = F.col("turn"), F.pmod(3 * F.col("conv_id") + F.col("turn"), F.lit(10))
    fault = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7))
    arguments = (
        F.when(fault == 1, F.to_json(F.struct("turn")))
        .when(fault == 2, F.to_json(F.struct(turn.cast("string").alias("turn"), "text")))
        .when(fault == 3, F.to_json(F.struct("turn", "text", F.lit(True).alias("urgent"))))
        .otherwise(F.to_json(F.struct("turn", "text")))
    )
    after = F.when(kind.isin(0, 1, 3, 6, 7, 8, 9), F.array(name(turn + 2))).when(kind == 2, F.array(name(turn - 2)))
    twice = F.explode(F.when(F.pmod(F.col("conv_id") + turn, F.lit(4)) == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("n")
    calls = turns.filter("role = 'user'").select("conv_id", "turn", twice, name(turn).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    params = "array(struct('text' as name, 'string' as type, true as required, cast(array() as array<string>) as options), struct('turn' as name, 'integer' as type, true as required, cast(array() as array<string>) as options))"
    tools = spark.range(1).select(F.lit("reply").alias("name"), F.expr(params).alias("params"))
    linked = toolcalls.link(calls, results, tools)
    return linked.select("conv_id", "call_id", "turn", F.col("place.turn").alias("place"), "step", "cyclic", "status", "n_results", F.size("errors").alias("n_errors"), "message")


def op8_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: counts by base kind, a digest of the base spans, and all spans."""
    rows = secrets.scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return rows.select("doc_id", *counts, F.sha2(secrets.joined(F.col("spans"), base=True), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, null ones as empty, as token pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), tokenizer())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole text, and the verdicts of the base rules and of the cutoffs of its language and source."""
    judged = rules.judge(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), carry_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    from quarry.llm import sql

    return {"op3_licence_scan": sql.OP3, "op7_tool_calls": sql.OP7, "op10_quality_rules": sql.OP10}
