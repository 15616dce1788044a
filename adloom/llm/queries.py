"""Each operator applied to its whole table, with the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm import bpe, chat, imatch, language, lexical, neighbours, oracle, packing, pii, repeats, simhash, sketches, substrings, warc
from adloom.llm.common import ship, small_batches

#: The key under which the registered queries permute personal data. A deployment passes its own.
KEY = "adloom-demonstration-key"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, rows.where("vec_id % 100 = 0"), 10)


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(table(spark, sf_dir, "documents"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language.learn(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    return language.identify(docs, learned, ["doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")])


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = chat.format_chats(rows.unionByName(more)).withColumn("back", chat.parse(F.col("formatted")))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    chats = chats.withColumn("loss", loss)
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 4096, 1)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.summary(spark, warc.archive(table(spark, sf_dir, "pages"), least_bytes=0))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, pattern, ["doc_id"])
    n = (F.octet_length("ids") / 4).cast("long")
    encoded = encoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    decoded = bpe.decode(encoded, path, pattern, ["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def looped(doc_id: Column, text: Column) -> Column:
    """Every tenth text by the hash of its doc_id, made to go round: from some word on its words repeat a number of times."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[ \x09-\x0D]+"), "")
    n = F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    round_ = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(words, 1, a.cast("int")), F.slice(round_, 1, (n - a).cast("int"))), " ")
    return F.when((h % 10 == 0) & text.rlike(r"[^ \x09-\x0D]"), made).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text"))
    found = repeats.collapse(docs)
    by_exponent = lambda x, y: F.coalesce(F.nullif(F.signum(y["length"] * x["period"] - x["length"] * y["period"]), F.lit(0.0)), F.nullif(F.signum(x["start"] - y["start"]), F.lit(0.0)), F.signum(x["period"] - y["period"])).cast("int")
    best = F.get(F.array_sort("runs", by_exponent), 0)
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")), F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.join(table(spark, sf_dir, "documents"))


def op13_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_neighbours, op2_pseudonyms, op3_imatch, op4_language, op5_passages, op6_chats, op7_packing, op8_warc, op9_bpe, op10_simhash, op11_runs, op12_jaccard, op13_nra, pipeline)
    return {f.__name__: f for f in own}


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + 1 + length('<|im_start|>') + length('<|im_end|>') + 1 + length(
    CASE WHEN regexp_replace(text, '<\\(\\*)\|', '<\1|', 'g') = text AND NOT contains(text, '<|im_start|>') AND NOT contains(text, '<|im_end|>')
         THEN text ELSE regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') END) AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id, alone
"""



def oracle_sql() -> dict[str, str]:
    return {"op6_chats": OP6_SQL, "op11_runs": oracle.OP11_SQL, "op12_jaccard": oracle.OP12_SQL, "op13_nra": oracle.OP13_SQL}
