"""The registered queries: each applies one operator, with production
parameters, to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.llm import pii, secrets
from errata.llm.alignment import alignment_measures
from errata.llm.jaccard import jaccard_components
from errata.llm.mixing import mix_sources, taken
from errata.llm.packing import pack
from errata.llm.quality import quality_rules
from errata.llm.recount import count_trees, recount
from errata.llm.registry import query, table
from errata.llm.repair import damage, repair_conversations
from errata.llm.sketches import fingerprints
from errata.llm.tokenfiles import read_tokens, token_digests, write_tokens
from errata.llm.toolcalls import link_tool_calls
from errata.llm.toxicity import toxicity_scores
from errata.session import scratch_path


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality counts and the divergence verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op1_ngram_jaccard")
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingle sets of every document and the components of links at 0.8."""
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal-data spans of every document."""
    return pii.digest_columns(pii.find_pii(table(spark, sf_dir, "documents")))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.digest_columns(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query("op6_drr_packing")
def op6_drr_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 4096 tokens, without the ids."""
    return pack(table(spark, sf_dir, "documents")).drop("ids", "row_key")


@query("op5_source_mix")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return taken(*mix_sources(table(spark, sf_dir, "documents"))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "shards")


@query("op10_iblt_fingerprints")
def op10_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints(table(spark, sf_dir, "documents"))


@query("op9_toxic_lexicon")
def op9_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that are not held out."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


TOOL_SCHEMAS = [
    ("search", '{"type":"object","required":["query","limit"],"additionalProperties":false,"properties":'
               '{"query":{"type":"string","minLength":20},"limit":{"type":"integer","minimum":1,"maximum":50}}}'),
    ("translate", '{"type":"object","required":["text"],"properties":{"text":{"type":"string","maxLength":2000},"lang":{"enum":["de","en","fr"]}}}'),
]


def tool_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stand-in calls and results: assistant turns call a tool with their text;
    by a hash of it a quarter of them depend on the call two turns later (a cycle
    where that one depends on them), a quarter on none and the others on the call
    two turns before.  User turns answer the turn before."""
    name_of = F.concat(F.lit("call-"), F.col("turn").cast("string"))
    calls = conversations.where("role = 'assistant'").select(
        "conv_id", name_of.alias("call_id"), "turn", F.expr("CASE pmod(length(text), 3) WHEN 0 THEN 'search' WHEN 1 THEN 'translate' ELSE 'lookup' END").alias("name"),
        F.expr("""CASE WHEN pmod(length(text), 3) = 0 THEN to_json(named_struct('query', text, 'limit', pmod(length(text), 60)))
                  ELSE to_json(named_struct('text', text, 'lang', 'en')) END""").alias("arguments"),
        F.expr("""CASE crc32(coalesce(text, '')) % 4 WHEN 0 THEN array(concat('call-', turn + 2)) WHEN 1 THEN CAST(array() AS array<string>)
                  ELSE array(concat('call-', turn - 2)) END""").alias("depends_on"))
    results = conversations.where("role = 'user'").select(
        "conv_id", F.expr("concat('call-', turn - 1)").alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


@query("op3_tool_call_links")
def op3_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls linked to results, ordered, validated and serialised."""
    calls, results = tool_calls(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, spark.createDataFrame(TOOL_SCHEMAS, "name string, schema string"))


@query("op7_edit_recount")
def op7_edit_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after two edits: its second
    quarter's first 40 characters give way to its first 25, and its last 30 go."""
    state = count_trees(table(spark, sf_dir, "documents"))
    edits = F.expr("""array(struct(length(text) div 4 AS start, length(text) div 4 + 40 AS stop, left(text, 25) AS text),
                            struct(greatest(0, length(text) - 50) AS start, CAST(NULL AS int) AS stop, '' AS text))""")
    return recount(state.withColumn("edits", edits))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level and a sentence-piece tokenizer over every document."""
    return alignment_measures(table(spark, sf_dir, "documents"))


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after the damage drawn for its rows."""
    return repair_conversations(damage(table(spark, sf_dir, "conversations")))


@query("op13_orc_token_files")
def op13_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to ORC files in id order and read back."""
    path = scratch_path(spark, "orc-tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digests(read_tokens(spark, path))
