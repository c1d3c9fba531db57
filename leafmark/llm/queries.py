"""The registered queries: each operator over its whole table, with the digests its contract asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import bagminhash, bpe, descent, hosts, language, lattice, licences, mixing, pii, prefix_trie, recipes, strata, syncmers
from leafmark.llm.common import table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def document_path():
    """Where a document would lie: source, language, and a folder for every hundred ids."""
    folder = F.floor(F.col("doc_id") / 100).cast("string")
    return F.concat_ws("/", *[F.coalesce(c, F.lit("_")) for c in (F.col("source"), F.col("lang"), folder, F.col("doc_id").cast("string"))])


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("path", document_path())
    return licences.scan(docs, ["doc_id"])


def op2_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents"), ["doc_id"]))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), ["doc_id"], digest=True)


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op7_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(language.training(docs))
    found = language.identify(docs, model, ["doc_id"])
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op9_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descent.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source")


def op11_euler_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.grafted_trie(table(spark, sf_dir, "conversations")).drop("enter_at", "exit_at")


def op12_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op13_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_licences,
        op2_hosts,
        op3_pii,
        op4_bagminhash,
        op5_bpe,
        op6_lattice,
        op7_recipes,
        op8_language,
        op9_descent,
        op10_cube,
        op11_euler_trie,
        op12_syncmers,
        op13_strata,
    )
}
