"""The queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import conversations, decontamination, jaccard, licenses, manifest, mixing, oracles, pii, quality, secrets, sharding, tokens, topk, toxicity
from skein.llm.common import table
from skein.llm.labels import fold

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document (toxicity.toxicity)."""
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _judged(scored, folds=5, held_out=0)


def _judged(scored: DataFrame, *, folds: int, held_out: int) -> DataFrame:
    more = [c for c in scored.columns if c not in ("doc_id", "score")]
    return scored.select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document (licenses.scan_licenses)."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("matches")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best products of every fiftieth vector (topk.top_inner_products)."""
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document (quality.with_quality)."""
    docs = table(spark, sf_dir, "documents")
    space = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return _judged(quality.with_quality(docs.select("doc_id", "text"), space).drop("text"), folds=3, held_out=1)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document (decontamination.find_passages)."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.find_passages(docs.select("doc_id", "text"), items).drop("item_ids", "text_key")


#: A public vocabulary whose words guessers know; None leaves the built-in
#: words, and a file that is not there is an error.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def op6_secret_scan(spark: SparkSession, sf_dir: str, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """Secret spans of every document (secrets.scan_secrets), as counts and digests."""
    words = secrets.vocabulary_words(vocabulary) if vocabulary else ()
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), words=words)

    def of(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(of("guess")).cast("long").alias("n_guess"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 16 shards (sharding.interleaved_shards)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # The text's size and checksum are all that is shuffled.
    return sharding.interleaved_shards(docs).drop("text")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents (jaccard.near_duplicates)."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes from every document (mixing.mix)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.blank_word_count(F.col("text")).alias("n_words"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key")
    )
    mixed = mixing.mix(docs, member=F.array("source"), size=F.col("n_words"), identity=[F.col("doc_id"), F.col("text_key")])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


#: The query's key is public; whoever needs secrecy passes another.
SURROGATE_KEY = "skein surrogate key 1"


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced (pii.pseudonymize)."""
    done = pii.pseudonymize(table(spark, sf_dir, "documents"), key=SURROGATE_KEY)
    spans = F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["start"].cast("string"), e["end"].cast("string")))
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(spans, ",").alias("spans"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation (conversations.repair_conversations)."""
    return conversations.repair_conversations(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document (manifest.merkle_manifest)."""
    return manifest.merkle_manifest(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Tokens of every document (tokens.count_tokens) by a public tokenizer."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer)


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_toxicity,
            op2_license_scan,
            op3_exact_top_k,
            op4_quality_classifier,
            op5_benchmark_decontamination,
            op6_secret_scan,
            op7_sharding,
            op8_ngram_jaccard_join,
            op9_source_mixing,
            op10_pii_surrogates,
            op11_conversation_repair,
            op12_merkle_manifest,
            op13_token_counts,
        )
    }


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
