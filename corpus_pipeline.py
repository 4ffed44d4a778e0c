"""A corpus pipeline: each stage calls an operator of postmill.llm, is written, and read by the next."""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postmill.llm import mixing, quality, simhash, substrings, tokens  # noqa: E402
from postmill.llm.common import load, settle  # noqa: E402
from postmill.llm.queries import TARGETS, labelled_languages  # noqa: E402
from postmill.session import ship  # noqa: E402

#: Below this score a document is rejected; lower than a label's threshold, to keep clean text.
REJECTED_BELOW = 0.4


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: rejected documents go. Null and empty texts have a score like any other;
    repeated rows are judged alike; an empty table stays one."""
    ship(spark)
    return quality.accepted(docs, quality.fit(docs, load(spark, sf_dir, "labels")), REJECTED_BELOW)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of texts whose fingerprints (three words) are linked by two bits or fewer, the
    document with the smallest doc_id stays.

    Of rows without a doc_id, those stay whose group has no id at all, one text of each group; rows
    equal in doc_id and text are one. Texts without words (null, empty) are one group."""
    ship(spark)
    return simhash.first_of_groups(docs)


def own_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages that stand in an earlier place too are cut out of the texts. A null or
    wordless text has none; rows equal in doc_id and text count as one document; no row goes."""
    ship(spark)
    return substrings.without_repeats(docs)


def balanced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are taken as often as the rates for the target weights say. Texts without
    words have the rate of the prior; rows of one doc_id are separate documents."""
    ship(spark)
    return mixing.mixed(docs, labelled_languages(spark, sf_dir, docs), TARGETS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: doc_id, n_tokens and the ids of every text, and the SHA-256 of the bytes that
    the ids decode to; fails where these are not the text's."""
    ship(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    made = tokens.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"], offsets=False, decoded=True)
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", good_text),
    ("simhash near-dedup", one_of_each),
    ("substring dedup", own_passages),
    ("mixing", balanced),
    ("byte-level bpe", token_ids),
]
#: SQL has no word for dictionaries, SimHash components or fitted rates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written as Parquet and read again."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
