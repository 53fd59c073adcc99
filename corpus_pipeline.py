"""The training-data pipeline: stages in order, each a function of (spark, docs, sf_dir).

Each stage takes all its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

import public_tokenizers

from foliomill.llm import bpe, jaccard, mixing, pii, quality
from foliomill.llm.common import read_table, written
from foliomill.llm.queries import MANY_VOCABULARY


def quality_rules(spark, docs, sf_dir):
    """Drops the documents that the risk-controlled rules reject."""
    return quality.keep_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """Keeps, of each component of similar documents, the one with the smallest id."""
    return jaccard.one_of_each(docs)


def personal_data(spark, docs, sf_dir):
    """Replaces personal data in each text by its kind; n_chars follows."""
    return pii.redact(docs, pii.train(docs))


def source_mix(spark, docs, sf_dir):
    """Repeats or drops documents so that sources come near their target weights."""
    return mixing.repeat_documents(docs)


def encode_tokens(spark, docs, sf_dir):
    """The columns of documents with tokens, n_tokens and whether the ids decode to the text."""
    return bpe.with_tokens(docs, MANY_VOCABULARY, public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing", source_mix), ("byte-level BPE", encode_tokens)]

#: No SQL expresses the stages with hashed orders and fitted models; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; each stage's table is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
