"""From documents to tokens: five stages, each a step of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's documents:

1. language ID: documents without a letter, or whose language stays open
   (calibrated score under 0.3, or 3-grams that are not those of the predicted
   language), go;
2. exact dedup: of equal texts the row with the smallest doc_id stays;
3. n-gram Jaccard join (five words, 0.8): of each component of near
   duplicates one document stays;
4. mixing sources to target weights: a document's words as often as the mix
   takes them, a row for each pass, other documents go;
5. BPE encoding and decoding: doc_id, n_tokens, ids and the decoded text.

Stages 1 to 4 return the columns of ``documents``, extra ones too. Null and
empty texts go in stage 1; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dbpulse.llm.bpe import encode_documents
from dbpulse.llm.common import cut
from dbpulse.llm.exact_dedup import drop_copies
from dbpulse.llm.lang_id import keep_identified
from dbpulse.llm.mixing import mixed_documents
from dbpulse.llm.ngram_join import keep_one_of_each
from dbpulse.sources.tables import load_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, k=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, digests=False)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mix", source_mix),
    ("bpe", bpe),
]

# The classifier, the near duplicates' components and the mix have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
