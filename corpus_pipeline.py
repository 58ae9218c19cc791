"""From documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs.  When a stage starts, the tables that earlier stages kept in the shared
folder are deleted, but for those that its docs still read (stages chained without a write between).

1. quality classifier: documents with a score under the threshold go.
2. n-gram Jaccard join: of documents alike in 0.8 of their five-word shingles, one stays.
3. suffix-array dedup: passages of 200 bytes and more that are elsewhere too are cut out.
4. mixing: every document is read at least once, those of small sources up to 1.5 times.
5. packing: pieces of sequences of 1024 tokens.

Defined results: a null text counts as empty; it is scored like any other, is no document's copy, has nothing to cut,
is read as often as its source is, and packs as its end token alone.  Of repeated rows one stays; of near copies the one with the
least id (null ids last), then of the least hash of its columns.  How rows are dealt out decides nothing.
Texts of any length are taken whole.  An empty table gives an empty result at every stage.  Columns other than
the documents' own are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from libgauge.llm import mixing, ngram_join, packing, quality_classifier, suffix_dedup
from libgauge.llm.common import Workspace

#: Workspaces whose tables earlier stages' results read.
_EARLIER: list[Workspace] = []


def _stage(body):
    """A stage first deletes what the stages before it kept, unless its docs read it; what it opens itself is
    noted for the next."""

    @functools.wraps(body)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        still = [work for work in _EARLIER if work.read_by(docs)]
        for work in _EARLIER:
            if work not in still:
                work.close()
        _EARLIER[:] = still
        before = list(Workspace.live)
        try:
            return body(spark, docs, sf_dir)
        finally:
            _EARLIER.extend(work for work in Workspace.live if work not in before)

    return run_stage


@_stage
def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, quality_classifier.fit_table(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


@_stage
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good_documents),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("suffix_array_dedup", cut_repeated_passages),
    ("temperature_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express a trained score, suffix sorting or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = written.save(stage(spark, docs, sf_dir), f"{k}_{name}")
    return docs
