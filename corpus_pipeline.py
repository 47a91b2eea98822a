"""A corpus in five stages, each an operator of quaystone.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import decontaminate, language, mixing, ngram_join, sharding
from quaystone.llm.shared import small, written
from quaystone.session import table

#: A document with less of its text in one language than this is rejected, and so is one without a letter.
LEAST_LANGUAGE_SHARE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is mostly in one learned language. A null text and
    one without a letter go; where no row has a lang, nothing is learned and
    all go. A null doc_id is learned from and judged like others; repeated rows
    are judged alike; an empty table stays empty; all columns stay, whatever
    their names."""
    name = "_language"
    while name in docs.columns:
        name += "_"
    labelled = language.identify(docs, language.remainder(4) != 2, spans=False, name=name)
    return labelled.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_LANGUAGE_SHARE)).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the least id, null ids last; of rows that
    share it, that of the least hash of the text, of equal rows any one.
    Documents without words are in no group and stay. Rows are told apart by a
    number written with them, not by id. A text of any length is compared
    whole; an empty table stays empty; all columns stay, whatever their names."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("hash"), F.struct("*").alias("doc")), "rows")
    found = written(ngram_join.jaccard_components(rows.select(F.col("row").alias("doc_id"), "doc.text")), "components")
    linked = found.where("n_links > 0").select(F.col("doc_id").alias("row"), "component_id")
    named = written(linked.join(rows.select("row", "doc.doc_id", "hash"), "row"), "named")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "row")).alias("k")).select("k.row")
    dropped = written(named.join(kept, "row", "left_anti").select("row"), "dropped")
    return rows.join(small(dropped), "row", "left_anti").select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, by at least 80 % of its shingles.
    Null and wordless texts hold none and stay; ids are not looked at; repeated
    rows are judged alike; an empty table stays empty; all columns stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target weight draws them, in
    one global order. A null source is one of its own; a null doc_id draws by
    the hash of the text; rows that share an id draw alike; an empty table
    stays empty; all columns stay, whatever their names."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot. Null texts count a byte, null ids
    come first, every repeated row has a slot of its own; an empty table stays
    empty; own columns named shard or slot are replaced, all others stay."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the Jaccard components and the learned languages.
ORACLE_SQL = None
