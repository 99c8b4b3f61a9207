"""From raw documents to a training mix: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet
and reads again for the next one. All but the last return the columns of ``documents``.

Every stage gives an empty table for an empty one, and judges repeated rows alike, each on its own but
for near dedup, which keeps one row of an id. What becomes of nulls is said at each stage.
The stages that hand texts to Python set the session's bound on batches for it, unless it has one; results don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, small_batches
from graphloom.llm.decontaminate import drop_contaminated
from graphloom.llm.line_dedup import RECURRING, dedup_lines
from graphloom.llm.mixing import mix_sources
from graphloom.llm.near_dedup import drop_near_duplicates
from graphloom.llm.quality_rules import quality_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. A null text has no words and fails; a null id is no reason to go."""
    small_batches(spark)
    return quality_rules(docs, _table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of which no line is left go. A null or blank text has no lines and stays."""
    small_batches(spark)
    return dedup_lines(docs, **RECURRING).where("n_dropped = 0 or n_lines > n_dropped").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id. Rows without an id stay, and texts without words are no copies."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A null text holds none, a null item is none."""
    small_batches(spark)
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (copies) and its figures. A null source is a source, the last; a null text has size 0."""
    mixed = mix_sources(docs, carry=docs.columns).where("copies > 0")
    return mixed.select("row.*", "size", "source_size", "target", F.col("copies"), "taken")


STAGES = [("quality rules", keep_quality), ("line dedup", drop_lines), ("near dedup", drop_copies), ("decontamination", drop_benchmark), ("mix", mix)]

#: SQL can't express the trained model of the first stage; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
