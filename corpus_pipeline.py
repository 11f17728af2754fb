"""The corpus pipeline: toxic documents go, near copies go, leaked test items go, sources are mixed, rows are sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewatch.llm import decontaminate, mixing, sharding, toxicity
from zonewatch.llm.common import lookup_side, read_table
from zonewatch.llm.near import near_components
from zonewatch.llm.queries import held_out
from zonewatch.session import materialize, release, tables_made


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Rows scored below the threshold stay."""
    labels = read_table(spark, sf_dir, "labels")
    model = toxicity.train(docs.filter(~held_out("doc_id")), labels.filter(~held_out("doc_id")))
    return model.score(docs, name="toxic_score_").filter(F.col("toxic_score_") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. Of each component the document with the smallest id stays. Where ids are null or
    repeated, row numbers (in the order of the rows' values) stand in for them."""
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("k")).first()
    named, key = docs, "doc_id"
    if ids["n"] != ids["k"]:
        named, key = materialize(sharding.numbered(docs, "row_id_")[0]), "row_id_"
    gone = near_components(named, id_col=key).filter(F.col(key) != F.col("component_id")).select(key)
    return named.join(lookup_side(gone), key, "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9. Documents that hold a test item go."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. Documents stand as often in the result as the mix takes them."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. All rows, with shard and slot."""
    return sharding.feistel_shards(docs)


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks),
          ("mixing sources to target weights", mix_sources), ("sharding", shard)]
#: The first stage fits a model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage wrote on its way, and what it read, is deleted once its result is written."""
    docs, written = read_table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with tables_made() as made:
            kept = materialize(stage(spark, docs, sf_dir))
        release(*written, *[t for t in made if t is not kept])
        docs, written = kept, [kept]
    return STAGES[-1][1](spark, docs, sf_dir)


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write what `run` returns, and leave nothing else behind in the shared folder."""
    with tables_made() as made:
        run(spark, sf_dir).write.parquet(path)
    release(*made)
