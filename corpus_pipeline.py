"""A training corpus in five stages: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows below the shared
folder and reads them again as the next one's input. All but the last return the columns they were given.

Cases: null and wordless texts are scored like any other, are near copies of each other, hold no benchmark passage and are not
taken by the mix. A null doc_id comes last among near copies; a null source is a source of its own. Rows equal in doc_id and
text are copies, of which one stays; of equal rows that come to the mix all or none are taken. Very long texts are read whole.
Tables without rows pass through all stages. Columns besides those named in a stage stay, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import Scratch, free, text_key, without, words
from terrane.llm.decontaminate import contaminated
from terrane.llm.mixing import apply_plan, mixing_plan, sizes_of
from terrane.llm.sharding import shard
from terrane.llm.simhash import one_of_each
from terrane.llm.toxicity import fit, score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned on the labelled rows outside the held-out fold, calls toxic go."""
    model = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(spark, docs, model, docs.columns, below=0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies (five-word shingles, similarity 0.8) the least doc_id stays."""
    return one_of_each(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all of a shorter one, go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    marks = Scratch(spark, "stage").write(contaminated(spark, docs, items).select("k1", "k2"))
    return without(docs, marks, text_key(F.col("text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: its certain copies, and one more if it is sampled."""
    scratch = Scratch(spark, "stage")
    plan = mixing_plan(scratch, scratch.write(sizes_of(docs)))
    row = free(docs, "row")
    whole = docs.select(F.struct(*docs.columns).alias(row), "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    times = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return apply_plan(whole, plan).where("copies > 0").select(row, times).select(f"{row}.*")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of 24 shards of nearly equal bytes, copies together."""
    return shard(spark, docs).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The trained classifier and the similarity search have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
