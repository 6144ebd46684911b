"""The corpus pipeline: STAGES in order over documents, each a written table that the next one reads.

Every stage but the last returns the columns of documents, whatever else they hold; ``run`` applies them to the documents of a
folder. A stage first writes its input with a number for each row and reads both from there ever after: numbers are made
once, so a verdict falls on exactly the row it was made for, whatever becomes of executors, splits or parallelism between two
jobs, and also where ids are null or repeat. Stages read doc_id, text and (mixing) lang alone; other columns come along under
any name. When a stage has its numbered input, what earlier stages worked on is deleted: their results are written by then.

In all stages: null and empty texts are clean, linked with nothing, and have no tokens; very long texts are read whole; an empty table gives
an empty table.

SQL cannot express the classifiers, the fitted rates and the tokenizer, so ORACLE_SQL is None; each stage is tested against a
brute-force version of its rows instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.decontamination import contamination
from postmill.llm.mixing import mix_to_targets
from postmill.llm.neardup import near_duplicates
from postmill.llm.queries import TOKENIZER, domains_of
from postmill.llm.records import token_records
from postmill.llm.shared import delete, scratch
from postmill.llm.toxicity import score_toxicity


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Folders that stages read while their result is made: numbered inputs, and in ``run`` the results themselves."""

    paths: list[str] = []

    @classmethod
    def new(cls, spark: SparkSession, name: str) -> str:
        cls.paths.append(scratch(spark, name.replace(" ", "-")))
        return cls.paths[-1]

    @classmethod
    def drop(cls, spark: SparkSession, but: str) -> None:
        for path in [x for x in cls.paths if x != but]:
            delete(spark, path)
            cls.paths.remove(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row in a column whose name none of the others has, as a written table: a number that is
    made anew in a later job may differ, one that is read never does."""
    name = "row_number_"
    while name in docs.columns:
        name += "_"
    path = Scratch.new(docs.sparkSession, "numbered")
    rows = docs.withColumn(name, F.monotonically_increasing_id())
    rows.write.parquet(path)
    Scratch.drop(docs.sparkSession, but=path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path), name


def without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows whose number is not among ``gone`` (gone_)."""
    return rows.join(gone.withColumnRenamed("gone_", row), row, "left_anti").drop(row)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go, each row by its own text. It learns from the labelled documents of
    the stage's input; a document with a null id is judged, but does not train."""
    rows, row = numbered(docs)
    scored = score_toxicity(rows.select("doc_id", "text", F.col(row).alias("gone_")), read(spark, sf_dir, "labels"), keep=("gone_",))
    return without(rows, row, scored.where("predicted = 1").select("gone_"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id (null ids last), of equal ids the first row. Five-word
    shingles, similarity 0.8 or more. Texts under one id are documents of their own, and repeated rows are copies."""
    rows, row = numbered(docs)
    found = near_duplicates(rows.select(F.col(row).alias("row_"), "text"), id_col="row_", width=5, percent=80).where("n_shingles > 0")
    groups = found.groupBy("component_id").agg(F.count("*").alias("members")).where("members > 1")
    copies = found.join(groups, "component_id").select(F.col("row_").alias("gone_"), "component_id")
    named = copies.join(rows.select(F.col(row).alias("row_"), "doc_id"), F.col("gone_") == F.col("row_"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "gone_")
    stays = named.groupBy("component_id").agg(F.min_by("gone_", order).alias("stays"))
    return without(rows, row, copies.join(stays, "component_id").where("gone_ != stays").select("gone_"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, each row by its own text, also where the item has no id."""
    rows, row = numbered(docs)
    found = contamination(rows.select(F.col(row).alias("gone_"), "text"), read(spark, sf_dir, "benchmark"), id_col="gone_")
    return without(rows, row, found.where("contaminated").select("gone_"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains get closer in size (shares to the power 0.9): documents of the smaller ones are repeated as often as their
    rate says. No document has a rate below 1, so clean ones all stay. Repeated rows are rated each."""
    rows, row = numbered(docs)
    labelled = domains_of(rows.select("doc_id", "lang"), read(spark, sf_dir, "labels"))
    mixed = mix_to_targets(rows.select("doc_id", "text", F.col(row).alias("row_")), labelled, temper=0.9, keep_all=True, keep=("row_",))
    # one number in the array for each copy
    times = mixed.select("row_", F.explode(F.array_repeat(F.lit(0), F.greatest(F.col("copies"), F.lit(1)).cast("int")))).select(F.col("row_").alias(row))
    return rows.join(times, row).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as binary records with an index, in order of ids (nulls first); the rows are read back from the files."""
    return token_records(docs.select("doc_id", "text"), TOKENIZER).drop("ids")


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicate), ("decontamination", decontamination), ("mixing", mixing), ("token records", token_output)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = Scratch.new(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        Scratch.drop(spark, but=path)
    return STAGES[-1][1](spark, docs, sf_dir)
