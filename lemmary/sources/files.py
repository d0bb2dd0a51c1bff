"""Readers and writers of the pipeline's file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TRIPLES = "s string, p string, o string"


def read_triples(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Distinct triples of a delimited file; lines with a missing part are skipped."""
    return spark.read.csv(path, sep=sep, schema=TRIPLES, quote="", escape="").na.drop().dropDuplicates()


def write_triples(triples: DataFrame, path: str, sep: str = "\t") -> None:
    triples.select("s", "p", "o").write.option("sep", sep).csv(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Mined rules with their quality columns: tab separated, header with spaces."""
    schema = "`Rule` string, `Head Coverage` double, `Std Confidence` double, `PCA Confidence` double, `Positive Examples` long"
    return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False)


def write_tree(frame: DataFrame, path: str) -> None:
    """One folder for each rule and mutation, so that filters on them prune folders."""
    frame.write.partitionBy("rule", "mutation_type").option("header", True).csv(path)


def read_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    full = StructType.fromDDL(f"{schema}, rule string, mutation_type string")
    return spark.read.schema(full).option("header", True).csv(path)


def read_named_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files kg_rule_N/<mutation>_llm_answers.csv: rule and mutation come from the path."""
    frame = spark.read.schema(schema).option("header", True).option("multiLine", True).csv(f"{path.rstrip('/')}/kg_rule_*/*.csv")
    name = F.col("_metadata.file_path")
    return frame.select(
        "*", F.regexp_extract(name, r"(kg_rule_\d+)/", 1).alias("rule"), F.regexp_extract(name, r"/([a-z_]+?)(?:_llm_answers)?\.csv$", 1).alias("mutation_type")
    )


def ordered_columns(frame: DataFrame, first: list[str]) -> DataFrame:
    """Known columns first, all others sorted."""
    known = [c for c in first if c in frame.columns]
    return frame.select(*known, *sorted(c for c in frame.columns if c not in known))


def read_jsonl(spark: SparkSession, path: str, schema: str, error: str = "error") -> DataFrame:
    """Rows without an error; blank and broken lines are skipped."""
    full = StructType.fromDDL(schema).add("_broken", "string")
    rows = spark.read.schema(full).option("columnNameOfCorruptRecord", "_broken").json(path)
    fine = F.col("_broken").isNull()
    return rows.filter(fine & F.col(error).isNull() if error in full.names else fine).drop("_broken")


def append_jsonl(frame: DataFrame, path: str) -> None:
    """A checkpoint sink: every call adds files, none is changed."""
    frame.write.mode("append").json(path)


def read_trainer_log(spark: SparkSession, path: str) -> DataFrame:
    """(current_steps, series, loss): training and evaluation losses of a mixed log."""
    rows = spark.read.json(path, schema="current_steps long, loss double, eval_loss double")
    pairs = F.array(F.struct(F.lit("train").alias("series"), F.col("loss").alias("loss")), F.struct(F.lit("eval").alias("series"), F.col("eval_loss").alias("loss")))
    return rows.select("current_steps", F.explode(F.filter(pairs, lambda x: x["loss"].isNotNull())).alias("x")).select("current_steps", "x.series", "x.loss")


def save_graph(path: str, triples: DataFrame, entities: DataFrame, properties: DataFrame) -> None:
    for name, frame in (("triples", triples), ("entities", entities), ("properties", properties)):
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("triples", "entities", "properties")}
