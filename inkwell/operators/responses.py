"""One response per id, and joining responses back to the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.session import materialize
from inkwell.sources.responses import read_response_files, read_results


def latest_per_id(df: DataFrame, id_col: str = "id", order: tuple[str, ...] = ("finished_at", "wave")) -> DataFrame:
    """The last row of each id, by `order`.

    Spark keeps one row per id in each task before the shuffle (a partial window
    group limit), so copies of a hot id never meet in one task.
    """
    newest = W.partitionBy(id_col).orderBy(*[F.col(name).desc_nulls_last() for name in order])
    return df.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")


def _drop_repeats(table: DataFrame, order: list[Column]) -> DataFrame:
    """The last row of each id of a file-backed table, moving ids only.

    Repeats are rare (a retry). The repeated ids are found on the id alone; without any, the table is returned as it
    is. Only their rows are then ordered, by the order columns, file and row number, and the full rows are filtered.
    Both short lists are written: their true size decides how they are joined.
    """
    counts = table.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    repeated = materialize(counts.where("_n > 1").select("id"), "repeated-ids")
    if repeated.isEmpty():
        return table
    place = F.struct(
        *order,
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.row_index").alias("row_index"),
    )
    located = table.select("*", place.alias("_place"))
    last = located.join(repeated, "id", "left_semi").groupBy("id").agg(F.max("_place").alias("_keep"))
    last = materialize(last, "last-places")
    kept = located.join(last, "id", "left").where(F.col("_keep").isNull() | (F.col("_keep") == F.col("_place")))
    return kept.select(*table.columns)


def responses(results: DataFrame) -> DataFrame:
    """(id, response) of the last successful attempt of each id, from any results frame."""
    ok = results.where(F.col("status") == "ok").select("id", "finished_at", "wave", "response")
    return latest_per_id(ok).select("id", "response")


def read_responses(spark: SparkSession, path: str, api_type: str = "chat-completion") -> DataFrame:
    """(id, response, shard) of a results table, one row per id."""
    ok = read_results(spark, path, api_type)
    if not ok.inputFiles():
        return ok.select("id", "response", "shard")
    ok = ok.where(F.col("status") == "ok")
    return _drop_repeats(ok, [F.col("finished_at"), F.col("wave")]).select("id", "response", "shard")


def read_plain_responses(spark: SparkSession, path: str, api_type: str = "chat-completion") -> DataFrame:
    """(id, response, shard) of `shardNNNNNN_*.parquet` files, one row per id."""
    table = read_response_files(spark, path, api_type)
    if not table.inputFiles():
        return table
    return _drop_repeats(table, [])


def join_back(
    df: DataFrame, answers: DataFrame, id_col: str = "id", how: str = "left", columns: dict[str, Column] | None = None
) -> DataFrame:
    """Input rows with their responses and a `responded` flag.

    `columns` names what to take from a response, for example
    `{"score": parse_score(content())}`; it is computed before the join, so only
    those values are shuffled and not the whole struct.
    """
    picked = columns if columns is not None else {"response": F.col("response")}
    right = answers.select(
        F.col("id").alias(id_col), *[value.alias(name) for name, value in picked.items()], F.lit(True).alias("responded")
    )
    joined = df.join(right, id_col, how)
    return joined.withColumn("responded", F.coalesce("responded", F.lit(False)))
