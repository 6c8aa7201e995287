"""The given tables in the shape of the catalogue.

The operators know only the catalogue's columns; these views give the order, document,
event and vector tables that shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators import catalog


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def split_code(key: Column) -> Column:
    """1 train, 2 validation, 3 test, six to two to two by the last digit."""
    return F.when(key % 10 < 6, 1).when(key % 10 < 8, 2).otherwise(3)


def order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as segments of customers."""
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("segment_id"),
        F.col("o_custkey").alias("measurement_id"),
        seconds(F.col("o_orderdate")).alias("time_s"),
        F.col("o_totalprice").alias("range_m"),
        (F.col("o_orderstatus") == "F").cast("int").alias("edge_flag"),
        split_code(F.col("o_orderkey")).alias("paper_split"),
        split_code(F.col("o_custkey")).alias("split_grouped"),
        F.sha1(F.concat_ws("|", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", "o_orderstatus").cast("binary")).alias("sha1"),
    )
    return catalog.sequence_segments(raw)


def customer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and class group of every measurement of ``order_segments``."""
    market = F.col("c_mktsegment")
    named = (
        F.when(market == "AUTOMOBILE", "D1").when(market == "BUILDING", "D2").when(market == "FURNITURE", "human_walk").when(market == "MACHINERY", "CR")
        .otherwise("seagull")
    )
    labels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("measurement_id"), named.alias("label"))
    return labels.withColumn("class_group", catalog.class_group(F.col("label")))


def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as segments of their sources, with the label their language."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("segment_id"),
        F.col("source").alias("measurement_id"),
        F.col("lang").alias("label"),
        split_code(F.col("doc_id")).alias("paper_split"),
        F.sha1(F.col("text").cast("binary")).alias("sha1"),
    )


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with two scores, whether they are toxic (positive), and their split."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("segment_id"),
        F.col("n_chars").cast("double").alias("score"),
        (F.char_length("text") / (F.size(F.split("text", " ")) + 1.0)).alias("word_score"),
        (F.col("toxic") == 1).alias("positive"),
        (F.col("quality") == 1).alias("clean"),
        split_code(F.col("doc_id")).alias("split_grouped"),
        F.col("lang").alias("label"),
    )


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments of users."""
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("segment_id"), F.col("user_id").alias("measurement_id"), seconds(F.col("ts")).alias("time_s"), F.col("event_type").alias("label"), "value"
    )
    return catalog.sequence_segments(raw)


def vector_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten consecutive vectors as a segment of five complex cells of 64 samples: (segment_id, iq_re, iq_im).

    Cell c of segment i has vector 10 i + 2 c as its real and the next one as its
    imaginary part. An incomplete last segment is left out.
    """
    packed = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 10").alias("segment_id")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("vec_id") % 10).alias("k"), "embedding"))).alias("v")  # ten rows
    )
    part = lambda odd: F.flatten(F.transform(F.filter("v", lambda x: x["k"] % 2 == odd), lambda x: x["embedding"]))
    return packed.where(F.size("v") == 10).select("segment_id", part(0).alias("iq_re"), part(1).alias("iq_im"))


def vector_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows of the segments of ``vector_arrays``, from ids and labels alone: vectors are not read."""
    names = F.array(*(F.lit(x) for x in ("D1", "D2", "D3", "D4", "D5", "D6", "seagull", "human_walk", "CR", "heron")))
    i, first = F.col("segment_id"), F.col("first")
    sized = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 10").alias("segment_id")).agg(
        F.count("*").alias("n"), F.min_by("label", "vec_id").alias("first")
    )
    raw = sized.where("n = 10").select(
        "segment_id",
        (2 * first + i % 2).cast("long").alias("measurement_id"),
        F.get(names, first).alias("label"),
        (0.1 * i + 2.0 * F.floor(i / 20)).alias("time_s"),
        (i % 11 == 0).cast("int").alias("edge_flag"),
        split_code(i).alias("paper_split"),
        split_code(2 * first + i % 2).alias("split_grouped"),
    )
    return catalog.sequence_segments(raw)


def vector_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows with their arrays; the arrays stay where their packing has put them."""
    return vector_catalog(spark, sf_dir).join(vector_arrays(spark, sf_dir), "segment_id")
