"""A bounded, repeatable sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.sources.scratch import materialize


def held_out(id_column: str = "doc_id"):
    """Rows never learned from: a quarter of the ids, by checksum."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


class Sample(NamedTuple):
    """`rows`: text, label (0.0 or 1.0), weight, fold (0 to 9); `classes`: labelled rows by label."""

    rows: DataFrame | None
    classes: dict[int, int]

    @property
    def prior(self) -> float:
        total = sum(self.classes.values())
        return self.classes.get(1, 0) / total if total else 0.0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> Sample:
    """At most `per_class` training documents of each label, chosen by a hash of the id.

    Labels other than 0 and 1 and null ids are ignored; a document with several labels has the
    largest.  Equal texts are taken once.  Weights give the classes their shares among all training
    labels again.  The ids are few, so they are broadcast to the scan of the documents; the sample
    is written once and read back.  `rows` is None when a class is missing.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    spark = docs.sparkSession
    known = materialize(known.join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi"), "labelled")
    classes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(classes) < 2:
        return Sample(None, classes)
    order = F.xxhash64("_id", F.lit("sample"))
    chosen = [r for c in classes for r in known.where(F.col("label") == c).orderBy(order, "_id").limit(per_class).collect()]
    few = spark.createDataFrame([(r["_id"], r["label"]) for r in chosen], "_id long, label int")
    weight = F.create_map(*(x for c, n in classes.items() for x in (F.lit(c), F.lit(n / min(n, per_class)))))
    rows = (
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
        .groupBy(F.xxhash64("text").alias("_text"), "label")
        .agg(F.first("text").alias("text"), F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
        .select(
            "text",
            F.col("label").cast("double").alias("label"),
            (weight[F.col("label")] * F.sqrt("copies")).alias("weight"),
            F.pmod(F.xxhash64("_text", F.lit("fold")), F.lit(10)).cast("int").alias("fold"),
            "doc_id",
        )
    )
    return Sample(materialize(rows, "sample"), classes)
