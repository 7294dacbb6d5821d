"""The flagship query: one pass from raw documents to a risk profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.functions.text import filled
from parapet.plans.corpus import audit_seeded, seeded_input


def label_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Label counts per project over freshly audited documents."""
    rows = audit_seeded(seeded_input(spark, folder))
    project = filled(F.col("project_name"), "-").alias("project_name")
    labels = rows.select(project, F.explode("risk_labels").alias("label"))
    return labels.groupBy("project_name", "label").agg(F.count("*").alias("count"))
