"""Connected components over links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.scratch import stage


def connected(links: DataFrame) -> DataFrame:
    """(id, label) of every end of ``links`` (a, b); label is the smallest id that it reaches.

    Every round takes the smallest label among the neighbours, then the label's own label,
    so chains shorten by half; rounds end when no label falls. Labels are written each round.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("id", "to"), "links")
    labels = stage(both.groupBy("id").agg(F.least("id", F.min("to")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("label").alias("theirs")), "to").groupBy("id").agg(F.min("theirs").alias("theirs"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "theirs").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = stage(lower.join(up, "label", "left").select("id", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        if new.where("label < was").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")
