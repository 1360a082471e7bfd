"""A stream of fact lines kept as one Parquet folder per relation.

The batch engine reads what has arrived with ``sources.store`` or plain Parquet readers.
Facts are sets: a batch adds only what the folder does not hold, so a batch that is run
again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kb import columns, union
from ..sources.facts import GROUPS, LINKS, beside, groups_of, kinds


def fact_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``rel`` and ``args`` of the lines of files that arrive in a folder."""
    parts = F.split("value", "\t")
    lines = spark.readStream.schema("value string").text(folder).filter(F.length(F.trim("value")) > 0)
    return lines.select(parts[0].alias("rel"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("args"))


def intake(facts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Adds the stream's new facts to ``target``, partitioned by relation, until it has no more."""
    spark = facts.sparkSession

    def add(batch: DataFrame, _: int) -> None:
        new = batch.distinct().persist()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            met = [r["rel"] for r in new.select("rel").distinct().collect()]  # relations of the catalogue: others are not read
            held = spark.read.schema("args array<string>, rel string").parquet(target).filter(F.col("rel").isin(*met))
            new.join(held, ["rel", "args"], "left_anti").write.mode("append").partitionBy("rel").parquet(target)
        else:
            new.write.mode("append").partitionBy("rel").parquet(target)
        new.unpersist()

    return facts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrived(spark: SparkSession, target: str) -> DataFrame:
    """``rel`` and ``args`` of all facts that ``target`` holds, each once; of relations that came by groups, the pairs are made here."""
    held = spark.read.schema("args array<string>, rel string").parquet(target)
    plain, by_groups = kinds(r["rel"] for r in held.select("rel").distinct().collect())  # names of the catalogue
    of = lambda name: held.filter(F.col("rel") == name)
    parts = [held.filter(F.col("rel").isin([n for n in plain if n not in by_groups])).select("rel", "args")]
    for name in by_groups:
        groups, pair = groups_of(of(name + GROUPS), of(name + LINKS)).written(), F.array(*columns(2)).alias("args")
        parts.append(groups.pairs().select(F.lit(name).alias("rel"), pair))
        if name in plain:
            own = of(name).select(*(F.col("args")[i].alias(c) for i, c in enumerate(columns(2))))
            parts.append(beside(own, groups).select(F.lit(name).alias("rel"), pair))
    return union(parts)
