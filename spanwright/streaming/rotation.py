"""A stream of requests as files of bounded size, in the order in which they came, none of them split.

Each micro-batch adds parts after those of the batches before. A part ends where the next request would make it longer than
``most``; a request that is longer by itself has a part of its own. What belongs to which part follows from running sums over the
batch's requests, so the parts of a batch are written side by side; a batch that is repeated after a crash replaces its parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files
from . import intake

#: Bytes of a part, and the least that may be asked for.
MOST, LEAST = 10 << 20, 1024


def parts(requests: DataFrame, most: int) -> DataFrame:
    """``requests`` (doc, value) with size (UTF-8 bytes and a line end) and part (from 0), in order of doc.

    The sizes of one micro-batch, which ``maxFilesPerTrigger`` bounds, are put in order and walked through once.
    """
    sized = requests.withColumn("size", F.octet_length("value") + 1)
    ordered = sized.groupBy().agg(F.array_sort(F.collect_list(F.struct("doc", "size"))).alias("x"))  # a number for each request of the batch
    start = F.struct(F.lit(0).alias("part"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("out"))

    def put(a, x):
        full = (a["held"] > 0) & (a["held"] + x["size"] > most)
        part = a["part"] + F.when(full, 1).otherwise(0)
        return F.struct(part.alias("part"), F.when(full, x["size"]).otherwise(a["held"] + x["size"]).alias("held"), F.concat(a["out"], F.array(part)).alias("out"))

    placed = ordered.select(F.explode(F.arrays_zip("x", F.aggregate("x", start, put, lambda a: a["out"]).alias("part"))).alias("z")).select("z.x.doc", F.col("z.part").alias("part"))
    return sized.join(placed, "doc")


def rotate(spark: SparkSession, folder: str, out: str, checkpoint: str, most: int = MOST, requests: int = 1000) -> StreamingQuery:
    """Writes new files of ``folder``, each one request, to parts of at most ``most`` bytes: ``out``/batch=n/part=k."""
    most = max(LEAST, most)

    def write(batch: DataFrame, number: int) -> None:
        placed = parts(batch, most).repartition("part").sortWithinPartitions("part", "doc")
        placed.select("part", "value").write.mode("overwrite").partitionBy("part").text(f"{out}/batch={number}")

    return intake.exports(spark, folder, requests).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, out: str) -> DataFrame:
    """batch, part, value (a request) of all that was written."""
    schema = "value string, batch int, part int"
    if not files.names(spark, out):
        return spark.createDataFrame([], schema).select("batch", "part", "value")
    return spark.read.schema(schema).text(out).select("batch", "part", "value")


def sizes(spark: SparkSession, out: str) -> DataFrame:
    """number (from 1 through all batches), batch, part, requests, size of each part."""
    found = read(spark, out).groupBy("batch", "part").agg(F.count("*").alias("requests"), F.sum(F.octet_length("value") + 1).alias("size"))
    return found.select(F.row_number().over(Window.orderBy("batch", "part")).alias("number"), "batch", "part", "requests", "size")  # a row for each part
