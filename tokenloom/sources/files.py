"""Image and configuration sources, file naming for sinks, and lookups in sharded weight indexes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: names of one format.
SAME_FORMAT = {"jpg": "jpeg"}


def binary_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content of image files in any file system Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """img_id, h, w, ch, data (bytes as integers, red first, row by row) of the image files of a folder."""
    rows = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    hexed, n = F.hex("data"), F.col("nChannels")
    byte = lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    raw = F.transform(F.sequence(F.lit(0), F.length("data") - 1), byte)
    rows = rows.withColumn("raw", raw)
    # Spark's channel order is blue, green, red (, alpha).
    order = F.when(F.col("nChannels") >= 3, F.array(F.lit(2), F.lit(1), F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))
    data = F.transform("raw", lambda _, i: F.get("raw", (F.floor(i / n) * n).cast("int") + F.get(order, i % n)))
    return rows.select(F.col("origin").alias("img_id"), F.col("height").alias("h"), F.col("width").alias("w"), n.alias("ch"), data.alias("data"))


def source_kind(location: Column) -> Column:
    """How a location is fetched."""
    return F.when(location.rlike("^https?://"), "http").when(location.rlike("^s3"), "object").otherwise("file")


class HttpFiles(DataSource):
    """spark.read.format("http_files").option("urls", "a b").load(): path, content; 32 tries, 0.1 s apart (option "tries")."""

    @classmethod
    def name(cls) -> str:
        return "http_files"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _HttpReader(self.options.get("urls", "").split(), int(self.options.get("tries", "32")))


class _HttpReader(DataSourceReader):
    def __init__(self, urls: list[str], tries: int):
        self.urls, self.tries = urls, tries

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import time
        import urllib.request

        for k in range(self.tries):
            try:
                with urllib.request.urlopen(partition.value, timeout=10) as r:
                    yield partition.value, r.read()
                return
            except OSError:
                if k + 1 == self.tries:
                    raise
                time.sleep(0.1)


def _split_path(path: str) -> tuple[Column, Column]:
    return F.regexp_replace(path, "[.][^./]*$", ""), F.regexp_extract(path, "([.][^./]*)$", 1)


def final_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """id, path, name: where each file goes when nothing may be overwritten.

    Of the rows that want one path, the one with the least id gets it unless a file is there
    (``taken``: path).  The others get path_0, path_1, ... in order of id, without the names that
    are taken or that anybody wants as they are, so no two rows get one name.
    """
    there = taken.select("path").distinct()
    owners = wanted.groupBy("path").agg(F.min("id").alias("owner")).join(there, "path", "left_anti")
    rows = wanted.join(owners, "path", "left").withColumn("plain", F.coalesce(F.col("id") == F.col("owner"), F.lit(False)))
    # Numbers in use, of paths that end in one.
    used = there.unionByName(wanted.select("path")).distinct().withColumn("number", F.regexp_extract("path", "_(0|[1-9][0-9]{0,17})([.][^./]*)?$", 1)).where("number <> ''")
    root, ext = F.regexp_replace("path", "_[0-9]+([.][^./]*)?$", ""), _split_path("path")[1]
    used = used.select(root.alias("root"), ext.alias("ext"), F.col("number").cast("long").alias("n")).distinct()
    # The k-th free number is k plus the number of used ones u_j with u_j - j <= k, so used and new ones are merged in one order.
    root, ext = _split_path("path")
    by = Window.partitionBy("root", "ext")
    gaps = used.select("root", "ext", (F.col("n") + 1 - F.row_number().over(by.orderBy("n"))).alias("k"), F.lit(1).alias("used"), F.lit(None).cast(wanted.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("path"))
    asking = rows.where("NOT plain").select("id", "path", root.alias("root"), ext.alias("ext"), F.lit(0).alias("used"))
    asking = asking.withColumn("k", (F.row_number().over(by.orderBy("id")) - 1).cast("long"))
    merged = gaps.unionByName(asking).withColumn("n", F.col("k") + F.sum("used").over(by.orderBy("k", F.desc("used")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    numbered = merged.where("used = 0").select("id", "path", F.concat("root", F.lit("_"), F.col("n").cast("string"), "ext").alias("name"))
    return rows.where("plain").select("id", "path", F.col("path").alias("name")).unionByName(numbered)


def format_matches(path: Column, wanted: Column) -> Column:
    """Whether the extension agrees with the format (jpg and jpeg are one)."""

    def plain(x: Column) -> Column:
        out = F.lower(x)
        for a, b in SAME_FORMAT.items():
            out = F.when(out == a, b).otherwise(out)
        return out

    return plain(F.regexp_extract(path, "[.]([^./]*)$", 1)) == plain(wanted)


def load_config(spark: SparkSession, path: str, allowed: Sequence[str], overrides: dict[str, str] | None = None) -> DataFrame:
    """key, value of a JSON file: overrides win, keys that are not allowed are dropped."""
    text = spark.read.text(path, wholetext=True)
    return filter_config(text.select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("key", "value")), allowed, overrides)


def filter_config(entries: DataFrame, allowed: Sequence[str], overrides: dict[str, str] | None = None) -> DataFrame:
    spark = entries.sparkSession
    more = spark.createDataFrame(list((overrides or {}).items()), "key string, override string")
    keys = spark.createDataFrame([(a,) for a in allowed], "key string")
    joined = entries.join(more, "key", "full").select("key", F.coalesce("override", "value").alias("value"))
    return joined.join(keys, "key", "left_semi")


def shard_of(index: DataFrame, weight_map: str, name: Column, single: str = "model.safetensors") -> DataFrame:
    """``index`` with the file that holds weight ``name``: from the map, or the single file without one."""
    return index.withColumn("file", F.coalesce(F.try_element_at(weight_map, name), F.lit(single)))


def head_name(tied: Column) -> Column:
    """The output head's weight: the embedding's if they are tied."""
    return F.when(tied, "model.embed_tokens.weight").otherwise("lm_head.weight")
