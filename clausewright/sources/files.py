"""JSON-lines and document sources and sinks, versioned outputs with an atomic pointer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.ids import document_identity


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object a line; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines). Lines are parsed as text, so either side can be
    read without the other."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = "_corrupt_record"
    parsed = lines.withColumn("r", F.from_json("value", StructType([*schema.fields, StructField(bad, StringType())]), {"columnNameOfCorruptRecord": bad, "mode": "PERMISSIVE"}))
    is_bad = F.col("r").isNull() | F.col(f"r.{bad}").isNotNull() | ~F.trim("value").startswith("{")
    return parsed.where(~is_bad).select(*(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields)), parsed.where(is_bad).select("value")


def count_lines(spark: SparkSession, path: str) -> int:
    """Non-blank lines, 0 where there is no file."""
    return spark.read.text(path).where(F.trim("value") != "").count() if exists(spark, path) else 0


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files with their identity: (source_pdf, content, document_hash_full, document_id)."""
    full, short = document_identity(F.col("content"))
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source_pdf"), "content", full.alias("document_hash_full"), short.alias("document_id"))


def parsed_documents(files: DataFrame, parser, first_page: int = 1, last_page: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, failures) of ``read_documents`` rows. ``parser`` is a provider with
    ``parse(content, first_page, last_page)``, which lists an item's (heading, text,
    page) in reading order, heading null for body items. A failing parse is one row of
    (source_pdf, document_id, error) and stops no other document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pdf, ident, content in zip(b["source_pdf"], b["document_id"], b["content"]):
                try:
                    got = [(pdf, ident, i, h, t, p, None) for i, (h, t, p) in enumerate(parser.parse(content, first_page, last_page))]
                except Exception as e:
                    got = [(pdf, ident, None, None, None, None, f"{type(e).__name__}: {e}"[:500])]
                out += got
            frame = pd.DataFrame(out, columns=["source_pdf", "document_id", "item_seq", "heading", "text", "page", "error"])
            yield frame.astype({"item_seq": "Int64", "page": "Int32"})

    d = files.select("source_pdf", "document_id", "content").mapInPandas(run, "source_pdf string, document_id string, item_seq long, heading string, text string, page int, error string")
    return d.where("error is null").drop("error"), d.where("error is not null").select("source_pdf", "document_id", "error")


def without_suffix(name: Column, suffixes: tuple[str, ...]) -> Column:
    """A file name without the first of the suffixes that ends it."""
    out = name
    for s in reversed(suffixes):
        out = F.when(name.endswith(s), F.substring(name, F.lit(1), F.length(name) - len(s))).otherwise(out)
    return out


def repaired_strings(df: DataFrame, table: dict[str, str]) -> DataFrame:
    """Private-use ligatures replaced in every string and list-of-strings column."""
    from ..functions.text import ligatures_repaired

    for name, kind in df.dtypes:
        if kind == "string":
            df = df.withColumn(name, ligatures_repaired(F.col(name), table))
        elif kind == "array<string>":
            df = df.withColumn(name, F.transform(name, lambda x: ligatures_repaired(x, table)))
    return df


def _swap_pointer(spark: SparkSession, root: str, version: str) -> None:
    """CURRENT replaced in one step: a rename that overwrites (HDFS and local files);
    there is no moment without a pointer, and a crash leaves the old one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    tmp, fs = _path(spark, f"{root}/_CURRENT.{version}")
    out = fs.create(tmp, True)
    out.write(version.encode())
    out.close()
    current, _ = _path(spark, f"{root}/CURRENT")
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(tmp), fs.makeQualified(current), over)


def publish(df: DataFrame, root: str, version: str, drop_old: bool = False) -> str:
    """Writes a new version and then points CURRENT to it by one overwriting rename, so
    readers see the old version or the whole new one; a failed write removes what it
    wrote and leaves the pointer alone. ``drop_old`` deletes the version pointed to
    before, once the pointer is swapped."""
    return publish_if(df, root, version, lambda _: None, drop_old)


def publish_if(df: DataFrame, root: str, version: str, refuse, drop_old: bool = False) -> str:
    """As ``publish``, but ``refuse`` gets the new version as written and may return why
    it must not go live; then it is deleted and a RuntimeError raised."""
    spark = df.sparkSession
    path = f"{root}/{version}"
    if exists(spark, path):
        raise ValueError(f"version {version} is already there")
    old = current_version(spark, root)
    p, fs = _path(spark, path)
    try:
        df.write.mode("errorifexists").parquet(path)
        if why := refuse(spark.read.schema(df.schema).parquet(path)):
            raise RuntimeError(why)
        _swap_pointer(spark, root, version)
    except Exception:
        if current_version(spark, root) != version:
            fs.delete(p, True)
        raise
    if drop_old and old and old != version:
        fs.delete(_path(spark, f"{root}/{old}")[0], True)
    return path


def current_version(spark: SparkSession, root: str) -> str | None:
    return spark.read.text(f"{root}/CURRENT").first()[0] if exists(spark, f"{root}/CURRENT") else None


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current_version(spark, root)}")


def run_catalogue(spark: SparkSession, root: str, suffixes: dict[str, str]) -> DataFrame:
    """(doc_key, run_dir, tier, mtime, path) of the files whose names end as given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("modificationTime").cast("timestamp_ntz").alias("mtime"))
    name, folder = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    parts = [files.where(name.endswith(s)).select(F.substring(name, F.lit(1), F.length(name) - len(s)).alias("doc_key"), folder.alias("run_dir"), F.lit(t).alias("tier"), "mtime", "path") for t, s in suffixes.items()]
    return reduce(DataFrame.unionByName, parts)
