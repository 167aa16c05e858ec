"""Readers of run artifacts: JSON lines, JSON documents, CSV, WAV headers; all through Spark's sources, so any store will do."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipweave.operators.intervals import numbered

#: Versions of the clips document that are understood.
SCHEMA_VERSIONS = (1,)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object per line; blank lines are skipped, anything else that is no object fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As ``json_lines``, but bad lines are kept: column bad_line holds their text."""
    full = T.StructType([*schema.fields, T.StructField("bad_line", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_line").json(path)


def json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A whole file that holds an object, or a list of objects, one row each."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def clips(spark: SparkSession, path: str, clip: T.StructType) -> DataFrame:
    """Clips of a file that is a bare list or {schema_version, clips}; another version fails the read."""
    wrapped = T.StructType([T.StructField("schema_version", T.IntegerType()), T.StructField("clips", T.ArrayType(clip)), *[f for f in clip.fields if f.name not in ("schema_version", "clips")]])
    rows = spark.read.schema(wrapped).option("multiLine", True).json(path)
    known = F.coalesce(F.col("schema_version").isin(*SCHEMA_VERSIONS), F.lit(False))
    bare = F.array(F.struct(*[F.col(f.name) for f in clip.fields]))
    unknown = F.raise_error(F.concat(F.lit("unknown schema_version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("null"))))
    found = F.when(F.col("clips").isNull(), bare).when(known, F.col("clips")).otherwise(unknown.cast(T.ArrayType(clip)))
    return rows.select(F.explode(found).alias("c")).select("c.*")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every value a string."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def wav_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_rate, channels, bits, frames, duration_sec and sha256 of each WAV file; files are read where they lie, one row each."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rate = channels = bits = size = None
                if content[:4] == b"RIFF" and content[8:12] == b"WAVE":
                    at = 12
                    while at + 8 <= len(content):
                        kind, n = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
                        if kind == b"fmt ":
                            channels, rate, bits = (*struct.unpack_from("<HI", content, at + 10), struct.unpack_from("<H", content, at + 22)[0])
                        elif kind == b"data":
                            size = min(n, len(content) - at - 8)
                        at += 8 + n + n % 2
                width = (channels or 0) * (bits or 0) // 8
                out.append((p, rate, channels, bits, size // width if size is not None and width else None))
            yield pd.DataFrame(out, columns=["path", "sample_rate", "channels", "bits", "frames"]).astype({c: "Int64" for c in ("sample_rate", "channels", "bits", "frames")})

    files = spark.read.format("binaryFile").load(path)
    heads = files.select("path", "content").mapInPandas(parse, "path string, sample_rate long, channels long, bits long, frames long")
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"))
    return heads.join(hashed, "path").withColumn("duration_sec", F.round(F.try_divide(F.col("frames"), F.col("sample_rate")), 6))


def with_surrogate_ids(rows: DataFrame, order: list[str], template: str = "source_audio_%04d", name: str = "source_audio_id") -> DataFrame:
    """Rows with ids numbered from 0 in a total order."""
    return numbered(rows, order, template, name, first=0)
