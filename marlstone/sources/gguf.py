"""Headers of weight files: only the header is read, never the weights."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from io import BytesIO
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marlstone.sources.paths import found, opened

# Fixed values of the format: magic, versions, and the sizes of scalar value types by their number.
MAGIC, VERSIONS = b"GGUF", (2, 3)
SIZES = {0: 1, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 1, 10: 8, 11: 8, 12: 8}
UINT32, STRING, ARRAY = 4, 8, 9


def context_length(f: BinaryIO) -> int | None:
    """The first ``*.context_length`` of type uint32; null where there is none or the header is no such header."""

    def number(form: str) -> int:
        return struct.unpack(form, f.read(struct.calcsize(form)))[0]

    def skip(kind: int) -> None:
        if kind == STRING:
            f.seek(number("<Q"), 1)
        elif kind == ARRAY:
            inner, n = number("<I"), number("<Q")
            if inner in SIZES:
                f.seek(n * SIZES[inner], 1)
            else:
                for _ in range(n):
                    skip(inner)
        else:
            f.seek(SIZES[kind], 1)

    try:
        if f.read(4) != MAGIC or number("<I") not in VERSIONS:
            return None
        number("<Q")
        for _ in range(number("<Q")):
            key = f.read(number("<Q")).decode("utf-8", "replace")
            kind = number("<I")
            if key.endswith(".context_length") and kind == UINT32:
                return number("<I")
            skip(kind)
    except (struct.error, KeyError, OverflowError, OSError, MemoryError, RecursionError):
        pass
    return None


def header_context_length(content: Column) -> Column:
    """``context_length`` of headers in a binary column."""

    @F.pandas_udf("bigint")
    def parse(b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else context_length(BytesIO(x)) for x in b], dtype="Int64")

    return parse(content)


class File(InputPartition):
    pass


class GgufReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self) -> list[File]:
        return [File(p) for p in found(self.path)]

    def read(self, partition: File) -> Iterator[tuple]:
        system, at = opened(partition.value)
        with system.open_input_file(at) as f:
            yield partition.value, context_length(f)


class GgufSource(DataSource):
    """``spark.read.format("gguf").load("/weights/**/*.gguf")``: ``(path, context_length)``."""

    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return "path string, context_length bigint"

    def reader(self, schema) -> GgufReader:
        return GgufReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GgufSource)
