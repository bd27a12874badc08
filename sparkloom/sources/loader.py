"""Reading tables by file extension with Spark's own readers.

Only the head of a delimited file is read on the driver, through Spark, to tell encoding and delimiter.
"""

from __future__ import annotations

import codecs
import csv
import io
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 65_536
SNIFFED = 4096
DELIMITERS = ",;\t|"


class UnsupportedFormatError(ValueError):
    """No reader is known for a file's extension or a named format."""


class DataLoader:
    """``load(source, fmt=None)``: a path, or a folder of one format with ``fmt``."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.readers = {
            "csv": self._delimited, "tsv": self._delimited, "parquet": self._parquet, "json": self._json, "ndjson": self._lines, "jsonl": self._lines,
            "xlsx": self._excel, "xls": self._excel, "arrow": self._arrow, "feather": self._arrow,
        }

    def load(self, source: str, fmt: str | None = None) -> DataFrame:
        path = str(source)
        kind = (fmt or PurePosixPath(path.rstrip("/")).suffix).lower().lstrip(".")
        if kind not in self.readers:
            raise UnsupportedFormatError(f"cannot read {kind or path!r}; supported: {', '.join(sorted(self.readers))}")
        if not self._exists(path):
            raise FileNotFoundError(path)
        return self.readers[kind](path)

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        return found is not None and len(found) > 0

    def _files(self, path: str) -> DataFrame:
        return self.spark.read.format("binaryFile").load(path)

    def _head(self, path: str) -> bytes:
        """The first bytes of the first file, through the store's own stream."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = sorted((s.getPath() for s in fs.globStatus(p)), key=lambda x: x.toString())
        first = found[0]
        if fs.getFileStatus(first).isDirectory():
            inner = [s.getPath() for s in fs.listStatus(first) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
            if not inner:
                return b""
            first = sorted(inner, key=lambda x: x.toString())[0]
        stream = fs.open(first)
        try:
            return bytes(stream.readNBytes(HEAD))
        finally:
            stream.close()

    def _delimited(self, path: str) -> DataFrame:
        head = self._head(path)
        encoding = detect_encoding(head)
        reader = self.spark.read.option("header", True).option("inferSchema", True).option("sep", detect_delimiter(head.decode(encoding, "replace"), "\t" if path.lower().endswith(".tsv") else ","))
        return reader.option("encoding", encoding).option("preferDate", True).csv(path)

    def _parquet(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def _json(self, path: str) -> DataFrame:
        return self.spark.read.option("multiLine", True).json(path)

    def _lines(self, path: str) -> DataFrame:
        return self.spark.read.json(path)

    def _arrow(self, path: str) -> DataFrame:
        """Files are decoded on the executors, one at a time; the schema comes from the first."""
        import pyarrow as pa

        files = self._files(path).select("content")
        first = files.limit(1).collect()
        if not first:
            raise FileNotFoundError(path)
        schema = self.spark.createDataFrame(_arrow_table(bytes(first[0]["content"])).slice(0, 1)).schema

        def decode(batches):
            for batch in batches:
                for content in batch[0]:
                    table = _arrow_table(content.as_py())
                    yield from table.combine_chunks().to_batches(max_chunksize=10_000)

        del pa
        return files.mapInArrow(decode, schema)

    def _excel(self, path: str) -> DataFrame:
        try:
            import pandas as pd

            content = bytes(self._files(path).select("content").first()["content"])
            return self.spark.createDataFrame(pd.read_excel(io.BytesIO(content)))
        except ImportError as error:
            raise UnsupportedFormatError(f"reading Excel files needs an engine for pandas: {error}") from error


def _arrow_table(content: bytes):
    import pyarrow as pa
    from pyarrow import feather

    try:
        return pa.ipc.open_file(pa.BufferReader(content)).read_all()
    except pa.ArrowInvalid:
        try:
            return pa.ipc.open_stream(pa.BufferReader(content)).read_all()
        except pa.ArrowInvalid:
            return feather.read_table(pa.BufferReader(content))


def detect_encoding(head: bytes) -> str:
    """By byte order mark, then strict UTF-8 (a character cut off at the end does not count), then Latin-1."""
    for mark, name in ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16"), (codecs.BOM_UTF16_BE, "UTF-16")):
        if head.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")("strict").decode(head, False)
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def detect_delimiter(head: str, default: str = ",") -> str:
    try:
        return csv.Sniffer().sniff(head[:SNIFFED], DELIMITERS).delimiter
    except csv.Error:
        return default


__all__ = ["AnalysisException", "DataLoader", "F", "UnsupportedFormatError", "detect_delimiter", "detect_encoding"]
