"""Sources and sinks."""

from __future__ import annotations

import hashlib
import inspect
import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None, schema: str | T.StructType | None = None, merge: bool = False, base: str | None = None) -> DataFrame:
    """Parquet files or folders; partition folders below ``base`` become columns, ``merge`` unites schemas."""
    reader = spark.read.option("mergeSchema", str(merge).lower())
    if base:
        reader = reader.option("basePath", base)
    if schema:
        reader = reader.schema(schema)
    df = reader.parquet(*paths)
    return df.select(*columns) if columns else df


def data_files(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files below ``path``, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    it = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hadoop, True)
    out = []
    while it.hasNext():
        f = it.next()
        if f.getPath().getName().endswith(suffix):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows, row_groups, column, low, high, nulls) from the footers alone, read by the executors in parallel.

    Bounds are given as strings, null where the footer has none.
    """
    files = spark.createDataFrame([(p,) for p, _, _ in data_files(spark, path)], "path string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["path"]:
                fs, inner = _opened(p)
                with fs.open_input_file(inner) as f:
                    m = pq.read_metadata(f)
                for c in range(m.num_columns):
                    parts = [m.row_group(g).column(c) for g in range(m.num_row_groups)]
                    known = [x.statistics for x in parts if x.statistics and x.statistics.has_min_max]
                    low, high = (min(x.min for x in known), max(x.max for x in known)) if known else (None, None)
                    nulls = [x.statistics.null_count for x in parts if x.statistics and x.statistics.has_null_count]
                    out.append((p, m.num_rows, m.num_row_groups, m.schema.column(c).path, None if low is None else str(low), None if high is None else str(high), sum(nulls)))
            yield pd.DataFrame(out, columns=["path", "rows", "row_groups", "column", "low", "high", "nulls"])

    files = files.repartition(max(1, min(files.count(), spark.sparkContext.defaultParallelism)))
    return files.mapInPandas(run, "path string, rows long, row_groups long, column string, low string, high string, nulls long")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def read_ndjson(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON document per line, plain or gzipped; lines that don't parse are kept in ``_corrupt``."""
    s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.json(path, schema=T.StructType([*s.fields, T.StructField("_corrupt", T.StringType())]), columnNameOfCorruptRecord="_corrupt")


def read_records(spark: SparkSession, path: str, begin: str, fields: Mapping[str, str]) -> DataFrame:
    """Records of several lines, each beginning with ``begin``: one column per field, by the first group of its pattern.

    The text is split by the reader at ``begin``, so a large file is not read by one task.
    Every record gets its ``begin`` back (without leading line feeds), but a file's first one, where it still
    has it. Nothing but blanks may stand before a file's first record.
    """
    head = begin.lstrip("\n")
    text = spark.read.option("lineSep", begin).text(path).where("trim(value) != ''")
    text = text.select(F.when(F.ltrim("value").startswith(head), F.ltrim("value")).otherwise(F.concat(F.lit(head), "value")).alias("record"))
    return text.select(*[F.nullif(F.regexp_extract("record", p, 1), F.lit("")).alias(n) for n, p in fields.items()], "record")


def from_memory(spark: SparkSession, data: object) -> DataFrame:
    """An Arrow table or pandas frame as a DataFrame."""
    return spark.createDataFrame(data)


def scored_by_process(df: DataFrame, schema: str, start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Rows scored by a helper that ``start`` sets up once for each task (such as a process)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = start()
        for b in batches:
            yield score(b)

    return df.mapInPandas(run, schema)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists", rows_per_file: int = 0) -> None:
    """Zstandard-compressed Parquet. With ``by`` in folders, whose rows are brought together first.

    The exchange is a rebalance, so AQE splits the rows of a hot folder over several tasks and
    merges small folders.
    """
    if by:
        df = df.hint("rebalance", *by)
    writer = df.write.mode(mode).option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def compact(spark: SparkSession, source: str, to: str, target_bytes: int = 256 << 20) -> int:
    """Rewrite many small files as files of about ``target_bytes``, without a shuffle; returns how many are wanted."""
    files = max(1, -(-sum(n for _, n, _ in data_files(spark, source)) // target_bytes))
    publish(spark.read.parquet(source).coalesce(files), to)
    return files


def write_archives(df: DataFrame, path: str, kind: str = "npz") -> DataFrame:
    """(file, rows): every partition as one ``npz`` of arrays or one ``zip`` with a CSV, in the folder ``path``.

    A partition's rows are held in memory. A task that is run again writes the same file anew.
    """
    if kind not in ("npz", "zip"):
        raise ValueError(kind)
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        fs, inner = _opened(path)
        fs.create_dir(inner, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.{kind}"
        data = io.BytesIO()
        if kind == "npz":
            np.savez_compressed(data, **{c: rows[c].to_numpy() if rows[c].dtype != object else rows[c].to_numpy("U") for c in names})
        else:
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(name.replace(".zip", ".csv"), rows.to_csv(index=False))
        with fs.open_output_stream(f"{inner}/{name}") as f:
            f.write(data.getvalue())
        yield pd.DataFrame({"file": [name], "rows": [len(rows)]})

    return df.mapInPandas(run, "file string, rows long")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def append(paths: Sequence[str], spark: SparkSession, to: str) -> None:
    """Files of one schema written after another: columns by name, absent ones null."""
    parts = [spark.read.parquet(p) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.write.mode("append").parquet(to)


def publish(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and rename, so that readers see all or nothing.

    Raises FileExistsError if ``path`` is there already, also when it
    appears meanwhile: the rename itself refuses an existing target.
    """
    sc = df.sparkSession.sparkContext
    jvm = sc._jvm.org.apache.hadoop.fs
    draft, to = jvm.Path(f"{path}.{uuid.uuid4().hex}"), jvm.Path(path)
    files = to.getFileSystem(sc._jsc.hadoopConfiguration())
    if files.exists(to):
        raise FileExistsError(path)
    df.write.parquet(draft.toString())
    none = sc._gateway.new_array(jvm.Options.Rename, 0)
    try:
        jvm.FileContext.getFileContext(files.getUri(), sc._jsc.hadoopConfiguration()).rename(files.makeQualified(draft), files.makeQualified(to), none)
    except Exception as e:
        files.delete(draft, True)
        raise FileExistsError(path) if files.exists(to) else e


class Stages:
    """Named results bound to the content of what they are made from; a finished one is read back instead of made again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def key(self, make: Callable[..., DataFrame], inputs: Sequence[str], settings: Mapping[str, object]) -> str:
        """Digest of the input files (names, sizes, times of change), the settings and the code that makes the stage."""
        try:
            code = inspect.getsource(make)
        except (OSError, TypeError):
            code = repr((make.__code__.co_code, make.__code__.co_consts, make.__code__.co_names))
        files = [f for p in inputs for f in data_files(self.spark, p, "")]
        return hashlib.sha256(json.dumps([files, sorted(settings.items()), code], default=str).encode()).hexdigest()

    def run(self, name: str, make: Callable[[], DataFrame], inputs: Sequence[str] = (), settings: Mapping[str, object] | None = None) -> DataFrame:
        """The stage's table; made by ``make()`` unless it is there with the same key. It appears by an atomic rename."""
        path = f"{self.root}/{name}-{self.key(make, inputs, settings or {})[:16]}"
        sc = self.spark.sparkContext
        done = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(sc._jsc.hadoopConfiguration()).exists(done):
            try:
                publish(make(), path)
            except FileExistsError:
                pass  # another run was faster; its result has the same key
        return self.spark.read.parquet(path)
