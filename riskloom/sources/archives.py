"""Packed graph archives (.tar.gz with metadata.txt, nodes.csv and transactions.csv), read without unpacking."""

from __future__ import annotations

import io
import json
import sys
import tarfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import csv, fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from riskloom.session import materialise
from riskloom.sources.files import ARCHIVE_DDL, archive_metadata

# The members of an archive, in a folder named like it
MEMBERS = {"metadata": "metadata.txt", "nodes": "nodes.csv", "transactions": "transactions.csv"}
SUFFIX = ".tar.gz"
BLOCK = 4 << 20


def sample_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].removesuffix(SUFFIX)


def opened(path: str) -> tarfile.TarFile:
    """The archive as a forward stream: one inflated block at a time is held."""
    store, inner = fs.FileSystem.from_uri(path)
    return tarfile.open(fileobj=store.open_input_stream(inner, compression=None), mode="r|gz")


class ArchivePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: Sequence[str], member: str, columns: Sequence[str]):
        self.paths, self.member, self.columns = list(paths), member, list(columns)

    def partitions(self) -> list[InputPartition]:
        return [ArchivePartition(p) for p in self.paths]

    def read(self, partition: ArchivePartition) -> Iterator[pa.RecordBatch]:
        path, names = partition.path, ["archive", *self.columns]
        with opened(path) as archive:
            if self.member == "members":
                for info in archive:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([info.name]), pa.array([str(info.size)])], names)
                return
            wanted = f"{sample_name(path)}/{MEMBERS[self.member]}"
            for info in archive:
                if info.name != wanted:
                    continue
                content = archive.extractfile(info)
                if self.member == "metadata":
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content.read().decode("utf-8")])], names)
                    return
                for batch in self.rows(content):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * batch.num_rows), *batch.columns], names)
                return
        raise FileNotFoundError(f"archive {path} lacks {wanted}")

    def rows(self, content) -> Iterator[pa.RecordBatch]:
        convert = csv.ConvertOptions(
            column_types={c: pa.string() for c in self.columns}, include_columns=self.columns, include_missing_columns=True, strings_can_be_null=True, null_values=[""]
        )
        try:
            yield from csv.open_csv(pa.PythonFile(content, mode="r"), csv.ReadOptions(block_size=BLOCK), convert_options=convert)
        except pa.ArrowInvalid as error:
            if "Empty CSV" not in str(error):
                raise


class ArchiveSource(DataSource):
    """Format ``graph_archive``. Options: ``paths``, a JSON list of archives, each of which is one partition; ``member``:
    nodes, transactions, metadata or members (names and sizes); ``columns``, a JSON list. All columns are text, and
    ``archive``, the path, comes first."""

    @classmethod
    def name(cls) -> str:
        return "graph_archive"

    def columns(self) -> list[str]:
        return json.loads(self.options["columns"])

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in ("archive", *self.columns())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArchiveReader(json.loads(self.options["paths"]), self.options["member"], self.columns())


def read_member(spark: SparkSession, paths: Sequence[str], member: str) -> DataFrame:
    # by value: the process that plans the read need not find this package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(ArchiveSource)
    own = {"metadata": ["value"], "members": ["name", "size"]}
    columns = own.get(member) or [f.name for f in T.StructType.fromDDL(ARCHIVE_DDL[member]).fields]
    options = {"paths": json.dumps(list(paths)), "member": member, "columns": json.dumps(columns)}
    return spark.read.format("graph_archive").options(**options).load()


def missing_members(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Required members that the archives lack, found in one pass over all of them."""
    found = read_member(spark, paths, "members").where(F.regexp_extract("name", r"[^/]+$", 0).isin(*MEMBERS.values()))
    names = {(r["archive"], r["name"]) for r in found.select("archive", "name").collect()}  # three of each archive
    required = [(p, f"{sample_name(p)}/{m}") for p in paths for m in MEMBERS.values()]
    return sorted(f"{p}: {m}" for p, m in required if (p, m) not in names)


def read_packed_archives(spark: SparkSession, paths: Sequence[str]) -> dict[str, DataFrame]:
    """Metadata, nodes and transactions of packed archives, as ``read_archive`` gives those of an unpacked one, with
    the path in ``archive``. An archive is streamed by one task: many archives are read side by side, and no task
    holds more than a block of one. A cell that is no number is NULL, as is a column that the header lacks. Paths are
    those that Arrow's file systems open. A missing member is named in the error."""
    missing = missing_members(spark, paths)
    if missing:
        raise FileNotFoundError(f"no graph archives, members are missing: {', '.join(missing)}")
    tables = {"metadata": archive_metadata(read_member(spark, paths, "metadata"))}
    for name in ("nodes", "transactions"):
        types = T.StructType.fromDDL(ARCHIVE_DDL[name]).fields
        rows = read_member(spark, paths, name)
        tables[name] = rows.select("archive", *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in types])
    return tables


def write_packed_archives(nodes: DataFrame, transactions: DataFrame, root: str, *, parts: int, patterns: str = "") -> DataFrame:
    """Writes ``parts`` archives and returns the stored manifest (path, nodes, transactions). Nodes and the
    transactions they send share an archive, packed by one task. Files carry a name of their own for each attempt;
    only those in the manifest count."""

    def pack(key: tuple, node_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        name = f"sample_{key[0]:05d}-{uuid.uuid4().hex}"
        fraud = int((node_rows["isFraud"].astype(str) == "1").sum())
        text = f"nodes: {len(node_rows)} ({fraud} fraud nodes)\ntransactions: {len(rows)}\npatterns: {patterns}\n"
        members = {"metadata": text.encode()} | {n: df.drop(columns="_part").to_csv(index=False).encode() for n, df in (("nodes", node_rows), ("transactions", rows))}
        path = f"{root}/{name}{SUFFIX}"
        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        with store.open_output_stream(inner, compression=None) as out, tarfile.open(fileobj=out, mode="w|gz") as archive:
            for member, content in members.items():
                info = tarfile.TarInfo(f"{name}/{MEMBERS[member]}")
                info.size = len(content)
                archive.addfile(info, io.BytesIO(content))
        return pd.DataFrame({"path": [path], "nodes": [len(node_rows)], "transactions": [len(rows)]})

    sides = [df.withColumn("_part", F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(parts)).cast("int")) for df, c in ((nodes, "nodeid"), (transactions, "sourceNodeId"))]
    packed = sides[0].groupBy("_part").cogroup(sides[1].groupBy("_part")).applyInPandas(pack, "path string, nodes bigint, transactions bigint")
    return materialise(packed, "archives")
