"""Files that arrive in a folder, scanned as a stream; files that change replace their cells."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cellweave.sources.datasource import OPENING, PARTITION, kind_of
from cellweave.sources.files import modified, opened
from cellweave.sources.reader import path_extension, scan_files
from cellweave.sources.streams import DAMAGE
from cellweave.sources.table_functions import EXTENSIONS, sound_cells

FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Stream of (path, modificationTime, length, content) of new files. A file that changes is not read again; see versions."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).load(folder)


def write_cells(files: DataFrame, exts: set[str], out: str, checkpoint: str, **options) -> StreamingQuery:
    """Write the cells of arriving files as Parquet, a folder a batch: a batch that is run again replaces its own."""

    def batch(df: DataFrame, n: int) -> None:
        scan_files(df.select("path", "content"), exts, **options).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrival_counts(files: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, extension, n, bytes) over tumbling windows of modification times; files later than `late` are left out."""
    t = files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window).alias("w"), path_extension(F.col("path")).alias("extension"))
    return t.agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).select(F.col("w.start").alias("start"), "extension", "n", "bytes")


# files that change

VERSIONS = "path string, version long, content binary"


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)
        self.files = files


class VersionReader(DataSourceStreamReader):
    """Files by the time of their last change: a batch has those that changed since the batch before. Offsets are times in nanoseconds."""

    def __init__(self, options: dict[str, str]):
        self.options = CaseInsensitiveDict(options)

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        # files changed in the last moments may still be written
        end = time.time_ns() - int(float(self.options.get("settleSeconds", "0")) * 1e9)
        return {"until": max([t for _, _, t in modified(self.options["path"]) if t <= end], default=0)}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        out, held, size = [], [], 0
        for path, n, t in modified(self.options["path"]):
            if start["until"] < t <= end["until"]:
                if held and size + n + OPENING > PARTITION:
                    out.append(_Files(held))
                    held, size = [], 0
                held.append((path, t))
                size += n + OPENING
        return out + [_Files(held)] if held else out

    def read(self, part: _Files) -> Iterator[pa.RecordBatch]:
        for path, t in part.files:
            with opened(path) as f:
                data = f.read()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([t], pa.int64()), pa.array([data], pa.binary())], ["path", "version", "content"])


class VersionSource(DataSource):
    """Options: path, settleSeconds (how long a file must have been left alone)."""

    @classmethod
    def name(cls) -> str:
        return "cellweave_versions"

    def schema(self) -> str:
        return VERSIONS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return VersionReader(dict(self.options))


def versions(spark: SparkSession, folder: str, settle: float = 0) -> DataFrame:
    """Stream of (path, version, content): a row for each file whenever it has changed."""
    spark.dataSource.register(VersionSource)
    return spark.readStream.format("cellweave_versions").option("settleSeconds", str(settle)).load(folder)


CHANGES = "path string, version long, action string, message string, sheet_idx int, row_idx int, col_idx int, v_type string, v_str string, v_num double, v_bool boolean, formula string"
_NAMES = [c.split()[0] for c in CHANGES.split(", ")]


class Changes(StatefulProcessor):
    """Keeps each path's last sound version and what it said. The same bytes again give nothing. A new sound version is announced and its
    cells follow; a damaged one is an error, and the cells of the version before stay."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "version long, digest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (path,) = key
        for r in sorted(rows, key=lambda r: r.version):
            data = bytes(r.content or b"")
            digest = hashlib.sha256(data).hexdigest()
            if self.known.exists() and (known := self.known.get()) and (known[1] == digest or known[0] >= r.version):
                continue
            try:
                form = EXTENSIONS.get(kind_of(path))
                if form is None:
                    raise ValueError(f"Unsupported file type: {kind_of(path)}")
                cells = [c[:8] for c in sound_cells(data, form)]
            except DAMAGE as e:
                yield self.row(path, r.version, "error", str(e))
                continue
            self.known.update((r.version, digest))
            yield self.row(path, r.version, "version", None)
            for cell in cells:
                yield self.row(path, r.version, "cell", None, cell)

    def row(self, path: str, version: int, action: str, message: str | None, cell: tuple = (None,) * 8) -> Row:
        return Row(**dict(zip(_NAMES, (path, version, action, message, *cell), strict=True)))

    def close(self) -> None:
        pass


def changes(files: DataFrame) -> DataFrame:
    """Stream of what changed (CHANGES), of a stream of versions: state is kept by path, in RocksDB."""
    files.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return files.groupBy("path").transformWithState(statefulProcessor=Changes(), outputStructType=CHANGES, outputMode="Append", timeMode="None")


def write_changes(changed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write changes as Parquet, a folder a batch: a batch that is run again replaces its own."""

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return changed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(cells, errors) as they stand: the cells of each path's last sound version, and errors of versions after it."""
    c = spark.read.schema(CHANGES).parquet(out)
    last = c.where("action = 'version'").groupBy("path").agg(F.max("version").alias("last"))
    cells = c.where("action = 'cell'").join(last, "path").where("version = last").drop("last", "action", "message").withColumnRenamed("path", "workbook_id")
    errors = c.where("action = 'error'").join(last, "path", "left").where("last is null or version > last").select("path", "version", "message")
    return cells, errors
