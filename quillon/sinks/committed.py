"""A report that is there whole or not at all: a data source writer with one commit.

Tasks write ordered parts below ``path``/parts; the commit lists them, in order, with the exit code, in ``path``/report.json, which is
put in place by one rename. Readers go by that file, so what a failed or repeated task left behind is never seen, and the
report before stays until the new one is there. Only the names of parts and their numbers of lines come to the driver.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillon import storage

LINES = "pair_id long, section_ord int, row_ord long, line string"
MANIFEST = "report.json"
ORDER = ["pair_id", "section_ord", "row_ord", "line"]


@dataclass
class _Part(WriterCommitMessage):
    number: int
    name: str
    lines: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.code, self.overwrite = options["path"], int(options.get("code", "0")), overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        fs, base = storage.filesystem(self.path)
        fs.create_dir(f"{base}/parts", recursive=True)
        number, n = TaskContext.get().partitionId(), 0
        name = f"{number:06d}-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{base}/parts/{name}", compression=None) as out:
            for batch in iterator:
                out.write(b"".join(batch.column(0).cast(pa.binary()).to_pylist()))
                n += batch.num_rows
        return _Part(number, name, n)

    def commit(self, messages):
        fs, base = storage.filesystem(self.path)
        fs.create_dir(base, recursive=True)
        before = set(_manifest(fs, base)["parts"])
        parts = [m.name for m in sorted((m for m in messages if m is not None and m.lines), key=lambda m: m.number)]
        with fs.open_output_stream(f"{base}/.{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"parts": parts, "lines": sum(m.lines for m in messages if m is not None), "code": self.code}).encode())
        fs.move(f"{base}/.{MANIFEST}", f"{base}/{MANIFEST}")
        for name in before - set(parts):
            fs.delete_file(f"{base}/parts/{name}")

    def abort(self, messages):
        fs, base = storage.filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{base}/parts/{m.name}")


def _manifest(fs, base: str) -> dict:
    from pyarrow import fs as pafs

    if fs.get_file_info(f"{base}/{MANIFEST}").type == pafs.FileType.NotFound:
        return {"parts": [], "lines": 0, "code": None}
    with fs.open_input_file(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


class CommittedReport(DataSource):
    @classmethod
    def name(cls):
        return "committed_report"

    def schema(self):
        return LINES

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def write(lines: DataFrame, codes: DataFrame, path: str) -> None:
    """Write the lines of a report (``LINES``) in order, made JSON by Spark, with the highest of ``codes`` (code); ``path`` is a URI all can reach."""
    spark = lines.sparkSession
    storage.ship(spark)
    spark.dataSource.register(CommittedReport)
    code = codes.agg(F.coalesce(F.max("code"), F.lit(0))).first()[0]
    # ranges are found by a look at all lines before they are dealt out, so the lines are made once and stored
    ordered = storage.stored(lines.select(*ORDER), "lines").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ready = ordered.select(F.concat(F.to_json(F.struct(*ORDER), {"ignoreNullFields": "false"}), F.lit("\n")).alias("json"))
    ready.write.format("committed_report").option("code", code).mode("append").save(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, int | None]:
    """The lines of the report that was committed, and its exit code; no lines and None if there is none."""
    fs, base = storage.filesystem(path)
    found = _manifest(fs, base)
    if not found["parts"]:
        return spark.createDataFrame([], LINES), found["code"]
    return spark.read.schema(LINES).json([f"{path}/parts/{p}" for p in found["parts"]]), found["code"]
