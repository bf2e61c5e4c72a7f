"""Ranked domains from a cached archive: a zip with one CSV of rank and domain, as a Python data source.

``ranked`` never makes domains up: an archive that is skipped, missing or unreadable gives no rows and a label that says so.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.pack import UNREADABLE, put

# What the label says of where the domains come from
RANKED, SKIPPED, UNAVAILABLE = "tranco-top-1m", "skipped", "unavailable"
ROWS = "rank long, domain string, fault string"


def _lines(raw: bytes):
    """(rank, domain) of the lines of an archive's first CSV that hold a dotted ASCII domain."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        name = next(n for n in z.namelist() if n.endswith(".csv"))
        with z.open(name) as f:
            for line in f:
                rank, comma, domain = line.decode("utf-8", "ignore").strip().partition(",")
                domain = domain.strip().lower()
                if comma and domain.isascii() and "." in domain:
                    yield int(rank) if rank.strip().isdigit() else None, domain


def _unpack(batches):
    """Rows of the archives' lines, some thousands at a time; an archive that does not read is one row with its fault."""
    for b in batches:
        for raw in b.column("content").to_pylist():
            rows: list[tuple] = []
            try:
                for row in _lines(raw):
                    rows.append((*row, None))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
            except (zipfile.BadZipFile, StopIteration, OSError, EOFError, ValueError, RuntimeError) as e:
                rows.append((None, None, str(e) or type(e).__name__))
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ranks, domains, faults = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(domains, pa.string()), pa.array(faults, pa.string())], ["rank", "domain", "fault"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """rank, domain, fault of all archives at ``path``; each archive is read by one task, line by line."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_unpack, ROWS)


def ranked(spark: SparkSession, path: str, skip: bool = False) -> tuple[DataFrame, str]:
    """(rank, domain; label). An archive with any fault counts as unavailable as a whole."""
    none = spark.createDataFrame([], "rank long, domain string")
    if skip:
        return none, SKIPPED
    try:
        rows = read_archives(spark, path)
        faults = rows.agg(F.count("*").alias("n"), F.count("fault").alias("bad")).first()
    except UNREADABLE:
        return none, UNAVAILABLE
    return (none, UNAVAILABLE) if faults["bad"] or not faults["n"] else (rows.select("rank", "domain"), RANKED)


def write_archive(spark: SparkSession, domains: DataFrame, path: str) -> None:
    """Write ``domains`` (rank, domain) as an archive. Such a list is a bounded file (a million lines); it streams through the driver."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("top-1m.csv", "w") as f:
        for r in domains.orderBy("rank").toLocalIterator():
            f.write(f"{r['rank']},{r['domain']}\n".encode())
    put(spark, path, out.getvalue())
