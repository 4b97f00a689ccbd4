"""How often every term occurs and in how many records: recursive radix spilling, aggregated out of core by DuckDB.

Rows are spread over the tasks by a hash of term and record, so a term that holds a third of all rows is spread like any other. A task writes its rows
to files by the leading bits of the term's hash; a file of more than LEAF_BYTES of rows is split by the next bits, and, when the bits of its terms no longer tell its rows
apart, by those of the record. DuckDB aggregates each leaf on its own. The sums of a term over tasks and leaves add up, as no record is split.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.plans.lineage import shared_dir

LEAF_BYTES = 64 << 20  # of rows as they stand in memory
RADIX_BITS = 3
BUFFER_ROWS = 1 << 18
MEMORY = "256MB"


def term(column: str) -> F.Column:
    """Trimmed of blanks and tabs, in lower case."""
    return F.lower(F.regexp_replace(F.col(column), r"^[ \t]+|[ \t]+$", ""))


class Spill:
    """A task's radix files in a folder of any file system, level by level."""

    def __init__(self, folder: str, leaf_bytes: int = LEAF_BYTES, bits: int = RADIX_BITS, disk: pafs.FileSystem | None = None):
        self.disk = disk or pafs.LocalFileSystem()
        self.folder, self.leaf_bytes, self.bits = folder, leaf_bytes, bits
        self.disk.create_dir(folder)

    def write(self, batches: Iterator[pa.Table], level: int, prefix: str) -> list[tuple[str, int]]:
        """Files of the rows by the bits of this level, and their bytes in memory: 64/bits levels of the term's hash h, then as many of the record's hash r."""
        per = 64 // self.bits
        column, shift = ("h", 64 - self.bits * (level + 1)) if level < per else ("r", 64 - self.bits * (level - per + 1))
        writers: dict[int, pq.ParquetWriter] = {}
        sizes: dict[int, int] = {}
        for table in batches:
            radix = (table.column(column).to_numpy().view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            for b in np.unique(radix):
                if b not in writers:
                    writers[b] = pq.ParquetWriter(f"{self.folder}/{prefix}{b:x}.parquet", table.schema, compression="zstd", filesystem=self.disk)
                part = table.filter(pa.array(radix == b))
                sizes[b] = sizes.get(b, 0) + part.nbytes
                writers[b].write_table(part)
        for w in writers.values():
            w.close()
        return [(f"{prefix}{b:x}", sizes[b]) for b in sorted(writers)]

    def leaves(self, batches: Iterator[pa.Table], level: int = 0, prefix: str = "p") -> Iterator[ds.Dataset]:
        """Files of at most leaf_bytes of rows (or rows of one term and record), each to be used before the next is asked for."""
        for name, size in self.write(batches, level, prefix):
            path = f"{self.folder}/{name}.parquet"
            leaf = ds.dataset(path, filesystem=self.disk, format="parquet")
            if size <= self.leaf_bytes or level + 1 >= 2 * (64 // self.bits):
                yield leaf
            else:
                tables = (pa.Table.from_batches([b]) for b in leaf.to_batches(batch_size=BUFFER_ROWS, batch_readahead=1, use_threads=False) if b.num_rows)
                yield from self.leaves(tables, level + 1, f"{name}-")
            self.disk.delete_file(path)


def _tables(batches: Iterator[pa.RecordBatch], rows: int = BUFFER_ROWS) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def frequencies(rows: DataFrame, leaf_bytes: int = LEAF_BYTES, bits: int = RADIX_BITS) -> DataFrame:
    """(field_name, term, n_rows, n_records) from rows (field_name, record, value): value is the stored text, term its trimmed lower-case form.

    Null values and terms that are empty after trimming are ignored, and so are rows with a null record; exact copies of a row count once in n_rows, and a
    record counts once in n_records however often it holds the term. An empty table gives no row. Every term comes out, however rare or common.
    """
    home = f"{shared_dir(rows.sparkSession)}/larkspan-radix-{uuid.uuid4().hex}"
    named = rows.select("field_name", "record", "value", term("value").alias("term")).filter("record IS NOT NULL AND term <> ''")
    named = named.withColumn("h", F.xxhash64("field_name", "term")).withColumn("r", F.xxhash64("record"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies that stand together go before the shuffle, so that a row that is a third of all leaves next to nothing of them."""
        for table in _tables(batches):
            yield from table.group_by(table.column_names, use_threads=False).aggregate([]).to_batches()

    spread = named.mapInArrow(once, named.schema).repartition(F.col("h").bitwiseXOR(F.col("r")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        disk, base = pafs.FileSystem.from_uri(home if "://" in home else f"file://{home}")
        folder = f"{base}-{uuid.uuid4().hex}"
        # A leaf fits into the memory; only where the shared folder is a mounted one can DuckDB spill beyond it.
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY} | ({"temp_directory": f"{folder}/temp"} if isinstance(disk, pafs.LocalFileSystem) else {}))
        try:
            spill = Spill(folder, leaf_bytes, bits, disk)
            for leaf in spill.leaves(_tables(batches)):
                con.register("leaf", leaf)
                got = con.sql("SELECT field_name, term, count(DISTINCT (record, value)) AS n_rows, count(DISTINCT record) AS n_records FROM leaf GROUP BY ALL").to_arrow_table()
                con.unregister("leaf")
                got = got.set_column(2, "n_rows", pc.cast(got.column(2), pa.int64())).set_column(3, "n_records", pc.cast(got.column(3), pa.int64()))
                yield from got.cast(pa.schema([("field_name", pa.string()), ("term", pa.string()), ("n_rows", pa.int64()), ("n_records", pa.int64())])).to_batches()
        finally:
            con.close()
            disk.delete_dir(folder)

    partial = spread.mapInArrow(run, "field_name string, term string, n_rows long, n_records long")
    return partial.groupBy("field_name", "term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"))


def marked(counts: DataFrame, n_all: DataFrame, rare: int = 2, common: float = 0.1) -> DataFrame:
    """counts with mark: rare if at most so many records hold the term, common if more than that part of all records do, else null.

    n_all is one row with the number of all records, n_all. A term that is both is rare.
    """
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > F.col("n_all") * common, "common")
    return counts.crossJoin(F.broadcast(n_all)).select(*counts.columns, mark.alias("mark"))
