"""FASTA files as genome tiles, read by byte ranges.

A first job counts: every task scans one byte range and reports the headers and
the bases it finds, running sums over these reports say which base of which
chromosome a range begins with. This index is a table in the shared folder. The data
source ``fasta_tiles`` then deals the ranges to tasks; a tile belongs to the range
its first base stands in and is read to its end from there. So no task and no row
holds a chromosome, however long its lines are, and filters on ``chrom`` leave the
ranges of other chromosomes unread.

A name is what stands between ``>`` and white space; bases are taken without white
space; lines before the first header belong to nobody; lines may have any lengths
and end in line feeds with or without carriage returns. A header without bases
gives no row. Compressed files can't be cut: unpack them first.

Files are opened with ``pyarrow.fs``, so a path may be local (shared by all
executors), or a URI of HDFS or an object store.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from strandlab.operators.session import shared_dir

SCHEMA = "chrom string, at bigint, seq string"
INDEX = "file string, chrom string, byte bigint, base bigint, bases bigint, length bigint"
RANGE_BYTES = 2**25
CHUNK = 2**20
ROWS, BATCH_BASES = 4096, 2**22
SPACE = b" \t\r\n\x0b\x0c"
REPORT = "file string, begin bigint, byte bigint, chrom string, bases bigint, open_start boolean, ends_in_header boolean"


def _opened(path: str):
    """File system and path; Hadoop writes local URIs with one slash."""
    return FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _bases(raw: bytes) -> int:
    return len(raw.translate(None, SPACE))


def _scan(handle, begin: int, end: int, size: int) -> Iterator[tuple]:
    """(byte, chrom, bases, open_start, ends_in_header) of the stretches of [begin, end).

    A stretch without a name goes on with the chromosome before. ``open_start``: it
    begins inside a line, which may be a header; then ``bases`` counts up to the end
    of that line and only what came before tells whether they count.
    ``ends_in_header`` says how the last stretch ends, null where that is open.
    """
    handle.seek(max(begin - 1, 0))
    fresh = begin == 0 or handle.read(1) == b"\n"
    state = "line" if fresh else "open"  # line: at the start of a line; open: inside an unknown one; bases; header
    byte, name, bases, header_at = begin, None, 0, 0
    header = bytearray()
    at = begin
    while at < end:
        chunk = handle.read(min(CHUNK, end - at))
        if not chunk:
            break
        i = 0
        while i < len(chunk):
            if state == "line":
                state = "header" if chunk[i : i + 1] == b">" else "bases"
                if state == "header":
                    yield byte, name, bases, False, False
                    header, header_at = bytearray(), at + i
            stop = chunk.find(b"\n", i)
            if state == "header":
                header += chunk[i : len(chunk) if stop < 0 else stop]
                if stop >= 0:
                    byte, name, bases, state = at + stop + 1, _name(header), 0, "line"
                i = len(chunk) if stop < 0 else stop + 1
            elif state == "open":
                bases += _bases(chunk[i : len(chunk) if stop < 0 else stop])
                if stop >= 0:
                    yield byte, None, bases, True, None
                    byte, name, bases, state = at + stop + 1, None, 0, "line"
                i = len(chunk) if stop < 0 else stop + 1
            else:
                # On to the next header, over all lines of bases between.
                stop = chunk.find(b"\n>", i)
                rest = chunk[i : len(chunk) if stop < 0 else stop]
                bases += _bases(rest)
                if stop >= 0:
                    i, state = stop + 1, "line"
                else:
                    i, state = len(chunk), "line" if chunk.endswith(b"\n") else "bases"
        at += len(chunk)
    if state == "header":
        # The name goes on in the next range.
        while at < size and b"\n" not in header:
            more = handle.read(4096)
            header += more
            at += len(more)
        line = bytes(header).split(b"\n")[0]
        yield header_at + len(line) + 1, _name(line), 0, False, True
    elif state == "open":
        yield byte, None, bases, True, None
    else:
        yield byte, name, bases, False, False


def _name(header: bytes) -> str:
    words = bytes(header)[1:].split()
    return words[0].decode("utf-8", "replace") if words else ""


def index_fasta(spark: SparkSession, path: str, index: str | None = None, range_bytes: int = RANGE_BYTES) -> str:
    """Writes the index of a file, a folder or a glob of them and returns its path (a new folder in the shared one where none is given)."""
    index = index or f"{shared_dir(spark)}/fasta-index-{uuid.uuid4().hex}"
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    packed = files.where(F.lower("file").rlike(r"\.(gz|bz2|zst|xz|zip)$")).first()
    if packed:
        raise ValueError(f"{packed.file} is compressed and can't be cut: unpack it first")
    step = F.lit(range_bytes).cast("bigint")
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, step)).alias("begin"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, name = _opened(row["file"])
                with system.open_input_file(name) as handle:
                    held = []
                    for found in _scan(handle, row["begin"], min(row["begin"] + range_bytes, row["length"]), row["length"]):
                        held.append((row["file"], row["begin"], *found))
                        if len(held) == ROWS:
                            yield _batch(held)
                            held = []
                    if held:
                        yield _batch(held)

    # Ranges in files' order are dealt out evenly: they all are of one size.
    reports = ranges.repartition(F.col("file"), F.col("begin")).mapInArrow(scan, REPORT)
    # One row for each range and header: small beside the file, whatever its size.
    before = Window.partitionBy("file").orderBy("begin", "byte", F.col("chrom").isNotNull(), F.col("open_start").desc()).rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.col("open_start") & F.coalesce(F.last("ends_in_header", ignorenulls=True).over(before), F.lit(False))
    rows = reports.withColumn("bases", F.when(inside, F.lit(0)).otherwise(F.col("bases")))
    rows = rows.withColumn("nth", F.count("chrom").over(upto)).withColumn("chrom", F.last("chrom", ignorenulls=True).over(upto))
    rows = rows.where("nth > 0 and bases > 0")
    one = Window.partitionBy("file", "nth")
    along = one.orderBy("begin", "byte").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("file", "chrom", "byte", F.coalesce(F.sum("bases").over(along), F.lit(0)).alias("base"), "bases", F.sum("bases").over(one).alias("length"))
    rows.write.parquet(index)
    return index


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file", "begin", "byte", "chrom", "bases", "open_start", "ends_in_header"])


class Stretches(InputPartition):
    """(file, chrom, byte, base, bases, length) of stretches that one task reads."""

    def __init__(self, rows: list[tuple]):
        super().__init__(rows)
        self.rows = rows


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.index, self.size = options["index"], int(options.get("tile", 2**16))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",):
                values = {f.value}
            elif isinstance(f, In) and f.attribute == ("chrom",):
                values = set(f.value)
            else:
                yield f
                continue
            self.wanted = values if self.wanted is None else self.wanted & values

    def partitions(self) -> list[Stretches]:
        system, path = _opened(self.index)
        table = pyarrow.dataset.dataset(path, filesystem=system, format="parquet")
        where = None if self.wanted is None else pyarrow.dataset.field("chrom").isin(list(self.wanted))
        rows = sorted(tuple(r[c] for c in ("file", "byte", "chrom", "base", "bases", "length")) for r in table.to_table(filter=where).to_pylist())
        # Short chromosomes share a task.
        out, held, size = [], [], 0
        for row in rows:
            held.append(row)
            size += row[4]
            if size >= RANGE_BYTES // 2 or len(held) >= ROWS:
                out.append(Stretches(held))
                held, size = [], 0
        return [*out, Stretches(held)] if held or not out else out

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        held, size, handle, opened = [], 0, None, None
        for file, byte, chrom, base, bases, length in partition.rows:
            if file != opened:
                system, name = _opened(file)
                handle, opened = system.open_input_file(name), file
            for at, seq in _tiles(handle, byte, base, bases, length, self.size):
                held.append((chrom, at, seq))
                size += len(seq)
                if size >= BATCH_BASES or len(held) >= ROWS:
                    yield _tile_batch(held)
                    held, size = [], 0
        if held:
            yield _tile_batch(held)


def _tiles(handle, byte: int, base: int, bases: int, length: int, size: int) -> Iterator[tuple[int, str]]:
    """The tiles that begin in a stretch; the last one is read beyond its end."""
    at = -(-base // size) * size
    skip, end = at - base, base + bases
    handle.seek(byte)
    buffer = bytearray()
    while at < end:
        want = min(size, length - at)
        while len(buffer) < skip + want:
            chunk = handle.read(CHUNK)
            if not chunk:
                raise EOFError("the file is shorter than its index says")
            buffer += chunk.translate(None, SPACE)
            drop = min(skip, len(buffer))
            del buffer[:drop]
            skip -= drop
        # One deletion for many tiles.
        n, cut = len(buffer), 0
        while at < end and n - cut >= (want := min(size, length - at)):
            yield at, buffer[cut : cut + want].decode("latin-1")
            cut, at = cut + want, at + size
        del buffer[:cut]


def _tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    chrom, at, seq = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(chrom, pa.string()), pa.array(at, pa.int64()), pa.array(seq, pa.string())], names=["chrom", "at", "seq"])


class FastaTiles(DataSource):
    """Options: ``index`` (a folder that ``index_fasta`` wrote), ``tile`` (bases in a tile)."""

    @classmethod
    def name(cls) -> str:
        return "fasta_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def read_fasta(spark: SparkSession, path: str, tile: int = 2**16, index: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(chrom, at, seq): tiles of ``tile`` bases; ``index`` is an index written before, else one is made now."""
    spark.dataSource.register(FastaTiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    index = index or index_fasta(spark, path, range_bytes=range_bytes)
    return spark.read.format("fasta_tiles").option("index", index).option("tile", tile).load()


def write_fasta(tiles: DataFrame, path: str) -> None:
    """(chrom, at, seq) as FASTA, one line for each tile; a chromosome stands in one file, which the format demands, and is sorted, not gathered."""
    lines = tiles.select("chrom", F.col("at").cast("bigint").alias("at"), F.col("seq").alias("value"))
    heads = tiles.select("chrom").distinct().select("chrom", F.lit(-1).cast("bigint").alias("at"), F.concat(F.lit(">"), "chrom").alias("value"))
    lines.unionByName(heads).repartition("chrom").sortWithinPartitions("chrom", "at").select("value").write.text(path)
