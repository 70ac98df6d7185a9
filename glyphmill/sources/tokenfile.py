"""Flat token files: a stream of 16-bit ids per split, as a Spark data source.

A folder holds part files (nothing but little-endian unsigned 16-bit ids) and
manifests that say which part begins where in which split's stream.  Block i of
a split is the ids from ``i * length`` to ``(i + 1) * length`` inclusive, found
by one search in the manifest and one or two short reads.

Commit protocol.  A task writes parts under names of its own attempt and hands
their places to the driver; parts count only once the driver has put a manifest
in place with a single rename.  A failed or repeated attempt leaves at most a
file that no manifest names.  A streaming batch writes the manifest of its own
number, so a batch that is run again replaces itself.

``place`` gives documents their place in the stream and the writer its order;
every task then writes one contiguous region per split and part.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)

from glyphmill.operators import packing
from glyphmill.operators.packing import BLOCK, DOC_SEED
from glyphmill.plans.sizing import BUCKET_DIGITS
from glyphmill.session import shuffles_removed

FORMAT = "tokenfile"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PLACED = "split string, start bigint, ids array<int>"
BLOCKS = "split string, block_id bigint, tokens array<int>"
MOST = 2**16
PART_IDS = 32 << 20
BLOCKS_A_TASK = 4096
BLOCKS_A_BATCH = 256


@dataclass(frozen=True)
class Part:
    """A contiguous region of a split's stream."""

    split: str
    start: int
    size: int
    file: str


@dataclass
class Written(WriterCommitMessage):
    parts: list[Part]


def place(tokens: DataFrame, seed: int = DOC_SEED, digits: int = BUCKET_DIGITS) -> DataFrame:
    """``split, start, ids`` of ``doc_id, split, ids``, in the order of each split's shuffled stream; see ``packing.place``."""
    placed = packing.place(tokens, seed, digits).select("split", F.col("st").alias("start"), "ids")
    return placed.repartitionByRange("split", "start").sortWithinPartitions("split", "start")


# -- files -------------------------------------------------------------------------


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _manifests(folder: str) -> dict[str, list[Part]]:
    files, base = _open(folder)
    found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))
    out = {}
    for name in names:
        with files.open_input_stream(f"{base}/{name}") as f:
            out[name] = [Part(**p) for p in json.loads(f.read())]
    return out


def parts_of(folder: str) -> dict[str, list[Part]]:
    """The parts of every split in stream order.

    Parts of one manifest carry their places; those of later manifests (batches
    of a stream) follow in the order of their numbers.
    """
    out: dict[str, list[Part]] = {}
    for parts in _manifests(folder).values():
        ends = {s: ps[-1].start + ps[-1].size for s, ps in out.items()}
        for p in sorted(parts, key=lambda p: (p.split, p.start)):
            out.setdefault(p.split, []).append(Part(p.split, ends.get(p.split, 0) + p.start, p.size, p.file))
    for split, ps in out.items():
        at = 0
        for p in ps:
            if p.start != at:
                raise ValueError(f"{folder}: the stream of {split} has a gap or an overlap at id {at}")
            at += p.size
    return out


def read_ids(folder: str, parts: Sequence[Part], start: int, stop: int) -> np.ndarray:
    """The ids of a split's stream from ``start`` up to ``stop`` (or its end), by offset."""
    files, base = _open(folder)
    out = []
    k = max(bisect_right([p.start for p in parts], start) - 1, 0)
    while k < len(parts) and parts[k].start < stop:
        p = parts[k]
        low, high = max(start, p.start), min(stop, p.start + p.size)
        if low < high:
            with files.open_input_file(f"{base}/{p.file}") as f:
                out.append(np.frombuffer(f.read_at(2 * (high - low), 2 * (low - p.start)), "<u2"))
        k += 1
    return np.concatenate(out) if out else np.zeros(0, "<u2")


def read_block(folder: str, split: str, block: int, length: int = BLOCK) -> np.ndarray:
    """Block ``block`` of a split: ``length + 1`` ids, fewer at the end of the stream."""
    return read_ids(folder, parts_of(folder).get(split, []), block * length, (block + 1) * length + 1)


def _publish(folder: str, number: int, messages: Sequence[Written | None]) -> None:
    """Put a manifest in place: written aside, then renamed."""
    files, base = _open(folder)
    parts = [vars(p) for m in messages if m is not None for p in m.parts]
    aside = f"{base}/.manifest-{uuid.uuid4().hex}"
    with files.open_output_stream(aside, compression=None) as f:
        f.write(json.dumps(parts).encode())
    files.move(aside, f"{base}/manifest-{number:012d}.json")


# -- the data source -------------------------------------------------------------------


class _Parts:
    """What batch and stream writers share: one task's parts."""

    def __init__(self, folder: str, part_ids: int):
        self.folder, self.part_ids = folder, part_ids

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = _open(self.folder)
        files.create_dir(base, recursive=True)
        done: list[Part] = []
        out = None
        split, first, size, name = "", 0, 0, ""

        def close():
            if out is not None:
                out.close()
                done.append(Part(split, first, size, name))

        for batch in iterator:
            for s, start, ids in zip(batch.column("split").to_pylist(), batch.column("start").to_pylist(), batch.column("ids")):
                values = ids.values.to_numpy(zero_copy_only=False)
                if len(values) and (values.min() < 0 or values.max() >= MOST):
                    raise ValueError("an id does not fit 16 bits")
                if out is None or s != split or start != first + size or size >= self.part_ids:
                    close()
                    split, first, size, name = s, start, 0, f"part-{uuid.uuid4().hex}.u16"
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                out.write(values.astype("<u2").tobytes())
                size += len(values)
        close()
        return Written(done)

    def abort(self, messages) -> None:
        """Nothing to undo: no manifest names the parts of an aborted write."""


class TokenFileWriter(_Parts, DataSourceArrowWriter):
    def __init__(self, folder: str, part_ids: int, overwrite: bool):
        super().__init__(folder, part_ids)
        self.overwrite = overwrite

    def commit(self, messages) -> None:
        old = _manifests(self.folder)
        if old and not self.overwrite:
            raise ValueError(f"{self.folder} holds a token file; write with mode overwrite")
        _publish(self.folder, 0, messages)
        files, base = _open(self.folder)
        named = {p.file for m in messages if m is not None for p in m.parts}
        for name in old:
            if name != "manifest-000000000000.json":
                files.delete_file(f"{base}/{name}")
        for p in (p for parts in old.values() for p in parts):
            if p.file not in named:
                files.delete_file(f"{base}/{p.file}")


class TokenFileStreamWriter(_Parts, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        _publish(self.folder, batchId, messages)

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        """As for a batch."""


class TokenFileReader(DataSourceReader):
    """Blocks of all splits."""

    def __init__(self, folder: str, length: int):
        self.folder, self.length = folder, length
        self.splits: set[str] | None = None
        self.blocks: set[int] | None = None

    def partitions(self) -> list[InputPartition]:
        out = []
        for split, parts in parts_of(self.folder).items():
            if self.splits is not None and split not in self.splits:
                continue
            n = -(-(parts[-1].start + parts[-1].size) // self.length)
            if self.blocks is not None:
                out += [InputPartition((split, b, b + 1)) for b in sorted(self.blocks) if 0 <= b < n]
            else:
                out += [InputPartition((split, a, min(a + BLOCKS_A_TASK, n))) for a in range(0, n, BLOCKS_A_TASK)]
        return out or [InputPartition(("", 0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        split, first, last = partition.value
        parts = parts_of(self.folder).get(split, [])
        for a in range(first, last, BLOCKS_A_BATCH):
            b = min(a + BLOCKS_A_BATCH, last)
            ids = read_ids(self.folder, parts, a * self.length, b * self.length + 1).astype(np.int32)
            tokens = [ids[k * self.length : (k + 1) * self.length + 1] for k in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([split] * (b - a)), pa.array(range(a, b), pa.int64()), pa.array(tokens, pa.list_(pa.int32()))],
                names=["split", "block_id", "tokens"],
            )


class FilteredReader(TokenFileReader):
    """A filter on ``split`` or ``block_id`` reads only those blocks."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("split",):
                self.splits = values if self.splits is None else self.splits & values
            elif values is not None and f.attribute == ("block_id",):
                self.blocks = values if self.blocks is None else self.blocks & values
            else:
                yield f


class TokenFile(DataSource):
    """Options: ``path``; ``length`` of a block when read; ``part_ids``, ids after which a new part begins."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> TokenFileReader:
        kind = FilteredReader if self.options.get("pushdown") == "true" else TokenFileReader
        return kind(self.options["path"], int(self.options.get("length", BLOCK)))

    def writer(self, schema, overwrite: bool) -> TokenFileWriter:
        return TokenFileWriter(self.options["path"], int(self.options.get("part_ids", PART_IDS)), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> TokenFileStreamWriter:  # noqa: N802
        return TokenFileStreamWriter(self.options["path"], int(self.options.get("part_ids", PART_IDS)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenFile)


def write_token_file(tokens: DataFrame, path: str, overwrite: bool = False, **options: int) -> None:
    """Write ``doc_id, split, ids`` as flat token streams."""
    register(tokens.sparkSession)
    mode = "overwrite" if overwrite else "append"
    with shuffles_removed(tokens.sparkSession):
        place(tokens).write.format(FORMAT).options(path=path, **options).mode(mode).save()


def read_token_file(spark: SparkSession, path: str, length: int = BLOCK) -> DataFrame:
    """``split, block_id, tokens``; the last block of a split may be shorter.

    Filters choose the blocks that are read where the session lets Python data
    sources see them (``spark.sql.python.filterPushdown.enabled``).
    """
    register(spark)
    pushdown = spark.conf.get(PUSHDOWN, "false").lower()
    return spark.read.format(FORMAT).options(path=path, length=length, pushdown=pushdown).load()
