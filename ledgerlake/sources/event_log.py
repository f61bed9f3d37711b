"""An event log as a resumable stream: a Python data source whose offset is the id of the last event read.

    spark.dataSource.register(EventLog)
    spark.readStream.format("event_log").option("ident", "event_id").option("cursor", 100).load(path)

The log is a Parquet file or folder that may grow. A page holds `page` events, and a micro-batch takes `pages` of them at
most (if not given, as many as hold BATCH events), so neither a long log nor a late reader makes a batch large.
Neighbouring pages share a partition of SHARE events, so a task has enough to do however small pages are. Files' footers tell which
row groups may hold the next ids, and the driver reads the ids of those alone, a few where the log was written in about
the order of its ids; rows are read by the tasks, each only the row groups of its page. A stream that is started again
goes on after the last id of its checkpoint, and each id is read once. Paths are opened by pyarrow's file systems.

Ids are whole numbers, and later events have larger ones. Events without an id are never read; an id that occurs
twice is read twice, in one page, which may then hold more than `page` events. A log without files or rows is an empty stream, with the schema it was given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from ledgerlake.sources.paths import opened


#: Events of a micro-batch where no number of pages is given, and of a partition, in whole pages.
BATCH, SHARE = 1_000_000, 50_000


@dataclass
class Page(InputPartition):
    """One or more neighbouring pages: the ids from `low` to `high`, both included, of the files that may hold them."""

    low: int
    high: int
    files: tuple[str, ...]


@dataclass(frozen=True)
class Stretch:
    """The ids of a row group."""

    low: int
    high: int
    file: str
    group: int


def pages(ids: np.ndarray, page: int, most: int | None = None) -> list[tuple[int, int]]:
    """Runs of `page` of the ascending ids (more where the last one is repeated), `most` of them: first and last id of each."""
    out, at = [], 0
    while at < len(ids) and (most is None or len(out) < most):
        last = ids[min(at + page, len(ids)) - 1]
        out.append((int(ids[at]), int(last)))
        at = int(np.searchsorted(ids, last, side="right"))
    return out


def ids_ahead(stretches: list[Stretch], after: int, most: int | None, end: int | None, read: Callable[[Stretch], np.ndarray]) -> np.ndarray:
    """At least the first `most` ids after a cursor, up to `end`, in order. Only stretches that may hold one of these are read."""
    found = np.zeros(0, np.int64)
    for s in sorted(stretches, key=lambda s: s.low):
        full = most is not None and len(found) >= most
        if s.high <= after:
            continue
        if end is not None and s.low > end or full and s.low > found[most - 1]:
            break
        own = read(s)
        own = own[(own > after) & (own <= (2**63 - 1 if end is None else end))]
        found = np.sort(np.concatenate([found, own]))
        if most is not None and len(found) > most:  # and all that repeat the last
            found = found[: np.searchsorted(found, found[most - 1], side="right")]
    return found


class EventLogReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.ident = options.get("ident", "id")
        self.first = int(options.get("cursor", -(2**62)))
        self.until = int(options["until"]) if "until" in options else None
        self.page = int(options.get("page", 100))
        self.most = int(options.get("pages", max(1, BATCH // self.page)))
        self.at: int | None = None
        self.known: dict[tuple, list[Stretch]] = {}

    def stretches(self) -> list[Stretch]:
        """Of every row group with ids; footers are read once a file, again if its size or time changes."""
        system, path = opened(self.path)
        found = system.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        seen = {}
        for f in files:
            name = f.base_name
            if f.type != fs.FileType.File or name.startswith(("_", ".")) or not f.size:
                continue
            key = (f.path, f.size, f.mtime_ns)
            seen[key] = self.known[key] if key in self.known else self._of(system, f.path)
        self.known = seen
        return [s for some in seen.values() for s in some]

    def _of(self, system: fs.FileSystem, path: str) -> list[Stretch]:
        out = []
        with system.open_input_file(path) as raw:
            file = pq.ParquetFile(raw)
            column = file.schema_arrow.get_field_index(self.ident)
            for k in range(file.num_row_groups):
                stats = file.metadata.row_group(k).column(column).statistics
                if stats is not None and stats.has_min_max:
                    low, high = stats.min, stats.max
                else:
                    ends = pc.min_max(file.read_row_group(k, columns=[self.ident]).column(0)).as_py()
                    low, high = ends["min"], ends["max"]
                if low is not None:
                    out.append(Stretch(int(low), int(high), path, k))
        return out

    def ahead(self, after: int, most: int | None, end: int | None) -> tuple[list[tuple[int, int]], list[Stretch]]:
        """The next pages after a cursor, and all stretches."""
        system, _ = opened(self.path)
        stretches = self.stretches()

        def read(s: Stretch) -> np.ndarray:
            with system.open_input_file(s.file) as raw:
                return np.asarray(pq.ParquetFile(raw).read_row_group(s.group, columns=[self.ident]).column(0).drop_null().combine_chunks(), np.int64)

        return pages(ids_ahead(stretches, after, most and most * self.page, end, read), self.page, most), stretches

    def initialOffset(self) -> dict:
        return {"cursor": self.first}

    def latestOffset(self) -> dict:
        """Up to `pages` pages on from what was planned last."""
        start = self.first if self.at is None else self.at
        ahead, _ = self.ahead(start, self.most, self.until)
        return {"cursor": ahead[-1][1] if ahead else start}

    def partitions(self, start: dict, end: dict) -> Sequence[Page]:
        """The pages between two cursors, neighbours together. A stream that is started again is asked for its last batch first."""
        self.at = max(end["cursor"], self.first if self.at is None else self.at)
        found, stretches = self.ahead(start["cursor"], None, end["cursor"])
        step = max(1, SHARE // self.page)
        runs = [(found[k][0], found[min(k + step, len(found)) - 1][1]) for k in range(0, len(found), step)]
        return [Page(low, high, tuple(sorted({s.file for s in stretches if s.low <= high and low <= s.high}))) for low, high in runs]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        ident = ds.field(self.ident)
        table = ds.dataset(list(partition.files), filesystem=system, format="parquet").to_table(columns=self.schema.names, filter=(ident >= partition.low) & (ident <= partition.high))
        yield from table.sort_by(self.ident).to_batches()


class EventLog(DataSource):
    """Options: path, ident, cursor (read events after it), until (and up to this one), page, pages."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> StructType:
        system, path = opened(self.options["path"])
        return from_arrow_schema(ds.dataset(path, filesystem=system, format="parquet").schema)

    def streamReader(self, schema: StructType) -> EventLogReader:
        return EventLogReader(dict(self.options), schema)
