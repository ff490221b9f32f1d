"""Square ``.npy`` matrices as a Spark data source: ``spark.read.format("npy_matrix").load(path)``.

A partition is a range of rows of one matrix. Only the file's header is read for planning; a task maps the file
and touches the pages of its own rows, and of those only what lies right of the diagonal. Values leave in Arrow batches
of bounded size, so a task's memory doesn't depend on the matrix. Files have to be on a path that all executors mount.
"""

import glob
import os

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Rows(InputPartition):
    """Rows ``low`` to ``high`` of a file whose values start at ``offset``."""

    def __init__(self, file: str, offset: int, size: int, kind: str, fortran: bool, low: int, high: int):
        self.file, self.offset, self.size, self.kind, self.fortran, self.low, self.high = file, offset, size, kind, fortran, low, high


def header(file: str) -> tuple[int, int, str, bool]:
    """Where the values start, the number of rows, the type, and whether columns come first."""
    with open(file, "rb") as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, kind = read(f)
        if len(shape) != 2 or shape[0] != shape[1] or kind.hasobject:
            raise ValueError(f"{file} isn't a square matrix of numbers: shape {shape}, type {kind}")
        return f.tell(), shape[0], kind.str, fortran


def row_ranges(size: int, values: int, triangle: bool) -> list[tuple[int, int]]:
    """Ranges of rows with about ``values`` values each (at least one row)."""
    length = size - 1 - np.arange(size) if triangle else np.full(size, size)
    ends = np.cumsum(length)
    out, low = [], 0
    while low < size:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + values, side="right")))
        out.append((low, min(size, high)))
        low = out[-1][1]
    return out


class MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.path = str(options.get("path", ""))
        self.values = int(options.get("values_per_partition", 1 << 24))
        self.batch = int(options.get("values_per_batch", 1 << 18))
        self.triangle = str(options.get("triangle", "true")).lower() == "true"

    def partitions(self):
        path = self.path.removeprefix("file://").removeprefix("file:")
        files = sorted(glob.glob(os.path.join(path, "*.npy")) if os.path.isdir(path) else glob.glob(path))
        if not files:
            raise FileNotFoundError(f"no matrices at {self.path}")
        return [Rows(f, *header(f), low, high) for f in map(os.path.abspath, files) for low, high in row_ranges(header(f)[1], self.values, self.triangle)]

    def read(self, part):
        if part.size == 0:
            return
        m = np.memmap(part.file, np.dtype(part.kind), "r", part.offset, (part.size, part.size), "F" if part.fortran else "C")
        i, j, d, held = [], [], [], 0
        for row in range(part.low, part.high):
            first = row + 1 if self.triangle else 0
            while first < part.size:
                last = min(part.size, first + self.batch - held)
                i.append(np.full(last - first, row, np.int32))
                j.append(np.arange(first, last, dtype=np.int32))
                d.append(np.asarray(m[row, first:last]).astype(np.float64))
                held += last - first
                first = last
                if held >= self.batch:
                    yield self._rows(part.file, i, j, d)
                    i, j, d, held = [], [], [], 0
        if held:
            yield self._rows(part.file, i, j, d)

    def _rows(self, file, i, j, d):
        n = sum(map(len, d))
        return pa.RecordBatch.from_arrays([pa.array([f"file:{file}"]).take(pa.array(np.zeros(n, np.int32))), pa.array(np.concatenate(i)), pa.array(np.concatenate(j)), pa.array(np.concatenate(d))], names=["map_id", "i", "j", "d"])


class MatrixSource(DataSource):
    """Options: ``path`` (a file, a folder of .npy files, or a pattern), ``triangle`` (strict upper triangle only, the default), ``values_per_partition``, ``values_per_batch``."""

    @classmethod
    def name(cls):
        return "npy_matrix"

    def schema(self):
        return "map_id string, i int, j int, d double"

    def reader(self, schema):
        return MatrixReader(self.options)
