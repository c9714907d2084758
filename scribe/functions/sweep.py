"""Sweeps down a page: boxes grouped into rows, boxes of a line merged, thin runs joined, in one pass over sorted arrays."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

Box = tuple[int, int, int, int, int]  # y, x, idx, width, height
FIELDS = ("y", "x", "idx", "width", "height")
BOX = StructType([StructField(f, IntegerType()) for f in FIELDS])
RUN = StructType([StructField(f, LongType()) for f in ("begin", "end")])


class Open:
    """What a later box may still join, in the order it was begun.

    Boxes come in order of y, so what ends at or above the next box's y can be joined by none: a heap of lower edges
    takes it out. The entries that a box is compared with are those that stand beside it on the page.
    """

    def __init__(self):
        self.last: dict[int, Box] = {}
        self.edges: list[tuple[int, int]] = []

    def put(self, number: int, box: Box) -> None:
        self.last[number] = box
        heapq.heappush(self.edges, (box[0] + box[4], number))

    def beside(self, y: int) -> Iterator[tuple[int, Box]]:
        while self.edges and self.edges[0][0] <= y:
            edge, number = heapq.heappop(self.edges)
            box = self.last.get(number)
            if box is not None and box[0] + box[4] <= y:
                del self.last[number]
        return iter(self.last.items())


def same_row(a: Box, b: Box, share: float = 0.5) -> bool:
    over = min(a[0] + a[4], b[0] + b[4]) - max(a[0], b[0])
    return over > 0 and over >= share * min(a[4], b[4])


def parted(a: Box, b: Box, gutters: list[tuple[int, int]]) -> bool:
    left, right = (a, b) if a[1] <= b[1] else (b, a)
    return any(g < right[1] and h > left[1] + left[3] for g, h in gutters)


def grouped(boxes: list[Box], gutters: list[tuple[int, int]]) -> list[list[Box]]:
    """Rows of boxes, each box in the first row whose last member it stands beside; rows by least y, members by x."""
    rows: list[list[Box]] = []
    open_ = Open()
    for box in boxes:
        number = next((k for k, last in open_.beside(box[0]) if same_row(last, box) and not parted(last, box, gutters)), len(rows))
        if number == len(rows):
            rows.append([])
        rows[number].append(box)
        open_.put(number, box)
    rows.sort(key=lambda row: min(b[0] for b in row))
    return [sorted(row, key=lambda b: (b[1], b[0], b[2])) for row in rows]


def merged(boxes: list[Box], gutters: list[tuple[int, int]], near: float, passes: int = 4) -> list[Box]:
    """Boxes joined with the first one of their line that is near; up to `passes` times, or until nothing changes."""
    for _ in range(passes):
        state: list[Box] = []
        open_ = Open()
        for box in boxes:
            for number, e in open_.beside(box[0]):
                left, right = (e, box) if e[1] <= box[1] else (box, e)
                if same_row(e, box) and right[1] - left[1] - left[3] <= near and not parted(e, box, gutters):
                    y, x = min(e[0], box[0]), min(e[1], box[1])
                    box = (y, x, min(e[2], box[2]), max(e[1] + e[3], box[1] + box[3]) - x, max(e[0] + e[4], box[0] + box[4]) - y)
                    state[number] = box
                    break
            else:
                number = len(state)
                state.append(box)
            open_.put(number, box)
        done = len(state) == len(boxes)
        boxes = sorted(state)
        if done:
            break
    return boxes


def joined(runs: list[tuple[int, int]], typical: float, least: int = 3) -> list[tuple[int, int]]:
    """Runs of rows, a thin one joined to the next across a small gap; those under `least` rows go."""
    out: list[tuple[int, int]] = []
    for begin, end in runs:
        if out and begin - out[-1][1] <= max(1.0, typical * 0.22) and out[-1][1] - out[-1][0] <= max(3.0, typical * 0.45):
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return [r for r in out if r[1] - r[0] >= least]


def _items(column: pa.Array, names: tuple[str, ...]) -> Iterator[list[tuple] | None]:
    """The arrays of structs of a column as lists of tuples."""
    for value in column:
        if not value.is_valid:
            yield None
            continue
        flat = value.values
        yield list(zip(*(flat.field(n).to_pylist() for n in names))) if len(flat) else []


def _structs(rows: list[tuple] | None, names: tuple[str, ...]) -> list[dict] | None:
    return None if rows is None else [dict(zip(names, r)) for r in rows]


def _type(names: tuple[str, ...], kind: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct([(n, kind) for n in names]))


def _rows(boxes: pa.Array, gutters: pa.Array) -> pa.Array:
    out = [None if b is None else [_structs(row, FIELDS) for row in grouped(b, g or [])] for b, g in zip(_items(boxes, FIELDS), _items(gutters, ("a", "b")))]
    return pa.array(out, pa.list_(_type(FIELDS, pa.int32())))


def _merge(boxes: pa.Array, gutters: pa.Array, near: pa.Array) -> pa.Array:
    out = [None if b is None or n is None else _structs(merged(b, g or [], n), FIELDS) for b, g, n in zip(_items(boxes, FIELDS), _items(gutters, ("a", "b")), near.to_pylist())]
    return pa.array(out, _type(FIELDS, pa.int32()))


def _bands(runs: pa.Array, typical: pa.Array) -> pa.Array:
    out = [None if r is None else _structs(joined(r, t), ("begin", "end")) for r, t in zip(_items(runs, ("begin", "end")), typical.to_pylist())]
    return pa.array(out, _type(("begin", "end"), pa.int64()))


rows_of_page = F.arrow_udf(_rows, ArrayType(ArrayType(BOX)))
merged_of_page = F.arrow_udf(_merge, ArrayType(BOX))
bands_of_page = F.arrow_udf(_bands, ArrayType(RUN))
