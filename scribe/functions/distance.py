"""Edit distance of whole texts, which go through Arrow in batches.

Pairs that are alike are followed along the diagonals of their table, all pairs of a batch side by side, so that the work
grows with the edits; for the others bits of long integers hold a column of the table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Rows of the table that are one integer; longer texts take several strips, and memory grows with one strip and one text.
STRIP = 1 << 14


def without_common_ends(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    start, least = 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return a[start : len(a) - end], b[start : len(b) - end]


def edit_distance(a: Sequence, b: Sequence, strip: int = STRIP) -> int:
    """Insertions, deletions and substitutions from a to b: strings by code point, or lists of hashable items.

    Common ends are left out first. The longer side is cut into strips of rows; in each strip the vertical differences of
    a column (plus and minus one) are two integers, which every item of the shorter side moves on by one column, and the
    horizontal differences at the strip's lower edge are handed on to the next strip.
    """
    a, b = without_common_ends(a, b)
    if not a or not b:
        return max(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    return _in_one_strip(a, b) if len(a) <= strip else _in_strips(a, b, strip)


def _places(rows: Sequence) -> dict:
    """The rows that hold each item, as the bits of an integer."""
    out: dict = {}
    for i, item in enumerate(rows):
        out[item] = out.get(item, 0) | 1 << i
    return out


def _in_one_strip(a: Sequence, b: Sequence) -> int:
    places, full = _places(a), (1 << len(a)) - 1
    plus, minus = full, 0
    for item in b:
        same = places.get(item, 0)
        diagonal = (((same & plus) + plus) ^ plus | same | minus) & full
        up = (minus | full ^ (diagonal | plus)) << 1 | 1
        down = (plus & diagonal) << 1
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal
    return len(b) + plus.bit_count() - minus.bit_count()


def _in_strips(a: Sequence, b: Sequence, strip: int) -> int:
    edge = bytearray(b"\2" * len(b))  # horizontal differences above a strip, plus one: 0, 1 or 2
    for low in range(0, len(a), strip):
        rows = a[low : low + strip]
        places = _places(rows)
        full, last = (1 << len(rows)) - 1, len(rows) - 1
        plus, minus = full, 0
        for j, item in enumerate(b):
            same, above = places.get(item, 0), edge[j]
            vertical = same | minus
            if not above:
                same |= 1
            diagonal = (((same & plus) + plus) ^ plus) | same
            up, down = minus | ~(diagonal | plus) & full, plus & diagonal
            edge[j] = 1 + (up >> last & 1) - (down >> last & 1)
            up, down = up << 1 & full, down << 1 & full
            if above == 2:
                up |= 1
            elif not above:
                down |= 1
            plus, minus = down | ~(vertical | up) & full, up & vertical
    return len(a) + sum(edge) - len(edge)


#: Pairs whose longer side is up to so long share one integer, side by side, up to so many bits.
LANE, WIDTH = 2048, 1 << 14


def edit_distances(pairs: list[tuple[Sequence, Sequence]]) -> list[int]:
    """edit_distance() of many pairs; those of middling length go side by side through the same integers."""
    out, short = [0] * len(pairs), []
    for i, (a, b) in enumerate(pairs):
        a, b = without_common_ends(a, b)
        if len(a) < len(b):
            a, b = b, a
        if not b:
            out[i] = len(a)
        elif len(a) > LANE:
            out[i] = edit_distance(a, b)
        else:
            short.append((len(b), len(a), i, a, b))
    short.sort(key=lambda x: x[:3])
    group, bits = [], 0
    for entry in short:
        if bits + entry[1] + 1 > WIDTH:
            _side_by_side(group, out)
            group, bits = [], 0
        group.append(entry)
        bits += entry[1] + 1
    _side_by_side(group, out)
    return out


def _side_by_side(group: list[tuple], out: list[int]) -> None:
    """_in_one_strip() for (columns, rows, place in out, a, b) in order of columns, each in bits of its own.

    A free bit above each pair takes its carries. A pair's distance is read when its columns end; what happens in its
    bits after that is of no account.
    """
    full = ones = low = 0
    lanes = []
    for columns, rows, place, a, b in group:
        places: dict = {}
        for i, item in enumerate(a):
            places[item] = places.get(item, 0) | 1 << low + i
        lanes.append((columns, rows, place, low, places, b))
        full, ones, low = full | (1 << rows) - 1 << low, ones | 1 << low, low + rows + 1
    plus, minus, first, j = full, 0, 0, 0
    while first < len(lanes):
        same = 0
        for _, _, _, _, places, b in lanes[first:]:
            same |= places.get(b[j], 0)
        diagonal = (((same & plus) + plus) ^ plus | same | minus) & full
        up = (minus | full ^ (diagonal | plus)) << 1 | ones
        down = (plus & diagonal) << 1
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal
        j += 1
        while first < len(lanes) and lanes[first][0] == j:
            columns, rows, place, low, _, _ = lanes[first]
            own = (1 << rows) - 1
            out[place] = columns + (plus >> low & own).bit_count() - (minus >> low & own).bit_count()
            first += 1


#: Edits beyond the difference of the lengths that are allowed for first, and how many times as many each next time.
SPARE, MORE = 2, 2
#: Items (characters or words) of both sides, and places on diagonals, that are held at once.
ITEMS, CELLS = 1 << 22, 1 << 21
#: What a place costs, in the nanoseconds in which similar_distances() weighs its two ways.
CELL_NS = 60
#: Windows of eight bytes that are compared at once in a long run of equal items.
AHEAD = 64
#: A place that no path reaches.
NEVER = -(1 << 40)
#: Items are counted in so many classes for the least number of edits that a pair can have.
CLASSES = 256


def similar_distances(pairs: list[tuple[Sequence, Sequence]]) -> list[int]:
    """edit_distance() of many pairs, in time that grows with the edits where the two sides are alike.

    Allowing `spare` edits beyond the difference of the lengths, a pair costs edits x spare places. The items that one side
    has more of say how many it needs at least; pairs that need more still are tried again with twice as many, until the
    table by columns is cheaper.
    """
    out, left, least = [0] * len(pairs), [], {}
    pairs = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    for i, (a, b) in enumerate(pairs):
        if not len(b):
            out[i] = len(a)
        elif a != b:
            left.append(i)
    for part in _slices(left, pairs, CLASSES):
        least.update(zip(part, _least_spare([pairs[i] for i in part])))
    spare, columns = SPARE, []
    while left:
        now, later = [], []
        for i in left:
            n, m = len(pairs[i][0]), len(pairs[i][1])
            needs = max(spare, least[i])
            if CELL_NS * (n - m + needs) * (needs + 1) > m * (600 + n // 3):
                columns.append(i)
            else:
                (now if needs == spare else later).append(i)
        now.sort(key=lambda i: len(pairs[i][0]) - len(pairs[i][1]))
        for part in _slices(now, pairs, spare):
            for i, d in zip(part, _along_diagonals([pairs[i] for i in part], spare)):
                if d < 0:
                    later.append(i)
                out[i] = d
        left, spare = later, spare * MORE
    for i, d in zip(columns, edit_distances([pairs[i] for i in columns])):
        out[i] = d
    return out


def _least_spare(pairs: list[tuple[Sequence, Sequence]]) -> list[int]:
    """A lower bound of the edits beyond the difference of the lengths: items that one side has more of, by class."""
    sides = [x for pair in pairs for x in pair]
    sizes = np.array([len(x) for x in sides])
    place = np.repeat(np.arange(len(sides)) * CLASSES, sizes) + (_codes(sides) & (CLASSES - 1))
    counts = np.bincount(place, minlength=len(sides) * CLASSES).reshape(-1, 2, CLASSES)
    more = counts[:, 0] - counts[:, 1]
    over, under = np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1)
    return (np.maximum(over, under) - (sizes[::2] - sizes[1::2])).tolist()


def _slices(chosen: list[int], pairs: list[tuple[Sequence, Sequence]], spare: int) -> Iterator[list[int]]:
    part, items = [], 0
    for i in chosen:
        size = len(pairs[i][0]) + len(pairs[i][1])
        if part and (items + size > ITEMS or (len(part) + 1) * (spare + 1) > CELLS):
            yield part
            part, items = [], 0
        part.append(i)
        items += size
    if part:
        yield part


def _codes(sides: list[Sequence]) -> np.ndarray:
    """The items of all sides in a row as small numbers from 2 on, in the narrowest type that holds them."""
    if isinstance(sides[0], str):
        items = np.frombuffer("".join(sides).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(int(items.max()) + 1, bool)
        seen[items] = True
        known = np.cumsum(seen) + 1
        most = int(known[-1])
        return known.astype(_kind(most))[items]
    known: dict = {}
    items = np.fromiter((known.setdefault(x, len(known) + 2) for side in sides for x in side), np.uint32, sum(map(len, sides)))
    return items.astype(_kind(len(known) + 1))


def _kind(most: int) -> type:
    return np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32


def _along_diagonals(pairs: list[tuple[Sequence, Sequence]], spare: int) -> list[int]:
    """Distances of pairs whose first side is not shorter, -1 where one is over the difference of lengths by more than `spare`.

    After `e` edits, `far` holds for every pair and w = e - (deletions - insertions) how many items of the first side are
    done at most; w is 0 for deletions alone, a substitution adds one to it, an insertion two, and w ends as the edits
    beyond the difference of the lengths. Equal items are skipped eight bytes at a time; the sides end in 0 and 1, so no
    skip passes an end.
    """
    sides = [x for pair in pairs for x in pair]
    sizes = np.array([len(x) for x in sides])
    codes = _codes(sides)
    starts = np.cumsum(sizes + 1) - sizes - 1  # one more item closes each side
    closed = np.zeros(len(codes) + len(sides) + 8 * AHEAD + 8, codes.dtype)
    closed[starts[1::2] + sizes[1::2]] = 1
    inside = np.ones(len(codes) + len(sides), bool)
    inside[starts + sizes] = False
    closed[: len(inside)][inside] = codes
    wide = closed.itemsize
    window = np.ndarray((len(closed) - 8,), "<u8", closed, strides=(wide,))
    step, shift = 8 // wide, 3 + (wide > 1) + (wide > 2)

    a, b, n, m = starts[::2], starts[1::2], sizes[::2], sizes[1::2]
    order = np.argsort(n - m, kind="stable")
    who, a, b, n, m, differ = order, a[order], b[order], n[order], m[order], (n - m)[order]
    out = np.full(len(pairs), -1)
    w = np.arange(spare + 1)
    far = np.where(w > 0, NEVER, 0) + np.zeros((len(pairs), 1), np.int64)
    e = 0
    while len(who):
        if e:
            before, far = far, far + 1  # a deletion leaves w as it is
            np.maximum(far[:, 1:], before[:, :-1] + 1, out=far[:, 1:])
            np.maximum(far[:, 2:], before[:, :-2], out=far[:, 2:])
            np.minimum(far, np.minimum(n[:, None], m[:, None] + (e - w)), out=far)
        row, col = np.nonzero(far >= 0)
        at = far[row, col]
        here, there = a[row] + at, b[row] + at - e + col
        unlike = window[here] ^ window[there]
        moved = np.bitwise_count((unlike & -unlike) - np.uint64(1)).astype(np.int64) >> shift
        going, ahead = np.flatnonzero(unlike == 0), 1
        while len(going):
            ahead = min(8 * ahead, AHEAD)
            next_ = moved[going, None] + step * np.arange(ahead)
            unlike = window[here[going, None] + next_] ^ window[there[going, None] + next_]
            place = (unlike != 0).argmax(1)
            unlike = unlike[np.arange(len(going)), place]
            more = np.bitwise_count((unlike & -unlike) - np.uint64(1)).astype(np.int64) >> shift
            moved[going] += np.where(unlike == 0, step * ahead, step * place + more)
            going = going[unlike == 0]
        far[row, col] = at + moved
        upto = int(np.searchsorted(differ, e, "right"))  # the table of these may end on a place that is held
        if upto:
            done = far[np.arange(upto), e - differ[:upto]] >= n[:upto]
            over = done | (differ[:upto] + spare <= e)
            if over.any():
                out[who[:upto][done]] = e
                stay = np.concatenate([~over, np.ones(len(who) - upto, bool)])
                who, a, b, n, m, differ, far = who[stay], a[stay], b[stay], n[stay], m[stay], differ[stay], far[stay]
        e += 1
    return out.tolist()


def _pairs(items_of: Callable[[str], Sequence]):
    def edits(reference: pd.Series, prediction: pd.Series) -> pd.Series:
        out, part, places, items = pd.Series([None] * len(reference), dtype="Int64"), [], [], 0
        for i, (a, b) in enumerate(zip(reference, prediction)):
            if a is not None and b is not None:
                part.append((items_of(a), items_of(b)))
                places.append(i)
                items += len(part[-1][0]) + len(part[-1][1])
            if places and (items > ITEMS or i == len(reference) - 1):  # lists of words are long: not all at once
                out.iloc[places] = similar_distances(part)
                part, places, items = [], [], 0
        return out

    return F.pandas_udf(edits, LongType())


char_distance = _pairs(lambda t: t)
#: Words are split at white space of any script, as scoring.words() does.
word_distance = _pairs(lambda t: t.split())
#: ASCII letters and digits in lower case, as normalize_text(lower=True, alnum_only=True) leaves them.
norm_distance = _pairs(lambda t: re.sub("[^0-9a-zA-Z]+", "", t).lower())
