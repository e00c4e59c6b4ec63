"""Periodic runs of words, found online by catchers over power-of-two blocks."""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import column_bytes, map_arrow
from .words import BASE, INVERSE, mixed

#: The smallest catcher watches for 2 ** LEAST words.
LEAST = 3
#: Words that are appended at a time.
CHUNK = 1 << 16


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.full(size, x, np.uint64) for x in (BASE, INVERSE))
            for table in (self.up, self.down):
                table[0] = 1
                np.multiply.accumulate(table, out=table)


_POWERS = _Powers()


class Catchers:
    """Runs of a sequence of whole numbers that grows at its end.

    When a block of 2**k numbers is complete its catcher starts: it compares
    the suffix of that length, after each appended number, with the block, for
    as long as the suffix starts 2**k to 2**(k+1) - 1 places (the smallest
    catcher: also 1 to 2**k - 1) behind the block's start. A catch at distance
    q is the beginning of a repetition with period q: it is followed to the
    left, and its right end is carried on by each appended number until one
    differs from the number q places before it. It is a square once it is 2q
    long; overlapping squares of one period are one stretch, and of stretches
    over the same numbers only the least period is kept.

    A run of period q that is 3q and 24 numbers long holds a whole block of
    largest size at most q (8 at least) whose copy q places on is in the run
    too, so its catcher can't miss it. Comparisons are made for all appended
    numbers at once, on fingerprints; each run is checked on the numbers.
    """

    def __init__(self, shortest: int = 24, exponent: int = 3):
        if exponent < 3 or shortest < 3 << LEAST:
            raise ValueError("runs have at least three periods and 24 items")
        self.shortest, self.exponent = shortest, exponent
        self.n = 0
        self.items = np.empty(0, np.int64)
        self.prefix = np.zeros(1, np.uint64)
        self.open = np.empty(0, np.int64), np.empty(0, np.int64)  # start, period: stretches that reach the end
        self.closed: dict[tuple[int, int], int] = {}  # (start, end) to the least period

    def append(self, items: np.ndarray) -> None:
        """Advance every catcher over ``items``."""
        before, self.n = self.n, self.n + len(items)
        self._store(items, before)
        starts, periods = self._carry_on(before)
        for k in range(LEAST, self.n.bit_length()):
            caught = [self._caught(k, before, 1)]
            if k == LEAST:
                caught.append(self._caught(k, before, 0))
            place, period = (np.concatenate(x) for x in zip(*caught))
            if len(place):
                s, e = self._stretch(place, period, 1 << k)
                self._close(s, e, period, e < self.n)
                starts, periods = np.r_[starts, s[e == self.n]], np.r_[periods, period[e == self.n]]
        self.open = self._merged(starts, periods)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs so far, by start and period."""
        stretches = dict(self.closed)
        for s, q in zip(*(x.tolist() for x in self.open)):
            stretches[s, self.n] = min(q, stretches.get((s, self.n), q))
        found = set()
        for (s, e), q in stretches.items():
            if e - s < max(self.shortest, self.exponent * q):
                continue
            # places where the numbers differ though the fingerprints agree: none but by chance
            differ = np.flatnonzero(self.items[s : e - q] != self.items[s + q : e]) + s
            for a, b in zip([s, *(differ + 1).tolist()], [*(differ + q).tolist(), e]):
                if b - a >= max(self.shortest, self.exponent * q):
                    found.add((a, b - a, q))
        return sorted(found, key=lambda r: (r[0], r[2]))

    def _store(self, items: np.ndarray, before: int) -> None:
        if self.n > len(self.items):
            size = max(self.n, 2 * len(self.items))
            self.items = np.r_[self.items[:before], np.empty(size - before, np.int64)]
            self.prefix = np.r_[self.prefix[: before + 1], np.empty(size - before, np.uint64)]
        _POWERS.need(self.n + 1)
        self.items[before : self.n] = items
        values = mixed(items.astype(np.uint64) + BASE) * _POWERS.up[before : self.n]
        self.prefix[before + 1 : self.n + 1] = np.cumsum(values) + self.prefix[before]

    def _prints(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.prefix[starts + size] - self.prefix[starts]) * _POWERS.down[starts]

    def _caught(self, k: int, before: int, back: int) -> tuple[np.ndarray, np.ndarray]:
        """Start of the block and distance of its copy, for the suffixes that end
        at appended numbers, against the block ``back`` blocks before their own."""
        size = 1 << k
        low, high = max(before - size + 1, back * size, 0), self.n - size + 1
        if low >= high:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        suffix = (self.prefix[low + size : high + size] - self.prefix[low:high]) * _POWERS.down[low:high]
        first = (low >> k) - back
        blocks = self._prints(np.arange(first, ((high - 1) >> k) - back + 1, dtype=np.int64) << k, size)
        place = (np.arange(low, high, dtype=np.int64) >> k) - back
        same = np.flatnonzero(suffix == blocks[place - first])
        start = place[same] << k
        distance = same + low - start
        return start[distance > 0], distance[distance > 0]

    def _carry_on(self, before: int) -> tuple[np.ndarray, np.ndarray]:
        """Open stretches advanced over the appended numbers; those that end are closed."""
        starts, periods = self.open
        if not len(starts):
            return starts, periods
        at = np.full(len(starts), before, dtype=np.int64)
        ends = at + self._forward(at - periods, at, self.n - at)
        self._close(starts, ends, periods, ends < self.n)
        still = ends == self.n
        return starts[still], periods[still]

    def _stretch(self, place: np.ndarray, period: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the stretches around the copies of blocks."""
        right = place + period + size
        return (
            place - self._backward(place, place + period, place),
            right + self._forward(right - period, right, self.n - right),
        )

    def _forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many numbers from ``a`` and ``b`` on agree, ``most`` at most."""
        done, step = np.zeros_like(most), 1 << int(most.max(initial=0)).bit_length()
        while step:
            on = np.flatnonzero(done + step <= most)
            on = on[self._prints(a[on] + done[on], step) == self._prints(b[on] + done[on], step)]
            done[on] += step
            step >>= 1
        return done

    def _backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many numbers before ``a`` and ``b`` agree, ``most`` at most."""
        done, step = np.zeros_like(most), 1 << int(most.max(initial=0)).bit_length()
        while step:
            on = np.flatnonzero(done + step <= most)
            far = done[on] + step
            on = on[self._prints(a[on] - far, step) == self._prints(b[on] - far, step)]
            done[on] += step
            step >>= 1
        return done

    def _close(self, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray, which: np.ndarray) -> None:
        long = which & (ends - starts >= np.maximum(self.shortest, self.exponent * periods))
        for s, e, q in zip(starts[long].tolist(), ends[long].tolist(), periods[long].tolist()):
            self.closed[s, e] = min(q, self.closed.get((s, e), q))

    def _merged(self, starts: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Open stretches once each, without those that repeat another's period:
        from the same start, with a multiple of the least period there, and long
        enough to end where that one ends."""
        if len(starts) < 2:
            return starts, periods
        order = np.lexsort((periods, starts))
        starts, periods = starts[order], periods[order]
        first = np.r_[True, starts[1:] != starts[:-1]]
        least = periods[first][np.cumsum(first) - 1]
        again = np.r_[False, (starts[1:] == starts[:-1]) & (periods[1:] == periods[:-1])]
        covered = ~first & (periods % least == 0) & (self.n - starts >= periods + least)
        return starts[~again & ~covered], periods[~again & ~covered]


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run among ``words``."""
    number = defaultdict(count().__next__)
    catchers = Catchers()
    for at in range(0, len(words), CHUNK):
        part = words[at : at + CHUNK]
        catchers.append(np.fromiter(map(number.__getitem__, part), dtype=np.int64, count=len(part)))
    return catchers.runs()


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period), start, length, period and
    exponent_milli of the most repetitive one, and collapsed (binary) per row.

    Words are runs of other bytes than space and \\x09-\\x0D, numbered from 0. A
    run is a stretch of words with least period q, 24 and 3q words long or
    longer, that can't be made longer. Runs are listed by start, then period; the most
    repetitive has the greatest length / period (ties: the least start, then
    period). ``collapsed`` is the text's words without those that a run repeats:
    of each run the first q words stay, unless another run repeats them.

    Null and empty texts have no words: no runs, four nulls, an empty
    ``collapsed``. Rows that repeat keep their own rows, an empty table gives
    none, a null doc_id stays null; other columns are ignored. A text is read
    by one task, which holds a few numbers a word.
    """

    def each(batch):
        runs, best, kept = [], [], []
        for text in column_bytes(batch, "text"):
            words = text.split()
            found = runs_of(words)
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            best.append(min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None))
            if found:
                stays = np.ones(len(words), dtype=bool)
                for s, n, q in found:
                    stays[s + q : s + n] = False
                words = compress(words, stays)
            kept.append(b" ".join(words))
        start, length, period = zip(*best) if best else ((), (), ())
        milli = [n and 1000 * n // q for n, q in zip(length, period)]
        longs = [pa.array(x, pa.int64()) for x in (start, length, period, milli)]
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(runs, kind), *longs, pa.array(kept, pa.binary())],
            names=["doc_id", "runs", "start", "length", "period", "exponent_milli", "collapsed"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(
        docs.select("doc_id", "text"),
        each,
        f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>,"
        " start long, length long, period long, exponent_milli long, collapsed binary",
    )
