"""Repeated strings across documents: hash-compared suffix sort around content-chosen anchors.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts somewhere else. Beside them, passages of ``WORDS``
words that another document has too are found in the same way, with words for bytes; they are reported and not removed
(over 50 words can be fewer than 400 bytes). All such strings are found:

1. Every string has anchors inside it: of its K-grams, those with the least hash. Equal strings have the same anchors.
   Around each anchor lies its context, the symbols of all strings that may hold it (K plus at most reach = length - K on
   either side, ending with the document).
2. Tasks combine equal contexts before anything is shuffled. A context that comes twice repeats with all its strings. The
   rest of what shares an anchor's hash, one row a different context, meets by that hash in sorted order. Contexts
   whose anchor stands alone end here.
3. Contexts that share their anchor but not themselves are sorted as suffixes: to the right of the anchor, and to the
   left of it read backwards. A merge sort runs for all groups at once; a comparison finds the common extension by binary
   search over prefix polynomial hashes, and neighbours' extensions are then verified on the symbols (another multiplier,
   should they ever differ). The strings of two contexts are equal where both extensions are long enough, which the
   sorted orders and neighbours' extensions tell for each offset without comparing pairs.
4. An anchor with more than ``Limits.largest`` different contexts, or with 1 / ``HEAVY_KEYS`` of all, is split: a
   string's offset to the anchor falls into one of a few ranges, and contexts with equal strings at offsets of a range
   have what all of its strings contain in common. So a context goes, cut to the range, to one key a range, where equal
   ones combine again; what is still too large is split again, down to single offsets, where equal strings are equal contexts.
5. Spans meet their documents again, are merged, and the other bytes kept.

Equal contexts are known by 127 bits of hash (anchor and context); extensions of different ones are compared on the symbols.
Memory: a task holds ``Limits.sorted`` contexts, or ``Limits.largest`` of one anchor. Texts are shuffled compressed.

Edge cases: a null text is empty, shorter texts lose nothing. Rows equal in id and text count as copies of each other for
bytes, and as one document for passages. Removed bytes may split a character; kept bytes are bytes. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.storage import Scratch, table

LENGTH = 400
WORDS = 51
CHUNK = 1 << 20  # bytes of documents hashed at a time
HEAVY_KEYS = 1_000  # heavy anchors have at least this share of all contexts, so that there are no more of them


class Limits(NamedTuple):
    """How much tasks hold and when anchors are split; they change no result."""

    held: int = 250_000  # anchors that a task combines at a time
    sorted: int = 6_000  # contexts sorted at a time
    largest: int = 12_000  # and the most of one anchor that are, some 100 MB
    heavy: int = 32  # different contexts of an anchor, among those combined at a time, that make it a candidate for splitting
    heavy_all: int = 500  # and the least sum of these counts over all tasks
    parts: int = 4  # ranges of offsets that an anchor, and then each of its ranges, is split into


class Unit(NamedTuple):
    number: int
    length: int
    k: int

    @property
    def reach(self) -> int:
        return self.length - self.k


BYTES, PASSAGE = Unit(0, LENGTH, 200), Unit(1, WORDS, 16)
UNITS = (BYTES, PASSAGE)
_U = np.uint64
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _slide(x: np.ndarray, w: int, best: np.ufunc, fill: int) -> np.ndarray:
    """Best of every w neighbours: of blocks of w, from the left and from the right."""
    n = len(x)
    y = np.full(-(-n // w) * w, fill, x.dtype)
    y[:n] = x
    y = y.reshape(-1, w)
    left = best.accumulate(y, axis=1).reshape(-1)
    right = best.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(right[: n - w + 1], left[w - 1 : n])


class _Hasher:
    """Prefix polynomial hashes of a run of symbols."""

    def __init__(self) -> None:
        self.size = 0

    def __call__(self, symbols: np.ndarray) -> np.ndarray:
        if len(symbols) + 1 > self.size:
            self.size = max(len(symbols) + 1, CHUNK + CHUNK // 4)
            self.up, self.down = _powers(_BASES[0], self.size)
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * self.up[: len(symbols)])))

    def of(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((prefix[hi] - prefix[lo]) * self.down[lo])


def _words(buf: np.ndarray, starts: np.ndarray, hasher: _Hasher, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of its first byte); words end at white space and where a document starts."""
    solid = ~_SPACE[buf]
    gap = np.ones(len(buf) + 1, bool)
    gap[1:-1] = ~solid[:-1]
    gap[starts[starts < len(buf)]] = True
    first = np.flatnonzero(solid & gap[:-1])
    gap[:-1] |= ~solid
    last = np.flatnonzero(solid & gap[1:]) + 1
    return hasher.of(prefix, first, last) | _U(1), first


class _Anchors:
    def __init__(self, passages: bool) -> None:
        self.bytes, self.words, self.passages = _Hasher(), _Hasher(), passages

    def __call__(self, docs: list[bytes]) -> Iterator[tuple[Unit, tuple[np.ndarray, ...]]]:
        """Of each unit (document number, position, anchor hash, context hash, context from, to) for every anchor."""
        n = np.fromiter(map(len, docs), np.int64, len(docs))
        buf = np.frombuffer(b"".join(docs), np.uint8)
        symbols = _TABLE[buf]
        prefix = self.bytes(symbols)
        yield BYTES, self.find(BYTES, self.bytes, prefix, n)
        if not self.passages:
            return
        starts = np.cumsum(n) - n
        words, first = _words(buf, starts, self.bytes, prefix)
        of = np.searchsorted(first, np.append(starts, len(buf)))
        yield PASSAGE, self.find(PASSAGE, self.words, self.words(words), np.diff(of))

    def find(self, unit: Unit, hasher: _Hasher, prefix: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        k, w = unit.k, unit.reach + 1
        if len(prefix) <= unit.length:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
        at = np.arange(len(prefix) - k)
        h = hasher.of(prefix, at, at + k) | _U(1)
        ends = np.cumsum(n)
        end = np.repeat(ends, n)
        least = _slide(h, w, np.minimum, (1 << 64) - 1)
        least[np.arange(len(least)) + unit.length > end[: len(least)]] = 0  # strings that would cross documents
        pad = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate((pad, least, pad)), w, np.maximum, 0) == h)
        doc = np.searchsorted(ends, at, side="right")
        start = ends[doc] - n[doc]
        lo, hi = np.maximum(at - unit.reach, start), np.minimum(at + unit.length, ends[doc])
        context = _context(hasher.of(prefix, lo, hi), at - lo, hi - lo)
        return doc, at - start, _of_unit(h[at], unit), context, lo - start, hi - start


def _context(hashed: np.ndarray, left: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A context's hash, with where its anchor lies."""
    return _mix(hashed + (left * 1024 + size).astype(np.uint64) * _U(_BASES[1]))


def _of_unit(h: np.ndarray, unit: Unit) -> np.ndarray:
    """Anchor hashes whose lowest bit is the unit's number."""
    return (h & ~_U(1)) | _U(unit.number)


def _combined(key: np.ndarray, pos: np.ndarray, a: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray | None = None, *, heavy: int) -> pa.RecordBatch:
    """Equal contexts as one row with their count: rows (kind 0: a span; 1: a context; 2: how many different ones a heavy anchor has).

    Bytes count places; passages count documents, and those of one document alone keep all their rows, the later ones with count 0.
    """
    order = np.lexsort((pos, key, c, a))
    key, pos, a, c, lo, hi = key[order], pos[order], a[order], c[order], lo[order], hi[order]
    words = (a & _U(1)) == 1
    length = np.where(words, PASSAGE.length, BYTES.length)
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(a)))
    each = np.ones(len(a), np.int64) if n is None else n[order]
    again = ~first
    again[1:] &= key[1:] == key[:-1]
    each = np.where(words & again, np.maximum(each - 1, 0), each)  # another place in the same document adds the others only
    total = np.repeat(np.add.reduceat(each, begin), size) if len(a) else each
    spans = np.flatnonzero((total > 1) & ~first & (hi - lo >= length))
    ship = np.flatnonzero(first | (words & (total == 1)))
    count = np.where(first, total, 0)[ship]
    heads = a[begin]
    runs = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1]))) if len(a) else np.empty(0, np.int64)
    many = np.diff(np.append(runs, len(heads)))
    candidates = begin[runs[many >= heavy]]
    rows = np.concatenate((spans, ship, candidates))
    kind = np.repeat(np.array([0, 1, 2], np.int32), [len(spans), len(ship), len(candidates)])
    seen = np.concatenate((np.ones(len(spans), np.int64), count, many[many >= heavy]))
    cols = [kind, a[rows].view(np.int64), c[rows].view(np.int64), key[rows], pos[rows].astype(np.int32), lo[rows].astype(np.int32), hi[rows].astype(np.int32), seen]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], _NAMES)


_NAMES = ["kind", "a", "c", "key", "pos", "lo", "hi", "n"]
_SCHEMA = "kind int, a long, c long, key long, pos int, lo int, hi int, n long"


def _anchor_rows(batches: Iterator[pa.RecordBatch], limits: Limits, passages: bool) -> Iterator[pa.RecordBatch]:
    """(key, text) -> combined contexts."""
    find, held, count = _Anchors(passages), [], 0

    def flush() -> pa.RecordBatch:
        nonlocal count
        out = _combined(*map(np.concatenate, zip(*held, strict=True)), heavy=limits.heavy)
        held.clear()
        count = 0
        return out

    def take(keys: list[int], docs: list[bytes]) -> None:
        nonlocal count
        for _, (doc, *rest) in find(docs):
            held.append((np.array(keys, np.int64)[doc], *rest))
            count += len(doc)

    keys: list[int] = []
    docs: list[bytes] = []
    size = 0
    for b in batches:
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if len(t) < (2 * WORDS - 1 if passages else LENGTH):  # neither a string nor a passage
                continue
            keys.append(k), docs.append(t)
            size += len(t)
            if size >= CHUNK:
                take(keys, docs)
                keys, docs, size = [], [], 0
                if count >= limits.held:
                    yield flush()
    if docs:
        take(keys, docs)
    if held:
        yield flush()


def _decide(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by (a, c, key) -> kind 0: spans; 1: contexts that share their anchor with others; 3: anchors of more contexts than a task sorts."""
    rest: list[np.ndarray] | None = None
    before = None  # the anchor hash of the row before those in hand
    carried = 0  # and how many contexts it had

    def out(x: list[np.ndarray], after: int | None) -> pa.RecordBatch:
        nonlocal before, carried
        a, c, key, pos, lo, hi, n = x
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(a)))
        again = ~new
        again[1:] &= key[1:] == key[:-1]
        total = np.repeat(np.add.reduceat(np.where((a & 1 == 1) & again, np.maximum(n - 1, 0), n), begin), size)
        ga = a[begin]
        shared = np.zeros(len(begin), bool)
        same = ga[1:] == ga[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        shared[0] |= before == ga[0]
        shared[-1] |= after == ga[-1]
        length = np.where(a & 1, PASSAGE.length, BYTES.length)
        spans = np.flatnonzero((total > 1) & (hi - lo >= length))
        ship = np.flatnonzero(np.repeat(shared, size) & (new | (total == 1)))
        runs = np.flatnonzero(np.concatenate(([True], ~same)))
        many = np.diff(np.append(runs, len(ga)))
        if before == ga[0]:
            many[0] += carried
        before, carried = int(ga[-1]), int(many[-1])
        if after == ga[-1]:
            runs, many = runs[:-1], many[:-1]
        large = begin[runs[many > limits.largest]]
        rows = np.concatenate((spans, ship, large))
        kind = np.repeat(np.array([0, 1, 3], np.int32), [len(spans), len(ship), len(large)])
        return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(y[rows]) for y in (a, c, key, pos, lo, hi)), pa.array(np.where(new, total, 0)[rows])], _NAMES)

    for b in batches:
        if not len(b):
            continue
        x = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        if rest is not None:
            x = [np.concatenate(y) for y in zip(rest, x, strict=True)]
        tail = (x[0] == x[0][-1]) & (x[1] == x[1][-1])
        cut = len(tail) - int(tail.sum())  # rows of the last context wait
        if cut:
            yield out([y[:cut] for y in x], int(x[0][-1]))
        rest = [y[cut:] for y in x]
    if rest is not None:
        yield out(rest, None)


def _symbols(text: bytes) -> np.ndarray:
    """Hashes of a text's words."""
    buf, hasher = np.frombuffer(text, np.uint8), _LOCAL
    return _words(buf, np.zeros(1, np.int64), hasher, hasher(_TABLE[buf]))[0]


_LOCAL = _Hasher()


def _split(key: int, text: bytes, wanted: list[dict], parts: int) -> tuple[np.ndarray, ...]:
    """One document's contexts, cut to each of so many ranges of offsets: (key, pos, a, c, lo, hi, n)."""
    found = []
    for unit in UNITS:
        mine = [w for w in wanted if w["a"] & 1 == unit.number]
        if not mine:
            continue
        hasher = _LOCAL
        prefix = hasher(_TABLE[np.frombuffer(text, np.uint8)] if unit is BYTES else _symbols(text))
        pos, lo, hi, n = (np.array([w[x] for w in mine], np.int64) for x in ("pos", "lo", "hi", "n"))
        least, most = np.maximum(0, pos + unit.length - hi), np.minimum(unit.reach, pos - lo)  # offsets of the context's strings
        width = max(1, -(-(unit.reach + 1) // parts))
        for d0 in range(0, unit.reach + 1, width):
            d1 = min(d0 + width, unit.reach + 1) - 1
            x, y = np.maximum(least, d0), np.minimum(most, d1)
            i = np.flatnonzero(x <= y)
            p = pos[i]
            common = hasher.of(prefix, p - d0, p - d1 + unit.length)
            a = _of_unit(_mix(common + _U((d0 * 4096 + width) * _BASES[2] % (1 << 64))), unit)
            l, h = p - y[i], p - x[i] + unit.length
            found.append((np.full(len(i), key, np.int64), p, a, _context(hasher.of(prefix, l, h), p - l, h - l), l, h, n[i]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


class _Contexts:
    """Contexts of a few groups, with prefix polynomial hashes."""

    def __init__(self, texts: list[bytes], left: np.ndarray, base: int, unit: Unit = BYTES):
        self.unit = unit
        joined = b"".join(texts)
        raw = np.frombuffer(joined, np.uint8 if unit is BYTES else np.uint64)
        self.n = np.fromiter(map(len, texts), np.int64, len(texts)) // raw.itemsize
        self.buf = np.concatenate((raw if unit is BYTES else raw.view(np.int64), np.zeros(1, np.uint8 if unit is BYTES else np.int64)))
        self.off = np.cumsum(self.n) - self.n
        self.left = left
        up, self.down = _powers(base, unit.length + unit.reach + 2)
        local = np.arange(len(raw)) - np.repeat(self.off, self.n)
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_TABLE[raw] if unit is BYTES else raw) * up[local])))

    def room(self, i: np.ndarray, right: bool) -> np.ndarray:
        return np.maximum(self.n[i] - self.left[i] - self.unit.k, 0) if right else self.left[i]

    def hash(self, i: np.ndarray, t: np.ndarray, right: bool) -> np.ndarray:
        lo = self.left[i] + self.unit.k if right else self.left[i] - t
        at = self.off[i] + lo
        return (self.prefix[at + t] - self.prefix[at]) * self.down[lo]

    def common(self, i: np.ndarray, j: np.ndarray, right: bool) -> np.ndarray:
        """Length of the common extension, by binary search."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.room(i, right), self.room(j, right))
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.hash(i, mid, right) == self.hash(j, mid, right)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def symbol(self, i: np.ndarray, t: np.ndarray, right: bool) -> np.ndarray:
        """The symbol after t of them, the least number at the end."""
        at = self.off[i] + (self.left[i] + self.unit.k + t if right else self.left[i] - 1 - t)
        return np.where(t < self.room(i, right), self.buf[np.clip(at, 0, len(self.buf) - 1)].astype(np.int64), np.iinfo(np.int64).min)

    def before(self, i: np.ndarray, j: np.ndarray, right: bool, equal: np.ndarray) -> np.ndarray:
        t = self.common(i, j, right)
        x, y = self.symbol(i, t, right), self.symbol(j, t, right)
        return (x < y) | (equal & (x == y))

    def sort(self, group: np.ndarray, right: bool) -> np.ndarray:
        """Order by suffix within each group (ascending numbers): a merge sort, all groups and runs side by side."""
        n = len(group)
        begin = np.searchsorted(group, group)
        size = np.searchsorted(group, group, side="right") - begin
        order, place, width = np.arange(n), np.arange(n) - begin, 1
        while width < size.max(initial=0):
            run = place // width
            other = begin + (run ^ 1) * width
            lo = np.minimum(other, begin + size)
            first = lo.copy()
            hi = np.minimum(other + width, begin + size)
            later = run % 2 == 1
            while len(act := np.flatnonzero(lo < hi)):
                mid = (lo[act] + hi[act]) // 2
                down = self.before(order[mid], order[act], right, later[act])
                lo[act[down]] = mid[down] + 1
                hi[act[~down]] = mid[~down]
            at = begin + run // 2 * 2 * width + place % width + lo - first
            moved = np.empty_like(order)
            moved[at] = order
            order, width = moved, width * 2
        return order

    def neighbours(self, group: np.ndarray, order: np.ndarray, right: bool) -> np.ndarray | None:
        """Common extension of each with the one before it in order (-1 for the first of a group); None if symbols differ."""
        out = np.full(len(order), -1, np.int64)
        k = np.flatnonzero(group[1:] == group[:-1]) + 1
        i, j = order[k - 1], order[k]
        t = out[k] = self.common(i, j, right)
        step = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
        for x in (i, j):
            at = np.repeat(self.off[x] + (self.left[x] + self.unit.k if right else self.left[x] - 1), t) + (step if right else -step)
            got = self.buf[at]
            if x is i:
                want = got
        return out if not len(k) or np.array_equal(want, got) else None


def repeated(texts: list[bytes], left: np.ndarray, group: np.ndarray, unit: Unit = BYTES, owner: np.ndarray | None = None, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each context the least and the greatest start, counted back from the anchor, of its strings that another context of its group has too; (-1, -1) without.

    With ``owner``, contexts of one owner don't count for each other, unless one is ``common`` to several owners.
    """
    for base in _BASES:
        c = _Contexts(texts, left, base, unit)
        sides = []
        for right in (True, False):
            order = c.sort(group, right)
            extension = c.neighbours(group, order, right)
            if extension is None:
                break
            sides.append((order, extension))
        if len(sides) == 2:
            break
    else:
        raise RuntimeError("prefix hashes differ from the symbols for every multiplier")
    n = len(texts)
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    classes = []
    for order, extension in sides:
        def number(need: int, order: np.ndarray = order, extension: np.ndarray = extension) -> np.ndarray:
            out = np.empty(n, np.int64)
            out[order] = np.cumsum(extension < need)
            return out
        classes.append(number)
    for d in range(unit.reach + 1):
        code = classes[0](unit.reach - d) * (n + 1) + classes[1](d)
        at = np.argsort(code, kind="stable")
        same = code[at[1:]] == code[at[:-1]]
        if not same.any():
            continue
        hit = np.zeros(n, bool)
        if owner is None:
            hit[at[1:][same]] = hit[at[:-1][same]] = True
        else:
            begin = np.flatnonzero(np.concatenate(([True], ~same)))
            size = np.diff(np.append(begin, n))
            several = np.minimum.reduceat(owner[at], begin) != np.maximum.reduceat(owner[at], begin)
            several |= np.logical_or.reduceat(common[at], begin) & (size > 1)
            hit[at] = np.repeat(several, size)
        least[hit & (least < 0)] = d
        most[hit] = d
    return least, most


def _compare(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Contexts (a, key, pos, n, lo, context) sorted by a -> spans (unit, key, from, to)."""
    held: list[pa.RecordBatch] = []

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        numbers = {x: t.column(x).to_numpy().astype(np.int64) for x in ("a", "key", "pos", "lo", "n")}
        for unit in UNITS:
            at = np.flatnonzero((numbers["a"] & 1) == unit.number)
            if not len(at):
                continue
            a, key, pos, lo, n = (numbers[x][at] for x in ("a", "key", "pos", "lo", "n"))
            more = {} if unit is BYTES else {"owner": key, "common": n > 1}
            least, most = repeated(t.column("context").take(pa.array(at)).to_pylist(), pos - lo, a, unit, **more)
            good = (least >= 0) & (n <= 1)
            out = [np.full(int(good.sum()), unit.number, np.int32), key[good], (pos - most)[good].astype(np.int32), (pos - least)[good].astype(np.int32) + np.int32(unit.length)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["unit", "key", "from", "to"])

    n = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        n += len(b)
        if n < limits.sorted:
            continue
        t = pa.Table.from_batches(held)
        a = t.column("a").to_numpy()
        whole = int(np.searchsorted(a, a[-1]))
        for at in _chunks(a[:whole], limits.sorted):
            yield from work(t.slice(*at))
        held = t.slice(whole).combine_chunks().to_batches()
        n = len(t) - whole
    if n:
        t = pa.Table.from_batches(held)
        for at in _chunks(t.column("a").to_numpy(), limits.sorted):
            yield from work(t.slice(*at))


def _chunks(a: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Pieces (from, length) of about ``size`` rows that keep equal values together."""
    start = 0
    while start < len(a):
        end = min(start + size, len(a))
        if end < len(a):
            end = int(np.searchsorted(a, a[end - 1], side="right"))
        yield start, end - start
        start = end


def _merged(lo: list[int], hi: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(zip(lo, hi, strict=True)):
        if out and x <= out[-1][1]:
            if y > out[-1][1]:
                out[-1] = (out[-1][0], y)
        else:
            out.append((x, y))
    return out


def repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", limits: Limits = Limits(), passages: bool = True) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, passages) for every row: removed runs (from, to, in bytes), the other bytes, and runs of words (from, to) that other documents have; without ``passages`` these aren't looked for."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    kind = docs.schema[doc_id].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array([squeeze(x.as_py()) for x in b.column(b.num_columns - 1)], pa.binary())], b.schema.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            names, parts = ("a", "key", "pos", "n", "lo"), ([], [], [], [], [], [])
            for key, packed, wanted in zip(*(b.column(c).to_pylist() for c in ("key", "text", "wanted")), strict=True):
                t = expand(packed)
                words = _symbols(t) if any(w["a"] & 1 for w in wanted) else None
                for w in wanted:
                    piece = words[w["lo"] : w["hi"]].tobytes() if w["a"] & 1 else t[w["lo"] : w["hi"]]
                    for x, y in zip(parts, (w["a"], key, w["pos"], w["n"], w["lo"], piece), strict=True):
                        x.append(y)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, types, strict=True)], [*names, "context"])

    def split(parts: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            expand = zstandard.ZstdDecompressor().decompress
            held, count = [], 0
            for b in batches:
                for key, packed, wanted in zip(*(b.column(c).to_pylist() for c in ("key", "text", "wanted")), strict=True):
                    held.append(_split(key, expand(packed), wanted, parts))
                    count += len(held[-1][0])
                    if count >= limits.held:
                        yield _combined(*map(np.concatenate, zip(*held, strict=True)), heavy=limits.heavy)
                        held, count = [], 0
            if held:
                yield _combined(*map(np.concatenate, zip(*held, strict=True)), heavy=limits.heavy)

        return run

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            sizes, runs, kept, others = [], [], [], []
            for packed, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                t = expand(packed)
                found, shared = (_merged([s["from"] for s in spans or () if s["unit"] == u], [s["to"] for s in spans or () if s["unit"] == u]) for u in (0, 1))
                cuts = [0, *(x for run in found for x in run), len(t)]
                sizes.append(len(t)), runs.append([{"from": x, "to": y} for x, y in found]), others.append([{"from": x, "to": y} for x, y in shared])
                kept.append(b"".join(t[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)))
            run = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, run), pa.array(kept, pa.binary()), pa.array(others, run)], ["doc_id", "n_bytes", "spans", "kept", "passages"])

    packed = rows.select("doc_id", "key", "text").mapInArrow(pack, f"doc_id {kind}, key long, text binary")

    def with_text(contexts: DataFrame) -> DataFrame:
        wanted = contexts.groupBy("key").agg(F.collect_list(F.struct("a", "pos", "n", "lo", "hi")).alias("wanted"))
        return packed.select("key", "text").join(wanted.hint("shuffle_hash"), "key")

    def decide(found: DataFrame, name: str) -> DataFrame:
        once = found.select(*_NAMES[1:]).repartition("a").sortWithinPartitions("a", "c", "key")
        return scratch.save(once.mapInArrow(lambda b: _decide(b, limits), _SCHEMA), name)

    def compare(contexts: DataFrame, name: str) -> DataFrame:
        shipped = with_text(contexts).mapInArrow(cut, "a long, key long, pos int, n long, lo int, context binary")
        return scratch.save(shipped.repartition("a").sortWithinPartitions("a").mapInArrow(lambda b: _compare(b, limits), "unit int, key long, `from` int, `to` int"), name)

    def spans_of(found: DataFrame) -> DataFrame:
        return found.where("kind = 0").select((F.col("a").bitwiseAND(F.lit(1))).cast("int").alias("unit"), "key", F.col("lo").alias("from"), F.col("hi").alias("to"))

    def parted(decided: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """Contexts of anchors that a task can sort, those of larger ones, and whether there are any."""
        contexts, large = decided.where("kind = 1"), decided.where("kind = 3").select("a")
        if large.limit(1).count() == 0:
            return contexts, contexts.limit(0), False
        return contexts.join(large, "a", "left_anti"), contexts.join(large, "a", "left_semi"), True

    found = scratch.save(rows.select("key", "text").mapInArrow(lambda b: _anchor_rows(b, limits, passages), _SCHEMA), "anchors")
    contexts = found.where("kind = 1")
    counted = found.where("kind = 2").groupBy("a").agg(F.sum("n").alias("n"))
    heavy = scratch.save(counted.where(F.col("n") >= max(limits.heavy_all, contexts.count() // HEAVY_KEYS)).select("a"), "heavy")  # at most HEAVY_KEYS rows
    any_heavy = heavy.limit(1).count() > 0
    decided = decide(contexts.join(F.broadcast(heavy), "a", "left_anti") if any_heavy else contexts, "decided")
    small, large, any_large = parted(decided)
    spans = [spans_of(found), spans_of(decided), compare(small, "compared")]
    large = large.unionByName(contexts.join(F.broadcast(heavy), "a", "left_semi")) if any_heavy else large
    parts = 1
    while any_large or any_heavy:  # ends where ranges are single offsets
        parts *= limits.parts
        pieces = scratch.save(with_text(large).mapInArrow(split(parts), _SCHEMA), f"pieces{parts}")
        decided = decide(pieces.where("kind = 1"), f"decided{parts}")
        small, large, any_large = parted(decided)
        spans += [spans_of(pieces), spans_of(decided), compare(small, f"compared{parts}")]
        any_heavy = False
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    per_row = every.groupBy("key").agg(F.collect_list(F.struct("unit", "from", "to")).alias("spans"))
    run = "array<struct<`from`:int,`to`:int>>"
    return packed.join(per_row.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "spans").mapInArrow(keep, f"doc_id {kind}, n_bytes long, spans {run}, kept binary, passages {run}")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and ``n_shared_words``: words under passages of 51 or more words that another document has too."""
    out = repeats(table(spark, sf_dir, "documents"))
    size = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.select("doc_id", "n_bytes", size("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), size("passages").alias("n_shared_words"))
