"""Links between documents whose word-shingle sets are similar, and their components.

A candidate search by the pigeonhole principle over a partitioned universe:

* Linked sets x and y have at least ``overlap`` elements in common, so each misses only a few
  of the other's: a set of n elements, as the smaller of a pair, at most a seventh of n, and
  as the larger at most a quarter (at 75 percent).
* The universe is partitioned into segments as fine as single elements, under one global
  order. Whatever stands in the first misses + 1 segments of either set includes a common
  one. The order spends this budget where it costs least: elements that were counted as
  frequent come last, the most frequent at the very end.
* A common first element at place i of x and j of y leaves ``min(|x| - i, |y| - j)`` elements
  to have in common; a group of sets with one element in common is dropped if no member has
  enough left to be the smaller of a pair, and pairs that have not enough left are no
  candidates. Sets that only share a passage, in most of their places, go by this. A pair is
  compared in the first of the groups that both are in, or in few, not in all.
* Small size bands, in which linked sets differ in one element at most, may be allotted one
  segment with its one-deletion neighbourhoods instead: then the sets share a whole subset,
  or one of them less one element. ``allot`` counts both ways' signatures over all documents
  and takes, band by band, the one with fewer rows and pairs.

Elements that several sets have in common form groups. In each round a few pivots of every
group are compared with the members that are not yet in their component, so a group of
near copies costs a comparison for each member and not one for each pair. Parity sketches,
whose differing bits are at most the sets' differing elements, rule out most pairs; the
others are verified on whole sets. Components are updated, and rounds go on until each
group's pairs are linked through a component or compared. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import textkernel as K
from quarry.llm.components import components
from quarry.llm.shared import discard, written

WORDS = 5
PERCENT = 75
#: Text and sets whose signatures are sorted and shuffled together.
EMIT_BYTES, EMIT_SETS = 1 << 20, 1 << 13
#: Signatures that one bucket holds on average; their number decides how many buckets there are.
BUCKET_SIGNATURES = 1 << 19
_U = np.uint64
_ODD = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    data, offsets = K.bytes_of(texts)
    count = len(offsets) - 1
    hashes, owner = K.words(data, offsets)
    per = np.bincount(owner, minlength=count)
    first = np.cumsum(per) - per
    mixed = K.mix(hashes)
    out: list[np.ndarray] = []
    if len(mixed) >= n:
        full = mixed[: len(mixed) - n + 1] * _ODD[0]
        for i in range(1, n):
            full = full + mixed[i : len(mixed) - n + 1 + i] * _ODD[i % 64]
        full = K.mix(full)
    else:
        full = mixed[:0]
    for k in range(count):
        words = int(per[k])
        if words >= n:
            out.append(np.unique(full[first[k] : first[k] + words - n + 1]))
        elif words:
            part = mixed[first[k] : first[k] + words]
            total = (part * _ODD[32 + np.arange(words) % 32]).sum(dtype=np.uint64)
            out.append(K.mix(np.array([total + _U(words)], _U)))
        else:
            out.append(full[:0])
    return out


def set_marks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, _U)
    ends = np.cumsum(size)

    def sums(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, _U), np.cumsum(x, dtype=_U)])
        return total[ends] - total[ends - size]

    n = size.astype(_U)
    return K.mix(sums(K.mix(flat)) + n), K.mix(sums(K.mix(flat ^ _ODD[7])) + n * _ODD[3])


#: Shingles that this many sets of a block share are counted as perhaps frequent.
FREQUENT_IN_BLOCK, BLOCK_SHINGLES = 3, 1_000_000
#: The most frequent of these are told apart in ordering elements; the others only cost more.
FREQUENT = 1 << 18
#: Places are rounded down to this many steps of the longest that a set shows.
PLACES = 255
#: Groups before a row's own that are remembered; see ``_before``.
BEFORE = 4
SETS = "kind int, doc_id long, n long, c1 long, c2 long, sketch binary"


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's elements in about twice as many classes as it has elements."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    at = (K.mix(s ^ _ODD[16]) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_differences(a: pa.Array, b: pa.Array) -> np.ndarray:
    """A lower bound of each pair's differing elements; the longer sketch is folded."""
    out = np.zeros(len(a), np.int64)
    la, lb = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    kinds, of = np.unique(np.stack([la, lb]), axis=1, return_inverse=True)
    for k, (m, n) in enumerate(kinds.T.tolist()):
        rows = np.flatnonzero(of.ravel() == k)
        x, y = (
            K.bytes_of(col.take(pa.array(rows)))[0].reshape(len(rows), width) for col, width in ((a, m), (b, n))
        )
        while x.shape[1] != y.shape[1]:
            if x.shape[1] < y.shape[1]:
                x, y = y, x
            half = x.shape[1] // 2
            x = x[:, :half] ^ x[:, half:]
        out[rows] = np.bitwise_count(x ^ y).sum(1)
    return out


class Bands:
    """What linked sets of given sizes have in common, and size bands of ratio
    100 / ``percent``, so that linked sets lie in one band or in neighbours."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.low, self.high = [], []
        low = 1
        while low < 1 << 40:
            high = low * 100 // percent
            self.low.append(low)
            self.high.append(high)
            low = high + 1
        self._lows = np.array(self.low)
        #: Most elements in which linked sets of a band, or of it and the one below, differ.
        self.worst = np.array([self.differ(2 * h) for h in self.high])

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self._lows, size, side="right") - 1

    def differ(self, total):
        return total * (100 - self.percent) // (100 + self.percent)

    def overlap(self, total):
        """Fewest elements that linked sets of that total size have in common."""
        return -(-self.percent * total // (100 + self.percent))

    def shown(self, n):
        """Elements that a set has to show: as the larger of a pair it may miss most."""
        return n - self.overlap(n - (-self.percent * n // 100)) + 1

    def may_be_smaller(self, left, n):
        """Can a set of n elements, of which the last ``left`` are open, be linked with one
        of its size or larger?"""
        return left >= self.overlap(2 * n)

    def steps(self, place, n):
        """``place`` in steps of the most that a set misses, rounded down."""
        return place * 100 * PLACES // np.maximum((100 - self.percent) * n, 1)

    def left(self, step, n):
        """Elements from a place on; not fewer than there are."""
        return n - -(-step * (100 - self.percent) * n // (100 * PLACES))


class Frequent:
    """Ranks of the frequent shingles by their counts; 0 for all others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ranks = np.minimum(1 + 6 * np.log2(np.maximum(counts[order], 1)), 255).astype(_U)
        self.may = np.zeros(1 << 22, bool)
        self.may[(self.hashes >> _U(42)).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), _U)
        if len(self.hashes):
            at = np.flatnonzero(self.may[(x >> _U(42)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hashes, x[at]), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[place] == x[at], self.ranks[place], _U(0))
        return out


def by_elements(sets: list[np.ndarray], bands: Bands, frequent: Frequent | None = None):
    """(signature, number of its set, step of its place): the elements that each set shows."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    key = (owner.astype(_U) << _U(49)) | (K.mix(flat ^ _ODD[12]) >> _U(23))
    if frequent is not None:
        key |= frequent(flat) << _U(41)
    # sets are sorted, so elements with one key keep one order in all of them
    order = np.argsort(key, kind="stable")
    own = owner[order]
    place = np.arange(len(flat)) - (np.cumsum(size) - size)[own]
    keep = place < bands.shown(size)[own]
    return flat[order[keep]], own[keep], bands.steps(place[keep], size[own[keep]])


def by_deletion(s: np.ndarray, band: int) -> np.ndarray:
    """Signatures of one segment and its one-deletion neighbourhoods: the set, and the set
    less each of its elements."""
    tokens = K.mix(s ^ _ODD[9])
    total = tokens.sum(dtype=_U)
    near = total - tokens if len(s) > 1 else tokens[:0]
    return np.unique(K.mix(np.append(near, total) + _ODD[10:11] * _U(band + 1)))


def signatures(
    sets: list[np.ndarray], bands: Bands, deletion: frozenset[int] = frozenset(), frequent: Frequent | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, number of its set, step of its place) in a set's own band and the next.
    The bands of ``deletion`` are allotted one-deletion neighbourhoods. Sets that no other
    set can be linked with have no signatures."""
    size = np.array([len(s) for s in sets], np.int64)
    own = bands.of(np.maximum(size, 1))
    by_element = np.zeros(len(sets), bool)
    sigs, sides = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for shift in (0, 1):
        band = own + shift
        deleted = np.isin(band, list(deletion))
        by_element |= ~deleted & (bands.worst[band] > 0)
        for k in np.flatnonzero(deleted & (size > 0)).tolist():
            sigs.append(by_deletion(sets[k], int(band[k])))
            sides.append(np.full(len(sigs[-1]), k))
    sig, side = np.concatenate(sigs), np.concatenate(sides)
    step = np.zeros(len(sig), np.int64)
    at = np.flatnonzero(by_element & (size > 0))
    if not len(at):
        return sig, side, step
    more, number, place = by_elements([sets[k] for k in at], bands, frequent)
    return np.concatenate([sig, more]), np.concatenate([side, at[number]]), np.concatenate([step, place])


def _small_signatures(sets: list[np.ndarray], bands: Bands) -> Iterator[tuple[int, np.ndarray]]:
    """(2 * band, or that + 1, signatures) of the small bands by elements and by deletion."""
    size = np.array([len(s) for s in sets], np.int64)
    own = bands.of(np.maximum(size, 1))
    for band in np.flatnonzero(bands.worst == 1).tolist():
        mine = [sets[k] for k in np.flatnonzero((size > 0) & ((own == band) | (own == band - 1)))]
        if mine:
            yield 2 * band, by_elements(mine, bands)[0]
            yield 2 * band + 1, np.concatenate([by_deletion(s, band) for s in mine])


def _meta(n: int, percent: int):
    """Rows of kind 0 tell each document's set; of kind 1 shingles that are perhaps frequent,
    with their number; of kind 2 how often a signature of a small band occurs."""
    bands = Bands(percent)

    def counted(kind: int, mark: int | None, flat: np.ndarray, least: int) -> pa.RecordBatch:
        value, count = np.unique(flat, return_counts=True)
        value, count = value[count >= least], count[count >= least]
        k = len(value)
        marks = pa.nulls(k, pa.int64()) if mark is None else pa.array(np.full(k, mark))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, kind, np.int32)), marks, pa.array(count),
             pa.array(value.view(np.int64)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())],
            names=["kind", "doc_id", "n", "c1", "c2", "sketch"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        total = 0
        for whole in batches:
            for batch in K.steps(whole, 1):
                sets = shingle_sets(batch.column(1), n)
                c1, c2 = set_marks(sets)
                size = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(sets), np.int32)), batch.column(0), pa.array(size),
                     pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)),
                     pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())],
                    names=["kind", "doc_id", "n", "c1", "c2", "sketch"],
                )
                fresh = []
                for mark, s in zip(c1.tolist(), sets, strict=True):
                    if mark not in seen and len(s):
                        seen.add(mark)
                        fresh.append(s)
                        total += len(s)
                held += fresh
                for mark, flat in _small_signatures(fresh, bands):
                    yield counted(2, mark, flat, 1)
                if total >= BLOCK_SHINGLES:
                    yield counted(1, None, np.concatenate(held), FREQUENT_IN_BLOCK)
                    held, seen, total = [], set(), 0
        if held:
            yield counted(1, None, np.concatenate(held), FREQUENT_IN_BLOCK)
        held = []
        K.give_back()

    return run


def allot(counts: DataFrame) -> frozenset[int]:
    """The bands that are cheaper by one-deletion neighbourhoods, from the counted rows
    ``(doc_id, c1, n)`` of kind 2. A way costs its rows and the pairs that they make."""
    cost = (
        counts.groupBy("doc_id", "c1")
        .agg(F.sum("n").cast("double").alias("n"))
        .groupBy("doc_id")
        .agg(F.sum(F.col("n") + F.col("n") * (F.col("n") - 1) / 2).alias("cost"))
    )
    found = {r["doc_id"]: r["cost"] for r in cost.collect()}  # two rows for each small band
    return frozenset(k // 2 for k in found if k % 2 and found[k] < found.get(k - 1, 0.0))


BLOBS = "bucket long, kind int, sig binary, owner binary, step binary, nodes binary, sizes binary"
#: Bits of a signature beside its bucket, and the marks beside the number of its set.
_LOW = _U((1 << 48) - 1)
_COMPANY, _SMALL, _NUMBER = 1 << 15, 1 << 14, (1 << 14) - 1


def _group_id(bucket, low: np.ndarray) -> np.ndarray:
    return K.mix(low ^ K.mix(np.atleast_1d(bucket).astype(_U) + _ODD[17]))


def _emit(n: int, percent: int, buckets: int, deletion: frozenset[int], frequent):
    """Signatures, packed by bucket. A signature that several sets of one emission share
    leaves one row for its bucket; the others' membership travels apart, so an element that
    very many documents share sends one row from each emission."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        turn = 0
        for whole in batches:
            for step in K.steps(whole, 0, EMIT_BYTES):
                for at in range(0, step.num_rows, EMIT_SETS):
                    sets = [s for s in shingle_sets(step.column(0).slice(at, EMIT_SETS), n) if len(s)]
                    if not sets:
                        continue
                    c1, _ = set_marks(sets)
                    _, only = np.unique(c1, return_index=True)
                    sets, c1 = [sets[k] for k in only], c1[only]
                    size = np.array([len(s) for s in sets], np.int64)
                    sig, owner, places = signatures(sets, bands, deletion, frequent.value)
                    if not len(sig):
                        continue
                    order = np.argsort(sig)
                    sig, owner, places = sig[order], owner[order], places[order].astype(np.uint8)
                    bucket = ((sig >> _U(32)) * _U(buckets)) >> _U(32)
                    head = np.ones(len(sig), bool)
                    np.not_equal(sig[1:], sig[:-1], out=head[1:])
                    company = np.append(~head[1:], False)[head]
                    small = bands.may_be_smaller(bands.left(places.astype(np.int64), size[owner]), size[owner])
                    small = np.logical_or.reduceat(small, np.flatnonzero(head))
                    rows = []
                    low, own, place = (sig & _LOW)[head], owner[head], places[head]
                    mark = (company * _COMPANY + small * _SMALL).astype(np.uint16)
                    home = bucket[head]
                    cut = np.flatnonzero(home[1:] != home[:-1]) + 1
                    for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(low)], strict=True):
                        used, number = np.unique(own[a:z], return_inverse=True)
                        six = low[a:z].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                        rows.append((
                            int(home[a]), 0, six.tobytes(), (number.astype(np.uint16) | mark[a:z]).tobytes(),
                            place[a:z].tobytes(), c1[used].tobytes(), size[used].tobytes(),
                        ))
                    if not head.all():
                        rest = ~head
                        turn += 1
                        g = _group_id(bucket[rest], sig[rest] & _LOW)
                        rows.append((
                            turn % buckets, 1, g.tobytes(), b"", places[rest].tobytes(),
                            c1[owner[rest]].tobytes(), size[owner[rest]].tobytes(),
                        ))
                    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["bucket", "kind", "sig", "owner", "step", "nodes", "sizes"],
                    )

    return run


GROUPS = "g long, c1 long, n long, left long"


def _group(percent: int):
    """Blobs sorted by bucket -> rows ``GROUPS`` of the signatures that several sets have,
    one of which can be the smaller of a pair. One bucket is held at a time."""
    bands = Bands(percent)

    def rows(g: np.ndarray, node: np.ndarray, n: np.ndarray, left: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(g), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[part].view(np.int64)), pa.array(node[part].view(np.int64)), pa.array(n[part]), pa.array(left[part])],
                names=["g", "c1", "n", "left"],
            )

    def whole(bucket: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sig = np.concatenate([h[0] for h in held])
        order = np.argsort(sig, kind="stable")
        near = sig[order]
        same = np.zeros(len(sig), bool)
        equal = near[1:] == near[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        mark = np.concatenate([h[1] for h in held])
        order = order[same | (mark[order] & _COMPANY > 0)]  # only signatures with company go on
        if not len(order):
            return
        sig, mark = sig[order], mark[order]
        node, n, left = (np.concatenate([h[k] for h in held])[order] for k in (2, 3, 4))
        order = np.lexsort((node, sig))
        sig, mark, node, n, left = (x[order] for x in (sig, mark, node, n, left))
        head = np.append(True, sig[1:] != sig[:-1])
        start, group = np.flatnonzero(head), np.cumsum(head) - 1
        marks = np.bitwise_or.reduceat(mark, start)
        fresh = head | np.append(True, node[1:] != node[:-1])
        several = marks & _COMPANY > 0
        wanted = (several | (np.add.reduceat(fresh.astype(np.int64), start) > 1)) & (marks & _SMALL > 0)
        members = np.add.reduceat(np.where(fresh, K.mix(node), _U(0)), start)
        g = np.where(several, _group_id(bucket, sig[start]), K.mix(members ^ _ODD[15]))
        # groups with the same members are one group, in which the earliest place counts
        first = np.arange(len(start))
        plain = np.flatnonzero(wanted & ~several)
        _, one, which = np.unique(g[plain], return_index=True, return_inverse=True)
        first[plain] = plain[one[which]]
        number = np.cumsum(fresh) - 1
        take = fresh & wanted[group]
        target = number[start][first[group]] + number - number[start][group]
        most = np.zeros(int(number[-1]) + 1, np.int64)
        np.maximum.at(most, target[take], left[take])
        take &= first[group] == group
        yield from rows(g[group[take]], node[take], n[take], most[number[take]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            for bucket, kind, sig, owner, step, node, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodes, sizes = np.frombuffer(node, _U), np.frombuffer(size, np.int64)
                places = np.frombuffer(step, np.uint8).astype(np.int64)
                if kind:
                    yield from rows(np.frombuffer(sig, _U), nodes, sizes, bands.left(places, sizes))
                    continue
                if bucket != last and held:
                    yield from whole(last, held)
                    held = []
                    K.give_back()
                last = bucket
                six = np.zeros((len(places), 8), np.uint8)
                six[:, :6] = np.frombuffer(sig, np.uint8).reshape(-1, 6)
                own = np.frombuffer(owner, np.uint16)
                number = own & _NUMBER
                n = sizes[number]
                held.append((six.view("<u8").ravel(), own & (_COMPANY | _SMALL), nodes[number], n, bands.left(places, n)))
        if held:
            yield from whole(last, held)
            held = []
            K.give_back()

    return run


def _blobs(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.steps(whole, 1):
                sets = shingle_sets(batch.column(1), n)
                c1, c2 = set_marks(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)),
                     pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "c1", "c2", "blob"],
                )

    return run


def _sieve(percent: int):
    """Pairs (a, ca, b, cb, n of either, sketch of either) that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            if not batch.num_rows:
                continue
            most = bands.differ(batch.column(4).to_numpy() + batch.column(5).to_numpy())
            mask = pa.array(sketch_differences(batch.column(6), batch.column(7)) <= most)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).filter(mask) for k in range(4)], names=["a", "ca", "b", "cb"]
            )

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                ok[i] = 100 * inter >= percent * (len(a) + len(b) - inter)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"]
            )

    return run


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(id, n_shingles, component_id), one row per input row.

    Words are what stands between white space (space, tab to carriage return), A-Z in lower
    case. A text with fewer than ``n`` words has them all as its one shingle; without words
    or with a null text its set is empty and linked with nothing. Two rows link when
    100 * intersection >= percent * union. ``component_id`` is the smallest id reachable by
    links. Rows that repeat an id count as one node, linked by whichever text links, also
    where one of the texts is empty; a row with a null id takes part as a node of its own,
    and a component of such rows alone is null. An empty table gives an empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(base.mapInArrow(_meta(n, percent), SETS), "ngram-sets")
    sets = rows.where("kind = 0").drop("kind")
    reps = written(
        sets.where("n > 0")
        .groupBy("c1", "c2")
        .agg(F.min("doc_id").alias("node"), F.max("n").alias("n"), F.max("sketch").alias("sketch")),
        "ngram-reps",
    )
    members = _members(base, rows, reps, n, percent)
    unnamed = _surrogates(sets, reps)
    nodes = reps if unnamed is None else reps.where("node IS NOT NULL").unionByName(unnamed)
    named = members.join(nodes.select("c1", "n", "node"), ["c1", "n"]).select("g", "c1", "node", "n", "left", _before())
    state = written(_open(named.withColumn("comp", F.col("node")), percent), "ngram-state")
    known, found, compared = None, None, 1
    while not state.isEmpty():
        by_node = F.row_number().over(Window.partitionBy("g").orderBy("node", "c1"))
        pivots = written(state.withColumn("_k", by_node).where(F.col("_k") <= compared), "ngram-pivots")
        p = pivots.select("g", *[F.col(c).alias(f"p_{c}") for c in ("c1", "node", "n", "left", "before", "comp")])
        pairs = (
            state.join(p, "g")
            .where("struct(node, c1) > struct(p_node, p_c1) AND comp <> p_comp")
            .where(f"100 * least(n, p_n) >= {percent} * greatest(n, p_n)")
            .where(f"{100 + percent} * least(left, p_left) >= {percent} * (n + p_n)")
            .where("NOT arrays_overlap(before, p_before)")  # the pair stands in that group too
            .select(
                F.col("p_node").alias("a"), F.col("p_c1").alias("ca"), F.col("node").alias("b"), F.col("c1").alias("cb")
            )
            .distinct()
        )
        if known is not None:
            pairs = pairs.join(known, ["a", "ca", "b", "cb"], "left_anti")
        pairs = written(pairs, "ngram-pairs")
        known = pairs if known is None else known.unionByName(pairs)
        new = _links(base, _likely(pairs, nodes, percent), n, percent, unnamed)
        if not new.isEmpty():
            # what is known of components, and the new links between them
            links = new if found is None else _edges(found).unionByName(new)
            found, old = written(components(links), "ngram-components"), found
            discard(old)
        discard(new)
        last = pivots.groupBy("g").agg(F.max(F.struct("node", "c1")).alias("_last"))
        later = state.drop("comp").join(last, "g").where("struct(node, c1) > _last").drop("_last")
        if found is not None:
            later = later.join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        else:
            later = later.withColumn("comp", F.col("node"))
        state, old = written(_open(later.select("g", "c1", "node", "n", "left", "before", "comp"), percent), "ngram-state"), state
        discard(old, pivots)
        compared *= 16
    discard(members, state)
    found, several = _one_node_per_id(sets, nodes, found)
    owner = nodes.select("c1", "c2", F.col("node").alias("component_id"))
    if found is not None:
        owner = written(
            nodes.join(found, "node", "left").select("c1", "c2", F.coalesce("component", "node").alias("component_id")),
            "ngram-owner",
        )
    if unnamed is not None:  # surrogates name no component
        ids = reps.select("c1", "c2", F.col("node").alias("_id"))
        least = owner.join(ids, ["c1", "c2"]).groupBy("component_id").agg(F.min("_id").alias("_least"))
        least = written(least, "ngram-least")
        named_by = lambda d: d.join(least, "component_id", "left").drop("component_id").withColumnRenamed("_least", "component_id")
        owner = named_by(owner)
    full = sets.where("n > 0").join(owner, ["c1", "c2"], "left").select("doc_id", "n", "component_id")
    empty = sets.where("n = 0").select("doc_id", "n")
    if several:
        held = found.select(F.col("node").alias("_id"), F.col("component").alias("component_id"))
        held = held if unnamed is None else named_by(held)
        empty = empty.join(held, F.col("doc_id") == F.col("_id"), "left").drop("_id")
        empty = empty.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    else:
        empty = empty.withColumn("component_id", F.col("doc_id"))
    return full.unionByName(empty).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _members(base: DataFrame, rows: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """(g, c1, n, left): the sets of every signature that several have in common."""
    spark = base.sparkSession
    top = rows.where("kind = 1").groupBy("c1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c1").limit(FREQUENT)
    held = top.select("c1", "n").toArrow()  # bounded by FREQUENT, as is what is broadcast
    hashes, counts = (held.column(c).to_numpy().astype(np.int64) for c in ("c1", "n"))
    frequent = spark.sparkContext.broadcast(Frequent(hashes.view(_U), counts))
    deletion = allot(rows.where("kind = 2"))
    shown = reps.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1).alias("s")).first()["s"] or 0
    buckets = max(1, min((1 << 32) - 1, int(shown // BUCKET_SIGNATURES) + 1))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4)
    blobs = base.select("text").mapInArrow(_emit(n, percent, buckets, deletion, frequent), BLOBS)
    dealt = blobs.repartition(parts, "bucket").sortWithinPartitions("bucket")
    groups = written(dealt.mapInArrow(_group(percent), GROUPS), "ngram-groups")
    # groups of different buckets with the same members are one group too
    members = written(groups.groupBy("g", "c1", "n").agg(F.max("left").alias("left")), "ngram-members")
    discard(groups)
    return members


def _before() -> Column:
    """The groups just before a row's group in its set's order. A pair that stands in one of
    them too, in both orders before this one, is compared there, where both have as much
    left or more; so near copies meet in one group or a few, not in each."""
    order = Window.partitionBy("c1", "node").orderBy(F.desc("left"), "g")
    return F.array_compact(F.array(*[F.lag("g", k).over(order) for k in range(1, BEFORE + 1)])).alias("before")


def _open(state: DataFrame, percent: int) -> DataFrame:
    """The rows of groups in which pairs may still have to be compared."""
    small = F.max(F.expr(f"{100 + percent} * left >= {percent} * 2 * n"))
    active = (
        state.groupBy("g")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), small.alias("small"))
        .where("lo <> hi AND small")
        .select("g")
    )
    return state.join(active, "g", "left_semi")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sketches do not rule out."""
    of = lambda x, c: nodes.select(F.col("node").alias(x), F.col("c1").alias(c), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    return written(
        pairs.join(of("a", "ca"), ["a", "ca"])
        .join(of("b", "cb"), ["b", "cb"])
        .select("a", "ca", "b", "cb", "n_a", "n_b", "s_a", "s_b")
        .mapInArrow(_sieve(percent), "a long, ca long, b long, cb long"),
        "ngram-likely",
    )


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _one_node_per_id(sets: DataFrame, nodes: DataFrame, found: DataFrame | None) -> tuple[DataFrame | None, bool]:
    """Components with the ids that have several texts linked to each text's node, and
    whether there are such ids."""
    several = (
        sets.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("c1", "c2") for f in (F.min, F.max)])
        .where("min_c1 <> max_c1 OR min_c2 <> max_c2")
        .select("doc_id")
    )
    several = written(several, "ngram-several")
    if several.isEmpty():
        return found, False
    own = sets.where("n > 0").join(several, "doc_id").select("doc_id", "c1", "c2").distinct()
    links = own.join(nodes, ["c1", "c2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    if found is not None:
        links = links.unionByName(_edges(found))
    return written(components(links), "ngram-components"), True


def _surrogates(sets: DataFrame, reps: DataFrame) -> DataFrame | None:
    """The rows of ``reps`` whose text stands only in rows with a null id, with a hash of
    the text that is no document's id as their node; None if there are none."""
    bare = reps.where("node IS NULL")
    if bare.isEmpty():
        return None
    ids = sets.select(F.col("doc_id").alias("node"))
    salt = 0
    while True:
        given = written(bare.withColumn("node", F.xxhash64(F.lit(salt), "c1", "c2")), "ngram-surrogates")
        twice = given.groupBy("node").count().where("count > 1")
        if twice.isEmpty() and given.join(ids, "node", "left_semi").isEmpty():
            return given
        salt += 1


def _links(base: DataFrame, pairs: DataFrame, n: int, percent: int, unnamed: DataFrame | None) -> DataFrame:
    """(a, b) of the pairs that link, by the whole sets of their texts."""
    ends = written(
        pairs.select(F.col("a").alias("_id"), F.col("ca").alias("_c"))
        .unionByName(pairs.select(F.col("b").alias("_id"), F.col("cb").alias("_c")))
        .distinct(),
        "ngram-ends",
    )
    ids = ends.select("_id").distinct()
    blobs = "doc_id long, c1 long, c2 long, blob binary"
    whole = base.join(ids, base["doc_id"] == ids["_id"], "left_semi").mapInArrow(_blobs(n), blobs).drop("c2")
    if unnamed is not None:
        bare = base.where("doc_id IS NULL").mapInArrow(_blobs(n), blobs).drop("doc_id")
        named = unnamed.select(F.col("node").alias("doc_id"), "c1", "c2")
        whole = whole.unionByName(bare.join(named, ["c1", "c2"]).select("doc_id", "c1", "blob"))
    texts = written(
        whole.join(ends, (F.col("doc_id") == F.col("_id")) & (F.col("c1") == F.col("_c")), "left_semi")
        .groupBy("doc_id", "c1")
        .agg(F.first("blob").alias("blob")),
        "ngram-texts",
    )
    left = texts.select(F.col("doc_id").alias("a"), F.col("c1").alias("ca"), F.col("blob").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("c1").alias("cb"), F.col("blob").alias("y"))
    linked = written(
        pairs.join(left, ["a", "ca"])
        .join(right, ["b", "cb"])
        .select("a", "b", "x", "y")
        .mapInArrow(_verify(percent), "a long, b long"),
        "ngram-links",
    )
    discard(pairs, ends, texts)
    return linked


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The input's rows whose id is their component's smallest; rows with a null id stay."""
    found = ngram_components(docs, id_col, text_col, **how).select(F.col(id_col).alias("_id"), "component_id")
    drop = found.where("_id <> component_id").select("_id").distinct()
    return docs.join(drop, docs[id_col] == drop["_id"], "left_anti")
