"""Byte strings of 200 that occur again, found by suffix arrays.

Sorting every suffix of a corpus would move each of its bytes many times, so suffixes are
first narrowed to those that can repeat, without losing one:

1. Each 200-byte window has an anchor, its 32-byte string of least hash (the leftmost of
   equals). Equal windows have equal anchors. Consecutive windows with one anchor form a
   segment, about 85 windows long. Segments whose anchor occurs once hold no repeat.
2. If all segments of an anchor are the same text, all their windows repeat. The same
   holds for each text that two segments of an anchor share.
3. For the other anchors one segment per distinct text goes to a shard by its anchor. A
   shard's suffix array is built by Larsson-Sadakane refinement (doubling, re-sorting
   only groups that are not yet singletons), its common prefixes by Kasai's rule, taken
   for all suffixes at once. Windows with 200 bytes in common with a neighbour repeat.
4. An anchor with very many distinct segments is split over several shards. Each of these
   also emits fingerprints of its distinct windows. Shards are merged by ranges of
   fingerprints: each is searched in the sorted union by bisection, and those that it
   holds twice repeat. A window of however many texts is one row of each shard.

All groupings are aggregates with a partial step, so a text that a third of all documents
share shuffles one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textkernel as K
from quarry.llm.shared import written

WINDOW = 200
GRAM = 32
#: Distinct segments of one anchor above which it is split over shards.
SPLIT_SEGMENTS = 4096
#: Bytes of one shard's text.
SHARD_BYTES = 1 << 20
_CHUNK = 1 << 23  # positions that fit beside 40 bits of hash in an anchor's key

SEGMENTS = "doc_id long, doc_hash long, start long, n_win int, anchor long, text_hash long"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def segment_table(data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """(text number, start in the buffer, windows, anchor, text hash) of all segments."""
    n = len(data)
    if n < window:
        return None
    per = window - gram + 1
    h = K.prefix_hash(data)
    grams = K.rolling_hash(h, gram)
    key = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    least = key
    while width * 2 <= per:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < per:
        least = np.minimum(least[: len(least) - (per - width)], least[per - width :])
    starts = np.arange(n - window + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))  # of the text that holds each byte
    ok = starts + window <= ends[: len(starts)]
    starts = starts[ok]
    if not len(starts):
        return None
    anchor = (least[ok] & np.uint64(0xFFFFFF)).astype(np.int64)
    fresh = np.empty(len(starts), bool)
    fresh[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=fresh[1:])
    fresh[1:] |= starts[1:] != starts[:-1] + 1
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    text = np.searchsorted(offsets, begin, side="right") - 1
    return text, begin, count, grams[anchor[first]], K.hash_spans(data, begin, begin + count + window - 1)


def _chunks(data: np.ndarray, offsets: np.ndarray, window: int):
    """The buffer, cut where it is too long for one step; cuts overlap by a window."""
    if len(data) <= _CHUNK:
        yield data, offsets, 0
        return
    for a in range(0, max(len(data) - window + 1, 1), _CHUNK - window):
        b = min(a + _CHUNK - 1, len(data))
        inner = np.clip(offsets, a, b) - a
        yield data[a:b], inner, a


def segments(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs(doc_id, doc_hash, text)`` -> ``SEGMENTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.steps(whole, 2):
                data, offsets = K.bytes_of(batch.column(2))
                for part, inner, shift in _chunks(data, offsets, window):
                    found = segment_table(part, inner, window, gram)
                    if found is None:
                        continue
                    text, begin, count, anchor, digest = found
                    at = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at),
                         pa.array(begin + shift - offsets[text]), pa.array(count.astype(np.int32)),
                         _signed(anchor), _signed(digest)],
                        names=["doc_id", "doc_hash", "start", "n_win", "anchor", "text_hash"],
                    )

    return docs.mapInArrow(run, SEGMENTS)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order, by Larsson-Sadakane refinement.

    Ranks are group starts. Each round doubles the sorted length and touches only groups
    that hold more than one suffix, until none does."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    first = np.ones(n, bool)
    sorted_key = key[order]
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=first[1:])
    del key, sorted_key
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    # suffixes shorter than the key stand behind zero bytes that are not theirs
    h = 8
    if n and not first.all():
        tail = np.arange(max(n - 8, 0), n)
        open_at = _open_places(first)
        pos = order[open_at]
        if np.isin(pos, tail).any():
            by = np.lexsort((np.where(pos + 8 > n, n - pos, 8), rank[pos]))
            pos = pos[by]
            order[open_at] = pos
            size = np.where(pos + 8 > n, n - pos, 8)
            fresh = np.append(True, (rank[pos[1:]] != rank[pos[:-1]]) | (size[1:] != size[:-1]))
            first[open_at] = fresh
            rank[pos] = np.maximum.accumulate(np.where(fresh, open_at, 0))
    while not first.all():
        open_at = _open_places(first)
        pos = order[open_at]
        pair = rank[pos] * (n + 1) + rank[np.minimum(pos + h, n)] + 1
        by = np.argsort(pair, kind="stable")
        pos, pair = pos[by], pair[by]
        order[open_at] = pos
        fresh = np.ones(len(pair), bool)
        np.not_equal(pair[1:], pair[:-1], out=fresh[1:])
        first[open_at] = fresh
        rank[pos] = np.maximum.accumulate(np.where(fresh, open_at, 0))
        h *= 2
    return order


def _open_places(first: np.ndarray) -> np.ndarray:
    """Places in groups of more than one suffix."""
    size = np.diff(np.append(np.flatnonzero(first), len(first)))
    return np.flatnonzero(np.repeat(size > 1, size))


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix of the array has in common with the one before it (Kasai).

    In text order a suffix has at most one byte less in common with its neighbour than the
    suffix one byte before it; it has exactly one less where the bytes before both are
    equal. Only the other suffixes are compared, eight bytes at a time and all at once; a
    running maximum then gives each suffix the last compared one before it."""
    n = len(data)
    before = np.full(n, -1, np.int64)  # the suffix before each one in the array
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    has = before >= 0
    fresh = ~has | (at == 0) | (before <= 0)
    inner = np.flatnonzero(~fresh)
    fresh[inner] = data[inner - 1] != data[before[inner] - 1]
    fresh[1:] |= ~has[:-1]  # what stands behind a suffix without neighbour is compared
    common = np.zeros(n, np.int64)
    live = np.flatnonzero(fresh & has)
    eight = np.ndarray((n + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    p, q = live.copy(), before[live]
    while len(live):
        left = n - np.maximum(p, q)
        diff = eight[p] ^ eight[q]
        low = diff & (~diff + np.uint64(1))  # its lowest set bit lies in the first byte that differs
        same = np.where(diff == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        step = np.minimum(same, left)
        common[live] += step
        go = (step == 8) & (left > 8)
        live, p, q = live[go], p[go] + 8, q[go] + 8
    last = np.maximum.accumulate(np.where(fresh, at, 0))
    by_text = np.where(has, np.maximum(common[last] - (at - last), 0), 0)
    return by_text[order]


def repeated_windows(data: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """For each valid start (sorted): does its window occur at another valid start?

    Valid suffixes that follow each other in the array have in common the least of the
    common prefixes from one to the other."""
    order = suffix_array(data)
    common = common_prefixes(data, order)
    is_valid = np.zeros(len(data), bool)
    is_valid[valid] = True
    place = np.flatnonzero(is_valid[order])
    kept = order[place]
    hit = np.zeros(len(data), bool)
    if len(kept) > 1:
        same = np.minimum.reduceat(common, place[:-1] + 1)  # the last range runs to the end
        same[-1] = common[place[-2] + 1 : place[-1] + 1].min()
        same = same >= window
        hit[kept[1:][same]] = True
        hit[kept[:-1][same]] = True
    return hit[valid]


SHARD_OUT = (
    "doc_id long, doc_hash long, a long, b long, anchor long, f1 long, f2 long"
)


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[first, last] of runs of set flags that do not cross owners."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on
    cut = (np.diff(on) > 1) | (owner[on[1:]] != owner[on[:-1]])
    return on[np.append(True, cut)], on[np.append(cut, True)]


def _shard_rows(rows: list[tuple], window: int, split: bool) -> pa.RecordBatch:
    """One shard: spans that repeat in it and, if its anchor is split, a fingerprint row for
    each distinct window of its segments."""
    texts = [r[5] for r in rows]
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    base = np.cumsum(sizes) - sizes
    n_win = sizes - window + 1
    owner = np.repeat(np.arange(len(rows)), n_win)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    valid = base[owner] + within
    hit = repeated_windows(data, valid, window)
    first, last = _runs(hit, owner)
    single = np.array([r[4] == 1 for r in rows])
    keep = single[owner[first]]
    first, last = first[keep], last[keep]
    take = lambda i, at: [rows[k][i] for k in at]
    start = np.array([r[2] for r in rows], np.int64)
    o = owner[first]
    nothing = pa.nulls(len(o), pa.int64())
    cols = [pa.array(take(0, o), pa.int64()), pa.array(take(1, o), pa.int64()),
            pa.array(start[o] + within[first]), pa.array(start[o] + within[last] + window), nothing, nothing, nothing]
    if split:
        f1, f2 = (K.hash_spans(data, valid, valid + window, seed) for seed in (1, 2))
        by = np.lexsort((f2, f1))
        fresh = np.append(True, (f1[by[1:]] != f1[by[:-1]]) | (f2[by[1:]] != f2[by[:-1]]))
        # a window that the shard has again is found already; one row tells the other shards
        one = np.sort(by[fresh])
        f1, f2, w, within = f1[one], f2[one], owner[one], within[one]
        more = [pa.array(take(0, w), pa.int64()), pa.array(take(1, w), pa.int64()), pa.array(start[w] + within),
                pa.array(start[w] + within + window), pa.array(take(3, w), pa.int64()), _signed(f1), _signed(f2)]
        cols = [pa.concat_arrays([a, b]) for a, b in zip(cols, more, strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SHARD_OUT.split(", ")])


def _shards(window: int, shard_bytes: int):
    """Rows (shard, split, doc_id, doc_hash, start, anchor, copies, segment) sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last, was_split = 0, None, False
        for batch in batches:
            for shard, split, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and shard != last and (split or was_split or size >= shard_bytes):
                    yield _shard_rows(held, window, was_split)
                    held, size = [], 0
                held.append(tuple(row))
                size += len(row[5])
                last, was_split = shard, split
        if held:
            yield _shard_rows(held, window, was_split)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, doc_hash, a, b, f1, f2) of all shards, one range of f1 and sorted: those
    that a binary search in the sorted union finds more than once. A run of equal values
    stays together in the stream; what may continue is carried over."""
    held = None

    def done(t: pa.Table, upto: int) -> list[pa.RecordBatch]:
        f1, f2 = (t.column(c).to_numpy()[:upto] for c in ("f1", "f2"))
        # equal values of f1 stand together; f2 is searched in its sorted values of each run
        start = np.searchsorted(f1, f1, side="left")
        union = np.empty(upto, [("x", np.int64), ("y", np.int64)])
        union["x"], union["y"] = start, f2
        mine = union.copy()
        union.sort(order=("x", "y"))
        alone = np.searchsorted(union, mine, side="right") - np.searchsorted(union, mine, side="left") < 2
        at = np.flatnonzero(~alone)
        return t.select(["doc_id", "doc_hash", "a", "b"]).take(pa.array(at)).combine_chunks().to_batches()

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        f1 = held.column("f1").to_numpy()
        upto = int(np.searchsorted(f1, f1[-1], side="left")) if len(f1) else 0
        if upto:
            yield from done(held, upto)
            held = held.slice(upto)
    if held is not None and held.num_rows:
        yield from done(held, held.num_rows)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, split_segments: int = SPLIT_SEGMENTS) -> DataFrame:
    """(doc_id, doc_hash, a, b): byte ranges, overlapping and repeated ones among them,
    that together are all bytes covered by a repeated window."""
    segs = written(segments(docs.select("doc_id", "doc_hash", "text"), window, gram), "suffix-segments")
    anchors = written(
        segs.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"))
        .where("n > 1")
        .select("anchor", (F.col("lo") == F.col("hi")).alias("uniform")),
        "suffix-anchors",
    )
    shared = written(segs.join(anchors, "anchor"), "suffix-shared")
    last = (F.col("start") + F.col("n_win") - 1 + window).alias("b")
    whole = shared.where("uniform").select("doc_id", "doc_hash", F.col("start").alias("a"), last)
    mixed = shared.where("NOT uniform")
    one = F.struct("doc_id", "doc_hash", "start", "n_win")
    classes = written(
        mixed.groupBy("anchor", "text_hash").agg(F.count("*").alias("copies"), F.min(one).alias("rep")),
        "suffix-classes",
    )
    many = classes.where("copies > 1").select("anchor", "text_hash")
    whole = whole.unionByName(
        mixed.join(many, ["anchor", "text_hash"], "left_semi").select(
            "doc_id", "doc_hash", F.col("start").alias("a"), last
        )
    )
    open_anchors = written(
        classes.groupBy("anchor")
        .agg(F.count("*").alias("k"), F.min("copies").alias("least"))
        .where("least = 1")
        .select("anchor", "k"),
        "suffix-open",
    )
    parts = F.ceil(F.col("k") / F.lit(split_segments)).cast("int")
    wanted = written(
        classes.join(open_anchors, "anchor").select(
            "rep.*",
            F.struct(
                F.col("rep.start").alias("start"),
                F.col("rep.n_win").alias("n_win"),
                "anchor",
                "copies",
                (F.col("k") > split_segments).alias("split"),
                F.pmod("text_hash", parts).cast("int").alias("part"),
            ).alias("seg"),
        )
        .groupBy("doc_id", "doc_hash")
        .agg(F.collect_list("seg").alias("segs")),
        "suffix-wanted",
    )
    d = docs.select(F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_h"), F.encode("text", "utf-8").alias("_bytes"))
    # rows that repeat an id and a text give the same segments; distinct leaves one of each
    cut = (
        d.join(wanted, d["_id"].eqNullSafe(wanted["doc_id"]) & (d["_h"] == wanted["doc_hash"]))
        .select(
            "doc_id",
            "doc_hash",
            F.explode(
                F.transform(
                    "segs",
                    lambda s: s.withField(
                        "segment",
                        F.substring(F.col("_bytes"), (s["start"] + 1).cast("int"), s["n_win"] + F.lit(window - 1)),
                    ),
                )
            ).alias("s"),
        )
        .select(
            F.xxhash64("s.anchor", "s.part").alias("shard"), F.col("s.split").alias("split"), "doc_id", "doc_hash",
            F.col("s.start").alias("start"), F.col("s.anchor").alias("anchor"), F.col("s.copies").alias("copies"),
            F.col("s.segment").alias("segment"),
        )
    )
    placed = cut.repartition("shard").sortWithinPartitions("shard")
    found = written(placed.mapInArrow(_shards(window, SHARD_BYTES), SHARD_OUT), "suffix-found")
    inside = found.where("f1 IS NULL").select("doc_id", "doc_hash", "a", "b")
    prints = found.where("f1 IS NOT NULL")
    across = (
        prints.select("doc_id", "doc_hash", "a", "b", F.xxhash64("anchor", "f1").alias("f1"), "f2")
        .repartitionByRange("f1")
        .sortWithinPartitions("f1")
        .mapInArrow(_merge, "doc_id long, doc_hash long, a long, b long")
    )
    return whole.unionByName(inside).unionByName(across)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text string, kept_sha256 string"


def merge_spans(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of the union of [a, b) ranges; ranges that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cutter(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.steps(whole, 1, 8 << 20):
                rows = []
                spans = batch.column(2)
                for i, (ident, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                    data = text.as_buffer() if text.is_valid else b""
                    listed = spans[i].as_py()
                    if not listed:
                        view, runs = memoryview(data), []
                        rows.append((ident, len(view), 0, 0, None, hashlib.sha256(view).hexdigest(), bytes(view) if with_text else None))
                        continue
                    runs = merge_spans([(s["a"], s["b"]) for s in listed])
                    view, at, kept = memoryview(data), 0, []
                    for a, b in runs:
                        kept.append(view[at:a])
                        at = b
                    kept.append(view[at:])
                    left = b"".join(kept)
                    rows.append((ident, len(view), len(view) - len(left), len(runs), None, hashlib.sha256(left).hexdigest(), left if with_text else None))
                cols = list(zip(*rows, strict=True))
                texts = [None if t is None else t.decode("utf-8", "replace") for t in cols[6]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), *(pa.array(cols[k], pa.int64()) for k in (1, 2, 3)),
                     pa.array(texts, pa.string()), pa.array(cols[5], pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256"],
                )

    return run


def suffix_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    split_segments: int = SPLIT_SEGMENTS,
    with_text: bool = True,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_text, kept_sha256), one row per input row.

    Every byte that a repeated ``window``-byte string covers is removed, in all places
    where the string stands. Null texts are empty; texts shorter than the window are left
    as they are. The digest is of the remaining bytes; ``kept_text`` shows them as UTF-8,
    with replacement characters where a cut split a character. Rows that repeat an id and
    a text are documents of their own, which therefore repeat each other. Null ids are
    allowed. An empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_hash"), text.alias("text"))
    spans = written(
        repeated_spans(base, window, gram, split_segments)
        .groupBy("doc_id", "doc_hash")
        .agg(F.collect_set(F.struct("a", "b")).alias("spans")),
        "suffix-spans",
    )
    b = base.select("doc_id", "doc_hash", F.encode("text", "utf-8").alias("bytes"))
    joined = b.join(spans.withColumnsRenamed({"doc_id": "_id", "doc_hash": "_h"}),
                    b["doc_id"].eqNullSafe(F.col("_id")) & (b["doc_hash"] == F.col("_h")), "left")
    return joined.select("doc_id", "bytes", "spans").mapInArrow(_cutter(with_text), RESULT)
