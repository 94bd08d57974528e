"""Packing documents into training sequences, balanced by attention cost.

Tokenising, packing and hashing happen in one pass over each input partition, so nothing
is shuffled and no task holds more than one block of documents. Within a block the pieces
of documents are taken in descending length; each goes to the sequence of lowest cost
(linear plus quadratic in the tokens of its pieces) that still has room for it.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textkernel as K

SEQUENCE_TOKENS = 4096
END_ID = 2
#: Tokens gathered before a block is packed.
BLOCK_TOKENS = 1 << 20
#: Bytes of text that are cut into pieces together: a piece takes some hundred bytes meanwhile.
PIECE_STEP_BYTES = 1 << 17
#: Cost of a piece of n tokens: n + n * n / QUADRATIC.
QUADRATIC = 2048.0
#: Distinct pieces of text whose ids a worker remembers; beyond that it starts anew.
CACHE_PIECES = 1 << 18
TOKENIZER_FILE = "word_bpe_49k.json"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
)


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _PUNCT[_a:_b] = True
_PUNCT[39] = False  # an apostrophe may belong to the letters behind it
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Longest piece, in bytes, that is remembered.
CACHED_BYTES = 256


def _splits_as_known(file: dict) -> bool:
    """Does a vocabulary file normalise and split as ``WordTokenizer`` does by itself?
    The split pattern and the special tokens may be any that keep its places to cut."""
    normalizer, split, model = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}, file["model"]
    steps = split.get("pretokenizers") or [{}, {}]
    return (
        [x.get("type") for x in normalizer.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and normalizer["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        and normalizer["normalizers"][1]["content"] == " "
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and file.get("truncation") is None
        and file.get("padding") is None
        and model.get("type") == "BPE"
        and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
        and not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in file["added_tokens"])
    )


class WordTokenizer:
    """Ids of whole texts, each distinct piece of text being encoded once.

    The vocabulary drops white space and splits between letters and punctuation before it
    merges, so a text may be cut at white space and where an ASCII or Latin-1 letter meets
    ASCII punctuation, but for the apostrophe. Pieces are found by a 64-bit hash of their
    bytes with A-Z in lower case, in an open-addressing table that numpy probes for a whole
    step of texts at once; the bytes themselves are compared then. Texts with a special
    token's string, and all texts under a file that normalises or splits otherwise, are
    encoded whole by the library.
    """

    def __init__(self, path: str, most: int = CACHE_PIECES):
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.by_piece = _splits_as_known(file)
        self.special = [x["content"].encode() for x in file.get("added_tokens", [])]
        if self.by_piece:
            self.split = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.unusual = regex.compile("[\x85\xa0\u0250-\U0010ffff]").search
        self.letters = _byte_letters()
        self.merge = self.model.model.tokenize
        del file
        self._reset(most)
        K.give_back()

    def _reset(self, most: int) -> None:
        self.most, self.mask = most, (1 << (2 * most - 1).bit_length()) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.slots = np.zeros(self.mask + 1, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.ends = np.zeros(most + 1, np.int64)
        self.bytes = np.zeros(1 << 18, np.uint8)
        self.byte_ends = np.zeros(most + 1, np.int64)
        self.count = 0

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one piece; what is not plainly Latin goes to the library."""
        if not piece.isascii():
            if self.unusual(piece):
                return self.model.encode(piece, add_special_tokens=False).ids
            piece = unicodedata.normalize("NFC", piece)
        piece = piece.lower()
        parts = [piece] if piece.isalpha() else self.split.findall(piece)
        return [
            t.id for x in parts for t in self.merge(x.encode().decode("latin-1").translate(self.letters))
        ]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if unknown."""
        out = np.full(len(h), -1, np.int64)
        at = h & np.uint64(self.mask)
        left = np.arange(len(h))
        while len(left):
            there = self.keys[at[left]]
            hit = there == h[left]
            out[left[hit]] = self.slots[at[left[hit]]]
            left = left[~hit & (there != 0)]
            at[left] = (at[left] + np.uint64(1)) & np.uint64(self.mask)
        return out

    def _learn(self, h: np.ndarray, pieces: list[bytes], lower: list[bytes]) -> None:
        flat: list[int] = []
        ends = []
        for piece in pieces:
            flat += self.piece_ids(piece.decode())
            ends.append(len(flat))
        a, z = self.count, self.count + len(h)
        self.ids = _append(self.ids, int(self.ends[a]), np.array(flat, np.uint32))
        self.ends[a + 1 : z + 1] = np.array(ends, np.int64) + self.ends[a]
        self.bytes = _append(self.bytes, int(self.byte_ends[a]), np.frombuffer(b"".join(lower), np.uint8))
        self.byte_ends[a + 1 : z + 1] = np.cumsum([len(x) for x in lower]) + self.byte_ends[a]
        at = (h & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):  # claim free slots; of several claims to one the first succeeds
            slot, first = np.unique(at[left], return_index=True)
            free = self.keys[slot] == 0
            won = left[first[free]]
            self.keys[at[won]] = h[won]
            self.slots[at[won]] = self.count + won
            left = left[self.keys[at[left]] != h[left]]
            at[left] = (at[left] + 1) & self.mask
        self.count += len(h)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets)."""
        data, offsets = K.bytes_of(texts)
        raw = data.tobytes()
        if not self.by_piece or any(x in raw for x in self.special):
            whole = [e.ids for e in self.model.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            lengths = np.array([0, *map(len, whole)])
            return np.array([i for x in whole for i in x], np.uint32), np.cumsum(lengths)
        start, end = pieces_of(data, offsets)
        low = K.ascii_lower(data)
        h = K.hash_spans(low, start, end) | np.uint64(1)
        short = end - start <= CACHED_BYTES
        entry = self._find(h)
        unknown = np.flatnonzero((entry < 0) & short)
        if len(unknown):
            fresh, first = np.unique(h[unknown], return_index=True)
            if self.count + len(fresh) > self.most:
                entry[:] = -1
                unknown = np.flatnonzero(short)
                fresh, first = np.unique(h[unknown], return_index=True)
                self._reset(max(self.most, len(fresh)))
            where = unknown[first]
            spans = list(zip(start[where].tolist(), end[where].tolist(), strict=True))
            small = low.tobytes()
            self._learn(fresh, [raw[a:b] for a, b in spans], [small[a:b] for a, b in spans])
            entry[unknown] = self._find(h[unknown])
        entry[~short] = -1
        begin, count = self.ends[entry], self.ends[entry + 1] - self.ends[entry]
        size = end - start
        known = (entry >= 0) & (self.byte_ends[entry + 1] - self.byte_ends[entry] == size)
        at = np.flatnonzero(known)
        known[at] = K.same_spans(low, start[at], self.bytes, self.byte_ends[entry[at]], size[at])
        ids = self.ids
        if not known.all():  # long pieces, and such as only share a hash with one in the table
            used = int(self.ends[self.count])
            alone = np.flatnonzero(~known)
            own = [self.piece_ids(raw[a:b].decode()) for a, b in zip(start[alone].tolist(), end[alone].tolist(), strict=True)]
            count[alone] = [len(x) for x in own]
            begin[alone] = used + np.cumsum(count[alone]) - count[alone]
            ids = np.concatenate([ids[:used], np.array([i for x in own for i in x], np.uint32)])
        total = np.concatenate([[0], np.cumsum(count)])
        out = ids[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return out, total[np.searchsorted(start, offsets)]


def _append(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``more`` behind the first ``used`` values; the array grows by doubling."""
    if used + len(more) > len(held):
        held = np.concatenate([held, np.zeros(max(len(held), len(more)), held.dtype)])
    held[used : used + len(more)] = more
    return held


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the pieces that can be encoded by themselves."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    letter, punct = _LETTER[data], _PUNCT[data]
    # C3 80 to C3 BF are letters, but for the signs of multiplication and division
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    letter[lead] = letter[lead + 1] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (letter[1:] & punct[:-1]) | (punct[1:] & letter[:-1])
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = inside[heads]
    ends = np.zeros(n + 1, bool)
    ends[1:n] = inside[:-1] & (~inside[1:] | begins[1:])
    ends[n] = inside[-1]
    return np.flatnonzero(begins), np.flatnonzero(ends)


def pack_block(lengths: np.ndarray, capacity: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for every piece.

    Sequences hold as many tokens as the block has: all of full capacity, and for what is
    left over lengths that are powers of two, which need no padding. Whole multiples of
    the capacity are cut from a document first. A rest that fits nowhere is cut to fill
    the open sequences in the order of their cost.
    """
    total = int(lengths.sum())
    full, rest = divmod(total, capacity)
    room = [capacity] * full + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if rest >> k & 1]
    pieces, used_full, tails = [], 0, []
    for doc in np.flatnonzero(lengths >= capacity):
        for part in range(int(lengths[doc]) // capacity):
            pieces.append((int(doc), part * capacity, capacity, used_full, 0))
            used_full += 1
    left = lengths % capacity
    tails = np.flatnonzero(left)
    tails = tails[np.argsort(-left[tails], kind="stable")]
    free = np.array(room[used_full:], np.int64)
    size, cost = free.copy(), np.zeros(len(free))
    for doc in tails:
        need, start = int(left[doc]), int(lengths[doc] - left[doc])
        while need:
            open_at = np.flatnonzero(free >= need)
            if not len(open_at):  # no sequence takes it whole: cut
                open_at = np.flatnonzero(free == free.max())
            at = int(open_at[np.argmin(cost[open_at])])
            put = min(need, int(free[at]))
            pieces.append((int(doc), start, put, used_full + at, int(size[at] - free[at])))
            free[at] -= put
            cost[at] += put + put * put / QUADRATIC
            start, need = start + put, need - put
    return pieces


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of rows with one value of the third column."""
    if not batch.num_rows:
        return
    code = batch.column(2).fill_null("").dictionary_encode().indices.to_numpy()
    cut = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield batch.slice(a, b - a)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    capacity: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    order: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per piece: see ``PIECES``. Documents are packed where they stand; nothing is
    shuffled.

    ``order`` names two columns (a string, a long) that put the documents into training
    order, as those of ``in_file_order``. A block then holds documents of one string only, in
    the order they stand in, and each row has a further column ``block``: string and long of
    its block's first document. Sorted by it, blocks follow each other in training order.

    A document is its ids and the end id; a null or empty text is the end id alone. Each
    id lies in exactly one piece, and a sequence's pieces follow each other without gaps.
    Rows that repeat an id are documents of their own. Null ids stay null. An empty table
    gives no pieces. Sequence ids are the partition's number times 2^32 plus a count, so
    reruns over the same files agree. Other columns are not read.
    """
    path = tokenizer_path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = WordTokenizer(path)
        base = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        tokens = sequences = 0
        block = None

        def flush() -> pa.RecordBatch:
            nonlocal held, tokens, sequences
            ident = pa.concat_arrays([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([h[2] for h in held])
            starts = np.concatenate([[0], np.cumsum(lengths)])
            found = np.array(pack_block(lengths, capacity), np.int64).reshape(-1, 5)
            doc, start, length, sequence, offset = found.T
            view = memoryview(ids.astype("<u4")).cast("B")
            at = (starts[doc] + start) * 4
            crc = [zlib.crc32(view[a : a + n]) for a, n in zip(at.tolist(), (length * 4).tolist(), strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            cols = [ident.take(pa.array(doc)), *map(pa.array, (start, length, np.array(crc, np.int64), lengths[doc])),
                    pa.array(base + sequences + sequence), pa.array(offset)]
            if order:
                names, cols = [*names, "block"], [*cols, pa.array([block] * len(doc), pa.string())]
            out = pa.RecordBatch.from_arrays(cols, names=names)
            sequences += int(sequence.max()) + 1
            held, tokens = [], 0
            return out

        for batch in batches:
            for near in _runs(batch) if order else [batch]:
                run_of = near.column(2)[0].as_py() if order and near.num_rows else None
                if held and order and not (block or "").startswith(f"{run_of}:"):
                    yield flush()
                for part in K.steps(near, 1, min(PIECE_STEP_BYTES, 4 * block_tokens)):
                    if order and not held:
                        place = part.column(3)[0].as_py()
                        block = f"{run_of}:{-1 if place is None else place:012d}"
                    ids, offsets = tokenizer.encode(part.column(1))
                    lengths = np.diff(offsets)
                    own = np.insert(ids, offsets[1:], end_id).astype(np.uint32)
                    held.append((part.column(0), own, lengths + 1))
                    tokens += len(own)
                    if tokens >= block_tokens:
                        yield flush()
        if held:
            yield flush()

    more = [F.col(order[0]).cast("string"), F.col(order[1]).cast("long")] if order else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return rows.mapInArrow(run, PIECES + (", block string" if order else ""))
