"""Toxicity by nearest labelled examples.

Texts are compared by exact TF-IDF cosine over the terms that the labels tell apart:
words, and beginnings of longer words, chosen by a likelihood ratio on a bounded sample of
labelled documents; all other words count together as one term, so that a stray hit in a
long text weighs little. Document frequencies are counted over all documents. Examples
stand in an inverted index of blocks with the largest weight of each term in each block;
a query visits blocks in the order of their bound and stops when no bound can reach its
k-th neighbour. Neighbours vote with weights that fall with distance, and isotonic
regression on left-out votes turns the vote into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import textkernel as K
from quarry.llm.shared import written

#: Labelled documents of each class from which terms and calibration are learnt.
SAMPLE_PER_CLASS = 6000
#: Of these, documents of each class that serve as neighbours, the first by the sample's hash.
EXAMPLES_PER_CLASS = 1500
MAX_TERMS = 2048
MIN_RATIO = 20.0
NEIGHBOURS = 15
BLOCK = 64
PREFIXES = (5, 6, 7, 8)
EVIDENCE = 3
_U = np.uint64


def text_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term hashes, number of each term's text, words of each text)."""
    start, end = K.word_spans(data, offsets, loose=True)
    owner = np.searchsorted(offsets, start, side="right") - 1
    low = K.ascii_lower(data)
    hashes, owners = [K.hash_spans(low, start, end)], [owner]
    for n in PREFIXES:
        longer = end - start > n
        s = start[longer]
        hashes.append(K.hash_spans(low, s, s + n, n))
        owners.append(owner[longer])
    return np.concatenate(hashes), np.concatenate(owners), np.bincount(owner, minlength=len(offsets) - 1)


class Vocabulary:
    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.may = np.zeros(1 << 20, bool)
        self.may[(self.hashes >> _U(44)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, tf) of the known terms, sorted by text; words of each text. The
        number len(self) stands for all other words."""
        data, offsets = K.bytes_of(texts)
        hashes, owner, n_words = text_terms(data, offsets)
        maybe = self.may[(hashes >> _U(44)).astype(np.int64)]
        hashes, owner = hashes[maybe], owner[maybe]
        if not len(self):
            hashes = hashes[:0]
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self) - 1, 0))
        ok = self.hashes[at] == hashes if len(hashes) else np.zeros(0, bool)
        key, tf = np.unique(owner[: len(at)][ok] * (len(self) + 1) + at[ok], return_counts=True)
        return key // (len(self) + 1), key % (len(self) + 1), tf, n_words


class BlockMaxIndex:
    """Examples' unit vectors, in blocks; see the module's first lines."""

    def __init__(
        self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK, ids: np.ndarray | None = None
    ):
        self.n, self.block = len(vectors), block
        self.ids = np.arange(self.n) if ids is None else ids
        n_blocks = max(1, -(-self.n // block))
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        example = np.repeat(np.arange(self.n), [len(v[0]) for v in vectors])
        cell = (example // block) * n_terms + term
        order = np.lexsort((example, cell))
        self.example, self.weight = example[order], weight[order]
        self.ptr = np.searchsorted(cell[order], np.arange(n_blocks * n_terms + 1))
        self.most = np.zeros(n_blocks * n_terms)
        np.maximum.at(self.most, cell, weight)
        self.most = self.most.reshape(n_blocks, n_terms)
        self.n_terms = n_terms
        self.evaluated = 0

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest, ties to the smaller id."""
        bound = self.most[:, terms] @ weights
        visit = np.argsort(-bound, kind="stable")
        scores = np.zeros(self.n)
        worst, at, width = -1.0, 0, 4
        seen: list[np.ndarray] = []
        while at < len(visit) and bound[visit[at]] > 0 and bound[visit[at]] >= worst - 1e-9:
            now = visit[at : at + width]
            now = now[bound[now] >= worst - 1e-9]
            cells = (now[:, None] * self.n_terms + terms[None, :]).ravel()
            first, count = self.ptr[cells], self.ptr[cells + 1] - self.ptr[cells]
            total = np.cumsum(count)
            idx = np.repeat(first - (total - count), count) + np.arange(total[-1] if len(total) else 0)
            by = np.repeat(np.tile(weights, len(now)), count)
            scores += np.bincount(self.example[idx], self.weight[idx] * by, self.n)
            seen.append(now)
            at += len(now)
            width *= 2
            if without >= 0:
                scores[without] = -1.0
            if self.n > k:
                worst = max(np.partition(scores, -k)[-k], 0.0)
        self.evaluated += sum(map(len, seen))
        best = np.flatnonzero(scores >= max(worst - 1e-11, 1e-12)) if worst > 0 else np.flatnonzero(scores > 0)
        best = best[np.lexsort((self.ids[best], -np.round(scores[best], 12)))][:k]
        return best, np.minimum(scores[best], 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression (pool adjacent violators) as points to interpolate."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of x by weight
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        blocks.append([b, c, a * c])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, v, s = blocks.pop()
            p = blocks[-1]
            p[0] = (p[0] * p[1] + m * v) / (p[1] + v)
            p[1] += v
            p[2] += s
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


@dataclass
class Model:
    """Everything that scoring needs; its size is bounded by the parameters above."""

    vocabulary: Vocabulary
    idf: np.ndarray
    index: BlockMaxIndex | None
    example_ids: np.ndarray
    example_toxic: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]
    no_hit: float
    k: int

    def vector(self, terms: np.ndarray, tf: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector of known terms and the term for all other words."""
        terms = np.append(terms, len(self.vocabulary))
        w = (1 + np.log(np.append(tf, max(words, 1)))) * self.idf[terms]
        return terms, w / np.sqrt(w @ w)

    def vote(self, terms, tf, words, without: int = -1):
        """(share of toxic among the neighbours by weight, neighbours, cosines)."""
        t, w = self.vector(terms, tf, words)
        near, cos = self.index.top(t, w, self.k, without)
        if not len(near):
            return 0.0, near, cos
        by = 1 / (0.01 + (1 - cos))
        return float(by @ self.example_toxic[near] / by.sum()), near, cos

    def score(self, texts: pa.Array):
        """(scores, evidence ids, evidence cosines) of texts."""
        n = len(texts)
        scores, ids, near_cos = np.full(n, self.no_hit), [[] for _ in range(n)], [[] for _ in range(n)]
        if self.index is None:
            return scores, ids, near_cos
        doc, term, tf, words = self.vocabulary.counts(texts)
        if not len(doc):
            return scores, ids, near_cos
        cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=True):
            d = int(doc[a])
            share, near, cos = self.vote(term[a:b], tf[a:b], int(words[d]))
            scores[d] = np.interp(share, *self.curve)
            ids[d], near_cos[d] = self.example_ids[near[:EVIDENCE]].tolist(), cos[:EVIDENCE].tolist()
        return np.clip(scores, 0.0, 1.0), ids, near_cos


def held_out(ident: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def likelihood_ratio(a, b, p, n) -> np.ndarray:
    """Two-sided log-likelihood ratio of a term in a of p toxic and b of n other documents."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    total = p + n

    def part(seen, expected):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen / expected), 0.0)

    have, lack = a + b, total - a - b
    return 2 * (
        part(a, have * p / total) + part(b, have * n / total)
        + part(p - a, np.maximum(lack, 1e-12) * p / total) + part(n - b, np.maximum(lack, 1e-12) * n / total)
    )


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> one row per (toxic, distinct term) and document, pre-counted."""
    for whole in batches:
        for batch in K.steps(whole, 1):
            data, offsets = K.bytes_of(batch.column(1))
            hashes, owner, _ = text_terms(data, offsets)
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for label in (0, 1):
                mine = toxic[owner] == label
                order = np.lexsort((owner[mine], hashes[mine]))
                h, o = hashes[mine][order], owner[mine][order]
                if not len(h):
                    continue
                fresh = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))
                term, count = np.unique(h[fresh], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(term.view(np.int64)), pa.array(np.full(len(term), label, np.int32)), pa.array(count.astype(np.int64))],
                    names=["term", "toxic", "n"],
                )


def _frequencies(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for whole in batches:
            for batch in K.steps(whole, 0):
                _, term, _, _ = vocabulary.counts(batch.column(0))
                total += np.bincount(term, minlength=len(total))
                total[-1] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    return run


def _vectors(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.steps(whole, 2):
                doc, term, tf, words = vocabulary.counts(batch.column(2))
                cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(3),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(term, pa.int64())),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(tf, pa.int64())),
                     pa.array(words, pa.int64())],
                    names=["doc_id", "toxic", "rank", "terms", "tfs", "words"],
                )

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_per_class: int = SAMPLE_PER_CLASS,
    examples_per_class: int = EXAMPLES_PER_CLASS,
    k: int = NEIGHBOURS,
) -> Model:
    """Learn from labelled documents outside the held-out fold.

    The sample is drawn by a hash of the id and is bounded by ``sample_per_class``; of it,
    the first ``examples_per_class`` of each class by the same hash are neighbours. What
    comes to the driver (sample ids, chosen terms, the sample's counts of these terms) is
    bounded by the parameters. Document frequencies come from all documents. Rows without
    a label are left out; a document with several labels counts as toxic if one says so.
    """
    train = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    empty = Model(Vocabulary(np.zeros(0, _U)), np.zeros(1), None, np.zeros(0), np.zeros(0), (np.zeros(1), np.zeros(1)), 0.0, k)
    if len(sizes) < 2:
        empty.no_hit = float(sizes.get(1, 0) > 0)
        return empty
    rank = F.xxhash64(F.lit("toxicity"), "_id")
    drawn = train.where("toxic = 1").orderBy(rank).limit(sample_per_class).unionByName(
        train.where("toxic = 0").orderBy(rank).limit(sample_per_class)
    )
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the sample's size is bounded by 2 * sample_per_class rows
    sample = written(
        base.join(F.broadcast(drawn), base["doc_id"] == drawn["_id"]).select("doc_id", "toxic", "text", rank.alias("rank")),
        "toxic-sample",
    )
    counted = (
        sample.select("toxic", "text")
        .mapInArrow(_sample_terms, "term long, toxic int, n long")
        .groupBy("term")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
             F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
        .where("a + b >= 5")
    )
    found = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, n = found.get(1, 0), found.get(0, 0)
    if not p or not n:
        empty.no_hit = float(p > 0)
        return empty

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = likelihood_ratio(b.column(1).to_numpy(), b.column(2).to_numpy(), p, n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(r)], names=["term", "r"])

    chosen = (
        counted.mapInArrow(ratio, "term long, r double").where(F.col("r") >= MIN_RATIO)
        .orderBy(F.desc("r"), "term").limit(MAX_TERMS).collect()
    )
    vocabulary = Vocabulary(np.array([r["term"] for r in chosen], np.int64).view(_U))
    size = len(vocabulary)
    counts = np.zeros(size + 1)
    for r in base.select("text").mapInArrow(_frequencies(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r["term"]] = r["n"]
    total = counts[size]
    counts[size] = total
    idf = np.log((1 + total) / (1 + counts)) + 1
    rows = sample.mapInArrow(_vectors(vocabulary), "doc_id long, toxic int, rank long, terms array<long>, tfs array<long>, words long").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    ids, toxic = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy()
    terms = [np.array(x, np.int64) for x in rows.column("terms").to_pylist()]
    tfs = [np.array(x, float) for x in rows.column("tfs").to_pylist()]
    words = rows.column("words").to_numpy()
    model = Model(vocabulary, idf, None, np.zeros(0, np.int64), np.zeros(0), (np.zeros(1), np.zeros(1)), 0.0, k)
    hit = np.array([len(t) > 0 for t in terms])
    weight = np.where(toxic == 1, sizes[1] / p, sizes[0] / n)
    bare = weight[~hit]
    model.no_hit = float((bare * toxic[~hit]).sum() / bare.sum()) if bare.sum() else float((weight * toxic).sum() / weight.sum())
    if not hit.any():
        return model
    # the hash that draws the sample draws the examples too: the order of ids may follow their kinds
    drawn_order = np.argsort(rows.column("rank").to_numpy(), kind="stable")
    chosen_rows = np.concatenate(
        [drawn_order[(hit & (toxic == y))[drawn_order]][:examples_per_class] for y in (1, 0)]
    )
    # neighbours in the index resemble each other: blocks are sorted by their strongest term
    vectors = [model.vector(terms[i], tfs[i], int(words[i])) for i in chosen_rows]
    strongest = np.array([t[np.argmax(w)] for t, w in vectors])
    order = np.lexsort((ids[chosen_rows], strongest))
    chosen_rows = chosen_rows[order]
    model.index = BlockMaxIndex([vectors[i] for i in order], size + 1, ids=ids[chosen_rows])
    model.example_ids, model.example_toxic = ids[chosen_rows], toxic[chosen_rows].astype(float)
    place = {int(r): i for i, r in enumerate(chosen_rows)}
    at = np.flatnonzero(hit)
    votes = np.array([model.vote(terms[i], tfs[i], int(words[i]), place.get(int(i), -1))[0] for i in at])
    model.curve = isotonic(votes, toxic[at].astype(float), weight[at])
    return model


def scorer(docs: DataFrame, model: Model):
    """text column -> struct(score, evidence_ids, evidence_cos)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see Model
    kind = T.StructType([
        T.StructField("score", T.DoubleType()),
        T.StructField("evidence_ids", T.ArrayType(T.LongType())),
        T.StructField("evidence_cos", T.ArrayType(T.DoubleType())),
    ])

    @F.arrow_udf(kind)
    def score(texts: pa.Array) -> pa.Array:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        scores, ids, cos = [], [], []
        for step in K.steps(pa.RecordBatch.from_arrays([texts], names=["t"]), 0):
            s, i, c = shared.value.score(step.column(0))
            scores.append(s)
            ids += i
            cos += c
        flat = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays(
            [pa.array(flat), pa.array(ids, pa.list_(pa.int64())), pa.array(cos, pa.list_(pa.float64()))],
            names=["score", "evidence_ids", "evidence_cos"],
        )

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, held_out, score, predicted, evidence_ids, evidence_cos), one row per input row.

    Null and empty texts, like all without a known term, get the share of toxic documents
    among such training documents. Of neighbours at one distance those with the smaller ids
    vote. Without labels of both classes every score is that of
    the only class (0 without labels). Rows that repeat an id are scored each. A null id
    is not held out. An empty table gives an empty result. Only the text enters a score.
    """
    scored = scorer(docs, fit(docs, labels, id_col, text_col, **how))(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).cast("long").alias(id_col), held_out(F.col(id_col)).alias("held_out"), scored.alias("_s")).select(
        id_col, "held_out", "_s.score", (F.col("_s.score") >= 0.5).cast("int").alias("predicted"),
        "_s.evidence_ids", "_s.evidence_cos",
    )


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The input's rows with a score under 0.5, all columns as they were."""
    scored = scorer(docs, fit(docs, labels, id_col, text_col, **how))(F.col(text_col).cast("string"))
    return docs.where(scored["score"] < 0.5)
