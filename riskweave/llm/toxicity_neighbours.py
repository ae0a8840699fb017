"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words (punctuation off, A-Z lower-cased) and the first five bytes of longer ones. The
index keeps those that the examples' labels depend on. A document's neighbours are found block of
examples by block, in the order of what a block can reach at most, until no other block can reach
the last neighbour. Neighbours vote with their similarity, next to a prior vote whose weight is
chosen by leaving each example out, so that scores are calibrated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import free_name, partitions, stored
from riskweave.llm.pieces import BLANK, Words, identities, mix, other_fields, runs, symbols

#: At most about this many labelled documents are examples.
EXAMPLES = 8_000
NEIGHBOURS, EVIDENCE = 20, 5
BLOCK = 64
PREFIX = 5
#: A term is kept if it is in so many examples, and its rate differs by label by so many standard
#: errors.
LEAST_EXAMPLES, LEAST_Z = 5, 5.0
PRIOR_WEIGHTS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0)
SPLIT = BLANK.copy()
SPLIT[list(b".,;:!?()[]\"'")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def terms(body: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each term occurrence."""
    raw = LOWER[np.frombuffer(body, np.uint8)]
    words = Words(raw, ends, SPLIT)
    doc = np.repeat(np.arange(len(ends)), words.counts)
    long = np.flatnonzero(words.ends - words.starts > PREFIX)
    prefix = symbols(identities(raw, words.starts[long], words.starts[long] + PREFIX))
    return np.concatenate([doc, doc[long]]), np.concatenate([words.hashes, mix(prefix ^ np.uint64(1))])


class Index:
    """Examples as unit vectors of TF-IDF weights, by term, with the most that a block holds.

    ``doc``, ``term`` and ``count`` say how often each example has each term (by number).
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray, label: np.ndarray, idf: np.ndarray):
        self.idf, self.label, self.n = idf, label, len(label)
        weight = (1 + np.log(count)) * idf[term]
        norm = np.sqrt(np.bincount(doc, weight**2, self.n))
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order], (weight / norm[doc])[order]
        blocks = max(1, -(-self.n // BLOCK))
        cell = term[order] * blocks + self.doc // BLOCK
        self.most = np.zeros(len(idf) * blocks)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(-1, blocks)
        self.begin = np.searchsorted(cell, np.arange(len(idf) * blocks + 1))
        self.blocks = blocks

    def vector(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        weight = (1 + np.log(count)) * self.idf[term]
        return weight / np.sqrt((weight**2).sum())

    def nearest(
        self, term: np.ndarray, count: np.ndarray, k: int, without: int | tuple[int, ...] = ()
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` most similar examples (those with a term in common), ties to the smaller number.

        ``without`` is an example that does not count, or several.
        """
        own = self.vector(term, count)
        limit = own @ self.most[term]
        order = np.argsort(-limit, kind="stable")
        order = order[limit[order] > 0]
        best, similar = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 4
        while at < len(order) and (len(best) < k or limit[order[at]] >= similar[-1] - 1e-12):
            chosen = order[at : at + step]
            cell = (term[:, None] * self.blocks + chosen).ravel()
            first, size = self.begin[cell], self.begin[cell + 1] - self.begin[cell]
            shift = np.cumsum(size) - size
            post = np.repeat(first - shift, size) + np.arange(int(size.sum()))
            value = self.weight[post] * np.repeat(np.repeat(own, len(chosen)), size)
            found, which = np.unique(self.doc[post], return_inverse=True)
            score = np.bincount(which, value, len(found))
            for one in np.atleast_1d(without):
                score, found = score[found != one], found[found != one]
            best, similar = np.concatenate([best, found]), np.concatenate([similar, score])
            keep = np.lexsort((best, -np.round(similar, 12)))[:k]
            best, similar = best[keep], similar[keep]
            at, step = at + step, 2 * step
        return best, similar


def _votes(index: Index, best: np.ndarray, similar: np.ndarray) -> tuple[float, float]:
    return float(similar @ index.label[best]), float(similar.sum())


def _prior_weight(index: Index, offsets: np.ndarray, term: np.ndarray, count: np.ndarray, prior: float) -> float:
    """The prior vote's weight with the least log loss over the examples, each left out."""
    votes = np.zeros((index.n, 2))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b > a:
            votes[i] = _votes(index, *index.nearest(term[a:b], count[a:b], NEIGHBOURS, (i,)))
    loss = [0.0] if not index.n else []
    for weight in PRIOR_WEIGHTS if index.n else ():
        p = np.clip((votes[:, 0] + weight * prior) / (votes[:, 1] + weight), 1e-6, 1 - 1e-6)
        loss.append(-np.mean(np.where(index.label == 1, np.log(p), np.log(1 - p))))
    return PRIOR_WEIGHTS[int(np.argmin(loss))]


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _label_terms(sample: DataFrame) -> np.ndarray:
    """The terms that the labels of the sample (``text``, ``label``) depend on, as sorted hashes.

    Equal texts are evidence once (toxic if one is), so that copies do not make a term.
    """
    sample = sample.groupBy("text").agg(F.max("label").alias("label"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, body, ends in runs(batch.column(0)):
                doc, term = terms(body, ends)
                pairs = np.unique(np.stack([term, doc.astype(np.uint64)]), axis=1)
                found, which = np.unique(pairs[0], return_inverse=True)
                yes = np.bincount(which, label[lo:hi][pairs[1].astype(np.int64)], len(found))
                columns = found.view(np.int64), yes.astype(np.int64), np.bincount(which, minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["term", "yes", "n"])

    total, yes = sample.agg(F.count("*"), F.sum("label")).first()
    if not total or not yes or yes == total:
        return np.zeros(0, np.uint64)
    rate, no = F.col("n") / total, total - yes
    error = F.sqrt(rate * (1 - rate) * (1 / yes + 1 / no))
    z = F.abs(F.col("yes") / yes - (F.col("n") - F.col("yes")) / no) / error
    counted = sample.select("text", "label").mapInArrow(each, "term long, yes long, n long")
    counted = counted.groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n"))
    # At most a share of the terms of the bounded sample.
    kept = counted.where((F.col("n") >= LEAST_EXAMPLES) & (F.col("n") < total)).where(z > LEAST_Z).select("term")
    return np.sort(kept.toArrow().column("term").to_numpy().view(np.uint64))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", examples: int = EXAMPLES
) -> DataFrame:
    """Scores every whole text; learns only from labelled documents that are not held out.

    Returns the other columns and (underscores before a name that is taken) ``held_out``, ``score``
    (0 to 1), ``predicted`` (1 from 0.5) and ``evidence`` (up to five neighbours: key, similarity,
    label). Examples are at most about ``examples`` labelled documents, chosen by hash; document
    frequencies are counted over all documents. A document is no neighbour of its own: its label
    votes on others only. Terms are kept that at least ``LEAST_EXAMPLES`` different texts of the
    examples have and whose rates differ by label by ``LEAST_Z`` standard errors, so a term of fewer
    examples is never learned. A text without kept terms (empty, null) scores the
    examples' share of toxic ones; without any labelled document all score 0. Null labels are
    ignored, several for a key count as toxic if one is. Repeated rows score alike.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).cast("long").alias("k")).agg(F.max(F.col(label).cast("int")).alias("label"))
    n = known.count()
    place = F.pmod(F.xxhash64("k"), F.lit(1_000_000))
    chosen = known.where(place < 1_000_000 * min(1.0, examples / max(1, n)))
    own_label, own_terms, own_counts = (free_name(x, docs.columns) for x in ("label_", "terms_", "counts_"))
    chosen = chosen.withColumnRenamed("label", own_label).withColumnRenamed("k", "example_key_")
    # The bounded sample: about ``examples`` rows of two numbers.
    marked = docs.join(F.broadcast(chosen), F.col(key).cast("long") == F.col("example_key_"), "left").drop("example_key_")
    sample = marked.where(F.col(own_label).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(own_label).alias("label"))
    vocabulary = _label_terms(stored(sample, "examples"))

    others = other_fields(docs, text)
    at = docs.columns.index(text)
    kept = T.StructType(
        [
            *others,
            T.StructField(own_label, T.IntegerType()),
            T.StructField(own_terms, T.ArrayType(T.LongType())),
            T.StructField(own_counts, T.ArrayType(T.LongType())),
        ]
    )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, body, ends in runs(batch.column(at).cast(pa.string())):
                doc, term = terms(body, ends)
                number = np.minimum(np.searchsorted(vocabulary, term), max(0, len(vocabulary) - 1))
                hit = vocabulary[number] == term if len(vocabulary) else np.zeros(len(term), bool)
                pair, count = np.unique(doc[hit] * max(1, len(vocabulary)) + number[hit], return_counts=True)
                owner, number = np.divmod(pair, max(1, len(vocabulary)))
                offsets = pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32))
                own = batch.slice(lo, hi - lo)
                columns = [c for i, c in enumerate(own.columns) if i != at]
                columns += [
                    pa.ListArray.from_arrays(offsets, pa.array(number.astype(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=kept.fieldNames())

    order = [*docs.columns, own_label]
    matched = stored(marked.select(order).mapInArrow(match, kept), "terms")
    size = matched.count()
    frequency = np.zeros(len(vocabulary))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            counted += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(vocabulary))
        found = np.flatnonzero(counted)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counted[found])], names=["t", "n"])

    counted = matched.select(own_terms).mapInArrow(tally, "t long, n long")
    rows = counted.groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row a kept term
    frequency[rows.column("t").to_numpy()] = rows.column("n").to_numpy()
    idf = np.log((size + 1) / (frequency + 1)) + 1
    held = matched.where(F.col(own_label).isNotNull()).select(F.col(key).cast("long").alias("k"), own_label, own_terms, own_counts)
    held = held.orderBy("k", own_terms, own_counts).toArrow().combine_chunks()  # the bounded examples
    lists = held.column(2).combine_chunks()
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    term, count = lists.flatten().to_numpy(), held.column(3).combine_chunks().flatten().to_numpy()
    owner = np.repeat(np.arange(held.num_rows), np.diff(offsets))
    index = Index(owner, term, count, held.column(1).to_numpy().astype(np.int64), idf)
    keys = held.column(0).to_pylist()
    examples_of: dict[int, tuple[int, ...]] = {}
    for j, own in enumerate(keys):
        examples_of[own] = (*examples_of.get(own, ()), j)
    # A key that is no whole number has no label, so it is no example either.
    own_key = F.expr(f"try_cast(`{key}` AS BIGINT)")
    prior = float(index.label.mean()) if index.n else 0.0
    weight = _prior_weight(index, offsets, term, count, prior)

    names = [f.name for f in others]
    added = [
        T.StructField(free_name("score", names), T.DoubleType()),
        T.StructField(
            free_name("evidence", names),
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("key", T.LongType()),
                        T.StructField("similarity", T.DoubleType()),
                        T.StructField("label", T.IntegerType()),
                    ]
                )
            ),
        ),
    ]
    schema = T.StructType([*others, *added])
    evidence_type = pa.list_(pa.struct([("key", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, counts = batch.column(len(others) + 1), batch.column(len(others) + 2)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            term, count = lists.flatten().to_numpy(), counts.flatten().to_numpy()
            score, evidence = np.full(batch.num_rows, prior), []
            own = batch.column(len(others) + 3).to_pylist()
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                shown = []
                if b > a and index.n:
                    best, similar = index.nearest(term[a:b], count[a:b], NEIGHBOURS, examples_of.get(own[i], ()))
                    yes, total = _votes(index, best, similar)
                    score[i] = (yes + weight * prior) / (total + weight)
                    for j, s in zip(best[:EVIDENCE], similar, strict=False):
                        shown.append({"key": keys[j], "similarity": float(s), "label": int(index.label[j])})
                evidence.append(shown)
            columns = [*batch.columns[: len(others)], pa.array(np.clip(score, 0, 1)), pa.array(evidence, evidence_type)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    # Few bytes a document, but a search each: dealt anew, so that all tasks share the work.
    scored = matched.withColumn(free_name("own_key_", matched.columns), own_key)
    scored = scored.repartition(partitions(docs.sparkSession)).mapInArrow(vote, schema)
    out = free_name("held_out", names), free_name("predicted", names)
    return scored.withColumn(out[0], held_out(key)).withColumn(out[1], (F.col(added[0].name) >= 0.5).cast("int"))
