"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. The probability of a word is the
sum over all its segmentations into pieces, computed by the forward algorithm; that of a text is
the product over its words, as no piece crosses a word's end. The pieces are byte strings that
include every single byte, so every word has a segmentation. Probabilities are fitted by
expectation-maximisation on word counts of a bounded, labelled sample.

A word here is a run of letters (ASCII letters and all bytes of other characters), lower-cased
and led by a space, as the vocabulary has it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenlens.llm.tokens import tokenizer_path
from sirenlens.llm.words import hash_spans, mix, pieces, raw, spans

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Labelled rows (about) from which word counts are taken, and words kept for each language.
SAMPLE_ROWS = 5_000
WORDS = 30_000
ROUNDS = 3
#: Longest piece in bytes; longer ones are left out of the vocabulary.
LONGEST = 12
#: Words that are scored at once.
AT_ONCE = 50_000
#: A longer word is scored by its first bytes and the rest as further words.
WORD_BYTES = 32
#: Words from which a posterior counts as if independent; more add no certainty.
CERTAIN = 40

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15))
_ANY_LETTER = re.compile(r"[^\W\d_]")
_PREDICTED = "doc_id long, lang_pred string, score double"


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    texts = [(t or "").lower() for t in column.to_pylist()]
    data, starts = raw(pa.array(texts, pa.large_string()))
    return data, starts, texts


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the words; one longer than ``WORD_BYTES`` is cut into several."""
    begin, end = spans(_LETTER[data], starts)
    long = end - begin > WORD_BYTES
    if long.any():
        extra = [np.arange(a, b, WORD_BYTES) for a, b in zip(begin[long], end[long], strict=True)]
        begin = np.sort(np.concatenate([begin[~long], *extra]))
        stops = [np.append(x[1:], b) for x, b in zip(extra, end[long], strict=True)]
        end = np.sort(np.concatenate([end[~long], *stops]))
    return begin, end


class Pieces:
    """The vocabulary as a hash table: piece bytes to piece number."""

    def __init__(self, name: str = VOCABULARY):
        found = set()
        with open(tokenizer_path(name), "rb") as file:
            for line in file:
                piece = base64.b64decode(line.split()[0])
                word = piece[1:] if piece[:1] == b" " else piece
                letters = np.frombuffer(word, np.uint8)
                if 0 < len(piece) <= LONGEST and _LETTER[letters].all() and piece.lower() == piece:
                    found.add(piece)
        found |= {bytes([b]) for b in (32, *range(97, 123), *range(128, 256))}
        self.pieces = sorted(found)
        data = np.frombuffer(b"".join(self.pieces), np.uint8)
        ends = np.cumsum([len(p) for p in self.pieces])
        keys = hash_spans(_VALUES[data], np.concatenate([[0], ends[:-1]]), ends)
        self.bits = np.uint64(64 - 18)
        # hashes in order, with the first of each slot (its top bits)
        order = np.argsort(keys)
        self.keys, self.number = keys[order], order.astype(np.int32)
        self.first = np.searchsorted(self.keys >> self.bits, np.arange((1 << 18) + 1, dtype=np.uint64)).astype(np.int32)
        self.depth = int(np.diff(self.first).max())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        slot = (keys >> self.bits).astype(np.int64)
        at, stop = self.first[slot], self.first[slot + 1]
        out = np.full(len(keys), -1, np.int32)
        for k in range(self.depth):
            here = np.minimum(at + k, len(self.keys) - 1)
            hit = (at + k < stop) & (self.keys[here] == keys)
            out[hit] = self.number[here[hit]]
        return out

    def lattice(self, words: list[np.ndarray] | np.ndarray, lengths: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """For words padded to one width: the piece from place i to place j of each, or -1."""
        count, width = words.shape
        values = _VALUES[words]
        flat = values.ravel()
        base = np.arange(count) * width
        edges = {}
        for j in range(1, width + 1):
            rows = np.flatnonzero(lengths >= j)
            if not len(rows):
                break
            for i in range(max(0, j - LONGEST), j):
                edges[i, j] = (rows, base[rows] + i, base[rows] + j)
        out = {}
        keys = sorted(edges)
        # one hash call: prefix sums are shared
        begin = np.concatenate([edges[k][1] for k in keys])
        end = np.concatenate([edges[k][2] for k in keys])
        number = self.find(hash_spans(flat, begin, end))
        at = 0
        for k in keys:
            rows = edges[k][0]
            out[k] = (rows, number[at : at + len(rows)])
            at += len(rows)
        return out


def _padded(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes behind a leading space."""
    lengths = end - begin
    width = int(lengths.max()) + 1
    out = np.zeros((len(begin), width), np.uint8)
    out[:, 0] = 32
    at = begin[:, None] + np.arange(width - 1)[None, :]
    inside = np.arange(width - 1)[None, :] < lengths[:, None]
    out[:, 1:][inside] = data[at[inside]]
    return out, lengths + 1


def forward(vocabulary: Pieces, prob: np.ndarray, words: np.ndarray, lengths: np.ndarray):
    """Sums over all segmentations of every prefix: ``alpha[word, place, language]``, and the lattice.

    Plain probabilities: a word has at most ``WORD_BYTES`` bytes, far from underflow.
    """
    count, width = words.shape
    lattice = vocabulary.lattice(words, lengths)
    alpha = np.zeros((width + 1, count, prob.shape[1]))
    alpha[0] = 1.0
    for i, j in sorted(lattice, key=lambda e: e[1]):
        rows, number = lattice[i, j]
        known = number >= 0
        rows, number = rows[known], number[known]
        if len(rows):
            alpha[j][rows] += alpha[i][rows] * prob[number]
    return alpha, lattice


def log_words(vocabulary: Pieces, prob: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language; words of like length go together."""
    out = np.empty((len(begin), prob.shape[1]))
    order = np.argsort(end - begin, kind="stable")
    for at in range(0, len(order), AT_ONCE // 4):
        part = order[at : at + AT_ONCE // 4]
        words, lengths = _padded(data, begin[part], end[part])
        alpha, _ = forward(vocabulary, prob, words, lengths)
        out[part] = np.log(alpha[lengths, np.arange(len(part))])
    return out


@dataclass
class Model:
    languages: list[str]
    prob: np.ndarray
    """Probability of each piece (row) in each language (column)."""


def fit(counts: list[tuple[str, str, int]], vocabulary: Pieces) -> Model:
    """Expectation-maximisation on ``(language, word, count)``; every piece keeps a little mass."""
    languages = sorted({language for language, _, _ in counts})
    prob = np.full((len(vocabulary.pieces), len(languages)), 1.0 / len(vocabulary.pieces))
    for k, language in enumerate(languages):
        mine = sorted((w, n) for name, w, n in counts if name == language)
        data = np.frombuffer("".join(w for w, _ in mine).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w, _ in mine])
        begins = np.concatenate([[0], ends[:-1]])
        weight = np.array([n for _, n in mine], np.float64)
        order = np.argsort(ends - begins, kind="stable")
        for _ in range(ROUNDS):
            own = prob[:, k : k + 1]
            expected = np.zeros(len(vocabulary.pieces))
            for at in range(0, len(order), AT_ONCE // 4):
                part = order[at : at + AT_ONCE // 4]
                words, lengths = _padded(data, begins[part], ends[part])
                alpha, lattice = forward(vocabulary, own, words, lengths)
                total = alpha[lengths, np.arange(len(part)), 0]
                beta = np.zeros((words.shape[1] + 1, len(part)))
                beta[lengths, np.arange(len(part))] = 1.0
                for i, j in sorted(lattice, key=lambda e: -e[0]):
                    rows, number = lattice[i, j]
                    rows, number = rows[number >= 0], number[number >= 0]
                    use = own[number, 0] * beta[j][rows]
                    np.add.at(beta[i], rows, use)
                    np.add.at(expected, number, alpha[i][rows, 0] * use * weight[part][rows] / total[rows])
            prob[:, k] = (expected + 0.1) / (expected.sum() + 0.1 * len(expected))
    return Model(languages, prob)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts, _ = _bytes(batch["text"])
        begin, end = word_spans(data, starts)
        row = np.searchsorted(starts, begin, side="right") - 1
        blob = data.tobytes()
        seen: dict[tuple[str, str], int] = {}
        for language, a, b in zip(np.array(batch["lang"].to_pylist(), object)[row], begin, end, strict=True):
            key = (language, blob[a:b].decode(errors="ignore"))
            seen[key] = seen.get(key, 0) + 1
        yield pa.record_batch(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
             pa.array(list(seen.values()), pa.int64())],
            names=["lang", "word", "n"],
        )


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, words: int = WORDS) -> Model | None:
    """A model from ``labelled(text, lang)``; None where no row has both.

    The sample is about ``sample_rows`` rows, those whose hash falls under one fraction for all;
    the driver gets at most ``words`` counts for each language.
    """
    labelled = labelled.where("text is not null and lang is not null").select("text", "lang")
    rows = labelled.agg(F.count("*")).first()[0]
    if not rows:
        return None
    share = F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_003)) / 1_000_003
    sample = labelled.where(share < sample_rows / rows) if rows > sample_rows else labelled
    counts = sample.mapInArrow(_count_words, "lang string, word string, n long")
    counts = counts.where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = counts.groupBy("lang").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("n", "word")), asc=False), 1, words).alias("top")
    )
    got = [(r.lang, x.word, x.n) for r in top.collect() for x in r.top]
    return fit(got, Pieces()) if got else None


def _scores(model: Model, vocabulary: Pieces, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Predicted language and posterior of each text."""
    data, starts, texts = _bytes(column)
    score = np.zeros((len(texts), len(model.languages)))
    for first, last in pieces(starts):
        part = data[starts[first] : starts[last]]
        at = starts[first : last + 1] - starts[first]
        begin, end = word_spans(part, at)
        if not len(begin):
            continue
        keys = hash_spans(_VALUES[part], begin, end)
        _, one, which = np.unique(keys, return_index=True, return_inverse=True)
        logs = log_words(vocabulary, model.prob, part, begin[one], end[one])
        sums = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs[which], axis=0)])
        where = np.searchsorted(begin, at)
        count = np.maximum(np.diff(where), 1)[:, None]
        # beyond some words the evidence is averaged, so that the posterior stays informative
        score[first:last] = (sums[where[1:]] - sums[where[:-1]]) / count * np.minimum(count, CERTAIN)
    best = score.argmax(axis=1)
    share = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
    none = np.array([_ANY_LETTER.search(t) is None for t in texts], bool)
    names = np.array([*model.languages, "und"], object)[np.where(none, len(model.languages), best)]
    return names, np.where(none, 0.0, share)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces()
        for batch in batches:
            names, share = _scores(model, vocabulary, batch["text"])
            yield pa.record_batch(
                [batch["doc_id"], pa.array(list(names), pa.string()), pa.array(share)],
                names=["doc_id", "lang_pred", "score"],
            )

    return run


def known_only(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``least``; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces()
        for batch in batches:
            names, share = _scores(model, vocabulary, batch["text"])
            yield batch.filter(pa.array((names != "und") & (share >= least)))

    return docs.mapInArrow(run, docs.schema) if model is not None else docs.where(F.lit(False))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs(doc_id, text)``, from the text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every text without a
    model. The score is the posterior among the learned languages. Of equal languages the first
    by name is taken. Repeated and null ids are kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.mapInArrow(_predict(model), _PREDICTED)


def held_out() -> F.Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learns from ``text, lang`` outside the held-out fold."""
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

