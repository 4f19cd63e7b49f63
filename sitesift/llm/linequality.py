"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good (1) or bad (0). Its chance depends on features of the line and of the lines before
and after it, and on the labels beside it. Forward-backward gives each line's chance of "good"; their mean, weighted
by line length, is scaled to the document's score.

Learning: a line takes the label of its document. The fit uses at most SAMPLE labelled documents with at
most LINES lines together, those of the smallest hashes of their ids, so its cost does not grow with
the input; scoring reads every text whole. Ids, languages, sources and labels are never features.

Defined cases: a null or empty text is one empty line and gets a score as any other; labels other than 0 and 1 and rows
without doc_id take no part in learning; a doc_id labelled twice takes its smaller label; repeated documents are
scored each; without labels every score is 0.5; columns beside the named ones are not read. A line of any length is
counted whole; one text is held by one task.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.shared import stored

#: Most labelled documents, and most lines of them, that the fit sees.
SAMPLE = 6_000
LINES = 200_000
ROUNDS = 150
#: Weight of the squared weights beside one document's likelihood.
RIDGE = 1e-3
LEAST_SCORE = 0.7

CAPITALS = string.ascii_uppercase.encode()
SMALL = string.ascii_lowercase.encode()
DIGITS = string.digits.encode()
MARKS = string.punctuation.encode()
STOPS = (b".", b"!", b"?", b":", b";", b'"')
PLAIN = b".,'-"  # marks of prose

NAMES = ("blank", "length", "capitals", "digits", "marks", "odd_marks", "word_length", "variety", "repeats",
         "stopped", "opened", "seen", "same")
WIDTH = len(NAMES)


def share(raw: bytes, some: bytes, size: int) -> float:
    return (size - len(raw.translate(None, some))) / size


def line_values(line: bytes, seen: bool, same: bool) -> tuple[float, ...]:
    """Features of one line: counts of its bytes and words, and whether it equals an earlier line or the one before."""
    size = len(line)
    words = line.split()
    if not words:
        return (1.0, *(0.0,) * (WIDTH - 3), float(seen), float(same))
    n = len(words)
    return (0.0, np.log1p(size), share(line, CAPITALS, size), share(line, DIGITS, size), share(line, MARKS, size),
            share(line.translate(None, PLAIN) + b" ", MARKS, size + 1), min((size - n + 1) / n, 40.0) / 10, len(set(words)) / n,
            sum(map(eq, words, words[1:])) / n, float(words[-1].endswith(STOPS)),
            float(line.lstrip()[:1] in CAPITALS), float(seen), float(same))


def text_values(text: str | None) -> np.ndarray:
    """(lines, WIDTH) features of a whole text."""
    known: set[bytes] = set()
    before, rows = None, []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        rows.append(line_values(line, line in known, line == before))
        known.add(line)
        before = line
    return np.array(rows, dtype=np.float32)


def with_neighbours(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Columns of the line itself, the line before, the line after, marks of both ends, and a constant."""
    ends = np.cumsum(lengths)
    first, last = np.zeros(len(values), bool), np.zeros(len(values), bool)
    first[ends - lengths], last[ends - 1] = True, True
    before, after = np.roll(values, 1, axis=0), np.roll(values, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.column_stack([values, before, after, first, last, np.ones(len(values))]).astype(np.float32)


class Chains:
    """Lines of several texts in the order (place in the text, text), longest text first, so that one step takes a slice."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        self.alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")  # texts longer than t
        self.start = np.concatenate([[0], np.cumsum(self.alive)])
        text = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.at = self.start[place] + rank[text]  # from the given order to this one

    def slices(self) -> list[slice]:
        return [slice(int(a), int(b)) for a, b in zip(self.start, self.start[1:])]

    def forward_backward(self, unary: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of "good" from the lines up to each one, and from the lines after it; in this order."""
        ahead, behind = unary.copy(), np.zeros_like(unary)
        steps = self.slices()
        for prior, here in zip(steps, steps[1:]):
            x = ahead[prior][: here.stop - here.start]
            ahead[here] += np.logaddexp(turns[0, 1], turns[1, 1] + x) - np.logaddexp(turns[0, 0], turns[1, 0] + x)
        for here, after in zip(steps[-2::-1], steps[:0:-1]):
            x = unary[after] + behind[after]
            behind[here.start: here.start + len(x)] = (
                np.logaddexp(turns[1, 0], turns[1, 1] + x) - np.logaddexp(turns[0, 0], turns[0, 1] + x))
        return ahead, behind


def chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


@dataclass(frozen=True)
class LineModel:
    """weights: over with_neighbours; turns: log weight of label a followed by b; slope, level: from log-odds of the mean to the score."""

    weights: np.ndarray
    turns: np.ndarray
    slope: float
    level: float

    def lines(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Chance of "good" of every line."""
        if not len(lengths):
            return np.zeros(0)
        chains = Chains(lengths)
        unary = np.empty(len(values))
        unary[chains.at] = with_neighbours(values, lengths) @ self.weights
        ahead, behind = chains.forward_backward(unary, self.turns)
        return chance(ahead + behind)[chains.at]

    def scores(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return chance(self.slope * mean_odds(self.lines(values, lengths), values, lengths) + self.level)


def mean_odds(good: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log-odds of each text's mean chance, weighted by line length; an empty line weighs as one byte."""
    if not len(lengths):
        return np.zeros(0)
    weight = np.maximum(np.expm1(values[:, NAMES.index("length")].astype(float)), 1.0)
    starts = np.cumsum(lengths) - lengths
    mean = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
    mean = np.clip(mean, 1e-9, 1 - 1e-9)
    return np.log(mean) - np.log1p(-mean)


def gradient(model: tuple[np.ndarray, np.ndarray], x: np.ndarray, chains: Chains, label: np.ndarray, share: np.ndarray):
    """Gradient of the mean log-likelihood by weights and turns; all rows in the order of ``chains``.

    ``label`` and ``share`` (the weight of its text) are given for each line.
    """
    weights, turns = model
    unary = x @ weights
    ahead, behind = chains.forward_backward(unary, turns)
    by_weight = x.T @ (share * (label - chance(ahead + behind)))
    by_turn = np.zeros((2, 2))
    steps = chains.slices()
    if len(steps) > 1:
        after = np.concatenate([np.arange(s.start, s.stop) for s in steps[1:]])
        before = np.concatenate([p.start + np.arange(s.stop - s.start) for p, s in zip(steps, steps[1:])])
        left, right = ahead[before], unary[after] + behind[after]
        logs = np.stack([turns[a, b] + a * left + b * right for a in (0, 1) for b in (0, 1)])
        odds = np.exp(logs - logs.max(axis=0))
        odds /= odds.sum(axis=0)
        seen = np.bincount((3 * label[after]).astype(int), weights=share[after], minlength=4)
        by_turn = (seen - odds @ share[after]).reshape(2, 2)
    return by_weight, by_turn


def learn(values: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> LineModel:
    """Weights by gradient ascent with adaptive steps, then slope and level of the score by logistic regression."""
    turns = np.zeros((2, 2))
    raw = with_neighbours(values, lengths)
    spread = np.maximum(raw.std(axis=0), 1e-3) if len(raw) else np.ones(3 * WIDTH + 3)
    spread[-1] = 1
    if not len(lengths):
        return LineModel(np.zeros(len(spread)), turns, 0.0, 0.0)
    chains = Chains(lengths)
    x = np.empty_like(raw)
    x[chains.at] = raw / spread.astype(np.float32)
    line_label, share = np.empty(len(x)), np.empty(len(x))
    line_label[chains.at] = np.repeat(labels, lengths)
    share[chains.at] = np.repeat(1 / np.sqrt(lengths), lengths) / len(lengths)
    point = np.zeros(x.shape[1] + 4)
    drift, size = np.zeros_like(point), np.zeros_like(point)
    for i in range(1, rounds + 1):
        by_weight, by_turn = gradient((point[:-4], point[-4:].reshape(2, 2)), x, chains, line_label, share)
        slope = np.concatenate([by_weight, by_turn.ravel()]) - RIDGE * point
        drift, size = 0.9 * drift + 0.1 * slope, 0.99 * size + 0.01 * slope**2
        rate = 0.1 * min(1.0, 2 * (1 - i / (rounds + 1)))
        point += rate * (drift / (1 - 0.9**i)) / (np.sqrt(size / (1 - 0.99**i)) + 1e-8)
    plain = LineModel(point[:-4] / spread, point[-4:].reshape(2, 2), 1.0, 0.0)
    odds = mean_odds(plain.lines(values, lengths), values, lengths)
    return LineModel(plain.weights, plain.turns, *scaled(odds, labels))


def scaled(odds: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and level of a logistic regression of the labels on ``odds``, by Newton steps with a small ridge."""
    x = np.column_stack([odds, np.ones(len(odds))])
    at = np.array([1.0, 0.0])
    for _ in range(30):
        p = chance(x @ at)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (labels - p) - 0.1 * (at - [1.0, 0.0]))
        at = at + np.clip(step, -1, 1)
    return max(float(at[0]), 0.0), float(at[1])


def packed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines of all texts, and the number of lines of each."""
    each = [text_values(t) for t in texts]
    return (np.concatenate(each) if each else np.zeros((0, WIDTH), np.float32)), np.array([len(v) for v in each], np.int64)


def remainder(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")), "UTF-8")) % 4


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> LineModel:
    """Model from the labelled documents whose ``remainder`` is not 2, at most ``sample`` with at most ``lines`` lines."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(remainder("doc_id") != 2)
    order = F.xxhash64("doc_id")
    chosen = (known.groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
              .withColumn("h", order).orderBy("h", "doc_id").limit(sample))
    features = pa.list_(pa.float32())

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths = packed(batch.column(0).to_pylist())
            ends = np.concatenate([[0], np.cumsum(lengths)]) * WIDTH
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(lengths), lists.cast(features)], names=["h", "label", "n", "values"])

    near = (documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "h", "label"))  # at most ``sample`` ids
    rows = stored(near.mapInArrow(featured, "h bigint, label double, n bigint, values array<float>"))
    sizes = rows.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") <= lines).orderBy("h").limit(sample).collect()
    total = np.cumsum([r.n for r in sizes])
    fits = int(np.searchsorted(total, lines, "right"))
    if not fits:
        return learn(np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64), np.zeros(0))
    found = rows.where(F.col("h").isin([r.h for r in sizes[:fits]])).orderBy("h", "n", "values").toArrow()
    values = found.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    return learn(values.astype(np.float32), found.column("n").to_numpy(), found.column("label").to_numpy())


def score(text: Column | str, model: LineModel) -> Column:
    """The document's score, 0 to 1."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(*packed(texts.to_pylist())))

    return scored(text)


def line_chances(text: Column | str, model: LineModel) -> Column:
    """Chance of "good" for every line of the text, in order."""

    @F.arrow_udf("array<double>")
    def chances(texts: pa.Array) -> pa.Array:
        values, lengths = packed(texts.to_pylist())
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(model.lines(values, lengths)))

    return chances(text)


def label_lines(documents: DataFrame, model: LineModel, text: str = "text") -> DataFrame:
    """(columns of documents, packed in ``doc``; line, good, label): one row a line, lines from 0."""
    chances = documents.select(F.struct("*").alias("doc"), line_chances(F.col(text), model).alias("chances"))
    return chances.select("doc", F.posexplode("chances").alias("line", "good")).withColumn("label", (F.col("good") >= 0.5).cast("int"))


def quality_scores(documents: DataFrame, labels: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, with a model fitted on the labels that are not held out."""
    found = score("text", fit(documents, labels))
    return documents.select("doc_id", (remainder("doc_id") == 2).alias("held_out"), found.alias("score")).withColumn(
        "predicted", (F.col("score") >= least).cast("int"))
