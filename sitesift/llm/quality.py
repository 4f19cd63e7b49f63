"""Quality rules by weak supervision.

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0).
Expectation-maximisation over the distinct vote patterns (at most 3 to the number of rules, so
their counts are a small table at any input size) estimates how often each
rule votes what on good and on bad texts. The posterior of "good" decides.

Defined cases: a null or empty text has all counts 0 and fails the base rule;
an empty table keeps the starting estimates; repeated rows count as often as they occur.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.shared import let_go, stored

# Characters that the contract counts.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
LEAST_WORDS = 50

#: For rules only: capitals and marks of ASCII.
CAPITALS = string.ascii_uppercase.encode()
MARKS = string.punctuation.encode()

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_distinct", "n_upper", "n_marks")
COUNTS_TYPE = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words inside 3-word windows that occur twice or more, distinct words)."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    n = len(ids)
    if n < 4 or len(known) == n:
        return 0, len(known)
    pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, window, times = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift: n - 2 + shift] |= again
    return int(covered.sum()), len(known)


def count_text(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    repeats, distinct = repeated_words(words)
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeats, len(lines), distinct,
            len(raw) - len(raw.translate(None, CAPITALS)), len(raw) - len(raw.translate(None, MARKS)))


def text_counts(text: Column | str) -> Column:
    """Struct of COUNTS for a text column."""

    @F.arrow_udf(COUNTS_TYPE)
    def counts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            rows = [count_text(t.as_py()) for t in texts]
            columns = np.array(rows, dtype=np.int64).reshape(len(rows), len(COUNTS))
            yield pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(len(COUNTS))], names=list(COUNTS))
        let_go()

    return counts(text)


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``value`` is outside [low, high], good where it is within [sure_low, sure_high]."""

    name: str
    value: str
    low: float
    high: float
    sure_low: float
    sure_high: float

    def vote(self) -> Column:
        x = F.expr(self.value)
        return F.when((x < self.low) | (x > self.high), -1).when(
            x.between(self.sure_low, self.sure_high), 1).otherwise(0)


RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", 0, 0.1, 0, 0.02),
    Rule("lines", "n_dup_lines / greatest(n_lines, 1)", 0, 0.4, 0, 0.1),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", 0, 0.35, 0, 0.1),
    Rule("variety", "n_distinct / greatest(n_words, 1)", 0.2, 1, 0.35, 1),
    Rule("capitals", "n_upper / greatest(word_chars, 1)", 0, 0.3, 0, 0.1),
    Rule("word_length", "word_chars / greatest(n_words, 1)", 2.5, 13, 3.5, 9),
    Rule("marks", "n_marks / greatest(word_chars, 1)", 0, 0.1, 0, 0.06),
)

#: Chances of the votes (bad, abstain, good) to start from: rules rarely blame a good text.
START_GOOD, START_BAD, START_PRIOR = (0.02, 0.08, 0.9), (0.4, 0.1, 0.5), 0.8
#: A rule is a rule only if it blames at most this share of good texts; keeps the classes from changing places.
MOST_BLAME = 0.02
#: The start counts as so many texts beside the data.
START_WEIGHT = 20.0


def posterior(votes: np.ndarray, chances: np.ndarray, prior: float) -> np.ndarray:
    """Chance of "good" per row of ``votes`` (0 bad, 1 abstain, 2 good); ``chances`` is (class, rule, vote)."""
    at = np.arange(votes.shape[1])
    good = np.log(prior) + np.log(chances[1][at, votes]).sum(axis=1)
    bad = np.log1p(-prior) + np.log(chances[0][at, votes]).sum(axis=1)
    return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def estimate(votes: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Vote chances per class and rule, and the share of good texts, by expectation-maximisation."""
    start = np.stack([np.tile(START_BAD, (votes.shape[1], 1)), np.tile(START_GOOD, (votes.shape[1], 1))])
    chances, prior = start, START_PRIOR
    for _ in range(rounds):
        good = posterior(votes, chances, prior)
        share = np.stack([weight * (1 - good), weight * good])
        fresh = np.stack([
            [np.bincount(votes[:, r], weights=share[c], minlength=3) for r in range(votes.shape[1])]
            for c in (0, 1)]) + START_WEIGHT * start
        fresh /= fresh.sum(axis=2, keepdims=True)
        fresh[1, :, 0] = np.minimum(fresh[1, :, 0], MOST_BLAME)
        total = weight.sum() + START_WEIGHT
        prior = float((share[1].sum() + START_WEIGHT * START_PRIOR) / total)
        moved, chances = np.abs(fresh - chances).max(), fresh
        if moved < 1e-9:
            break
    return chances, prior


def votes_column(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.array(*[rule.vote() for rule in rules])


def learn(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[np.ndarray, float]:
    """Estimates from a table that has the columns of COUNTS. Texts that fail the base rule take no part."""
    rows = counted.where(~base_failed()).groupBy(votes_column(rules).alias("votes")).count().collect()
    votes = np.array([r.votes for r in rows], dtype=np.int64).reshape(len(rows), len(rules)) + 1
    return estimate(votes, np.array([r["count"] for r in rows], dtype=float))


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words")


def good_chance(model: tuple[np.ndarray, float], rules: tuple[Rule, ...] = RULES) -> Column:
    """Posterior of "good" as an expression over the columns of COUNTS."""
    chances, prior = model
    total = F.lit(float(np.log(prior) - np.log1p(-prior)))
    for i, rule in enumerate(rules):
        weights = [float(x) for x in np.log(chances[1][i]) - np.log(chances[0][i])]
        total = total + F.get(F.array(*[F.lit(w) for w in weights]), rule.vote() + 1)
    return 1 / (1 + F.exp(-total))


def with_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` plus the columns of COUNTS, packed in a struct ``counts``."""
    return documents.withColumn("counts", text_counts(text))


def judge(documents: DataFrame, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that pass the base rule and whose posterior is ``least`` or more; same columns."""
    counts = stored(with_counts(documents.select(F.col(text).alias("text"))).select("counts.*"))
    verdict = ~base_failed() & (good_chance(learn(counts)) >= least)
    packed = documents.select(F.struct("*").alias("doc"))
    return with_counts(packed, f"doc.{text}").select("doc", "counts.*").where(verdict).select("doc.*")


def quality_digest(documents: DataFrame, least: float = 0.5) -> DataFrame:
    counted = stored(with_counts(documents.select("doc_id", "text")).select("doc_id", "counts.*"))
    chance = good_chance(learn(counted))
    return counted.select(
        "doc_id", *COUNTS[:5], base_failed().alias("base_failed"),
        (~base_failed() & (chance >= least)).alias("kept"), chance.alias("posterior"))
