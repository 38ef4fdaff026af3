"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding undoes the usual disguises: capitals, look-alike letters, digits and signs for letters. Lexicon entries are
words and word beginnings with the log odds that labelled rows give them. A phrase of the exceptions takes back the
entries that it covers: two words of which one matches an entry and that clean labelled rows have while toxic ones don't,
and some fixed ones. A document's score is a logistic curve of its weight and of its weight per word.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table
from .quality import labelled_sample, rated, with_score_columns

#: Labelled rows that a model is fitted on at most, by the hash of their id.
SAMPLE = 20_000
#: Entries of the lexicon at most.
ENTRIES = 4000
#: Exceptions that are learnt at most.
PHRASES = 2000
#: Letters of a word beginning.
STEM = range(4, 9)
LEAST_DOCS = 5
LEAST_ODDS = math.log(20)
#: Letters of other scripts that look like Latin ones, and signs used for letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "к": "k", "м": "m", "т": "t",
    "н": "h", "в": "b", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ո": "n", "α": "a", "β": "b", "γ": "y", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Harmless phrases around words that lexicons tend to have.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "sore loser tree", "idiot proof", "idiot light")

_FOLD = str.maketrans(LOOKALIKES)
#: Signs between letters, or at the edge of a word of two letters at least.
_DISGUISED = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?=[^\W\d_])|[013457@$]+(?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[013457@$]+")
_OTHER = re.compile(r"[\W\d_]+")
_SIGNS = str.maketrans(SUBSTITUTES)
#: Runs of letters and signs with one of each at least.
_MIXED = re.compile(r"(?=[013457@$!]*[^\W\d_])(?=[^\W\d_]*[013457@$!])(?:[^\W\d_]|[013457@$!])+")


def _readings(token: re.Match) -> str:
    """A token as it reads with the signs beside plain letters folded, and as it reads with all of them folded.
    Exclamation marks at the end are none."""
    plain = _DISGUISED.sub(lambda m: m[0].translate(_SIGNS), token[0])
    whole = token[0].rstrip("!").translate(_SIGNS)
    return plain if _OTHER.sub(" ", plain).strip() == whole else f"{plain} {whole} "


def folded(text: str | None) -> str:
    """Words in small Latin letters, each with one space before and after it. A token that still holds signs among its
    letters gives what it reads as without and with them."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _MIXED.sub(_readings, text)
    return f" {_OTHER.sub(' ', text).strip()} "


def candidates(text: str | None) -> set[str]:
    found = set()
    for word in set(folded(text).split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in STEM if len(word) >= n)
    return found


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (1.0, 1.0, -3.0)
    automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "automaton": None}

    def built(self):
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self.automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self.automaton.add_word(folded(phrase), (len(folded(phrase)), None))
            if len(self.automaton):
                self.automaton.make_automaton()
        return self.automaton

    def features(self, text: str | None) -> tuple[float, float]:
        """(weight, weight per square root of words). At a place only the heaviest entry counts; none inside an exception."""
        plain, automaton = folded(text), self.built()
        best: dict[int, float] = {}
        spared: list[list[int]] = []
        for end, (length, weight) in automaton.iter(plain) if len(automaton) else ():
            start = end - length + 1
            if weight is None:
                # ends ascend: what overlaps is one range
                while spared and spared[-1][0] >= start:
                    spared.pop()
                if spared and spared[-1][1] >= start - 1:
                    spared[-1][1] = end
                else:
                    spared.append([start, end])
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if spared:
            firsts = [a for a, _ in spared]
            # the space at the end of a phrase is the one before the next word
            best = {s: w for s, w in best.items() if (i := bisect.bisect_right(firsts, s) - 1) < 0 or s >= spared[i][1]}
        total = sum(best.values())
        return math.log1p(total), total / math.sqrt(plain.count(" ") or 1)

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b * y + c))))


def _few_rows(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Slices whose words a worker holds at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def learnt_weights(sample: DataFrame, entries: int = ENTRIES) -> dict[str, float]:
    """Log odds of the entries that toxic rows of sample (text, label) have much more often."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            entry, label = [], []
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                found = candidates(text.as_py())
                entry += found
                label += [y.as_py()] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(entry, pa.string()), pa.array(label, pa.int32())], names=["entry", "label"])

    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    counts = sample.select("text", "label").mapInArrow(split, "entry string, label int").groupBy("entry").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    strong = counts.where(F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    rows = strong.orderBy(F.desc(F.col("toxic") * F.col("odds")), "entry").limit(entries).collect()
    found = {r.entry: r.odds for r in rows}
    # a longer entry that is hardly purer than a beginning of it says nothing more
    return {e: w for e, w in found.items() if not any(found.get(e[:n], -1) >= w - 0.5 for n in range(3, len(e)))}


def fit_curve(points: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    if not len(labels):
        return 1.0, 1.0, -3.0
    x, w = np.column_stack([points, np.ones(len(points))]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.01 * np.eye(3), x.T @ (labels - p) - 0.01 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1]), float(w[2])


def learnt_exceptions(sample: DataFrame, lexicon: Lexicon, phrases: int = PHRASES) -> tuple[str, ...]:
    """Two words, one of which matches an entry, that LEAST_DOCS clean rows of sample have and no toxic one."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = lexicon.built(), {}
        for batch in _few_rows(batches):
            phrase, label = [], []
            if len(known) > 200_000:
                known.clear()
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                words = folded(text.as_py()).split()
                for w in set(words):
                    if w not in known:
                        known[w] = next(automaton.iter(f" {w} "), None) is not None
                at = [i for i, w in enumerate(words) if known[w]]
                found = {" ".join(words[j : j + 2]) for i in at for j in (i - 1, i) if 0 <= j < len(words) - 1}
                phrase += found
                label += [y.as_py()] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.string()), pa.array(label, pa.int32())], names=["phrase", "label"])

    counts = sample.select("text", "label").mapInArrow(split, "phrase string, label int").groupBy("phrase").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    rows = counts.where((F.col("toxic") == 0) & (F.col("n") >= LEAST_DOCS)).orderBy(F.desc("n"), "phrase").limit(phrases).collect()
    return tuple(r.phrase for r in rows)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon of the labelled sample. Without labelled rows, or with clean ones only, it has no entries. Rows without id or
    label teach nothing. Other columns are not read."""
    sample = cut(labelled_sample(docs, labels, label, limit).select("text", "label"), "sample")
    plain = Lexicon(learnt_weights(sample), ())
    lexicon = Lexicon(plain.weights, (*exceptions, *(learnt_exceptions(sample, plain) if plain.weights else ())))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [lexicon.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in both], pa.float64()), pa.array([b[1] for b in both], pa.float64()), batch.column(1)], names=["x", "y", "label"])

    points = sample.mapInArrow(weigh, "x double, y double, label int").collect()  # limit rows
    drop_table(sample)
    points = sorted((p.x, p.y, p.label) for p in points)
    lexicon.curve = fit_curve(np.array([p[:2] for p in points]).reshape(-1, 2), np.array([p[2] for p in points], dtype=float))
    return lexicon


def _scorer(docs: DataFrame, lexicon: Lexicon):
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # ENTRIES strings, and PHRASES of exceptions, at most
    return lambda: shared.value.score


def with_scores(docs: DataFrame, lexicon: Lexicon, least: float = 0.5) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= least), in the place of columns with these names. Null and empty
    texts match nothing. Rows are scored one by one: ids may be null or repeat."""
    return with_score_columns(docs, _scorer(docs, lexicon), least)


def harmless_ones(docs: DataFrame, lexicon: Lexicon, least: float = 0.5) -> DataFrame:
    """The rows of docs that score below least."""
    found, name = rated(docs, _scorer(docs, lexicon))
    return found.where(F.col(name) < least).select(*docs.columns)
