"""Toxicity scores from a learned lexicon, misspellings included.

Terms that mark toxic training texts form a trie; a term is a whole word or a stem that any ending
may follow. The Levenshtein automata of all terms run through the trie at once: a state is the
set of trie nodes that the letters so far can have reached with so many errors. States are
determined as words need them, so a word costs one step per letter. A hit is weighed by the
words around it: hits between quotation marks or beside words of reporting count apart from
others. A logistic model on these counts gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm import common

#: Words before and after a hit that tell quotation from abuse.
WINDOW = 8

#: Marks that open or close a quotation, and words that report one.
QUOTES = "\"“”„«»‹›‘"
REPORTING = frozenset(
    "said says wrote called calls word words term quote quoted quotes so-called dijo palabra dit mot sagte wort".split()
)

#: Characters stripped from the ends of a word.
EDGES = ".,;:!?\"'()[]{}<>|#*$%&“”„«»‹›‘’…-_/\\~`+=@^"

#: Steps of the automaton, and places in its states, that a worker keeps; with more it begins anew.
STEPS = 100_000

#: Words that a worker remembers; they are forgotten when so many.
CACHED_WORDS = 150_000

#: Words up to this length are remembered.
CACHED_LETTERS = 64

#: Lengths of the beginnings of words that are tried as stems.
STEMS = (4, 5, 6, 7)


def errors_allowed(length: int) -> int:
    """A misspelling may have one error from five letters on, two from nine."""
    return (length >= 5) + (length >= 9)


@dataclass
class Node:
    children: dict[str, "Node"] = field(default_factory=dict)
    word: bool = False
    stem: bool = False
    depth: int = 0
    reach: int = 0  # errors allowed by the longest term below


class Lexicon:
    """A trie of terms and the automaton of their misspellings, determined as needed."""

    def __init__(self, words: list[str], stems: list[str]):
        self.root, self.nodes = Node(), []
        for term, is_stem in [(w, False) for w in words] + [(s, True) for s in stems]:
            node, reach = self.root, errors_allowed(len(term))
            node.reach = max(node.reach, reach)
            for letter in term:
                nxt = node.children.setdefault(letter, Node(depth=node.depth + 1))
                node = nxt
                node.reach = max(node.reach, reach)
            node.word |= not is_stem
            node.stem |= is_stem
        self.steps: dict[tuple[int, str], int] = {}
        self.sets: list[dict[int, tuple[Node, int]]] = []
        self.numbers: dict[frozenset, int] = {}
        self.stem_hits: list[int | None] = []
        self.held = 0
        self.start = self._number({id(self.root): (self.root, 0)})

    def _closed(self, states: dict[int, tuple[Node, int]]) -> dict[int, tuple[Node, int]]:
        """With the nodes reached by leaving out letters of a term."""
        todo = list(states.values())
        while todo:
            node, errors = todo.pop()
            for child in node.children.values():
                if errors < child.reach and errors + 1 < states.get(id(child), (None, 9))[1]:
                    states[id(child)] = (child, errors + 1)
                    todo.append((child, errors + 1))
        return states

    def _number(self, states: dict[int, tuple[Node, int]]) -> int:
        states = self._closed(states)
        name = frozenset((k, e) for k, (_, e) in states.items())
        if name not in self.numbers:
            self.numbers[name] = len(self.sets)
            self.sets.append(states)
            self.held += len(states)
            hits = [e for n, e in states.values() if n.stem and e <= errors_allowed(n.depth)]
            self.stem_hits.append(min(hits, default=None))
        return self.numbers[name]

    def _step(self, number: int, letter: str) -> int:
        out: dict[int, tuple[Node, int]] = {}

        def add(node: Node, errors: int) -> None:
            if errors <= node.reach and errors < out.get(id(node), (None, 9))[1]:
                out[id(node)] = (node, errors)

        for node, errors in self.sets[number].values():
            add(node, errors + 1)
            for name, child in node.children.items():
                add(child, errors + (name != letter))
        return self._number(out)

    def errors(self, word: str) -> int | None:
        """The fewest errors at which the word is a term, or begins with a stem; None if it is none."""
        state, best = self.start, None
        for letter in word:
            nxt = self.steps.get((state, letter))
            if nxt is None:
                nxt = self.steps[state, letter] = self._step(state, letter)
            state = nxt
            hit = self.stem_hits[state]
            if hit is not None and (best is None or hit < best):
                best = hit
            if best == 0 or not self.sets[state]:
                return best
        hits = [e for n, e in self.sets[state].values() if n.word and e <= errors_allowed(n.depth)]
        return min([*hits, *([] if best is None else [best])], default=None)


def plain(word: str) -> str:
    return word.lower().strip(EDGES)


class Finder(dict):
    """What each word of a text is: -1 for nothing, else the errors of its hit."""

    def __init__(self, words: list[str], stems: list[str]):
        super().__init__()
        self.words, self.stems, self.lexicon = words, stems, Lexicon(words, stems)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(self.lexicon.steps) > STEPS or self.lexicon.held > STEPS:
            self.lexicon = Lexicon(self.words, self.stems)
        # A word that leaves all terms behind ends the automaton, so a very long word costs no more than a term.
        found = self.lexicon.errors(plain(word))
        found = -1 if found is None else found
        if len(word) <= CACHED_LETTERS:
            self[word] = found
        return found

    def __reduce__(self):
        return Finder, (self.words, self.stems)


#: What a text is judged by.
FEATURES = ("one", "exact", "misspelled", "quoted_exact", "quoted_misspelled", "dense", "any_exact", "length")


def features(text: str, finder: Finder) -> list[float]:
    """The figures of one text; an empty one has the constant only."""
    words = text.split()
    hits = [(i, e) for i, e in enumerate(map(finder.__getitem__, words)) if e >= 0]
    if not hits:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, math.log1p(len(words))]
    counts = {(exact, quoted): 0 for exact in (True, False) for quoted in (True, False)}
    densest = 0
    for n, (i, e) in enumerate(hits):
        around = words[max(0, i - WINDOW) : i + WINDOW + 1]
        marks = sum(any(q in w for q in QUOTES) for w in around)
        quoted = marks >= 2 or any(plain(w) in REPORTING for w in around)
        counts[e == 0, quoted] += 1
        densest = max(densest, sum(1 for j, _ in hits[n : n + 2 * WINDOW] if j - i <= 2 * WINDOW))
    logs = [math.log1p(counts[k]) for k in ((True, False), (False, False), (True, True), (False, True))]
    plainly = float(counts[True, False] > 0)
    return [1.0, *logs, math.log1p(densest), plainly, math.log1p(len(words))]


@dataclass
class Model:
    finder: Finder
    weights: list[float]

    def score(self, text: str) -> float:
        z = sum(a * b for a, b in zip(self.weights, features(text, self.finder)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic model by Newton's method; the constant is not penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * penalty
    ridge[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


#: A term stands in at least this share of the toxic texts learned from, and in four of them.
MIN_SHARE = 0.01


def _term_counts(wanted: frozenset | None):
    """In how many texts each word and each beginning of a word stands; only those ``wanted``, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for text in common.each_string(batch.column("text")):
                words = {plain(w) for w in text.split()}
                terms = {w for w in words if len(w) >= 3}
                terms.update(w[:n] + "*" for w in words for n in STEMS if len(w) >= n)
                counts.update(terms if wanted is None else terms & wanted)
        columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "n"])

    return run


def _lexicon(sample: DataFrame, toxic: int, other: int) -> tuple[list[str], list[str]]:
    """Terms that mark toxic texts, the strongest first; a stem makes its words and longer stems needless."""

    def counted(rows: DataFrame, wanted: frozenset | None, least: float) -> dict[str, int]:
        # At most 1 / MIN_SHARE times the terms of a text come to the driver.
        terms = rows.mapInArrow(_term_counts(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        return {r["term"]: r["n"] for r in terms.where(F.col("n") >= least).collect()}

    bad = counted(sample.where("label > 0"), None, max(4, MIN_SHARE * toxic))
    good = counted(sample.where("label <= 0"), frozenset(bad), 1)
    ratio = {t: (n + 0.5) / (toxic + 1) / ((good.get(t, 0) + 0.5) / (other + 1)) for t, n in bad.items()}
    strong = [t for t, n in bad.items() if ratio[t] > 8 and n > 2 * good.get(t, 0)]
    strong = sorted(strong, key=lambda t: (-bad[t] * math.log(ratio[t]), t))
    found = {t: bad[t] for t in strong}
    stems: list[str] = []
    for term in sorted((t[:-1] for t in found if t.endswith("*")), key=lambda t: (len(t), t)):
        # A beginning is a stem only if its texts are not all those of one word.
        words = max((n for t, n in found.items() if not t.endswith("*") and t.startswith(term)), default=0)
        if found[term + "*"] > 1.2 * words and not any(term.startswith(x) for x in stems):
            stems.append(term)
    words = [t for t in found if not t.endswith("*") and not any(t.startswith(x) for x in stems)]
    return sorted(words), stems


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = 20_000,
) -> Model:
    """A model of the labelled texts.

    Uses at most ``max_labelled`` labelled rows, chosen evenly by a hash of their id, and every term that they give
    evidence for: one that stands in ``MIN_SHARE`` of the toxic texts, so their number is bounded too. Rows with a null id or label are not used; with no label of either kind
    every text scores one half. Equal ids on both sides all count.
    """
    label = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    label = label.where("id IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("id"), "id", "label").limit(max_labelled)
    label = common.written(label, "labelled")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # At most max_labelled pairs of numbers are broadcast.
    sample = texts.join(F.broadcast(label), "id").select("text", "label").dropDuplicates()  # copies count once
    sample = common.written(sample, "sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy((F.col("label") > 0).alias("toxic")).count().collect()}
    words, stems = _lexicon(sample, sizes.get(True, 0), sizes.get(False, 0))
    finder = Finder(words, stems)
    if len(sizes) < 2:
        return Model(finder, [0.0] * len(FEATURES))

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x, finder) for x in common.each_string(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("label")], names=["x", "label"])

    table = sample.mapInArrow(figures, "x array<double>, label int").toArrow()  # at most max_labelled rows
    x = np.array(table["x"].to_pylist())
    y = (table["label"].to_numpy() > 0).astype(float)
    return Model(finder, logistic(x, y).tolist())


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher for toxic texts.

    A null text counts as empty and gets the score of a text without hits. All rows and columns
    stay; ``score_col`` replaces a column of that name. An empty table gives an empty one.
    """

    @F.arrow_udf(T.DoubleType())
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        common.give_back()
        for column in texts:
            yield pa.array([model.score(x) for x in common.each_string(column)], pa.float64())

    return docs.withColumn(score_col, scored(F.coalesce(F.col(text_col), F.lit(""))))


def in_fold(identifier: Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of an id as text leaves ``fold`` when divided by ``folds``."""
    return F.crc32(F.coalesce(identifier.cast("string"), F.lit("")).cast("binary")) % folds == fold
