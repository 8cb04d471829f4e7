"""Toxicity scores from a learned lexicon, misspellings included.

Terms that mark toxic documents are learned from labelled rows: whole words, and word
beginnings for languages that build words from stems. They lie in a trie. A word is
looked up as it is and as one that begins with a stem; a word that is not there is
intersected, as a Levenshtein automaton, with the trie's words, those of stems too, and so is
what has digits or marks in letters' places. Each hit counts
by its context window: in quotation or after a word of report it counts less, since it
is mentioned rather than used. A logistic model over the hits' sums gives the score.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from fleetlens.llm import common
from fleetlens.session import materialize

#: Labelled rows that a model is fitted on at most (the rows of the smallest hashes).
SAMPLE_ROWS = 20_000
#: Terms of the lexicon at most, the strongest first.
MAX_TERMS = 4_000
STEM_CHARS, MAX_STEM_CHARS, FUZZY_CHARS = 4, 9, 5
THRESHOLD = 0.7

LETTERS = re.compile(r"[^\W\d_]+")
# Marks of quotation, and words that report what others say.
QUOTES = frozenset("\"“”„«»‹›")
REPORTS = frozenset("said says say quote quoted quotes called calls wrote writes term word sagte schrieb dit dijo".split())
#: What stands around words and is no part of one.
PUNCTUATION = ".,:;!?()[]{}<>'’‘…-_/\\" + "".join(sorted(QUOTES))
TRAILING = re.compile(r"(?<=\w)[\W_]+\Z")
#: Letters that a word with digits or marks for letters must show of a term.
SHOWN_CHARS = 3
#: Words looked at on either side of a hit, and what a mentioned hit counts.
WINDOW, MENTION = 4, 0.3
#: What a misspelled term counts of the term itself.
NEAR = 0.8
#: A term must be so many times as usual in toxic documents, and a stem of which one word makes up this share is that word.
RATIO, ONE_WORD = 8, 0.6
FEATURES = 4


def left_out(word: str) -> list[str]:
    """The word without one of its letters, for each of them."""
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


class Trie:
    """Terms by their letters: a stem's weight at its node, a word's under ``""``, an inflected word's under ``"near"``.

    Inflected words are those that a stem stands for: only their misspellings are looked for.
    """

    def __init__(self, stems: dict[str, float], words: dict[str, float], inflected: dict[str, float] | None = None):
        self.root: dict = {}
        inflected = inflected or {}
        for terms, mark in ((stems, "stem"), (words, ""), (inflected, "near")):
            for term, weight in terms.items():
                node = self.root
                for letter in term:
                    node = node.setdefault(letter, {})
                node[mark] = weight
        # Two words one edit apart are equal, or one is the other, after leaving out a letter of each.
        fuzzy = [w for w in (*words, *inflected) if len(w) >= FUZZY_CHARS]
        self.shorter = {s for w in fuzzy for s in (w, *left_out(w))}
        self.longest = max(map(len, fuzzy), default=0)

    def maybe_word(self, word: str) -> bool:
        """Whether a whole word may be one edit away; false is certain."""
        return len(word) <= self.longest + 1 and (word in self.shorter or not self.shorter.isdisjoint(left_out(word)))

    def exact(self, word: str) -> float:
        """The highest weight of the word and of the stems that it begins with."""
        node, best = self.root, 0.0
        for letter in word:
            node = node.get(letter)
            if node is None:
                return best
            best = max(best, node.get("stem", 0.0))
        return max(best, node.get("", 0.0))

    def near(self, word: str) -> float:
        """The highest weight of a whole word one edit away; an exchange of neighbours is one edit too."""
        n, best = len(word), 0.0
        if n < FUZZY_CHARS - 1 or not self.maybe_word(word):
            return best
        # States: node, its letters so far, and the automaton's rows for it and its parent.
        stack = [(self.root, "", list(range(n + 1)), None)]
        while stack:
            node, path, row, above = stack.pop()
            if row[n] == 1 and len(path) >= FUZZY_CHARS:
                best = max(best, node.get("", 0.0), node.get("near", 0.0))
            for letter, child in node.items():
                if len(letter) != 1:
                    continue
                new = [row[0] + 1]
                for i, own in enumerate(word, 1):
                    cost = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (own != letter))
                    if above and i > 1 and own == path[-1] and word[i - 2] == letter:
                        cost = min(cost, above[i - 2] + 1)
                    new.append(cost)
                if min(new) <= 1 or min(row) <= 1 and len(path) < n:
                    stack.append((child, path + letter, new, row))
        return best

    def masked(self, word: str) -> float:
        """The highest weight of a term that the word shows all but the letters under its digits and marks of."""
        best, stack = 0.0, [(self.root, 0, 0)]
        while stack:
            node, at, shown = stack.pop()
            if shown >= SHOWN_CHARS and 2 * shown >= at:
                best = max(best, node.get("stem", 0.0))
                if at == len(word):
                    best = max(best, node.get("", 0.0), node.get("near", 0.0))
            if at < len(word):
                own = word[at]
                if own.isalpha():
                    if own in node:
                        stack.append((node[own], at + 1, shown + 1))
                else:
                    stack += [(child, at + 1, shown) for letter, child in node.items() if len(letter) == 1]
        return best


@dataclass
class Model:
    """A lexicon and the coefficients of its features, the constant last."""

    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0,) * FEATURES + (-4.0,)
    #: Words that stems stand for, to find their misspellings.
    inflected: dict[str, float] = field(default_factory=dict)


class Scorer:
    def __init__(self, model: Model):
        self.trie, self.weights = Trie(model.stems, model.words, model.inflected), np.array(model.weights)
        self.chunks: dict[str, float] = {}

    def chunk(self, chunk: str) -> float:
        """The highest weight of the words in what stands between white space."""
        best = 0.0
        for word in LETTERS.findall(chunk):
            best = max(best, self.trie.exact(word) or NEAR * self.trie.near(word))
        marked = TRAILING.sub("", chunk.strip(PUNCTUATION))
        if not marked.isalpha() and LETTERS.search(marked):  # digits or marks may stand for letters
            best = max(best, NEAR * self.trie.masked(marked), NEAR * self.trie.near(marked))
        return best

    def features(self, text: str) -> list[float]:
        """Sums of used and of mentioned hits, the strongest used hit, and used hits per word."""
        chunks, known, hits = text.lower().split(), self.chunks, []
        for i, c in enumerate(chunks):
            got = known.get(c)
            if got is None:
                got = self.chunk(c)
                if len(c) <= common.MEMO_CHARS:
                    known[c] = got
            if got:
                hits.append((i, got))
        used = mentioned = most = 0.0
        for i, weight in hits:
            before, after = chunks[max(0, i - WINDOW) : i], chunks[i + 1 : i + 1 + WINDOW]
            marks = [not QUOTES.isdisjoint(c) for c in (*before, chunks[i], *after)]
            quoted = marks[len(before)] or any(marks[: len(before)]) and any(marks[len(before) + 1 :])
            if quoted or any(c.strip(".,:;") in REPORTS for c in before):
                mentioned += weight
                weight *= MENTION
            used += weight
            most = max(most, weight)
        return [math.log1p(used), math.log1p(mentioned), most, math.log1p(100 * used / max(1, len(chunks)))]

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.chunks) > common.MEMO_ENTRIES:
            self.chunks.clear()
        rows = np.array([self.features(t) for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights[:-1] + self.weights[-1], -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: by the CRC-32 of its id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, toxic, half`` of at most ``rows`` labelled documents that aren't held out."""
    usable = labels.filter("doc_id is not null and toxic is not null").select("doc_id", "toxic").distinct()
    usable = usable.filter(~held_out(F.col("doc_id"))).withColumn("hash", F.xxhash64("doc_id"))
    picked = materialize(usable.orderBy("hash", "toxic").limit(rows))  # no more rows than the bound
    return materialize(
        common.id_and_text(docs)
        .join(F.broadcast(picked), "doc_id")
        .select("text", (F.col("toxic") == 1).alias("toxic"), F.pmod("hash", F.lit(2)).alias("half"))
    )


def terms_of(text: str) -> set[tuple[str, bool]]:
    """A text's words, and as stems their beginnings (marked true)."""
    words = set(LETTERS.findall(text.lower()))
    stems = {(w[:n], True) for w in words for n in range(STEM_CHARS, min(len(w), MAX_STEM_CHARS) + 1)}
    return stems.union((w, False) for w in words)


def term_counts(texts: DataFrame, among: frozenset[tuple[str, bool]]) -> DataFrame:
    """``term, stem, n``: how many of ``texts(text)`` have a term of ``among``."""
    shared = texts.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            counts: Counter = Counter()
            for _, texts in common.slices(batch.column(0)):
                for text in texts:
                    counts.update(terms_of(text) & wanted)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t for t, _ in counts], pa.string()),
                    pa.array([s for _, s in counts], pa.bool_()),
                    pa.array(counts.values(), pa.int64()),
                ],
                ["term", "stem", "n"],
            )

    made = texts.select("text").mapInArrow(run, "term string, stem boolean, n long")
    return made.groupBy("term", "stem").agg(F.sum("n").alias("n"))


def term_contexts(texts: DataFrame) -> DataFrame:
    """``term, stem, n``: in how many different contexts (the words beside it) ``texts(text)`` have a term.

    A term has one context per text. Copies of a text add no context, so their
    chance words stay rare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in (t for _, texts in common.slices(batch.column(0)) for t in texts):
                words = LETTERS.findall(text.lower())
                first: dict[tuple[str, bool], int] = {}
                for i, word in enumerate(words):
                    if (word, False) not in first:
                        first[word, False] = i
                        for n in range(STEM_CHARS, min(len(word), MAX_STEM_CHARS) + 1):
                            first.setdefault((word[:n], True), i)
                beside = [xxh64_intdigest(" ".join(words[max(0, i - 1) : i + 2])) >> 1 for i in range(len(words))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([t for t, _ in first], pa.string()),
                        pa.array([s for _, s in first], pa.bool_()),
                        pa.array([beside[i] for i in first.values()], pa.int64()),
                    ],
                    ["term", "stem", "context"],
                )

    made = texts.select("text").mapInArrow(run, "term string, stem boolean, context long")
    return made.groupBy("term", "stem").agg(F.count_distinct("context").alias("n"))


def lexicon(sample: DataFrame, toxic: int, clean: int, max_terms: int) -> tuple[dict[str, float], ...]:
    """Stems, words, and words that a stem stands for, that are at least RATIO times as usual in toxic documents as in clean ones, with log weights.

    A stem that is mostly one word is left to that word, and a word or longer
    stem that begins with a stem of the lexicon to that stem.
    """
    least = max(3, toxic // 100)
    # The sample is bounded, and so are the terms that so many of its documents have.
    seen = term_contexts(sample.filter("toxic")).filter(F.col("n") >= least).collect()
    counts = {(r.term, r.stem): r.n for r in seen}
    usual = {(r.term, r.stem): r.n for r in term_counts(sample.filter("not toxic"), frozenset(counts)).collect()}
    # Counted low by 1.5 standard deviations: terms seen a few times may be chance.
    low = {t: max(n - 1.5 * math.sqrt(n), 1e-9) for t, n in counts.items()}
    ratio = {t: n / toxic / ((usual.get(t, 0) + 0.5) / (clean + 1)) for t, n in low.items()}
    strong = sorted((t for t in counts if ratio[t] >= RATIO), key=lambda t: (-counts[t] * math.log(ratio[t]), t))
    strong = strong[:max_terms]
    weight = {t: round(min(5.0, math.log(ratio[t])), 4) for t in strong}
    most: dict[str, int] = {}
    for (term, stem), n in counts.items():
        if not stem:
            for i in range(STEM_CHARS, min(len(term), MAX_STEM_CHARS) + 1):
                most[term[:i]] = max(most.get(term[:i], 0), n)
    stems: dict[str, float] = {}
    for term in sorted((t for t, stem in strong if stem), key=lambda t: (len(t), t)):
        if most.get(term, 0) < ONE_WORD * counts[term, True] and not covered(term, weight[term, True], stems):
            stems[term] = weight[term, True]
    words = {t: weight[t, False] for t, stem in strong if not stem and not covered(t, weight[t, False], stems)}
    stood_for = ((t, max((stems.get(t[:i], 0.0) for i in range(STEM_CHARS, len(t) + 1)), default=0.0)) for t, stem in counts if not stem)
    inflected = {t: w for t, w in stood_for if w and t not in words}
    return stems, words, inflected


def covered(term: str, weight: float, stems: dict[str, float]) -> bool:
    """Whether a stem that the term begins with weighs about as much."""
    return any(stems.get(term[:i], 0) >= weight - 0.5 for i in range(STEM_CHARS, len(term) + 1))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS) -> Model:
    """A model of ``labels(doc_id, toxic)``, learned from texts alone.

    Terms come from one half of the sample, coefficients from the other, so
    chance terms get no credit. Without toxic or without clean rows in a half the
    model has no terms and scores everything low. Conflicting labels of a
    document are used as they are, as two rows; null ones are not.
    """
    sample = training_sample(docs, labels, rows)
    sizes = {(r.half, r.toxic): r.n for r in sample.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 4:
        return Model()
    stems, words, inflected = lexicon(sample.filter("half = 0"), sizes[0, True], sizes[0, False], max_terms)
    model = Model(stems, words, inflected=inflected)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            made = [scorer.features(t) for _, texts in common.slices(batch.column(0)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    learned = sample.filter("half = 1").select("text", "toxic").mapInArrow(run, "x array<double>, y boolean").toArrow()
    order = np.lexsort(np.array(learned["x"].to_pylist()).T)  # sums must not depend on the order of tasks
    x, y = np.array(learned["x"].to_pylist())[order], np.array(learned["y"].to_pylist(), dtype=float)[order]
    model.weights = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Coefficients of a ridge logistic regression by Newton steps, the constant last."""
    x = np.c_[x, np.ones(len(x))]
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(round(float(v), 6) for v in w)


def score_column(docs: DataFrame, model: Model):
    """A column function: scores of a text column; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            made = [scorer.scores(some) for _, some in common.slices(texts)]
            yield pa.array(np.concatenate(made) if made else np.zeros(0))
        common.give_back()

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``, whole texts.

    A score from 0 to 1, higher if label 1 is likelier; null texts score as empty
    ones. ``held_out`` rows have no part in learning; rows without an id have
    none either, and count as not held out. Repeated rows score alike; columns
    other than ``doc_id`` and ``text`` are not looked at. Empty tables give empty
    ones.
    """
    score = score_column(docs, fit(docs, labels))
    scored = docs.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns."""
    score = score_column(docs, fit(docs, labels))
    return docs.filter(score(F.col("text")) < threshold)
