"""Personal data: entities by pattern, and the words that give them away.

Addresses, card and phone numbers are found by pattern and checks. They are the protected
entities. Over the whole corpus, words near an entity are counted with it; a word's
pointwise mutual information with an entity says how many of the bits that it takes to name
the entity the word already tells. Where at most one bit is missing the word is removed, where
at most two are it is generalised, wherever it stands. All counts are Spark aggregations
over all documents; a task holds the words of single documents and a bounded number of counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm import common
from fleetlens.operators.skew import lookup_join
from fleetlens.session import materialize

# The patterns and limits of the base kinds. An address is looked for at its "@", see emails().
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, MAX_PART = (14, 19), (10, 15), 255

#: In the order in which spans of one start are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "generalise", "remove")

#: A word is everything but ASCII marks, white space and controls, of three characters or more.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{3,}"
#: Words that end or begin within so many characters of an entity stand near it.
WINDOW_CHARS = 100
#: In how many different surroundings a word must stand near an entity; copies of a passage are one.
MIN_CONTEXTS = 3
#: Bits that may be missing to name the entity, for words that are removed and generalised, and the fewest bits that such a word tells.
REMOVE_BITS, GENERALISE_BITS, LEAST_BITS = 1.0, 2.0, 3.0

#: Different words that a task counts before it hands its counts on.
COUNTED_WORDS = 100_000
#: Slots that a word may fall into: tasks are told which of them hold a word that matters.
SLOTS = 2**20

_WORDS, _TOUCHING = re.compile(WORD), re.compile(WORD.replace("{3,}", ""))
_TO_LOWER = str.maketrans(common.UPPER, common.LOWER)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, each looked for from its "@" so that long runs of letters cost nothing."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def passes_luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def entities(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (exclusive, in code points) of the base kinds, by start and then kind.

    Matches are the leftmost of each kind and don't overlap within it; a match that fails its check is
    passed over as a whole. Takes time in proportion to the text, whatever it holds.
    """
    found = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= MAX_PART for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            digits = digits_of(m[0])
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and passes_luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if PHONE_DIGITS[0] <= len(digits_of(m[0])) <= PHONE_DIGITS[1]:
            found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def blanked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with spaces where entities stand."""
    out, at = [], 0
    for _, start, end in found:
        if end > at:
            out += [text[at : max(start, at)], " " * (end - max(start, at))]
            at = end
    return "".join(out) + text[at:]


def named(kind: str, value: str) -> str:
    """An entity's name: numbers whatever their marks, addresses in lower case."""
    return f"{kind}:{digits_of(value) if kind in ('card', 'phone') else value.translate(_TO_LOWER)}"


def words_in(text: str, plain: str, start: int, end: int) -> Iterator[re.Match]:
    """Words of the blanked text within a range that are whole words of the text, and so counted as such."""
    for m in _WORDS.finditer(plain, start, end):
        if not _TOUCHING.match(text[max(0, m.start() - 1) : m.start()]) and not _TOUCHING.match(text[m.end() : m.end() + 1]):
            yield m


def near(text: str, plain: str, start: int, end: int) -> list[str]:
    """Words whose whole length lies within the window before or after a place."""
    around = [(max(0, start - WINDOW_CHARS), start), (end, end + WINDOW_CHARS)]
    return [m[0].translate(_TO_LOWER) for a, b in around for m in words_in(text, plain, a, b)]


def contexts(docs: DataFrame) -> DataFrame:
    """``row, entity, word, context`` for every entity and word near it, and one row without a word.

    ``context`` numbers the words around: the same for copies of a passage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["row", "entity", "word", "words"], [pa.int64(), pa.string(), pa.string(), pa.string()]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()
            return out

        for ids, texts in common.portions(batches):
            for row, text in zip(ids.to_pylist(), texts):
                found = entities(text)
                plain = blanked(text, found) if found else text
                for kind, a, b in found:
                    words, entity = near(text, plain, a, b), named(kind, text[a:b])
                    around = " ".join(words)
                    rows.append((row, entity, None, around))
                    rows += [(row, entity, w, around) for w in dict.fromkeys(words)]
                    if len(rows) >= 20_000:
                        yield batch()
        if rows:
            yield batch()

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    seen = texts.mapInArrow(run, "row long, entity string, word string, words string")
    return seen.select("row", "entity", "word", F.xxhash64("words").alias("context"))


def different_words(text: str) -> set[str]:
    return {w.translate(_TO_LOWER) for w in set(_WORDS.findall(text))}


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n_word``: in how many documents each word stands. What leaves a task are its own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def batch() -> pa.RecordBatch:
            columns = [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for _, texts in common.portions(batches):
            for text in texts:
                counts.update(different_words(text))
                if len(counts) >= COUNTED_WORDS:
                    yield batch()
        if counts:
            yield batch()

    return common.id_and_text(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n_word"))


def slot(word: str) -> int:
    return zlib.crc32(word.encode()) % SLOTS


def words_among(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``digest, word`` of the different words of every text that are in ``words``, next to the text's digest.

    Tasks get a map of the slots that the wanted words fall into, whose size is fixed; an exact join
    does the rest.
    """
    wanted = words.select((F.crc32(F.col("word").cast("binary")) % SLOTS).alias("slot")).distinct()
    marked = bytearray(SLOTS // 8)
    for r in wanted.collect():  # at most SLOTS
        marked[r["slot"] // 8] |= 1 << r["slot"] % 8
    shared = docs.sparkSession.sparkContext.broadcast(bytes(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        none = not any(bits)
        for digests, texts in common.portions(batches):
            rows = []
            for digest, text in zip(digests.to_pylist(), () if none else texts):
                found = ((w, slot(w)) for w in different_words(text))
                rows += [(digest, w) for w, at in found if bits[at // 8] >> at % 8 & 1]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["digest", "word"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(F.md5("text").alias("digest"), "text")
    return lookup_join(texts.mapInArrow(run, "digest string, word string"), words, "word", spread=["digest"])


def disclosures(
    docs: DataFrame,
    min_contexts: int = MIN_CONTEXTS,
    remove_bits: float = REMOVE_BITS,
    generalise_bits: float = GENERALISE_BITS,
    least_bits: float = LEAST_BITS,
) -> DataFrame:
    """``entity, word, n_both, n_word, n_entity, bits, missing, level`` of the words that give an entity away.

    The counts are documents: with the word near the entity, with the word anywhere, with the entity.
    ``bits`` is the pair's pointwise mutual information, ``missing`` what naming the entity still takes,
    ``-log2(n_both / n_word)``; ``level`` is ``remove`` or ``generalise``. Entities so frequent that naming
    them takes fewer than ``least_bits`` are given away by nothing. Every document counts, copies too,
    but a word must stand near the entity in ``min_contexts`` different surroundings.
    """
    counted = materialize(
        contexts(docs)
        .groupBy("entity", "word")
        .agg(F.count_distinct("row").alias("n_both"), F.count_distinct("context").alias("n_contexts"))
    )
    whole = counted.filter("word is null").select("entity", F.col("n_both").alias("n_entity"))
    pairs = counted.filter(F.col("word").isNotNull() & (F.col("n_contexts") >= min_contexts)).drop("n_contexts")
    pairs = materialize(pairs.join(whole, "entity"))
    all_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    with_counts = pairs.join(word_counts(docs), "word")
    told = with_counts.withColumn("n", all_docs.scalar()).select(
        "entity",
        "word",
        "n_both",
        "n_word",
        "n_entity",
        F.log2(F.col("n_both") * F.col("n") / (F.col("n_entity") * F.col("n_word"))).alias("bits"),
        F.log2(F.col("n_word") / F.col("n_both")).alias("missing"),
    )
    level = F.when(F.col("missing") <= remove_bits, "remove").otherwise("generalise")
    return told.filter((F.col("missing") <= generalise_bits) & (F.col("bits") >= least_bits)).withColumn("level", level)


def general(word: str) -> str:
    """What is left of a generalised word: what kind of word it was."""
    return "[number]" if word.isdigit() else "[name]" if word[0].isupper() else "[word]"


def sanitised(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with entities replaced by their kind, generalised words by theirs, and removed words left out.

    Of spans that overlap, the first says what stands there.
    """
    out, at = [], 0
    for kind, start, end in found:
        if end <= at:
            continue
        if start >= at:
            word = {"remove": "", "generalise": general(text[start:end])}.get(kind, f"[{kind}]")
            out += [text[at:start], word]
        at = end
    return "".join(out) + text[at:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_personal_data(docs: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """``doc_id, spans, sanitised`` of every row of ``docs``, whole texts.

    ``spans``: kind, start and end (exclusive) in code points, by start and then kind, of the entities and of
    the words in ``told`` (default: the ``disclosures`` of ``docs``) wherever they stand outside of entities; a
    word that is both generalised and removed, for different entities, is removed. ``sanitised``: see there. A
    null text is an empty one. Repeated and null ids are kept; columns other than ``doc_id`` and ``text``
    are not looked at.
    """
    told = disclosures(docs) if told is None else told
    levels = materialize(told.groupBy("word").agg(F.max("level").alias("level")))  # "remove" is the greater
    hits = words_among(docs, levels)
    # Words hold no line ends: a text's are listed in one string, whose size can be measured.
    marked = F.array_sort(F.collect_set(F.concat_ws(" ", "level", "word")))
    hits = materialize(hits.groupBy("digest").agg(F.array_join(marked, "\n").alias("told")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in common.slices(batch.column(1)):
                listed, clean = [], []
                for i, text in enumerate(texts):
                    found = entities(text)
                    told_here = batch.column(2)[start + i].as_py()
                    level = dict(t.split(" ")[::-1] for t in told_here.split("\n")) if told_here else {}
                    if level:
                        words = words_in(text, blanked(text, found), 0, len(text))
                        kinds = ((level.get(m[0].translate(_TO_LOWER)), *m.span()) for m in words)
                        found += [k for k in kinds if k[0]]
                        found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                    listed.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                    clean.append(sanitised(text, found) if found else text)
                ids = batch.column(0)[start : start + len(texts)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(listed, _SPANS), pa.array(clean, pa.string())], ["doc_id", "spans", "sanitised"]
                )
        common.give_back()

    texts = common.id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    told_of = lookup_join(texts.withColumn("digest", F.md5("text")), hits, "digest", "left", spread=["doc_id"])
    return told_of.select("doc_id", "text", "told").mapInArrow(
        run, f"doc_id {kind}, spans array<struct<kind string, start long, end long>>, sanitised string"
    )


def span_list(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data_report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their list, and the list of all spans."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(span_list(of(*BASE)).cast("binary"), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )
