"""Toxicity by noisy-channel deobfuscation: restore disguised words, then score the restored text."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import cached_property
from heapq import nsmallest
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_training_part, mapped, slices, stored, table

#: Bound on the labelled rows that are learned from: about so many, drawn by a hash of the id.
SAMPLE = 20_000
#: What the channel may have written for a letter (fixed values).
DISGUISES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li",
             "+": "t", "€": "e", "£": "l"}
#: Costs (negative log probabilities) of a disguised letter, a lengthened one, a sign put inside a word, of a blank between
#: spaced-out letters that is a real one, and of a blank put between pieces of a word.
SWAP, LENGTHEN, GAP, BLANK, JOIN = 1.0, 0.5, 0.3, 4.0, 1.0
#: A letter repeated this often may have been lengthened.
RUN = 2

#: Symbols of the language model: the most frequent letters, all other letters, digits and the like, gaps.
LETTERS = 93
OTHER, SIGN, SPACE, SYMBOLS = LETTERS, LETTERS + 1, LETTERS + 2, LETTERS + 3
#: Added to each trigram count.
SMOOTHING = 0.1
#: Characters that stand for signs and gaps among those that are counted, the one after each text, and the bits of each in a triple.
SIGN_CHAR, GAP_CHAR, END, CHAR_BITS = ord("0"), ord(" "), 0x110000, 21
#: Different triples that a task gathers before it hands them on.
GATHERED = 1 << 19

SEPARATORS = ".-_*"
#: Three or more single characters, each set off by blanks, dots, dashes, underscores or stars.
SPACED = re.compile(r"(?<!\S)[\w@$!|+](?:[ .\-_*]{1,3}[\w@$!|+]){2,}(?!\S)")
#: Three or more pieces of one or two letters, set off by blanks; of one letter at least once, which is looked at apart.
PIECES = re.compile(r"(?<!\S)[\w@$!|+]{1,2}(?: {1,3}[\w@$!|+]{1,2}){2,}(?!\S)")
_SINGLE = re.compile(r"(?<!\S)\w(?!\S)")
_LETTERS = re.compile(r"[^\W\d_]+")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_ENDS = SEPARATORS + ",;:?\"'()[]{}<>~&%#=/\\“”‘’«»…–—"
#: Words kept with what was found out about them, for each task.
CACHE = 200_000

#: Evidence a feature needs: labelled texts with it, standard deviations to the lower end of its share of toxic ones, and how many
#: times the odds of all labelled texts the odds at that end must be.  Besides, its share must be too unlikely for chance to bring it
#: about in any of all the features that are looked at.
LEAST_TEXTS, SURE, LIFT = 3, 2.0, 2.0
#: Least hashes of its triples of words by which copies of a labelled text are told.
SKETCH = 3
#: The most that a text without any such feature scores, whatever the share of toxic labels: nothing speaks against it.
UNSURE = 0.4
#: Of the regression: steps, and the pull of weights to zero.
STEPS, RIDGE = 1000, 1e-7


@dataclass(frozen=True)
class Characters:
    """Costs of each symbol after each two.  ``letters`` numbers the letters that have a symbol of their own."""

    letters: dict
    costs: np.ndarray

    @cached_property
    def rows(self) -> list:
        return self.costs.tolist()

    def symbol(self, char: str) -> int:
        found = self.letters.get(char)
        if found is None:
            found = (OTHER, SIGN, SPACE)[kind(char)]
        return found


def kind(char: str) -> int:
    """0: a letter, 1: a digit or a sign that may stand for a letter, 2: anything else."""
    if char in DISGUISES or char.isdigit():
        return 1
    return 0 if char.isalpha() else 2


class Triples:
    """Counts triples of neighbouring characters of lower-cased texts; gaps that follow each other are one."""

    def __init__(self):
        self.known, self.counts = {END: END}, {}

    def add(self, texts: list[str]) -> None:
        if not texts:
            return
        codes = np.frombuffer("".join([t + "\0" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        codes[ends] = END
        present = np.flatnonzero(np.bincount(codes))
        for c in present.tolist():
            if c not in self.known:
                self.known[c] = (c, SIGN_CHAR, GAP_CHAR)[kind(chr(c))]
        meant, numbers = np.unique([self.known[c] for c in present.tolist()], return_inverse=True)
        number = np.zeros(END + 1, np.int64)
        number[present] = numbers
        codes = number[codes]
        keep = np.ones(len(codes), bool)
        gap = np.searchsorted(meant, GAP_CHAR)
        keep[1:] = (codes[1:] != codes[:-1]) | (codes[1:] != gap) if gap < len(meant) and meant[gap] == GAP_CHAR else True
        codes, n = codes[keep], len(meant)
        triples = (codes[:-2] * n + codes[1:-1]) * n + codes[2:]
        if n ** 3 <= 1 << 24:
            counts = np.bincount(triples, minlength=n ** 3)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(triples, return_counts=True)
        one, two, three = meant[found // (n * n)], meant[found // n % n], meant[found % n]
        inside = (one != END) & (two != END) & (three != END)
        packed = (one << 2 * CHAR_BITS | two << CHAR_BITS | three)[inside]
        for triple, n in zip(packed.tolist(), counts[inside].tolist(), strict=True):
            self.counts[triple] = self.counts.get(triple, 0) + n

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(self.counts), pa.int64()), pa.array(list(self.counts.values()), pa.int64())],
                                         ["triple", "n"])
        self.counts = {}
        return out


def language_model(docs: DataFrame, text_col: str = "text") -> Characters:
    """The model of the characters of all texts.

    Triples of the characters themselves are counted in the tasks, summed over
    all, and stored: a table that grows with the alphabets of the corpus.  The
    ``LETTERS`` most frequent letters (ties: the smaller code) get symbols of
    their own, so that what is sent is an array of fixed size.
    """
    def count(batches):
        triples = Triples()
        for batch in slices(batches, "text"):
            triples.add([t.lower() for t in batch.column("text").to_pylist() if t])
            if len(triples.counts) > GATHERED:
                yield triples.batch()
        yield triples.batch()

    triples = stored(mapped(docs.select(F.col(text_col).alias("text")), count, "triple long, n long")
                     .groupBy("triple").agg(F.sum("n").alias("n")))
    mask = (1 << CHAR_BITS) - 1
    chars = [F.shiftright("triple", 2 * CHAR_BITS), F.shiftright("triple", CHAR_BITS).bitwiseAND(F.lit(mask)), F.col("triple").bitwiseAND(F.lit(mask))]
    common = triples.groupBy(chars[2].alias("c")).agg(F.sum("n").alias("n")).where(~F.col("c").isin(SIGN_CHAR, GAP_CHAR)) \
        .orderBy(F.desc("n"), "c").limit(LETTERS).collect()
    letters = {chr(r.c): i for i, r in enumerate(common)}
    number = F.create_map(*[F.lit(x) for pair in [(SIGN_CHAR, SIGN), (GAP_CHAR, SPACE), *[(ord(c), i) for c, i in letters.items()]] for x in pair])
    folded = triples.groupBy(*[F.coalesce(F.try_element_at(number, c.cast("int")), F.lit(OTHER)).alias(x) for c, x in zip(chars, "abc", strict=True)]) \
        .agg(F.sum("n").alias("n")).collect()  # at most one row for each cell of the array
    counts = np.full((SYMBOLS, SYMBOLS, SYMBOLS), SMOOTHING)
    for a, b, c, n in folded:
        counts[a, b, c] += n
    return Characters(letters, -np.log(counts / counts.sum(2, keepdims=True)))


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each place what may have been meant there and what it costs; elsewhere the text as it is costs nothing."""
    spaced = SPACED.fullmatch(span) is not None
    pieces = not spaced and PIECES.fullmatch(span) is not None and _SINGLE.search(span) is not None
    out, at = [], 0
    while at < len(span):
        char, to = span[at], at + 1
        ways = [(char, 0.0)]
        if spaced and (char == " " or char in SEPARATORS):
            while span[to] == " " or span[to] in SEPARATORS:
                to += 1
            ways = [("", 0.0), (" ", BLANK)]
        elif char == " ":
            while span[to] == " ":
                to += 1
            ways = [(" ", 0.0)] + ([("", JOIN)] if pieces else [])
        elif char in DISGUISES:
            ways += [(c, SWAP) for c in DISGUISES[char]]
        elif char in SEPARATORS:
            ways = [(char, 0.0), ("", GAP)]
        elif char.isalpha():
            while to < len(span) and span[to] == char:
                to += 1
            ways = [(char * (to - at), 0.0)]
            if to - at >= RUN:
                ways += [(char, LENGTHEN)] + ([(char * 2, LENGTHEN)] if to - at > 2 else [])
        out.append(ways)
        at = to
    return out


def restore(span: str, model: Characters) -> str:
    """The cheapest path through the lattice under the model, by Viterbi over the last two symbols; ties go to the earlier way."""
    costs, symbol = model.rows, model.symbol
    paths = {(SPACE, SPACE): (0.0, None)}
    for ways in [*lattice(span), [(" ", 0.0)]]:
        reached = {}
        ways = [(text, [symbol(c) for c in text], extra) for text, extra in ways]
        for (one, two), (cost, back) in paths.items():
            for text, codes, extra in ways:
                a, b, total = one, two, cost + extra
                for c in codes:
                    if c == SPACE and b == SPACE:
                        continue
                    total += costs[a][b][c]
                    a, b = b, c
                if (a, b) not in reached or total < reached[a, b][0]:
                    reached[a, b] = (total, (back, text))
        paths = reached
    back, parts = min(paths.values(), key=lambda x: x[0])[1], []
    while back:
        back, text = back
        parts.append(text)
    return "".join(reversed(parts)).rstrip(" ")


def ambiguous(word: str) -> bool:
    """More than one path leads through the word: signs that may stand for letters or lie between them, or doubled letters."""
    if word.isalpha():
        return _DOUBLED.search(word) is not None
    return _LETTERS.search(word) is not None and (any(c in DISGUISES or c in SEPARATORS for c in word) or _DOUBLED.search(word) is not None) \
        or len(word) >= 4 and any(c in "@$!|" for c in word) and not word.isdigit()


def features(word: str) -> list[str]:
    """The words in a restored word, and their beginnings of four and five letters."""
    found = []
    for part in _LETTERS.findall(word):
        found.append("w" + part)
        found += [str(n) + part[:n] for n in (4, 5) if len(part) > n]
    return found


def sketch(text: str | None) -> list[int]:
    words = (text or "").lower().split()
    triples = set(zip(words, words[1:], words[2:], strict=False)) or {tuple(words)}
    return nsmallest(SKETCH, {zlib.crc32(" ".join(t).encode("utf-8", "surrogatepass")) for t in triples})


class Reader:
    """Features of whole texts; words that are seen again are looked up."""

    def __init__(self, characters: Characters, wanted: dict | None = None):
        self.characters, self.wanted, self.words, self.spans = characters, wanted, {}, {}
        self.maybe = None if wanted is None else Sieve(wanted).of_word

    def _of_word(self, word: str):
        found = self.words.get(word)
        if found is None:
            core = word.strip(_ENDS)
            if core is not word and core in self.words:
                found = self.words[core]
            else:
                if self.maybe is not None and not self.maybe(core):
                    found = []
                else:
                    found = features(restore(core, self.characters) if ambiguous(core) else core)
                    if self.wanted is not None:
                        found = [f for f in found if f in self.wanted]
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = self.words[core] = found
        return found

    def _span(self, match: re.Match) -> str:
        span = match.group(0)
        if len(self.spans) >= CACHE:
            self.spans.clear()
        if span not in self.spans:
            self.spans[span] = restore(span, self.characters)
        return self.spans[span]

    def _pieces(self, match: re.Match) -> str:
        return self._span(match) if _SINGLE.search(match.group(0)) else match.group(0)

    def _words(self, text: str) -> list[str]:
        return PIECES.sub(self._pieces, SPACED.sub(self._span, text.lower())).split()

    def restored(self, text: str) -> str:
        return " ".join(restore(w, self.characters) if ambiguous(w) else w for w in self._words(text))

    def __call__(self, text: str | None) -> set[str]:
        found = set()
        for word in set(self._words(text or "")):
            more = self._of_word(word)
            if more:
                found.update(more)
        return found


# --- texts without any wanted feature ---------------------------------------
# A path through the lattice only swaps letters and signs of one group, leaves blanks and separators out, and makes runs
# shorter.  So a feature that some path gives lies in the text's skeleton: one letter for each group, no blanks and
# separators, no repeats.  Texts whose skeleton has no wanted one score like an empty text, and need no decoding.

def _groups() -> dict[str, str]:
    group = {}
    for sign, letters in DISGUISES.items():
        for c in letters:
            group.setdefault(c, group.get(letters[0], letters[0]))
        group[sign] = group[letters[0]]
    return group


_GROUPS = _groups()
_ASCII = bytes(ord(_GROUPS.get(chr(i), chr(i))) for i in range(128)) + bytes(range(128, 256))
_WIDE = [(c.encode(), to.encode()) for c, to in _GROUPS.items() if ord(c) > 127]
_LEFT_OUT = b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f" + SEPARATORS.encode()


_REPEAT = re.compile(rb"(.)\1+", re.S)


def skeleton_bytes(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    for sign, letter in _WIDE:
        if sign in data:
            data = data.replace(sign, letter)
    return data.translate(_ASCII, _LEFT_OUT)


def skeleton(text: str) -> np.ndarray:
    data = np.frombuffer(skeleton_bytes(text.lower()), np.uint8)
    keep = np.ones(len(data), bool)
    keep[1:] = data[1:] != data[:-1]
    return data[keep]


class Sieve:
    """Tells whether any of some features may be in a text."""

    GRAM = 4

    def __init__(self, wanted):
        self.whole = {bytes(skeleton(f[1:])) for f in wanted}
        self.short = [s for s in self.whole if len(s) < self.GRAM]
        least = [s for s in self.whole if not any(o in s for o in self.whole if o != s)]
        self.any = re.compile(b"|".join(map(re.escape, sorted(least)))) if least else None
        self.table, self.after = np.zeros(1 << 16, bool), {}
        for s in self.whole:
            if len(s) >= self.GRAM:
                code = self._codes(np.frombuffer(s[:self.GRAM], np.uint8))
                self.table[code] = True
                self.after.setdefault(int(code[0]), []).append(s)

    def _codes(self, data: np.ndarray) -> np.ndarray:
        code = data[:len(data) - self.GRAM + 1].astype(np.uint32)
        for i in range(1, self.GRAM):
            code = code * np.uint32(0x01000193) + data[i:len(data) - self.GRAM + 1 + i]
        return (code ^ code >> np.uint32(15)) & np.uint32(0xFFFF)

    def of_word(self, word: str) -> bool:
        """The same for a lower-cased word."""
        return self.any is not None and self.any.search(_REPEAT.sub(rb"\1", skeleton_bytes(word))) is not None

    def __call__(self, text: str | None) -> bool:
        """Whether any path through any of the words and spans of a text may give one of the features."""
        if not text or not self.whole:
            return False
        data = skeleton(text)
        whole = data.tobytes()
        if any(s in whole for s in self.short):
            return True
        if len(data) < self.GRAM:
            return False
        codes = self._codes(data)
        for at in np.flatnonzero(self.table[codes]).tolist():
            if any(whole.startswith(s, at) for s in self.after[int(codes[at])]):
                return True
        return False


@dataclass(frozen=True)
class ToxicityModel:
    characters: Characters
    bias: float
    weights: dict = field(default_factory=dict)

    def score(self, found: set[str]) -> float:
        x = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + exp(-x)) if x > -700 else 0.0


def _bias(prior: float) -> float:
    """Log odds of a text without any feature."""
    share = min(prior, UNSURE)
    return float(np.log(share / (1 - share)))


def _regression(rows: list[np.ndarray], labels: np.ndarray, size: int, prior: float) -> np.ndarray:
    """Logistic regression over sets of features; the last weight is the bias, which is bounded.  Full gradients, steps by Adam."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    columns = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    w = np.zeros(size + 1)
    w[-1] = _bias(prior)
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for turn in range(1, STEPS + 1):
        x = np.bincount(owner, w[columns], len(rows)) + w[-1]
        off = 1 / (1 + np.exp(-np.clip(x, -30, 30))) - labels
        slope = np.append(np.bincount(columns, off[owner], size), off.sum()) / len(rows)
        slope[:-1] += RIDGE * w[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope ** 2
        w -= 0.05 * mean / (1 - 0.9 ** turn) / (np.sqrt(square / (1 - 0.999 ** turn)) + 1e-8)
        w[-1] = min(w[-1], _bias(UNSURE))
    return w


def fit(docs: DataFrame, labels: DataFrame, characters: Characters, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> ToxicityModel:
    """Learn from about ``sample`` of the labelled rows given, all of which may be learned from.

    Features that are seen clearly more often in toxic texts than by chance are
    kept and weighed by logistic regression.  They are judged by odds, so any
    share of toxic labels will do; a text without any of them scores ``UNSURE``
    at most, also when no label can be learned from or all are alike.  Only a
    count per feature and the kept features of the sampled rows reach the driver.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL") \
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    n = marks.count()
    drawn = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "doc_id")

    def read(batches):
        reader = Reader(characters)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.int32()), pa.array([sorted(reader(t)) for t in texts], pa.list_(pa.string())),
                 pa.array([sketch(t) for t in texts], pa.list_(pa.int64()))], ["label", "found", "sketch"])

    # Read once: the sample's features are needed for the counts and for the fit.  Copies of a text, are one piece of
    # evidence and not many.
    found = stored(mapped(texts, read, "label int, found array<string>, sketch array<long>")
                   .groupBy((F.col("label") > 0).cast("int").alias("label"), "sketch")
                   .agg(F.min("found").alias("found")).drop("sketch"))
    total = dict(found.groupBy("label").count().collect())
    bad, all_ = total.get(1, 0), sum(total.values())
    prior = (bad + 0.5) / (all_ + 1)
    if not bad or bad == all_:
        return ToxicityModel(characters, _bias(prior))
    share = F.col("bad") / F.col("n")
    low = share - SURE * F.sqrt(share * (1 - share) / F.col("n") + 1 / (4 * F.col("n") * F.col("n")))
    counted = stored(found.select("label", F.explode("found").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")))
    surprise = F.col("n") * (share * F.log(share / prior) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - prior))).otherwise(0))
    kept = counted.where((F.col("bad") >= LEAST_TEXTS) & (low * (1 - prior) > LIFT * prior * (1 - low))
                         & (surprise >= float(np.log(max(counted.count(), 1))))).select("feature").collect()
    place = {r.feature: i for i, r in enumerate(sorted(kept))}
    of_them = F.filter("found", lambda f: f.isin(list(place))) if place else F.array().cast("array<string>")
    rows = sorted((tuple(place[f] for f in r.found), r.label) for r in found.select("label", of_them.alias("found")).collect())
    w = _regression([np.array(r, np.int64) for r, _ in rows], np.array([x for _, x in rows]), len(place), prior)
    return ToxicityModel(characters, float(w[-1]), {f: float(w[i]) for f, i in place.items()})


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all columns) and ``score`` (0 to 1, higher: more likely toxic) of every whole text.

    Words and spans through which more than one path leads (signs that look like
    letters or lie between them, doubled letters, spaced-out words and pieces of
    words) are decoded by Viterbi under the character model; elsewhere the text
    is the only path.  Texts in which no path of any kind can give a feature of the
    model are told by their skeletons first and score as a text without any.

    A null text and an empty one get the score of a text without any feature.
    Rows with equal ids are scored each by its text; ids may be null.  An empty
    table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))

    def judge(batches):
        reader, sieve = Reader(model.characters, model.weights), Sieve(model.weights)
        nothing = model.score(set())
        for batch in slices(batches, "text"):
            scores = [model.score(reader(t)) if sieve(t) else nothing for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], ["row", "score"])

    return mapped(rows, judge, rows.select("row").schema.add("score", "double"))


def trained(spark, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """Model of the characters of ``docs`` and the labels of those that may be learned from."""
    labels = table(spark, sf_dir, "labels").where(in_training_part(F.col("doc_id")))
    return fit(docs.where(in_training_part(F.col("doc_id"))), labels, language_model(docs))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, trained(spark, docs, sf_dir)).select(
        "row.doc_id", (~in_training_part(F.col("row.doc_id"))).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
