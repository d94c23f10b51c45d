"""Mine collocations: frequent phrases whose parts are rarely apart."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, ranked, slices, stored, table
from .trie import DoubleArray

#: Occurrences from which a phrase is a candidate, its most words, and phrases in the result for each language.
LEAST, LONGEST, MOST = 30, 4, 2000
#: A phrase goes if a longer one around it has at least this per cent of its occurrences.
COVER_PCT = 80
#: A phrase that always occurs when its parts do scores half of this.
SCALE = 2_000_000
#: Language of rows without one.
UNKNOWN = "und"

#: Words that are sent to the tasks at a time, and phrases in one trie: what bounds a broadcast.
WORD_BLOCK, TRIE_PHRASES = 1 << 20, 1 << 19
#: Phrases whose counts go from task to task as one row; divides ``TRIE_PHRASES``.
CHUNK = 1 << 12
#: Bytes of text cut into words at a time; different words or numbers that a task gathers before it hands them on.
RUN_BYTES, GATHERED = 1 << 20, 1 << 19

#: A break between pieces, as a byte that no UTF-8 text has.
BREAK = b"\xff"
_LOWER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_LOWER + b".,;:!?\n\x0b\x0c\r", _LOWER.lower() + BREAK * 10)
_BLANK = re.compile(rb"[ \t\xff]")


def words(text: bytes) -> Iterator[list[bytes]]:
    """Words in lower case and breaks, in lists that follow each other."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        blank = _BLANK.search(text, at + RUN_BYTES) if at + RUN_BYTES < len(text) else None
        to = blank.start() if blank else len(text)
        yield text[at:to].replace(BREAK, b" \xff ").split()
        at = to


def _rows(batches) -> Iterator[list[tuple[str, bytes]]]:
    for batch in slices(batches, "text"):
        yield list(zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True))


def _word_counts(docs: DataFrame) -> DataFrame:
    def read(batches):
        counts = defaultdict(Counter)

        def out():
            for lang, found in counts.items():
                found.pop(BREAK, None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()),
                     pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for rows in _rows(batches):
            for lang, text in rows:
                for some in words(text):
                    counts[lang].update(some)
            if sum(map(len, counts.values())) > GATHERED:
                yield from out()
        yield from out()

    return mapped(docs, read, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _numbered(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``nth`` from 0 in the given order, gapless, and the number of rows."""
    rows, run = ranked(df, *order)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows")) \
        .select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))  # one row for each range
    numbered = rows.withColumn("nth", F.row_number().over(run)).join(F.broadcast(starts), "part") \
        .withColumn("nth", F.col("start") + F.col("nth") - 1).drop("start", "part", "tie")
    return stored(numbered), rows.count()


def _encoded(docs: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """The texts as numbers: those of frequent words, and -1 for breaks, other words and the end of a text.

    The words are sent in blocks.  Each block fills its numbers in; all but one
    pass are needed only beyond ``WORD_BLOCK`` frequent words.
    """
    coded = docs.select("lang", "text", F.lit(None).cast("binary").alias("ids"))
    for low in range(0, size, WORD_BLOCK):
        block = vocabulary.where(F.col("nth").between(low, low + WORD_BLOCK - 1)).select("lang", "word", "nth").toArrow()
        numbers = defaultdict(dict)
        for lang, word, nth in zip(*[block.column(c).to_pylist() for c in ("lang", "word", "nth")], strict=True):
            numbers[lang][word.encode()] = nth
        sent, last = docs.sparkSession.sparkContext.broadcast(dict(numbers)), low + WORD_BLOCK >= size

        def read(batches, sent=sent, last=last):
            for batch in slices(batches, "text"):
                out = []
                columns = [batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(),
                           batch.column("ids").to_pylist()]
                for lang, text, ids in zip(*columns, strict=True):
                    known = sent.value.get(lang, {}).get
                    now = [np.fromiter((known(w, -1) for w in some), np.int32, len(some)) for some in words(text)]
                    now = np.concatenate([*now, np.array([-1], np.int32)])
                    out.append(now if ids is None else np.maximum(now, np.frombuffer(ids, np.int32)))
                if last and out:
                    # All that is still wanted are the numbers: one row for many texts, without breaks that follow each other.
                    ids = np.concatenate(out)
                    ids = ids[(ids >= 0) | np.concatenate(([True], ids[:-1] >= 0))]
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])
                elif out:
                    yield batch.set_column(2, "ids", pa.array([x.tobytes() for x in out], pa.binary()))

        coded = stored(mapped(coded, read, "ids binary" if last else coded.schema))
    return coded


def _counted(coded: DataFrame, codes) -> DataFrame:
    """How often each code comes that ``codes`` makes of the numbers of texts."""
    def read(batches):
        kept, size = [], 0

        def out():
            found, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["code", "n"])

        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                kept.append(codes(np.frombuffer(ids, np.int32)))
                size += len(kept[-1])
                if size > 8 * GATHERED:
                    yield out()
                    kept, size = [], 0
        if size:
            yield out()

    return mapped(coded, read, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _pairs(ids: np.ndarray) -> np.ndarray:
    first, second = ids[:-1].astype(np.int64), ids[1:]
    both = (first >= 0) & (second >= 0)
    return first[both] << 32 | second[both]


def _tries(phrases: DataFrame, size: int, longest: int, vocabulary: int) -> Iterator[tuple[int, object]]:
    """Broadcast tries of ``TRIE_PHRASES`` phrases each, and the number of the first."""
    for low in range(0, size, TRIE_PHRASES):
        block = phrases.where(F.col("nth").between(low, low + TRIE_PHRASES - 1)).orderBy("nth")
        block = block.select(*[F.coalesce(F.get("ids", F.lit(i)), F.lit(-1)).alias(f"w{i}") for i in range(longest)]).toArrow()
        trie = DoubleArray.of(np.stack([c.to_numpy() for c in block.columns], 1), vocabulary)
        sent = phrases.sparkSession.sparkContext.broadcast(trie)
        yield low, sent
        sent.unpersist()


def _longer(coded: DataFrame, phrases: DataFrame, size: int, vocabulary: int, length: int, least: int) -> DataFrame:
    """Frequent phrases of ``length`` words, from those of one word less.

    Only places count where the words before the last make a frequent phrase;
    as far as one trie holds all phrases, those after the first must too.
    """
    found = []
    for low, sent in _tries(phrases, size, length - 1, vocabulary):
        def codes(ids, sent=sent, every=size <= TRIE_PHRASES):
            trie = sent.value
            *_, (at, state) = trie.walk(ids)
            go = at + length - 1 < len(ids)
            if every:
                starts = np.zeros(len(ids) + 1, bool)
                starts[at] = True
                go &= starts[at + 1]
            at, state = at[go], state[go]
            last = ids[at + length - 1]
            return trie.accept[state[last >= 0]].astype(np.int64) << 32 | last[last >= 0]

        found.append(stored(_counted(coded, codes).where(F.col("n") >= least).select(
            (F.shiftright("code", 32) + low).alias("prefix"), F.expr("CAST(code & 4294967295L AS int)").alias("word"))))
    return reduce(DataFrame.unionByName, found).join(phrases.select(F.col("nth").alias("prefix"), "ids"), "prefix") \
        .select(F.concat("ids", F.array("word")).alias("ids"))


def _occurrences(coded: DataFrame, phrases: DataFrame, size: int, vocabulary: int, longest: int) -> DataFrame:
    """Each phrase's occurrences ``a``: all positions advance through a trie, a shard counts its accepting states, shards add up.

    What is added up are the shards' counts of ``CHUNK`` phrases that follow each other.
    """
    def add(batches):
        chunk, total = None, None
        for batch in batches:
            for mine, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts = np.frombuffer(counts, np.int64)
                if mine != chunk and total is not None:
                    yield out(chunk, total)
                total = counts if mine != chunk else total + counts
                chunk = mine
        if total is not None:
            yield out(chunk, total)

    def out(chunk, total):
        met = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(met + chunk * CHUNK), pa.array(total[met])], ["nth", "a"])

    found = []
    for low, sent in _tries(phrases, size, longest, vocabulary):
        def read(batches, sent=sent, low=low):
            trie = sent.value
            many = int(trie.accept.max()) + 1
            total = np.zeros(-(-many // CHUNK) * CHUNK, np.int64)
            for batch in batches:
                for ids in batch.column("ids").to_pylist():
                    for _, state in trie.walk(np.frombuffer(ids, np.int32)):
                        ends = trie.accept[state]
                        total += np.bincount(ends[ends >= 0], minlength=len(total))
            parts = [(low // CHUNK + i, part.tobytes()) for i, part in enumerate(total.reshape(-1, CHUNK)) if part.any()]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary())],
                                                 ["chunk", "counts"])

        counts = mapped(coded, read, "chunk long, counts binary").repartition("chunk").sortWithinPartitions("chunk")
        found.append(stored(counts.mapInArrow(add, "nth long, a long")))
    return reduce(DataFrame.unionByName, found)


def mine_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, cover_pct: int = COVER_PCT,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The phrases of 2 to ``longest`` words of each language whose parts are least often apart.

    Texts (A-Z in lower case) fall into pieces at punctuation and line ends and
    these into words at blanks and tabs.  A phrase counts wherever it lies in a
    piece, overlaps included.  Candidates are found length by length, Apriori
    fashion: a phrase can have ``least`` occurrences only if its parts have, so
    words are counted first, then pairs of frequent words, then what follows
    a frequent phrase.  The candidates of all lengths go into double-array
    tries, through which numpy takes all positions of a text at once, a word a
    step; the accepting states are counted for each task and summed.

    The lowest of ``floor(SCALE * a / (l + r))`` over all cuts of a phrase into
    two (a, l, r: occurrences of it, the first part, the rest; ties to the
    shorter first part) is its score.  Phrases go that lie in a longer one,
    dropped or not, with ``cover_pct`` per cent of their occurrences or more.
    Returns each language's first ``most`` by score, occurrences and phrase:
    ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (all words of
    the language) and ``score``.

    Broadcast are blocks of at most ``WORD_BLOCK`` words and tries of at most
    ``TRIE_PHRASES`` phrases, one at a time; more of them mean more passes over
    the numbered texts.  Hot languages and words are counted in the tasks before
    they are shuffled.

    A null text is empty; a null language is ``und``, as is a row that says so.
    Repeated rows count each time.  Other columns are not looked at.  A table
    without frequent phrases gives no rows.
    """
    if least < 1 or longest < 2:
        raise ValueError("least must be positive and longest at least 2")
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = stored(_word_counts(docs))
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary, known = _numbered(counts.where(F.col("n") >= least), "lang", "word")
    coded = _encoded(docs, vocabulary, known) if known else docs.select(F.lit(None).cast("binary").alias("ids")).limit(0)
    pairs = _counted(coded, _pairs).where(F.col("n") >= least)
    phrases, size = _numbered(pairs.select(F.expr("array(CAST(shiftright(code, 32) AS int), CAST(code & 4294967295L AS int))").alias("ids")), "ids")
    lengths = [phrases]
    for length in range(3, longest + 1):
        if size:
            phrases, size = _numbered(_longer(coded, phrases, size, known, length, least), "ids")
            lengths.append(phrases)
    phrases, size = _numbered(reduce(DataFrame.unionByName, lengths).select("ids"), "ids")
    if size:
        counted = phrases.join(_occurrences(coded, phrases, size, known, longest), "nth")
    else:
        counted = phrases.withColumn("a", F.lit(0).cast("long"))
    return _chosen(stored(_spelled(counted, vocabulary)), vocabulary, sizes, most, cover_pct)


def _spelled(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    parts = phrases.select("nth", "a", F.posexplode("ids").alias("at", "id")) \
        .join(vocabulary.select(F.col("nth").alias("id"), "lang", "word"), "id")
    return parts.groupBy("nth", "lang").agg(F.max("a").alias("a"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")) \
        .select("lang", F.col("w.word").alias("words"), "a")


def _part(first, count) -> F.Column:
    return F.array_join(F.slice("words", first, count), " ")


def _chosen(phrases: DataFrame, vocabulary: DataFrame, sizes: DataFrame, most: int, cover_pct: int) -> DataFrame:
    length = F.size("words")
    phrases = phrases.withColumn("phrase", F.array_join("words", " "))
    counts = phrases.select("lang", "phrase", "a").unionByName(
        vocabulary.select("lang", F.col("word").alias("phrase"), F.col("n").alias("a")))

    def named(name, value):
        return counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(value))

    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), length - 1))).select(
        "lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, length - F.col("k")).alias("right"))
    score = F.expr(f"CAST((CAST({SCALE} AS decimal(10, 0)) * CAST(a AS decimal(20, 0))) DIV (CAST(l AS decimal(20, 0)) + r) AS bigint)")
    scored = cuts.join(named("left", "l"), ["lang", "left"]).join(named("right", "r"), ["lang", "right"]) \
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    within = phrases.where(length > 2).select(
        "lang", "a", F.explode(F.expr("""flatten(transform(sequence(2, size(words) - 1), m ->
            transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))""")).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    left = scored.join(within, ["lang", "phrase"], "left") \
        .where(F.col("cover").isNull() | (F.col("cover") * 100 < F.col("a") * cover_pct)) \
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most) \
        .join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir):
    return mine_phrases(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '{UNKNOWN}') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT d, lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
cut AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
runs AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM runs, range(1, {LONGEST} + 1) r(m)
    WHERE i + m - 1 <= len(w) GROUP BY ALL),
sizes AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= {LEAST}),
halves AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
cuts AS (SELECT h.lang, h.phrase, h.a, k, f1.a AS l, f2.a AS r, h.a::hugeint * {SCALE} // (f1.a + f2.a) AS score
    FROM halves h JOIN f f1 ON f1.lang = h.lang AND f1.phrase = first_part JOIN f f2 ON f2.lang = h.lang AND f2.phrase = rest),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, array_to_string(w[i:i + p - 1], ' ') AS phrase, max(a) AS cover
    FROM candidates, range(2, {LONGEST}) q(p), range(1, {LONGEST}) s(i) WHERE p < m AND i + p - 1 <= m GROUP BY ALL),
ranked AS (SELECT x.*, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.phrase) AS rank
    FROM lowest x LEFT JOIN inner_parts y ON x.lang = y.lang AND x.phrase = y.phrase WHERE cover IS NULL OR 100 * cover < {COVER_PCT} * a)
SELECT lang, rank, phrase, a, l, r, n::bigint AS n, score::bigint AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= {MOST}"""
