"""Line-first cleaning: rules per line, then a verdict on what each document lost."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, table, texts_as_bytes
from .lines import WHITE
from .substring import words_of

# --- Fixed values ---
#: Least words of a document, and most per cent of its words that repeated windows may hold.
MIN_WORDS, REPEAT_PCT = 50, 50
#: Words of the windows that are looked up for repeats.
RUN = 3
SYMBOLS = "#*$%&|<>"
#: A line that does not end in a closing mark needs one after every so many words.
MARK_EVERY = 40
CLOSING, QUOTES = ".!?…。！？؟।", "\"')]»”’"
#: Words that only part the items of a menu: at least so many, and one in so many words.
SEPARATORS, MIN_SEPARATORS, SEPARATOR_EVERY = ("|", "||", ">", "»", "›", "·", "•", "/", "::"), 2, 5
#: Phrases of page frames, in lines of fewer words than this.
PHRASES = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use of cookies",
    "enable javascript", "skip to content", "skip to main", "click here", "read more", "sign up", "log in", "subscribe to",
    "share this", "back to top", "alle rechte vorbehalten", "datenschutzerklärung", "tous droits réservés",
    "politique de confidentialité", "todos los derechos reservados", "política de privacidad",
)
PHRASE_WORDS = 40
#: Most per cent of its word characters that a document may lose with its lines.
LOST_PCT = 30
# --- End of fixed values ---


def _any(marks: str) -> bytes:
    return b"(?:" + b"|".join(re.escape(m.encode()) for m in marks) + b")"


_CLOSED = re.compile(_any(CLOSING) + _any(QUOTES) + rb"*(?=[ \t-\r]|\Z)")
_ENDS = re.compile(_any(CLOSING) + _any(QUOTES) + rb"*\Z")
_PHRASE = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))
_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)


def unpunctuated(line: bytes, words: list[bytes]) -> bool:
    last = words[-1]
    return not last.endswith((b".", b"!", b"?")) and not _ENDS.search(last) \
        and len(_CLOSED.findall(line)) * MARK_EVERY < len(words)


def navigation(words: list[bytes]) -> bool:
    parting = sum(map(_SEPARATORS.__contains__, words))
    return parting >= MIN_SEPARATORS and parting * SEPARATOR_EVERY >= len(words)


def boilerplate(line: bytes, words: list[bytes]) -> bool:
    return len(words) < PHRASE_WORDS and _PHRASE.search(line.lower()) is not None


def fails(line: bytes) -> bool:
    """Whether a line breaks a rule.  A line without a word breaks none."""
    words = line.split()
    return bool(words) and (unpunctuated(line, words) or navigation(words) or boilerplate(line, words))


def _within(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring borders."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[borders])


def repeated_words(words: list[bytes], before: np.ndarray) -> np.ndarray:
    """For each text the words that lie in a window of ``RUN`` words found twice or more in it."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    first = np.arange(max(len(ids) - RUN + 1, 0))
    first = first[owner[first] == owner[first + RUN - 1]]
    # Three numbers and the text's own in two keys that do not overflow: a slice has far fewer than 2^31 words.
    low, high = ids[first] << 31 | ids[first + 1], owner[first] << 31 | ids[first + 2]
    order = np.lexsort((low, high))
    same = (low[order[1:]] == low[order[:-1]]) & (high[order[1:]] == high[order[:-1]])
    twice = np.zeros(len(first), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(ids), bool)
    for i in range(RUN):
        covered[first[twice] + i] = True
    return _within(covered, before)


def _measured(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    data, offsets = texts_as_bytes(batch.column("text"))
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    before = words_of(data, offsets)[2]
    n_words = np.diff(before)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    repeats = repeated_words(b"\n".join(texts).split(), before)
    twins, removed, lost, cleaned = [], [], [], []
    for text in texts:
        lines = text.split(b"\n")
        worded = [x for x in lines if x.strip(WHITE)]
        twins.append(len(worded) - len(set(worded)))
        bad = {x for x in set(worded) if fails(x)}
        gone = [x for x in worded if x in bad]
        removed.append(len(gone))
        lost.append(sum(len(b"".join(x.split()).decode()) for x in gone))
        cleaned.append(b"\n".join([x for x in lines if x not in bad]) if bad else text)
    chars = _within(((data & 0xC0) != 0x80) & ~white, offsets)
    base_failed = (n_words < MIN_WORDS) | (100 * repeats > REPEAT_PCT * n_words)
    lost = np.array(lost, np.int64)
    return {"clean_text": cleaned, "n_words": n_words, "word_chars": chars, "n_symbols": _within(symbol[data], offsets),
            "n_dup_lines": np.array(twins, np.int64), "n_repeat_words": repeats, "n_removed_lines": np.array(removed, np.int64),
            "lost_chars": lost, "base_failed": base_failed, "kept": ~base_failed & (100 * lost <= LOST_PCT * chars)}


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines", "lost_chars")


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Take failing lines out of every text and judge each document by what it lost.

    A line with a word fails if it breaks one of three rules.  Punctuation: it
    does not end in a closing mark, and fewer than one in ``MARK_EVERY`` words
    has one.  Navigation: at least two of its words, and one in five, only part
    the items of a menu.  Boilerplate: it is short and has a phrase of page
    frames (A-Z in lower case).  All lines are judged first; a document is kept
    unless it lost more than ``LOST_PCT`` per cent of its word characters with
    them, or failed the base rules on its whole text: at least ``MIN_WORDS``
    words, and no more than half of them in windows of three that repeat.

    One pass without a shuffle: each text is judged by itself, whole, so hot
    sources, copies and very long texts do not meet anywhere.

    Returns ``row`` (a struct of all columns but the text), ``text`` without
    the failing lines, the figures of ``FIGURES``, ``base_failed`` and
    ``kept``.  A null text stays null, has no words and fails the base rules, as
    an empty one does.  Rows that repeat are judged alike; other columns may
    have any names.  An empty table gives no rows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))

    def judge(batches):
        for batch in slices(batches, "text"):
            found = _measured(batch)
            text = pa.array(found["clean_text"], pa.binary(), mask=batch.column("text").is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), text.cast(pa.string()), *[pa.array(found[c]) for c in (*FIGURES, "base_failed", "kept")]],
                ["row", "text", *FIGURES, "base_failed", "kept"])

    schema = rows.select("row", "text").schema
    for name in FIGURES:
        schema = schema.add(name, "long")
    return mapped(rows, judge, schema.add("base_failed", "boolean").add("kept", "boolean"))


def op11_quality(spark, sf_dir):
    return clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", *FIGURES[:5], "base_failed", "kept", *FIGURES[5:],
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


def _text_sql(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_MARK = "[" + CLOSING + "][" + QUOTES.replace("]", "\\]").replace("'", "''") + "]*"
OP11_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM docs),
worded AS (SELECT *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw FROM lines),
judged AS (SELECT *, len(lw) > 0 AND (
        (NOT regexp_matches(lw[-1], '{_MARK}$') AND len(regexp_extract_all(line, '{_MARK}([\\x20\\x09-\\x0D]|$)')) * {MARK_EVERY} < len(lw))
        OR (len(list_filter(lw, lambda x: x IN ({_text_sql(SEPARATORS)}))) >= {MIN_SEPARATORS}
            AND len(list_filter(lw, lambda x: x IN ({_text_sql(SEPARATORS)}))) * {SEPARATOR_EVERY} >= len(lw))
        OR (len(lw) < {PHRASE_WORDS} AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '{"|".join(PHRASES)}'))) AS bad FROM worded),
by_doc AS (SELECT doc_id, count(*) FILTER (WHERE len(lw) > 0) - count(DISTINCT line) FILTER (WHERE len(lw) > 0) AS n_dup_lines,
        count(*) FILTER (WHERE bad) AS n_removed_lines, coalesce(sum(length(array_to_string(lw, ''))) FILTER (WHERE bad), 0) AS lost_chars,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT bad), '')) AS clean_sha256 FROM judged GROUP BY doc_id),
windows AS (SELECT doc_id, i, w[i:i + {RUN - 1}] AS g FROM docs, LATERAL unnest(range(1, len(w) - {RUN} + 2)) u(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM windows) WHERE times > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range({RUN}) r(k) GROUP BY doc_id),
figures AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        n_removed_lines, lost_chars, clean_sha256
    FROM docs d JOIN by_doc b ON d.doc_id = b.doc_id LEFT JOIN covered c ON d.doc_id = c.doc_id)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols,
    n_dup_lines::bigint AS n_dup_lines, n_repeat_words::bigint AS n_repeat_words,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PCT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PCT} * n_words) AND 100 * lost_chars <= {LOST_PCT} * word_chars AS kept,
    n_removed_lines::bigint AS n_removed_lines, lost_chars::bigint AS lost_chars, clean_sha256
FROM figures"""
