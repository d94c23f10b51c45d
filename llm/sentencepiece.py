"""SentencePiece encoding and decoding with a batched Viterbi in numpy."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, table
from .cuckoo import mixed

#: A model file of byte-pair pieces; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Units whose pieces are kept, and characters that advance together.
CACHE, TOGETHER = 400_000, 400_000
#: Bytes of text that are encoded, and rows that are decoded, at a time.
BATCH_BYTES, ROWS = 2 << 20, 256
#: Slots for pairs of pieces whose border has been judged.
SLOTS = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _merge(parts: list[str], rank: dict[str, int]) -> list[list[str]]:
    """Byte-pair merging by rank, the leftmost of equals first: the parts before and after each merge."""
    steps = [parts]
    while len(parts) > 1:
        best, at = min((rank.get(a + b, len(rank) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best > len(rank):
            break
        parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2:]]
        steps.append(parts)
    return steps


class Pieces:
    """The tables of a model, of a size that its vocabulary fixes.

    Pieces are numbered by merge: single characters first, then the others from
    the best score on, so that a smaller number merges earlier.
    """

    def __init__(self, path: str = MODEL):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        special = {i for i in range(self.size) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        if any(not sp.is_byte(int(i)) for i in self.bytes):
            raise ValueError("a model with byte pieces is needed")
        names = {sp.id_to_piece(i): i for i in range(self.size) if i not in special}
        self.texts = [b""] * self.size
        for name, i in names.items():
            self.texts[i] = name.replace(BLANK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.texts[i] = bytes([b])
        # Runs of blanks merge last and from the left, so they are cut by length.
        self.runs = {len(n): i for n, i in names.items() if n.strip(BLANK) == ""}
        words = [n for n in names if not n.startswith(2 * BLANK)]
        if any(n.startswith(2 * BLANK) and n.strip(BLANK) for n in names) or any(BLANK in n[1:] for n in words) or BLANK not in names:
            raise ValueError("pieces with blanks inside words are not handled")
        if any(sp.get_score(i) % 1 for i in names.values()):
            raise ValueError("a byte-pair model is needed, whose scores are the ranks of its merges; a unigram model has log probabilities")
        chars = sorted((n for n in words if len(n) == 1))
        merged = sorted((n for n in words if len(n) > 1), key=lambda n: (-sp.get_score(names[n]), names[n]))
        rank = {n: r for r, n in enumerate(merged)}
        number = {n: i for i, n in enumerate([*chars, *merged])}
        self.ids = np.array([names[n] for n in number])
        self.left, self.right = np.arange(len(number)), np.arange(len(number))
        kept = list(chars)
        for name in merged:
            steps = _merge(list(name), rank)
            if steps[-1] == [name] and len(steps) > 1 and all(c in number for c in name):
                self.left[number[name]], self.right[number[name]] = (number[p] for p in steps[-2])
                kept.append(name)  # others are never reached by merging
        made = np.array([number[n] for n in kept[len(chars):]], np.int64)
        pairs = self.left[made] << 32 | self.right[made]
        order = np.argsort(pairs)
        self.pairs, self.made = pairs[order], made[order]
        self.longest = max(map(len, kept))
        self.keys, self.checks, self.numbers = {}, {}, {}
        for length in range(1, self.longest + 1):
            own = [n for n in kept if len(n) == length]
            if own:
                codes = np.array([[ord(c) for c in n] for n in own], np.uint64)
                keys = _hashes(codes, BASES[0])(0, length)[:, 0]
                order = np.argsort(keys)
                self.keys[length], self.checks[length] = keys[order], _hashes(codes, BASES[1])(0, length)[order, 0]
                self.numbers[length] = np.array([number[n] for n in own])[order]
        self.newline = not any("\n" in n for n in names)

    def at_home(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether merging the text of two pieces that stand side by side gives just these two.

        Goes back in time from the last merge on either side: a piece across
        the border was due if the two parts at the border make one that merges
        before the next merge of either part.  Of equal merges the left one
        comes first, so the border's comes before one to its right.
        """
        x, y = one.copy(), other.copy()
        ok, open_ = np.ones(len(x), bool), np.arange(len(x))
        limit = np.full(len(x), 1 << 40)
        while len(open_):
            a, b, top = x[open_], y[open_], limit[open_]
            wanted = a << 32 | b
            at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
            bad = (self.pairs[at] == wanted) & (self.made[at] < top)
            ok[open_[bad]] = False
            # Undo the later of the two merges; characters have none.
            x_whole, y_whole = self.right[a] == a, self.left[b] == b
            back_x = ~x_whole & ((a > b) | y_whole)
            back_y = ~y_whole & ~back_x
            limit[open_] = np.where(back_x, a, b + 1)
            x[open_] = np.where(back_x, self.right[a], a)
            y[open_] = np.where(back_y, self.left[b], b)
            open_ = open_[~bad & (back_x | back_y)]
        return ok


def _hashes(codes: np.ndarray, base: int):
    """Hashes of the substrings of equally long words: a function from start and length, or all starts at once."""
    n = codes.shape[1]
    power = np.ones(n + 1, np.uint64)
    inverse = np.ones(n + 1, np.uint64)
    if n:
        power[1:] = np.multiply.accumulate(np.full(n, base, np.uint64))
        inverse[1:] = np.multiply.accumulate(np.full(n, pow(base, -1, 1 << 64), np.uint64))
    sums = np.zeros((len(codes), n + 1), np.uint64)
    np.cumsum((codes + np.uint64(1)) * power[:n], axis=1, out=sums[:, 1:])

    def of(start: int | None, length: int) -> np.ndarray:
        first = 0 if start is None else start
        last = n - length + 1 if start is None else start + 1
        return mixed((sums[:, first + length:last + length] - sums[:, first:last]) * inverse[first:last] + np.uint64(length))
    return of


@lru_cache(2)
def pieces(path: str = MODEL) -> Pieces:
    return Pieces(path)


class Encoder:
    """Pieces of whole texts.  Units that come again, words with the blank before them, are looked up."""

    def __init__(self, model: Pieces):
        self.model = model
        unit = f"{BLANK}*[^{BLANK}\n]+|{BLANK}*\n|{BLANK}+" if model.newline else f"{BLANK}*[^{BLANK}]+|{BLANK}+"
        self.units = re.compile(unit).findall
        self.slot_pair, self.slot_ok = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self._forget()

    def _forget(self):
        """Known units by number; the ids of all of them one after another, and where each unit's begin and how many they are."""
        self.known = {}
        self.flat, self.begin, self.counts = (np.zeros(0, np.int64) for _ in range(3))

    def _border(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """``at_home`` for pairs of which many have been judged before; a number below 0 is a character without a piece."""
        pair = one << 32 | (other & 0xFFFFFFFF)
        slot = (mixed(pair.view(np.uint64)) >> np.uint64(44)).astype(np.int64) % SLOTS
        new = (self.slot_pair[slot] != pair) & (one >= 0) & (other >= 0)
        ok = np.where(new, False, self.slot_ok[slot]) | (one < 0) | (other < 0)
        if new.any():
            pairs, where = np.unique(pair[new], return_inverse=True)
            judged = self.model.at_home(pairs >> 32, pairs & 0xFFFFFFFF)
            ok[new] = judged[where]
            self.slot_pair[slot[new]], self.slot_ok[slot[new]] = pair[new], judged[where]
        return ok

    def _viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of words of one length, and how many each has; a character without a piece is -1 - its code point.

        The best path to each place is the one whose last piece merging would
        leave beside the piece before it; the lattice has one such path, which
        is the result of merging.
        """
        n, rows = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(rows, n)
        keys, checks = _hashes(codes, BASES[0]), _hashes(codes, BASES[1])
        ends, starts, whose, which = [], [], [], []
        for length, sorted_keys in self.model.keys.items():
            if length > n:
                continue
            key = keys(None, length)
            at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
            hit = sorted_keys[at] == key
            word, start = np.nonzero(hit)
            at = at[hit]
            sure = self.model.checks[length][at] == checks(None, length)[hit]
            word, start, at = word[sure], start[sure], at[sure]
            ends.append(start + length)
            starts.append(start)
            whose.append(word)
            which.append(self.model.numbers[length][at])
            if length == 1:
                bare = np.ones((rows, n), bool)
                bare[word, start] = False
                word, start = np.nonzero(bare)
                ends.append(start + 1)
                starts.append(start)
                whose.append(word)
                which.append(-1 - codes[word, start].astype(np.int64))
        ends, starts, whose, which = map(np.concatenate, (ends, starts, whose, which))
        order = np.argsort(ends, kind="stable")
        starts, whose, which = starts[order], whose[order], which[order]
        borders = np.searchsorted(ends[order], np.arange(1, n + 2))
        last, back = np.full((rows, n + 1), -1, np.int64), np.zeros((rows, n + 1), np.int64)
        for i in range(1, n + 1):
            own = slice(borders[i - 1], borders[i])
            start, word, piece = starts[own], whose[own], which[own]
            best = np.where((start == 0) | self._border(last[word, start], piece), i - start, 0)
            ok = best > 0
            last[word[ok], i], back[word[ok], i] = piece[ok], start[ok]
        at, alive = np.full(rows, n), np.arange(rows)
        path, count = np.zeros((rows, n), np.int64), np.zeros(rows, np.int64)
        while len(alive):  # from the ends back to the starts
            path[alive, count[alive]] = last[alive, at[alive]]
            count[alive] += 1
            at[alive] = back[alive, at[alive]]
            alive = alive[at[alive] > 0]
        turned = count[:, None] - 1 - np.arange(n)
        return path[np.arange(rows)[:, None], np.maximum(turned, 0)][turned >= 0], count

    def _ids(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for piece numbers, characters without a piece as their bytes, and how many each word has now."""
        if (numbers >= 0).all():
            return self.model.ids[numbers], counts
        parts = [[self.model.ids[x]] if x >= 0 else self.model.bytes[list(chr(-1 - x).encode("utf-8", "surrogatepass"))].tolist()
                 for x in numbers.tolist()]
        sums = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        ends = np.cumsum(counts)
        return np.array(list(chain.from_iterable(parts)), np.int64), sums[ends] - sums[ends - counts]

    def _keep(self, units: list[str], ids: list[np.ndarray], counts: list[np.ndarray]) -> None:
        first, counts = len(self.counts), np.concatenate(counts).astype(np.int64)
        self.known.update(zip(units, range(first, first + len(units)), strict=True))
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(counts) - counts)
        self.counts = np.append(self.counts, counts)
        self.flat = np.concatenate([self.flat, *ids])

    def _run(self, blanks: int) -> list[int]:
        out = []
        while blanks:
            take = max(r for r in self.model.runs if r <= blanks)
            out.append(self.model.runs[take])
            blanks -= take
        return out

    def _learn(self, units: list[str]) -> None:
        """Find the pieces of units that are not known yet: those of equal length advance together.

        In a longer run of blanks the last one merges with the word if it can,
        before the blanks merge with each other.
        """
        long = [u for u in units if u.startswith(2 * BLANK)]
        bare = {u: BLANK + u.lstrip(BLANK) for u in long}
        plain = dict.fromkeys(u for u in units if u not in bare)
        plain.update(dict.fromkeys(w for w in bare.values() if w not in self.known))
        by_length = {}
        for word in plain:
            by_length.setdefault(len(word), []).append(word)
        names, ids, counts = [], [], []
        for length, words in by_length.items():
            step = max(1, TOGETHER // length)
            for first in range(0, len(words), step):
                some = words[first:first + step]
                found, count = self._ids(*self._viterbi(some))
                names += some
                ids.append(found)
                counts.append(count)
        if names:
            self._keep(names, ids, counts)
        if long:
            whole = []
            for unit in long:
                at = self.known[bare[unit]]
                word = self.flat[self.begin[at]:self.begin[at] + self.counts[at]]
                blanks = len(unit) - len(unit.lstrip(BLANK))
                alone = word[0] == self.model.runs[1]
                whole.append(np.append(self._run(blanks if alone else blanks - 1), word[1:] if alone else word).astype(np.int64))
            self._keep(long, whole, [np.array([len(w) for w in whole])])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the n + 1 borders between them."""
        if len(self.known) > CACHE:
            self._forget()
        split = [self.units(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        units = list(chain.from_iterable(split))
        each = list(map(self.known.get, units))
        if None in each:
            self._learn(list(dict.fromkeys(u for u, k in zip(units, each, strict=True) if k is None)))
            each = list(map(self.known.get, units))
        each = np.array(each, np.int64)
        ids, sums = ragged(self.flat, self.begin[each], self.counts[each])
        return ids.astype(np.int32), sums[np.cumsum([0, *map(len, split)])]


def ragged(flat: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` put one after another, and the borders of the runs."""
    sums = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    return flat[np.repeat(begin - sums[:-1], counts) + np.arange(sums[-1])], sums


def encode(docs: DataFrame, model_path: str = MODEL, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all columns but the text) and ``ids`` (array of int) for every whole text.

    Blanks become the piece character and one is put in front, as the model
    asks for.  Texts are cut before each run of blanks, across which no piece
    goes; units of equal length advance together through one Viterbi: hashes of
    all their substrings probe the sorted hashes of the pieces, and each place
    keeps the start of its best last piece.  For a model of byte-pair merges the
    best path is the one that merging gives, so ids are those of merging.
    Characters without a piece become their UTF-8 bytes' pieces.

    A null text has null ids, an empty one none.  Any other column is handed
    on; ids of rows may be null or repeat.  An empty table gives no rows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(pieces(model_path))

    def read(batches):
        encoder = Encoder(sent.value)
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text")
            ids, borders = encoder.encode(texts.to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(ids, pa.int32()), mask=texts.is_null())
            yield pa.RecordBatch.from_arrays([batch.column("row"), lists], ["row", "ids"])

    return mapped(rows, read, _schema(rows, "ids", "array<int>"))


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``row``, ``ids`` and the ``text`` that the ids stand for; null where they are null.

    Bytes that are no UTF-8 together become U+FFFD.  The blank that encoding
    puts in front is taken away.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(pieces(model_path).texts)

    def write(batches):
        piece = sent.value.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                texts = [_joined(piece, ids) for ids in some.column("ids")]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], [*some.schema.names, "text"])

    return mapped(encoded, write, _schema(encoded, "text", "string"))


def _joined(piece, ids: pa.ListScalar) -> str | None:
    if not ids.is_valid:
        return None
    return b"".join(map(piece, ids.values.to_numpy().tolist())).removeprefix(b" ").decode("utf-8", "replace")


def _schema(df: DataFrame, name: str, kind: str):
    kept = df.select(*[c for c in ("row", "ids") if c in df.columns])
    return df.sparkSession.createDataFrame([], kept.schema).withColumn(name, F.lit(None).cast(kind)).schema


def round_trip(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, token_ids and the text they decode to."""
    return decode(encode(docs.select("doc_id", "text"), model_path), model_path).select(
        "row.doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.col("ids").alias("token_ids"), "text")


def op7_sentencepiece(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", "token_ids", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("decoded_sha256"))


