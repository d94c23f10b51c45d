"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_training_part, mapped, slices, stored, table, texts_as_bytes

#: Buckets of hashed n-grams: the first quarter for pairs of bytes, the rest for triples.
DIMENSIONS = 4096
#: Bound on the labelled sample: about so many documents of each language, fewer where there are fewer, and about so many in all.
SAMPLE, SAMPLE_ALL = 800, 16_000
#: Languages that are learned, the most frequent ones: each needs a few rows of the sample for its clusters.
MOST_LANGS = 1_000
#: Clusters per language.  One with less than this share of its language's sample may be noise in the labels: it is left out if half
#: of its members lie as near to a large cluster of another language as that one's own do (this quantile of their distances).
CLUSTERS, SMALL, OWN = 4, 0.1, 0.99
#: A text farther from its centroid than this times the sample's 99th percentile is rejected.
SLACK = 1.25
#: Rows whose vectors are held at a time.
ROWS = 512
UNKNOWN = "und"

#: Letters in lower case and all bytes beyond ASCII as they are; everything else is a gap.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def counts_of(column: pa.Array) -> np.ndarray:
    """How often each text has each n-gram, as a matrix."""
    data, offsets = texts_as_bytes(column)
    rows, text = len(offsets) - 1, _FOLD[data].astype(np.uint32)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    out = np.zeros(rows * DIMENSIONS, np.int64)
    quarter = DIMENSIONS // 4
    if len(text) > 1:
        pair = text[:-1] * np.uint32(256) + text[1:]
        ok = owner[:-1] == owner[1:]
        bucket = ((pair * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(quarter)
        out += np.bincount((owner[:-1] * DIMENSIONS + bucket)[ok], minlength=len(out))
    if len(text) > 2:
        ok = owner[:-2] == owner[2:]
        bucket = (((pair[:-1] * np.uint32(256) + text[2:]) * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(3 * quarter)
        out += np.bincount((owner[:-2] * DIMENSIONS + quarter + bucket)[ok], minlength=len(out))
    return out.reshape(rows, DIMENSIONS)


def small_slices(batches):
    for batch in slices(batches, "text"):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    """Unit centroids, each with its language and the distance beyond which a text is rejected."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    reach: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts, dtype=np.float32) * self.idf)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each text and their cosine; ties go to the first centroid."""
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(1)
        return best, cosines[np.arange(len(best)), best]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the first vector and those farthest from the ones before."""
    chosen = [_unit(x.mean(0, keepdims=True))[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[(x @ np.array(chosen).T).max(1).argmin()])
    centres = np.array(chosen)
    for _ in range(15):
        own = (x @ centres.T).argmax(1)
        centres = np.array([_unit(x[own == i].sum(0, keepdims=True))[0] if (own == i).any() else c for i, c in enumerate(centres)])
    return centres, (x @ centres.T).argmax(1)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Learn from the rows given, all of which may be learned from.

    Document frequencies come from all texts.  The centroids come from a sample
    of about ``sample`` rows of each language, drawn by a hash of id and text;
    only its sparse vectors reach the driver, so their size does not grow with
    the table.  The languages themselves, one row each, do too.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def frequencies(batches):
        found, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in small_slices(batches):
            found += (counts_of(batch.column("text")) > 0).sum(0)
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIMENSIONS), -1)), pa.array(np.append(found, rows))],
                                         ["bucket", "n"])

    df = np.zeros(DIMENSIONS + 1)
    for bucket, n in mapped(docs.select("text"), frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        df[bucket] = n
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    langs = stored(sizes)
    quota = min(sample, SAMPLE_ALL // max(langs.count(), 1))
    share = F.least(F.lit(1.0), quota / F.col("n"))
    drawn = labelled.join(F.broadcast(langs), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20))

    def sparse(batches):
        for batch in small_slices(batches):
            counts = counts_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([np.flatnonzero(c).astype(np.int16).tobytes() for c in counts], pa.binary()),
                 pa.array([c[c > 0].astype(np.int32).tobytes() for c in counts], pa.binary())], ["lang", "at", "n"])

    rows = mapped(drawn, sparse, "lang string, at binary, n binary").collect()
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r["lang"]].append((bytes(r["at"]), bytes(r["n"])))
    found = []
    for lang, own in sorted(by_lang.items()):
        counts = np.zeros((len(own), DIMENSIONS), np.int32)
        for i, (at, n) in enumerate(sorted(own)):
            counts[i, np.frombuffer(at, np.int16)] = np.frombuffer(n, np.int32)
        x = _unit(np.log1p(counts, dtype=np.float32) * idf)
        centres, whose = _clusters(x, CLUSTERS)
        for i, centre in enumerate(centres):
            if (members := x[whose == i]).size:
                small = len(members) < SMALL * len(x)
                found.append((lang, centre, np.quantile(1 - members @ centre, OWN), members if small else None))
    kept = [c for c in found if c[3] is None or not _strays(c, found)]
    return LanguageModel(idf, np.array([c[1] for c in kept], np.float32).reshape(-1, DIMENSIONS), tuple(c[0] for c in kept),
                         np.array([SLACK * c[2] for c in kept]))


def _strays(cluster: tuple, found: list) -> bool:
    """Half of a small cluster's members lie among those of a large cluster of another language: they are labelled wrongly."""
    lang, _, _, members = cluster
    return any(members_of is None and other != lang and (1 - members @ centre <= reach).mean() >= 0.5
               for other, centre, reach, members_of in found)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of the nearest centroid for every whole text: ``doc_id``, ``nearest``, ``score``, ``rejected``.

    A text is a unit vector of n-gram weights log(1 + count) times the inverse
    document frequency.  ``score`` is the cosine to the nearest centroid of any
    language, between 0 and 1.  ``rejected`` marks texts that are farther from
    it than the texts it was learned from.

    A null text, and one without any letter, has the language ``und``, score 0
    and is rejected; so has every text if nothing was learned.  Rows with equal
    ids are judged each by its text; ids may be null; other columns are not
    looked at.  An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def judge(batches):
        for batch in small_slices(batches):
            texts = batch.column("text")
            known = np.array([has_letter(t.as_py()) for t in texts]) & (len(model.langs) > 0)
            langs, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            rejected = np.ones(batch.num_rows, bool)
            if known.any():
                best, cosine = model.nearest(counts_of(texts))
                langs[known] = np.array(model.langs, object)[best][known]
                scores[known] = np.clip(cosine, 0, 1)[known]
                rejected[known] = (1 - cosine > model.reach[best])[known]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)],
                                             ["doc_id", "nearest", "score", "rejected"])

    return mapped(docs, judge, docs.select("doc_id").schema.add("nearest", "string").add("score", "double").add("rejected", "boolean"))


def op1_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(in_training_part(F.col("doc_id"))))
    return identify(docs, model).select(
        "doc_id", (~in_training_part(F.col("doc_id"))).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")
