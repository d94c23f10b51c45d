"""The pipeline's stages on their own inputs against plain Python, and the registered queries against their SQL."""

import os
from fractions import Fraction

import pyarrow.parquet as pq
import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from check_queries import rows  # noqa: E402
from llm.mixing import BLOCK_ROWS, mix  # noqa: E402
from llm.toxicity import score, trained  # noqa: E402

from . import test_lines, test_simhash  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def kept_of(records):
    """(doc_id, text) of those that stay: the least of each class of near copies."""
    records = sorted(set(records), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    fps = [test_simhash.plain(t) for _, t in records]
    root = test_simhash.classes([f - 2 ** 64 if f >> 63 else f for f in fps])
    first = {}
    for r, f in zip(records, fps, strict=True):
        first.setdefault(root[f - 2 ** 64 if f >> 63 else f], r)
    return first.values()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "simhash near dedup", "mixing", "sentencepiece"]
    one = stored(stages["toxicity"](spark, docs, SF), tmp_path / "1")
    model = trained(spark, docs, SF)
    want = {r.row.doc_id for r in score(docs, model).collect() if r.score < corpus_pipeline.TOXIC}
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns
    two = stored(stages["line dedup"](spark, one, SF), tmp_path / "2")
    plain = test_lines.plain([(r.doc_id, r.text, None) for r in one.collect()])
    assert sorted((r.doc_id, r.text) for r in two.collect()) == sorted((i, t) for i, _, t, *_ in plain)
    assert all(r.n_chars == len(r.text) for r in two.collect()) and two.columns == docs.columns
    three = stored(stages["simhash near dedup"](spark, two, SF), tmp_path / "3")
    assert sorted((r.doc_id, r.text) for r in three.collect()) == sorted(kept_of([(r.doc_id, r.text) for r in two.collect()]))
    four = stored(stages["mixing"](spark, three, SF), tmp_path / "4")
    assert {tuple(r) for r in four.collect()} == {tuple(r) for r in three.collect()} and four.columns == docs.columns
    five = stages["sentencepiece"](spark, four, SF).collect()
    assert sorted((r.doc_id, r.text) for r in five) == sorted((r.doc_id, r.text) for r in four.collect())


def test_odd_rows(spark, tmp_path):
    records = [(1, None, "en", "a", None), (2, None, None, None, 0), (None, "one text without an id", "en", "a", 3),
               (None, "one text without an id", "en", "a", 3), (3, "", "en", "b", 0), (4, "same words here", "en", "b", 15),
               (5, "Same  words here", "en", None, 16), (5, "another text of that id", "en", "c", 1), (6, "much longer " * 20_000, "x", "a", 9)]
    docs = stored(spark.createDataFrame(records, "doc_id long, text string, lang string, source string, n_chars long"), tmp_path / "docs")
    found = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = found[name] = stored(stage(spark, docs, SF), tmp_path / str(n))
    assert sorted({(r.doc_id, r.text) for r in found["simhash near dedup"].collect()}, key=repr) == sorted(
        kept_of([r[:2] for r in records]), key=repr)
    assert found["simhash near dedup"].count() == len(kept_of([r[:2] for r in records]))
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[1:]):
        none = stored(stage(spark, none, SF), tmp_path / f"none{n}")
        assert none.count() == 0


def stream(sizes, weights):
    """(source, rank) of every row by earliest deadline first, slot by slot, until all rows have come once."""
    order = sorted(sizes, key=lambda x: (-weights[x], x is not None, x or ""))
    done, out = dict.fromkeys(order, 0), []
    while any(done[s] * BLOCK_ROWS < sizes[s] for s in order):
        slot = len(out) // BLOCK_ROWS
        turn = min((s for s in order if done[s] // weights[s] <= slot), key=lambda s: -(-(done[s] + 1) // weights[s]))
        out += [(turn, k % sizes[turn]) for k in range(done[turn] * BLOCK_ROWS, (done[turn] + 1) * BLOCK_ROWS)]
        done[turn] += 1
    return out


def in_files(path):
    """Rows file by file in the order of the names."""
    return [r for f in sorted(path.glob("part-*.parquet")) for r in pq.read_table(f).to_pylist()]


def test_mixing_keeps_the_stream(spark, tmp_path):
    sizes = {"a": 900, "b": 150, "c": 31, None: 3}
    records = [(1000 * j + i, f"text {j} of {i}", s) for j, (s, n) in enumerate(sizes.items()) for i in range(n)]
    docs = stored(spark.createDataFrame(records, "doc_id long, text string, source string"), tmp_path / "docs")
    weights = {r.source: Fraction(r.weight) for r in mix(docs).select("source", "weight").distinct().collect()}
    want = [1000 * list(sizes).index(s) + i for s, i in stream(sizes, weights)]
    stages = dict(corpus_pipeline.STAGES)
    # Several files, of which a smaller one comes first.
    four = stored(stages["mixing"](spark, docs, SF), tmp_path / "4")
    assert [r["doc_id"] for r in in_files(tmp_path / "4")] == want
    pq_files = tmp_path / "5in"
    cut = [0, 50, 900, len(want)]
    text = {i: t for i, t, _ in records}
    pq_files.mkdir()
    for n, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        spark.createDataFrame([(i, text[i]) for i in want[a:b]], four.select("doc_id", "text").schema).coalesce(1) \
            .write.parquet(str(tmp_path / f"cut{n}"))
        (next((tmp_path / f"cut{n}").glob("part-*.parquet"))).rename(pq_files / f"part-{n:05}.parquet")
    stored(stages["sentencepiece"](spark, spark.read.parquet(str(pq_files)), SF), tmp_path / "5")
    assert [r["doc_id"] for r in in_files(tmp_path / "5")] == want


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


LLM = sorted(set(entry.oracle_sql()) - set(entry.survey_sql()))


@pytest.mark.parametrize("name", LLM)
def test_query_equals_sql(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, cursor.fetchall())


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.columns == ["doc_id", "n_tokens", "token_ids", "text"]
