"""Line dedup against plain Python, and its index after insertions and deletions."""

from collections import defaultdict

import numpy as np
import pytest

from llm import cuckoo, lines
from llm.lines import LineIndex, dedup_lines

LONG = "This Line is long enough to count"
ROWS = [
    (1, f"{LONG}\nfirst\n{LONG}", "a"), (2, f"  {LONG.upper()}\t\nshort\nshort", "b"), (3, f"{LONG}\r\nother", "c"),
    (4, None, "d"), (5, "", "e"), (6, "\n\n", "f"), (7, f"ééééééééééééééééééé\n{'é' * 20}", "g"), (8, f"ééééééééééééééééééé\n{'é' * 20}", "h"),
    (9, f"ééééééééééééééééééé\n{'é' * 20}", "i"), (10, "a line that only two hold\nx", "j"), (11, "a line that only two hold", "k"),
    (None, f"{LONG}\nno id", "l"), (None, f"only rows without an id hold this\n{LONG}", "m"), (None, "only rows without an id hold this", "n"),
    (None, "only rows without an id hold this", "o"), (12, "the same row many times over\n" * 3, "p"), (12, "the same row many times over\n" * 3, "p"),
    (12, "the same row many times over\n" * 3, "p"), (0, "the same row many times over\nend", "q"), (20, "y\n" * 30_000 + LONG, "r"),
]
WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plain(rows):
    holders = defaultdict(list)
    for i, text, _ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(i)
    keep = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, text, n_dropped in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, n_dropped, "\n".join(kept) if text is not None else None, len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def frame(spark, rows):
    # The third column has the name of a result.
    return spark.createDataFrame(rows, "doc_id long, text string, n_dropped string")


def found(df):
    return sorted(((r.row.doc_id, r.row.n_dropped, r.text, r.n_lines, r[3]) for r in df.collect()), key=repr)


def test_dedup(spark):
    assert found(dedup_lines(frame(spark, ROWS))) == plain(ROWS)
    assert dedup_lines(frame(spark, [])).count() == 0


def test_large_shards_are_looked_up_in_lots(spark, monkeypatch):
    """At any size the filters decide what goes on to the exact counts."""
    monkeypatch.setattr(lines, "LOOKED_UP", 2)
    index = LineIndex.of(frame(spark, ROWS), shards=2)
    assert found(dedup_lines(frame(spark, ROWS), index)) == plain(ROWS)
    repeated = index.counts.where("n >= 3").select("hi", "lo")
    went_on = index._maybe_repeated(index.refs)
    assert went_on.join(repeated, ["hi", "lo"]).count() == index.refs.join(repeated, ["hi", "lo"]).count()
    assert went_on.count() < index.refs.count()


def state(index):
    return sorted(map(tuple, index.counts.collect())), {r.shard: (np.frombuffer(r.cells, np.uint16) > 0).sum()
                                                        for r in index.filters.collect() if any(r.cells)}


def test_index_is_reversible(spark):
    part, rest = ROWS[::2], ROWS[1::2]
    one = LineIndex.of(frame(spark, part), shards=3)
    both = one.insert(frame(spark, rest))
    assert state(both) == state(LineIndex.of(frame(spark, ROWS), shards=3))
    assert found(dedup_lines(frame(spark, ROWS), both)) == plain(ROWS)
    fewer = [r for r in ROWS if r[0] not in (3, 20, None)]
    after = both.delete(spark.createDataFrame([(3,), (20,), (None,), (99,)], "doc_id long"))
    assert state(after) == state(LineIndex.of(frame(spark, fewer), shards=3))
    assert found(dedup_lines(frame(spark, fewer), after)) == plain(fewer)


@pytest.mark.parametrize("n", [0, 1, 13, 14, 5000, 60_000])
def test_cuckoo(n):
    keys = np.unique(np.random.default_rng(n).integers(-2 ** 62, 2 ** 62, n))
    cells = cuckoo.unpacked(cuckoo.packed(cuckoo.made(keys)))
    assert cuckoo.holds(cells, keys).all() and (cells > 0).sum() == len(keys)
    others = np.random.default_rng(n + 1).integers(-2 ** 62, 2 ** 62, 20_000)
    assert cuckoo.holds(cells, others).mean() < 0.002
    cuckoo.delete(cells, keys[::3])
    left = np.delete(keys, np.s_[::3])
    assert cuckoo.holds(cells, left).all() and (cells > 0).sum() == len(left)
    assert cuckoo.insert(cells, keys[::3]) and cuckoo.holds(cells, keys).all()
