"""Line-first cleaning against plain Python, rule by rule and for odd tables."""

import re
from collections import Counter

import pytest

from llm.quality import CLOSING, FIGURES, PHRASES, QUOTES, SEPARATORS, clean_lines, fails

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
CLEAN = "\n".join(" ".join(WORDS[(i + 3 * k) % 20] + str(i * k) for i in range(20)) + "." for k in range(1, 5))
ROWS = [
    (1, CLEAN, "a"), (2, None, "b"), (3, "", "c"), (4, "too short.", "d"), (5, CLEAN + "\nHome | About | Contact | Imprint", "e"),
    (6, CLEAN + "\n" + "\n".join("no mark here " * 5 for _ in range(9)), "f"), (7, "same three words " * 40 + ".", "g"),
    (8, CLEAN + "\n\n \n" + CLEAN.split("\n")[0] + "\nAll Rights Reserved.\n", "h"), (9, "# * $ % & | < >\n" + CLEAN, "i"),
    (10, "é ü… " * 30 + "\x85x\x1cy.", "j"), (None, CLEAN, "k"), (1, CLEAN, "a"), (11, (CLEAN + "\n") * 3000, "l"),
    (12, "\r\n".join(CLEAN.split("\n")), "m"), (13, CLEAN.replace(".", ".»") + "\nmenu » menu » menu » end.", "n"),
    (14, "a a a a", "o"), (15, "word " * 100, "p"),
]


def plain_fails(line):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    if not words:
        return False
    closes = [bool(re.search(f"[{CLOSING}][{re.escape(QUOTES)}]*$", w)) for w in words]
    parting = sum(w in SEPARATORS for w in words)
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return (not closes[-1] and sum(closes) * 40 < len(words)) or (parting >= 2 and parting * 5 >= len(words)) \
        or (len(words) < 40 and any(p in lower for p in PHRASES))


def plain(text):
    lines = (text or "").split("\n")
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    worded = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if times[g] > 1 for k in range(3)}
    gone = [x for x in lines if plain_fails(x)]
    lost, chars = sum(len("".join(re.findall(r"[^\x20\x09-\x0D]+", x))) for x in gone), len("".join(words))
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (None if text is None else "\n".join(x for x in lines if not plain_fails(x)), len(words), chars,
            sum(c in "#*$%&|<>" for c in text or ""), len(worded) - len(set(worded)), len(covered), len(gone), lost, base,
            not base and 100 * lost <= 30 * chars)


def test_equals_plain_python(spark):
    # The last column has the name of a figure.
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_words string")
    found = [(r.row.doc_id, r.row.n_words, r.text, *[r[c] for c in FIGURES], r.base_failed, r.kept) for r in clean_lines(docs).collect()]
    assert sorted(found, key=repr) == sorted([(i, other, *plain(text)) for i, text, other in ROWS], key=repr)


@pytest.mark.parametrize("line, bad", [
    ("A sentence ends here.", False), ('He said "so."', False), ("A heading", True), ("Home | News | Contact.", True),
    ("You must enable JavaScript to see this.", True), ("word " * 39 + "mark. " + "word " * 3, True),
    ("word " * 30 + "mark. " + "word " * 3, False), ("", False), (" \t", False), ("either / or, this is fine.", False),
    ("click here " + "and read on " * 20 + ".", False),
])
def test_rules(line, bad):
    assert fails(line.encode()) is bad


def test_verdicts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, other string")
    kept = {r[0]: r[1] for r in clean_lines(docs).select("row.other", "kept").collect()}
    assert kept["a"] and kept["e"] and kept["k"] and kept["l"] is False and kept["f"] is False and kept["g"] is False
    assert not any(kept[x] for x in "bcdop")


def test_empty_table(spark):
    out = clean_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns[:2] == ["row", "text"]
