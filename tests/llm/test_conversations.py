"""The prefix trie against plain Python, with shards of a few nodes and queues that spill."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from llm.conversations import prefix_trie
from llm.spilling import SpillingQueue


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.blake2b(b"%d:%b%b" % (len(role.encode()), role.encode(), text.encode()), digest_size=16).digest()
            # Ties of a turn: by role, then by the hash of the text.
            halves = [int.from_bytes(digest[i:i + 8]) % (2**61 - 1) for i in (0, 8)]
            own[conv].append((turn is not None, turn or 0, role.encode(), halves, (role, text)))
    own = {c: [x[4] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in sorted(rebuilt.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        words = (len(m) - 1) * len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += words
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if len(rebuilt[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def found(spark, rows, **settings):
    # The last columns have names of the result.
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, part int")
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie(frame, **settings).collect())


def random_rows(seed, convs=90):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        n = rng.choice([0, 1, 2, 3, 5, 9])
        rows += [(c, t, "user" if t % 2 == 0 else "bot", rng.choice(["hi there", "yes", "no no no", "a b c d"])) for t in range(n)]
    return rows


ODD = [
    (None, 0, "user", "no conversation"), (-25, 1, "user", "below zero"), (-20, 0, "user", "its base"), (-20, 1, "user", "more"),
    (500, None, None, None), (500, 2, "user", ""), (500, 2, "user", "tie one"), (500, 2, "bot", "tie two"), (500, 2, "user", "tie one"),
    (501, 0, "user", "é \x85 ü\tx"), (502, 0, "us", "erx"), (503, 0, "use", "rx"),
]


@pytest.mark.parametrize("seed, most", [(1, 2), (2, 1 << 17)])
def test_equals_plain_python(spark, seed, most):
    rows = random_rows(seed) + ODD
    random.Random(seed).shuffle(rows)
    assert found(spark, rows, most=most) == plain(rows)


def test_one_conversation_and_one_crowd_hold_most_rows(spark):
    """A conversation over all shards, with branches off it, and copies of a few turns."""
    rows = [(40, t, "user", f"turn {t} of many") for t in range(300)]
    rows += [(c, t, "user", f"turn {t} of many") for c in range(41, 47) for t in range(40 * (c - 40))] + [(c, 900, "user", "end") for c in range(41, 47)]
    rows += [(c, t, "user", "the same") for c in range(100, 220) for t in range(5)]
    # More partitions than the session has otherwise, so that prefixes span several.
    spark.conf.set("spark.sql.shuffle.partitions", 11)
    try:
        assert found(spark, rows, most=4) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_without_conversations(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []


def test_conversations_without_turns_meet_in_the_root(spark):
    rows = [(c, 0, "user", "one turn") for c in range(1, 30) if c % 20]
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in plain(rows))
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("seed", range(5))
def test_spilling_queue(seed):
    rng, kept = random.Random(seed), []
    queue = SpillingQueue(rng.choice([2, 3, 50]))
    for _ in range(30_000):
        if kept and rng.random() < 0.4:
            assert queue.peek() == min(kept)
            kept.remove(queue.pop())
        elif len(kept) < 300:
            kept.append((rng.randrange(50), rng.random()))
            queue.push(kept[-1])
    assert [queue.pop() for _ in range(len(kept))] == sorted(kept) and not queue
    assert queue.spilled > 0
