"""The trie of conversation prefixes, its subtree totals by time-forward processing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, ranked, slices, stored, table
from .spilling import SpillingQueue

#: Conversations that share their first turns, and the number of first turns goes below this.
GROUP, HEADS = 20, 4
#: Prefixes are told apart by two sums of powers of these modulo a prime; the terms are strong hashes of the turns.
PRIME, BASES = (1 << 61) - 1, (0x0BADC0DE5EEDF00D, 0x1234567890ABCDE1)
#: First prefixes by which the nodes are put in order, so that a shard holds whole subtrees as far as possible.
NEAR = 4
#: Messages of a queue that are held in memory, and ids that are joined to one text at a time.
MOST, JOINED = 1 << 17, 1 << 12

LOWEST = -1
PREFIXES = [f"near{k}" for k in range(1, NEAR + 1)]
NODE = ["depth", "q1", "q2"]


def _turn_hashes(conversations: DataFrame) -> DataFrame:
    def read(batches):
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            roles = batch.column("role").cast(pa.binary()).to_pylist()
            digests = [hashlib.blake2b(b"%d:%b%b" % (len(r), r, t), digest_size=16).digest() for r, t in zip(roles, texts, strict=True)]
            hashes = [pa.array([int.from_bytes(d[i:i + 8]) % PRIME for d in digests], pa.int64()) for i in (0, 8)]
            words = pa.array([len(t.split()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), *hashes, words],
                                             ["conv_id", "turn", "role", "h1", "h2", "words"])

    schema = conversations.select("conv_id", "turn", "role").schema
    return mapped(conversations, read, schema.add("h1", "long").add("h2", "long").add("words", "long"))


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations by depth, and each conversation's ``length`` when rebuilt.

    A turn's place in its own conversation is its place in a range of all turns
    plus what earlier ranges hold of the conversation, however long it is.
    """
    rows, _ = ranked(turns, "conv_id", "turn", "role", "h1", "h2")
    runs = rows.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("part", "conv_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = Window.partitionBy("part", "conv_id").orderBy("turn", "role", "h1", "h2", "tie")
    placed = stored(rows.withColumn("nth", F.row_number().over(place)).join(before, ["part", "conv_id"]).select(
        "conv_id", (F.col("nth") + F.col("before")).alias("nth"), "h1", "h2", "words"))

    own = runs.groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = own.withColumn("base", F.expr(f"conv_id - conv_id % {GROUP}")) \
        .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    sizes = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stored(convs.join(sizes, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0)))).select(
        "conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    what = ["conv_id", "depth", "h1", "h2", "words", (F.col("depth") == F.col("length")).alias("last")]
    tails = placed.join(convs, "conv_id").where("nth > h").withColumn("depth", F.col("nth") - F.col("h") + F.col("head")).select(*what)
    # A base's first turns go to the few conversations of its group.
    first = placed.where(F.col("nth") < HEADS).select(F.col("conv_id").alias("base"), F.col("nth").alias("depth"), "h1", "h2", "words")
    heads = first.join(convs, "base").where("depth <= head").select(*what)
    return heads.unionByName(tails), convs.select("conv_id", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with the prefix before it (p1, p2) and with it (q1, q2), and its first ``NEAR`` prefixes.

    Sums run inside ranges of (conversation, depth); what a conversation has in
    earlier ranges is added for the first run of a range.
    """
    def read(batches):
        conv = near = None
        p, power = [0, 0], [0, 0]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "depth", "h1", "h2")]
            out = []
            for c, depth, *h in zip(*columns, strict=True):
                if c != conv:
                    conv, near, p = c, [LOWEST] * NEAR, [0, 0]
                    power = [pow(b, depth, PRIME) for b in BASES]
                q = [(p[i] + h[i] * power[i]) % PRIME for i in (0, 1)]
                if depth <= NEAR:
                    near[depth - 1] = q[0]
                out.append((*p, *q, *near))
                p, power = q, [power[i] * BASES[i] % PRIME for i in (0, 1)]
            kept = [batch.column(c) for c in ("conv_id", "depth", "words", "last", "part")]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x, pa.int64()) for x in zip(*out, strict=True)]],
                                             ["conv_id", "depth", "words", "last", "part", *names])

    names = ["p1", "p2", "q1", "q2", *PREFIXES]
    sums = ", ".join(f"{n} long" for n in names)
    rows = turns.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth").withColumn("part", F.spark_partition_id())
    rows = stored(rows.mapInArrow(lambda batches: read(b for b in batches if b.num_rows),
                                  f"conv_id long, depth long, words long, last boolean, part int, {sums}"))
    # Only the first conversation of a range can have begun in an earlier one: one row for each range at most.
    runs = rows.groupBy("part", "conv_id").agg(
        F.min("depth").alias("start"), F.max_by("q1", "depth").alias("t1"), F.max_by("q2", "depth").alias("t2"),
        *[F.max(F.when(F.col("depth") >= k, F.col(f"near{k}"))).alias(f"near{k}") for k in range(1, NEAR + 1)])
    conv = Window.partitionBy("conv_id").orderBy("part")
    earlier = conv.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("begun", F.max("start").over(Window.partitionBy("conv_id")) > 1).where("begun")
    for i in (1, 2):
        runs = runs.withColumn(f"o{i}", F.coalesce(F.sum(F.col(f"t{i}").cast("decimal(38,0)")).over(earlier), F.lit(0)) % PRIME)
    for k in range(1, NEAR + 1):
        own = F.when(F.col(f"near{k}") != LOWEST, (F.col(f"near{k}") + F.col("o1")) % PRIME)
        runs = runs.withColumn(f"e{k}", F.first(own, ignorenulls=True).over(conv.rowsBetween(Window.unboundedPreceding, 0)))
    late = runs.where("start > 1").select("part", "conv_id", "o1", "o2", *[f"e{k}" for k in range(1, NEAR + 1)])
    rows = rows.join(F.broadcast(late), ["part", "conv_id"], "left")

    def moved(name):
        return F.coalesce(((F.col(name) + F.col(f"o{name[1]}")) % PRIME).cast("long"), F.col(name)).alias(name)

    near = [F.when(F.col("o1").isNull() | (F.col("depth") < k), F.col(f"near{k}")).otherwise(F.col(f"e{k}").cast("long")).alias(f"near{k}")
            for k in range(1, NEAR + 1)]
    return stored(rows.select("conv_id", "depth", "words", "last", *map(moved, ("p1", "p2", "q1", "q2")), *near))


def _ends(members: DataFrame) -> DataFrame:
    """SHA-256 of each node's ``conv_id`` s in order: ids are joined where they lie, and the joined texts meet in order."""
    def join(batches):
        rows = (row for b in batches for row in zip(*[b.column(c).to_pylist() for c in (*NODE, "conv_id")], strict=True))
        out = []
        for node, group in groupby(rows, lambda r: r[:3]):
            ids = [r[3] for r, _ in zip(group, range(JOINED), strict=False)]
            while ids:
                out.append((*node, ids[0], ",".join(map(str, ids))))
                if len(out) == JOINED // 16:
                    yield _batch(out, [*NODE, "first", "ids"])
                    out = []
                ids = [r[3] for r, _ in zip(group, range(JOINED), strict=False)]
        if out:
            yield _batch(out, [*NODE, "first", "ids"])

    def hashed(batches):
        rows = (row for b in batches for row in zip(*[b.column(c).to_pylist() for c in (*NODE, "ids")], strict=True))
        out = []
        for node, group in groupby(rows, lambda r: r[:3]):
            digest, comma = hashlib.sha256(), b""
            for r in group:
                digest.update(comma + r[3].encode())
                comma = b","
            out.append((*node, digest.hexdigest()))
            if len(out) == JOINED:
                yield _batch(out, [*NODE, "ends_sha256"])
                out = []
        if out:
            yield _batch(out, [*NODE, "ends_sha256"])

    order = [*NODE, "conv_id"]
    texts = members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        join, "depth long, q1 long, q2 long, first long, ids string")
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        hashed, "depth long, q1 long, q2 long, ends_sha256 string")


def _batch(rows, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


class Forward:
    """Time-forward processing of one forest whose nodes come in reverse level order, children before parents.

    A node adds up the messages for it and sends the totals on to its parent
    through the queue.  Messages for nodes that never came have left the forest.
    Tags of nodes travel along.
    """

    def __init__(self, most: int):
        self.queue, self.sent = SpillingQueue(most), 0

    def node(self, key, leaves: int, saved: int, parent, tag=None):
        """The totals of the node, and the messages that turn out to have left."""
        left, tags = list(self.left(key)), [] if tag is None else [tag]
        while self.queue and self.queue.peek()[0] == key:
            _, _, more, words, others = self.queue.pop()
            leaves, saved = leaves + more, saved + words
            tags += others
        if parent is not None:
            self.sent += 1
            self.queue.push((parent, self.sent, leaves, saved, tags))
        return leaves, saved, left

    def left(self, before=None) -> Iterator[tuple]:
        """Messages to nodes before ``before``, or all that are there; those for the same node without tags as one."""
        whole = None
        while self.queue and (before is None or self.queue.peek()[0] < before):
            to, _, leaves, saved, tags = self.queue.pop()
            if tags:
                yield to, leaves, saved, tags
            elif whole and whole[0] == to:
                whole = (to, whole[1] + leaves, whole[2] + saved, [])
            else:
                if whole:
                    yield whole
                whole = (to, leaves, saved, [])
        if whole:
            yield whole


def _in_shards(tree: DataFrame) -> DataFrame:
    return tree.repartition("part").sortWithinPartitions("part", F.desc("depth"), "conv_id")


def _messages(tree: DataFrame, most: int) -> DataFrame:
    """What leaves each shard: the totals of its topmost nodes for their parents, and the ports below them.

    A port is a node with children in other shards, whose totals are to come.
    """
    def read(batches):
        part, work, out = None, None, []

        def sent(messages):
            out.extend((to[1], -to[0], leaves, saved, tags) for to, leaves, saved, tags in messages)

        def packed():
            ports = pa.array([[{"conv_id": -1 if c is None else c, "depth": d} for c, d in r[4]] for r in out], PORTS)
            numbers = [pa.array([r[i] for r in out], pa.int64()) for i in range(4)]
            out.clear()
            return pa.RecordBatch.from_arrays([*numbers, ports], ["conv_id", "depth", "leaves", "saved", "ports"])

        for batch in batches:
            columns = ("part", "conv_id", "depth", "parent_conv_id", "leaves", "saved", "port")
            for p, conv, depth, parent, leaves, saved, port in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                if p != part:
                    sent(work.left() if work else ())
                    part, work = p, Forward(most)
                up = None if parent is None else (1 - depth, parent)
                sent(work.node((-depth, conv), leaves, saved, up, (conv, depth) if port else None)[2])
                if len(out) >= JOINED:
                    yield packed()
        sent(work.left() if work else ())
        if out:
            yield packed()

    kind = "conv_id long, depth long, leaves long, saved long, ports array<struct<conv_id: long, depth: long>>"
    return _in_shards(tree.select("part", "conv_id", "depth", "parent_conv_id", "leaves", "saved", "port")).mapInArrow(read, kind)


PORTS = pa.list_(pa.struct([("conv_id", pa.int64()), ("depth", pa.int64())]))


def _across(messages: DataFrame, most: int) -> DataFrame:
    """What each port gets in all from other shards.

    The tree of what lies between: a port hands what it gets to the topmost
    node of its shard above it, and that node, with its own totals, to a port of
    another shard.  Topmost nodes without ports are done: their totals are added
    up for each port first.  What is left are the ports and the topmost nodes
    above them, which one task takes as a sorted stream.
    """
    messages = messages.withColumn("id", F.monotonically_increasing_id())
    messages = stored(messages)
    upper = messages.where(F.size("ports") > 0)
    owner = upper.select(F.explode("ports").alias("port"), "id", (F.col("depth") + 1).alias("to_depth")).select(
        "port.conv_id", "port.depth", F.col("id").alias("to_id"), "to_depth")
    plain = messages.where(F.size("ports") == 0).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    ports = messages.select("conv_id", "depth").distinct().join(plain, ["conv_id", "depth"], "left") \
        .join(owner, ["conv_id", "depth"], "left").select(
        "depth", F.lit(0).alias("kind"), F.col("conv_id").alias("id"), F.coalesce("leaves", F.lit(0)).alias("leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved"), "to_depth", "to_id")
    tops = upper.select((F.col("depth") + 1).alias("depth"), F.lit(1).alias("kind"), "id", "leaves", "saved",
                        F.col("depth").alias("to_depth"), F.col("conv_id").alias("to_id"))

    def read(batches):
        work = Forward(most)
        for batch in batches:
            out = []
            columns = ("depth", "kind", "id", "leaves", "saved", "to_depth", "to_id")
            for depth, kind, name, leaves, saved, to_depth, to_id in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                to = None if to_id is None else (-to_depth, 1 - kind, to_id)
                leaves, saved, _ = work.node((-depth, kind, name), leaves, saved, to)
                if kind == 0:
                    out.append((name, depth, leaves, saved))
            if out:
                yield _batch(out, ["conv_id", "depth", "more_leaves", "more_saved"])

    between = ports.unionByName(tops).repartition(1).sortWithinPartitions(F.desc("depth"), "kind", "id")
    return between.mapInArrow(read, "conv_id long, depth long, more_leaves long, more_saved long")


def _totals(tree: DataFrame, most: int) -> DataFrame:
    """The shards once more, now with what ports get from other shards: every node's totals."""
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256"]

    def read(batches):
        part = work = None
        for batch in batches:
            totals = []
            columns = ("part", "conv_id", "depth", "parent_conv_id", "leaves", "saved")
            for p, conv, depth, parent, leaves, saved in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                if p != part:
                    part, work = p, Forward(most)
                totals.append(work.node((-depth, conv), leaves, saved, None if parent is None else (1 - depth, parent))[:2])
            if totals:
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in kept], *[pa.array(x, pa.int64()) for x in zip(*totals, strict=True)]],
                    [*kept, "n_leaves", "saved_tokens"])

    schema = tree.select(*kept).schema.add("n_leaves", "long").add("saved_tokens", "long")
    return _in_shards(tree).mapInArrow(read, schema)


def prefix_trie(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """The trie of the rebuilt conversations' prefixes, one row a node.

    Conversation c is rebuilt from the first h turns of conversation c - c % 20
    and its own turns after its first h, with h the unsigned crc32 of c as text
    modulo 4.  A node is a sequence of first turns (role and text) that some
    rebuilt conversation has; that conversation is a member.  A node is named by
    its smallest member and its depth, which no other node has both of.

    Prefixes are compared by two 61-bit sums over strong hashes of their turns,
    which add up over ranges of a conversation however long it is.  Subtree
    totals: nodes, put in order of their first prefixes, are dealt into shards
    of equal size, which hold whole subtrees but for their borders.  In a shard
    the nodes are sorted by reverse level order and each sends its totals to its
    parent through a priority queue that holds ``most`` messages in memory and
    spills the rest.  Totals for parents in other shards are passed on
    across the shards' topmost nodes, and the shards go through once more with them.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs`` (members), ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256`` (of the members that end here).

    A null turn comes first; turns that tie are ordered by role and hash of the
    text, and a null role or text is an empty one.  Rows without a ``conv_id``
    belong to no conversation and are left out.  Repeated rows are turns of
    their own.  Other columns are not looked at.  Without conversations there
    are no rows, not even the root.
    """
    empty = F.lit("")
    turns = _turn_hashes(conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), "turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text")))
    rebuilt, convs = _rebuilt(turns)
    rows = _prefixes(rebuilt)
    top = [F.lit(0).cast("long").alias(c) for c in ("depth", "q1", "q2")]
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        *top, "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), *[F.lit(LOWEST).cast("long").alias(c) for c in ("p1", "p2", *PREFIXES)])
    nodes = stored(rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        *[F.max(c).alias(c) for c in ("p1", "p2", *PREFIXES)]).unionByName(root))
    members = rows.where("last").select(*NODE, "conv_id").unionByName(convs.where("length = 0").select(*top, "conv_id"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    near = [*PREFIXES, "conv_id", "depth"]
    tree = stored(nodes.join(_ends(members), NODE, "left").join(parents, ["depth", "p1", "p2"], "left").select(
        *near, "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
        .repartitionByRange(*near).drop(*PREFIXES).withColumn("part", F.spark_partition_id()))
    children = tree.where(F.col("parent_conv_id").isNotNull()).groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"), F.min("part").alias("low"), F.max("part").alias("high"))
    tree = stored(tree.join(children, ["conv_id", "depth"], "left").select(
        "part", "conv_id", "depth", "parent_conv_id", "n_convs", "saved", "ends_sha256",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        F.coalesce((F.col("low") != F.col("part")) | (F.col("high") != F.col("part")), F.lit(False)).alias("port")))
    more = stored(_across(_messages(tree, most), most))
    whole = tree.join(more, ["conv_id", "depth"], "left") \
        .withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")})
    return _totals(whole, most).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_conversations(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: The checksum is taken byte by byte with a 256-entry table that is made from its polynomial.
OP12_SQL = f"""
WITH RECURSIVE steps(n, c, k) AS (
    SELECT n, n, 0 FROM range(256) r(n)
    UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
lookup AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS r, coalesce(role, '') AS role,
    coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, xor(list_reduce(list_prepend(4294967295::bigint,
        list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM own), lookup),
heads AS (SELECT c.conv_id, r AS d, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND r <= h),
sizes AS (SELECT c.conv_id, h, count(d) AS m FROM convs c LEFT JOIN heads USING (conv_id) GROUP BY c.conv_id, h),
rebuilt AS (SELECT * FROM heads UNION ALL
    SELECT conv_id, r - h + m, role, text FROM own JOIN sizes USING (conv_id) WHERE r > h),
paths AS (SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS p
    FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
prefixes AS (SELECT conv_id, len(p) AS n, d, p[1:d] AS p FROM paths, LATERAL unnest(range(0, len(p) + 1)) u(d)),
nodes AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[-1].text, '[^\\x20\\x09-\\x0D]+')) END AS words FROM prefixes GROUP BY d, p),
links AS (SELECT n.d, n.conv_id, n.n_convs, n.words, n.ends_sha256, n.p, a.conv_id AS parent_conv_id
    FROM nodes n LEFT JOIN nodes a ON a.d = n.d - 1 AND a.p = n.p[1:n.d - 1]),
counted AS (SELECT l.*, coalesce(k, 0) AS n_children FROM links l LEFT JOIN
    (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS k FROM links WHERE d > 0 GROUP BY ALL) c ON c.conv_id = l.conv_id AND c.d = l.d),
subtrees AS (SELECT a AS d, p[1:a] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
    FROM counted, LATERAL unnest(range(0, d + 1)) u(a) GROUP BY ALL)
SELECT conv_id, c.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::bigint AS saved_tokens, ends_sha256
FROM counted c JOIN subtrees s ON s.d = c.d AND s.p = c.p"""
