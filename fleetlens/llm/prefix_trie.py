"""A prefix trie of conversations: double arrays by prefix shard, shared nodes merged, subtree sums over paths.

Rebuilt conversations are cut into segments of SEGMENT turns. Equal segments after an equal prefix become one row, and
segments are dealt to shards by their prefix and first turn, so that a shard's double array holds whole branches; the
branches of a first turn with many segments go to several shards, and their upper nodes are merged afterwards.

A node is named by its smallest member and its depth, so a member's nodes are a path downwards. Sums over a subtree are
sums along paths, plus what other paths add where they leave: one round for each change of path on the way to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Turns of a segment, segments of a shard (about), rows of a window, ids hashed as one piece of text.
SEGMENT, SHARD, SPAN, IDS = 32, 20_000, 4096, 8192
GROUP, MOST_BORROWED = 100, 5


class DoubleArray:
    """A trie in two arrays: the child of slot s by code c is slot base[s] + c, if check there is s. Codes count from 1.

    sequences: lists of codes in sorted order. A node's children take the first place, of TRIES free ones looked at, where
    all fit; else the end. A single child takes the first free slot.
    """

    TRIES = 32

    def __init__(self, sequences: list[list[int]]):
        self.base, self.check, self.free = [0], [0], 1
        level, depth = [(0, 0, len(sequences))], 0
        while level:
            below = []
            for slot, low, high in level:
                while low < high and len(sequences[low]) <= depth:
                    low += 1
                if low == high:
                    continue
                edges, i = [], low
                while i < high:
                    code, start = sequences[i][depth], i
                    while i < high and sequences[i][depth] == code:
                        i += 1
                    edges.append((code, start, i))
                base = self.base[slot] = self._place([e[0] for e in edges])
                for code, start, end in edges:
                    self.check[base + code] = slot
                    below.append((base + code, start, end))
            level, depth = below, depth + 1

    def _place(self, codes: list[int]) -> int:
        while self.free < len(self.check) and self.check[self.free] >= 0:
            self.free += 1
        at, tries, first = self.free, 0, codes[0]
        while at < len(self.check) and tries < self.TRIES:
            if self.check[at] < 0:
                tries += 1
                if all(at - first + c >= len(self.check) or self.check[at - first + c] < 0 for c in codes[1:]):
                    break
            at += 1
        else:
            at = len(self.check)
        more = at - first + codes[-1] + 1 - len(self.check)
        if more > 0:
            self.check += [-1] * more
            self.base += [0] * more
        return at - first

    def child(self, slot: int, code: int) -> int:
        """The child's slot; -1 if there is none."""
        at = self.base[slot] + code
        return at if 0 < at < len(self.check) and self.check[at] == slot else -1

    def walk(self, sequence: list[int]) -> list[int]:
        """Slots of the sequence's prefixes, as far as the trie has them."""
        slots, at = [], 0
        for code in sequence:
            at = self.child(at, code)
            if at < 0:
                break
            slots.append(at)
        return slots


def dense(values: list) -> list[int]:
    """Codes from 1 in the order of first appearance, so that what comes together has codes close together."""
    codes: dict = {}
    return [codes.setdefault(v, len(codes) + 1) for v in values]


NODES = "n1 long, n2 long, q1 long, q2 long, depth long, n_convs long, conv_id long, points long"


def shard_nodes(table: pa.Table) -> pa.Table:
    """Nodes of a shard's segments (p1, p2, block, first_at, keys, z1, z2, points, n, conv_id)."""
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    prefixes = list(zip(columns["block"], columns["p1"], columns["p2"], strict=True))
    order = sorted(range(len(prefixes)), key=lambda i: (prefixes[i], columns["keys"][i]))
    # Siblings get neighbouring codes; a prefix has a code too, as the first symbol.
    codes = dense([("p", prefixes[i]) for i in order])
    symbols: dict[bytes, int] = {}
    start = max(codes, default=0)
    sequences = [[codes[k], *(symbols.setdefault(key, start + len(symbols) + 1) for key in columns["keys"][i])] for k, i in enumerate(order)]
    by_code = sorted(range(len(order)), key=lambda k: sequences[k])
    trie = DoubleArray([sequences[k] for k in by_code])
    size = len(trie.check)
    n, least, seen = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), {}
    for k in by_code:
        i = order[k]
        slots = trie.walk(sequences[k])[1:]
        n[slots] += columns["n"][i]
        least[slots] = np.minimum(least[slots], columns["conv_id"][i])
        a, b = columns["p1"][i], columns["p2"][i]
        for d, slot in enumerate(slots):
            up, a, b = (a, b), a ^ columns["z1"][i][d], b ^ columns["z2"][i][d]
            if slot not in seen:
                seen[slot] = a, b, *up, columns["first_at"][i] + d, columns["points"][i][d]
    slots = list(seen)
    rows = list(zip(*seen.values(), strict=True)) or [()] * 6
    out = {"n1": rows[0], "n2": rows[1], "q1": rows[2], "q2": rows[3], "depth": rows[4], "n_convs": n[slots], "conv_id": least[slots], "points": rows[5]}
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def ranked(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, tie, ...) with place, from 0 within the conversation.

    Rows are sorted in ranges; a conversation that spans ranges goes on where the range before ended (at most one does
    at each range's edge), so no window holds more rows than a range.
    """
    at = F.monotonically_increasing_id()
    rows = common.stored(turns.orderBy("conv_id", F.col("turn").asc_nulls_first(), "tie").withColumn("at", at)).withColumn("part", F.shiftright("at", 33))
    rows = rows.withColumn("inside", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("at")) - 1)
    spans = rows.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("conv_id")
    parts = rows.join(F.broadcast(spans), "conv_id").groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part")
    before = parts.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), (F.sum("n").over(earlier) - F.col("n")).alias("_before"))
    placed = rows.join(F.broadcast(before), (F.col("conv_id") == F.col("_c")) & (F.col("part") == F.col("_p")), "left")
    return placed.withColumn("place", F.col("inside") + F.coalesce("_before", F.lit(0))).drop("at", "part", "inside", "tie", "turn", "_c", "_p", "_before")


def keyed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, tie, key, points; key names role and text, tie orders rows of one turn by role, then text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    narrow = rows.select("conv_id", "turn", key.alias("key"), F.char_length("text").cast("long").alias("points"))
    tied = narrow.groupBy("conv_id", "turn").agg(F.min("key").alias("_a"), F.max("key").alias("_b")).where("_a < _b").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"))
    tied = common.stored(tied)
    if not tied.limit(1).count():
        return narrow.withColumn("tie", F.lit(0).cast("long"))
    met = rows.join(tied, (F.col("conv_id") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left_semi")
    ties = met.select(key.alias("_k"), "role", "text").dropDuplicates(["_k"]).orderBy("role", "text").select("_k", F.monotonically_increasing_id().alias("tie"))
    return narrow.join(common.stored(ties), F.col("key") == F.col("_k"), "left").drop("_k").withColumn("tie", F.coalesce("tie", F.lit(0)))


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its group's first one."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_BORROWED + 1)).cast("int")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns (conv_id, depth, key, points) and members (conv_id, turns) of the conversations as rebuilt.

    Conversation c has the first borrowed(c) turns of conversation c - c % 100, then its own after as many. Rows without
    a conv_id belong to no conversation. A null turn comes first, rows of one turn in the order of role and text;
    repeated rows are turns of their own.
    """
    own = common.stored(ranked(keyed_turns(conversations)))
    heads = own.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < MOST_BORROWED)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("place", "key", "points"))).alias("head"))
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": borrowed(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    head = F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.col("h"))).otherwise(F.col("head"))
    members = convs.join(heads, "base", "left").withColumn("head", F.when((F.col("h") > 0) & F.col("head").isNotNull(), head))
    members = common.stored(members.withColumn("taken", F.coalesce(F.size("head"), F.lit(0)).cast("long")).withColumn("taken", F.greatest("taken", F.lit(0))))
    members = members.withColumn("turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    first = members.where("taken > 0").select("conv_id", "turns", F.posexplode("head").alias("i", "x")).select("conv_id", "turns", (F.col("i") + 1).cast("long").alias("depth"), "x.key", "x.points")
    rest = common.heavy_join(own, members.select("conv_id", "n", "h", "taken", "turns"), ["conv_id"], F.col("place")).where("place >= h")
    rest = rest.select("conv_id", "turns", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), "key", "points")
    return first.unionByName(rest), members.select("conv_id", "turns")


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, block, first_at, p1, p2 (the prefix before it), x1, x2, and by turn keys, z1, z2, points.

    Prefixes are named by the exclusive or of two 64-bit hashes of each turn with its depth.
    """
    z = lambda seed: F.xxhash64(F.lit(seed), "depth", "key")
    rows = turns.withColumns({"z1": z(1), "z2": z(2), "block": F.floor((F.col("depth") - 1) / F.lit(SEGMENT))})
    cut = rows.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("depth", "key", "z1", "z2", "points"))).alias("t"), F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"), F.max("turns").alias("turns")
    )
    cut = cut.select("conv_id", "block", "turns", "x1", "x2", F.col("t")[0]["depth"].alias("first_at"), F.col("t.key").alias("keys"), F.col("t.z1").alias("z1"), F.col("t.z2").alias("z2"), F.col("t.points").alias("points"))
    cut = common.stored(cut)
    short = cut.where(F.col("turns") <= SEGMENT).withColumns({"p1": F.lit(0).cast("long"), "p2": F.lit(0).cast("long")})
    # Of longer ones, the segments before: within a span of blocks, and the spans before it.
    deep = cut.where(F.col("turns") > SEGMENT).withColumn("span", F.floor(F.col("block") / F.lit(SPAN)))
    inside = Window.partitionBy("conv_id", "span").orderBy("block")
    spans = deep.groupBy("conv_id", "span").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    earlier = Window.partitionBy("conv_id").orderBy("span")
    spans = spans.select("conv_id", "span", *[F.bit_xor(s).over(earlier).bitwiseXOR(F.col(s)).alias(s) for s in ("s1", "s2")])
    deep = deep.withColumns({f"p{k}": F.bit_xor(f"x{k}").over(inside).bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)}).join(spans, ["conv_id", "span"])
    deep = deep.withColumns({f"p{k}": F.col(f"p{k}").bitwiseXOR(F.col(f"s{k}")) for k in (1, 2)})
    return short.unionByName(deep.select(*short.columns))


def merged_nodes(cut: DataFrame) -> DataFrame:
    """n1, n2 (the node's name), q1, q2 (its parent's), depth, n_convs, conv_id, points; all nodes but the root."""
    shown = [c for c in ("first_at", "keys", "z1", "z2", "points")]
    alike = cut.groupBy("p1", "p2", "block", "x1", "x2").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in shown])
    alike = common.stored(alike.withColumn("first_key", F.col("keys")[0]))
    branch = ["p1", "p2", "block", "first_key"]
    sizes = common.stored(alike.groupBy(*branch).agg(F.count("*").alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    apart = F.when(F.col("size") > SHARD // 4, F.xxhash64(*branch, "x1", "x2")).otherwise(F.xxhash64(*branch))
    dealt = common.heavy_join(alike, sizes, branch, F.col("x1"), count="size", total=total).withColumn("shard", F.pmod(apart, F.lit(shards)))
    dealt = dealt.select("shard", "p1", "p2", "block", "first_at", "keys", "z1", "z2", "points", "n", "conv_id")
    found = dealt.groupBy("shard").applyInArrow(shard_nodes, NODES)
    return found.groupBy("n1", "n2", "depth").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in ("q1", "q2", "points")])


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (e1, e2, conv_id) -> e1, e2, first_id, ids: runs of at most IDS decimal ids, joined by commas."""
    for batch in batches:
        e1, e2, ids = (batch.column(k).to_numpy() for k in range(3))
        new = np.flatnonzero(np.concatenate([[True], (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])])) if len(ids) else np.array([], np.int64)
        cuts = [k for a, b in zip(new, [*new[1:], len(ids)], strict=True) for k in range(a, b, IDS)]
        texts = [",".join(map(str, ids[a:b].tolist())).encode() for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(e1[cuts]), pa.array(e2[cuts]), pa.array(ids[cuts]), pa.array(texts, pa.binary())], ["e1", "e2", "first_id", "ids"])


def hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order (e1, e2, first_id, ids) -> e1, e2, ends_sha256 of each group's ids; a hash goes on from run to run."""
    key, hash_ = None, None

    def out(rows: list) -> pa.RecordBatch:
        a, b, c = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], ["e1", "e2", "ends_sha256"])

    for batch in batches:
        rows = []
        for e1, e2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (e1, e2) == key:
                hash_.update(b"," + ids)
            else:
                if key:
                    rows.append((*key, hash_.hexdigest()))
                key, hash_ = (e1, e2), hashlib.sha256(ids)
        if rows:
            yield out(rows)
    if key:
        yield out([(*key, hash_.hexdigest())])


def ends(cut: DataFrame, members: DataFrame) -> DataFrame:
    """n1, n2, ends_sha256 of the conversations whose last turn is the node's."""
    last = cut.groupBy("conv_id").agg(F.bit_xor("x1").alias("e1"), F.bit_xor("x2").alias("e2")).select("e1", "e2", "conv_id")
    none = members.where("turns = 0").select(F.lit(0).cast("long").alias("e1"), F.lit(0).cast("long").alias("e2"), "conv_id")
    runs = last.unionByName(none).orderBy("e1", "e2", "conv_id").mapInArrow(joined_ids, "e1 long, e2 long, first_id long, ids binary")
    by_group = runs.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "first_id")
    return by_group.mapInArrow(hashed_ids, "e1 long, e2 long, ends_sha256 string").withColumnsRenamed({"e1": "n1", "e2": "n2"})


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with n_children and parent_conv_id. Only a path's top has another parent than its own member."""
    below = nodes.where("depth > 0").groupBy(F.col("q1").alias("n1"), F.col("q2").alias("n2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = common.stored(nodes.join(below, ["n1", "n2", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    tops = nodes.groupBy("conv_id").agg(F.min_by(F.struct("depth", "q1", "q2"), "depth").alias("x")).select("conv_id", "x.*").where("depth > 0")
    owners = nodes.where("n_children > 0").select(F.col("n1").alias("q1"), F.col("n2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"), "n_children")
    found = common.heavy_join(tops, owners, ["q1", "q2", "depth"], F.col("conv_id"), count="n_children")
    found = common.stored(found.select("conv_id", F.col("depth").alias("top"), "parent"))
    out = nodes.join(found.withColumnRenamed("top", "depth"), ["conv_id", "depth"], "left")
    return out.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))).drop("parent"), found


def with_subtrees(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """nodes with n_leaves and saved_tokens of their subtrees. tops: conv_id, top, parent of each path but the root's."""
    sums = ["n_leaves", "saved_tokens"]
    own = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("points")})
    total = lambda rows, *by: rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
    paths = tops.select("conv_id", F.col("parent").alias("up"), (F.col("top") - 1).alias("at"))
    # What a path's whole subtree adds, arrives at the paths above it round by round.
    now, arrived = common.stored(total(total(own, "conv_id").join(paths, "conv_id"), "up", "at")), []
    while now.limit(1).count():
        arrived.append(now)
        above = total(now.withColumnRenamed("up", "conv_id"), "conv_id")
        now = common.stored(total(above.join(paths, "conv_id"), "up", "at"))
    rows = own
    for k in arrived:
        rows = rows.select("conv_id", "depth", *sums).unionByName(k.select(F.col("up").alias("conv_id"), F.col("at").alias("depth"), *sums))
    value = common.stored(total(rows, "conv_id", "depth").withColumn("span", F.floor(F.col("depth") / F.lit(SPAN))))
    down = F.col("depth").desc()
    inside = value.select("conv_id", "depth", "span", *[F.sum(c).over(Window.partitionBy("conv_id", "span").orderBy(down)).alias(c) for c in sums])
    # Spans further down the path.
    later = total(value.where("span > 0"), "conv_id", "span")
    later = later.select("conv_id", (F.col("span") - 1).alias("span"), *[F.sum(c).over(Window.partitionBy("conv_id").orderBy(F.col("span").desc())).alias(f"_{c}") for c in sums])
    whole = inside.join(later, ["conv_id", "span"], "left").select("conv_id", "depth", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums])
    return nodes.join(whole, ["conv_id", "depth"])


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the root's too: conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty. See rebuilt() for null ids, null and tied turns and repeated rows. A conversation
    that is left without turns is a member of the root. A table without conversations has no nodes. Columns beside
    conv_id, turn, role and text do not count. A conversation or a first turn may hold any share of the rows.
    """
    turns, members = rebuilt(conversations)
    cut = common.stored(segments(turns))
    zero = F.lit(0).cast("long")
    root = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("n1"), zero.alias("n2"), zero.alias("depth"), "n_convs", "conv_id", zero.alias("q1"), zero.alias("q2"), zero.alias("points"))
    nodes, tops = with_parents(common.stored(merged_nodes(cut).unionByName(root)))
    nodes = with_subtrees(common.stored(nodes), tops)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = nodes.join(ends(cut, members), ["n1", "n2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(common.table(spark, sf_dir, "conversations"))


#: The group size, the divisor of crc32 and its polynomial stand as in the query.
OP12_SQL = """
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({'r': r, 't': t} ORDER BY i) AS a, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, i::INT, 1))::BIGINT)),
        lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 6 AS h FROM o GROUP BY c),
m AS (SELECT l.c, list_concat(coalesce(b.a[1:l.h], []), l.a[l.h + 1:]) AS s FROM l LEFT JOIN l b ON b.c = l.c - l.c % 100),
p AS (SELECT c, len(s) AS n, d AS depth, s[1:d] AS p, s[1:d - 1] AS up, CASE WHEN d > 0 THEN length(s[d].t) ELSE 0 END AS points FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM m)),
g AS (SELECT p, depth, any_value(up) AS up, any_value(points) AS points, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256 FROM p GROUP BY p, depth),
k AS (SELECT up AS p, depth - 1 AS depth, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (p, depth)),
a AS (SELECT p, depth, unnest(range(depth + 1)) AS e, n_children = 0 AS leaf, (n_convs - 1) * points AS saved FROM v),
t AS (SELECT p[1:e] AS p, e AS depth, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY ALL)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, t.n_leaves, t.saved_tokens, v.ends_sha256
FROM v JOIN t ON t.p = v.p AND t.depth = v.depth LEFT JOIN g u ON v.depth > 0 AND u.p = v.up AND u.depth = v.depth - 1
"""
