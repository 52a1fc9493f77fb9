"""A trie of conversations by recursion at half depth.

A trie of height ``2H`` is an upper trie of height ``H`` and, below its cut
nodes, a forest of lower tries of height ``H``. A node at the cut is named by
the name of its trie's root and the name of the block of ``H`` turns between
them; blocks are named by their two halves. So all tries of one height are
worked on at once, from the greatest height down, and a node at depth ``d`` has

    name(d) = H(name(d - b), block of the b turns before d),  b the lowest bit of d.

Names are 128-bit digests: equal prefixes get equal names wherever they are.
Conversations are held in segments of ``SEGMENT`` turns. The recursion runs
over segments in rounds of joins, as many as the logarithm of the longest
conversation's segments, and inside a segment in one task.

Every node belongs to its smallest member. The nodes of one owner form a chain
that ends at the owner's last turn, so a subtree is the rest of the owner's
chain and the whole chains of all other members that hang below. Chain totals
are summed on the chains and then grafted onto the nodes above them, all in
one exchange that adds up before it shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftweave.llm.frequent import met
from draftweave.llm.storage import stored
from draftweave.operators.skew import hot_rows, ranked

#: Turns in a segment, a power of two.
SEGMENT = 256

#: Conversations in a piece of the list of those that end at a node.
ENDS = 1 << 16

#: Conversations that share their opening turns, and most of those turns plus one.
FAMILY, OPENING = 100, 6

_NAME = 16


def _digest(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()[:_NAME]


def _digest_of(body: Column) -> Column:
    """The same digest as a column expression."""
    return F.unhex(F.substring(F.sha2(body, 256), 1, 2 * _NAME))


def opening(conv: Column) -> Column:
    """Turns that a conversation takes over from the first one of its family."""
    return (F.crc32(conv.cast("string").cast("binary")) % OPENING).cast("int")


def units(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their places, ``conv, pos, unit, size``, and the number of turns of each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"),
        _digest_of(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("unit"),
        F.length(text).cast("long").alias("size"),
    )
    counts = stored(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("turns")))
    hot = counts.filter(F.col("turns") > hot_rows(rows.sparkSession)).select("conv")
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("unit").asc()]
    placed = ranked(rows, ["conv"], order, "pos", None if hot.isEmpty() else hot)
    return stored(placed.select("conv", "pos", "unit", "size")), counts


def rebuilt(turns: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that open with the turns of their family's first.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % FAMILY``
    (all if it has fewer, none if there is no such conversation) and goes on
    with its own turns after the ``h``-th.
    """
    first = F.col("conv") - F.col("conv") % FAMILY
    heads = counts.select(F.col("conv").alias("first"), F.col("turns").alias("offered"))
    convs = stored(
        counts.withColumn("first", first).withColumn("h", opening(F.col("conv"))).join(heads, "first", "left")
        .withColumn("taken", F.least("h", F.coalesce("offered", F.lit(0))).cast("long"))
        .select("conv", "first", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("turns") - F.col("h"))).alias("length"))
    )
    own = turns.join(convs.select("conv", "h", "taken"), "conv").filter("pos > h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "unit", "size")
    shared = turns.filter((F.col("conv") % FAMILY == 0) & (F.col("pos") < OPENING)).withColumnRenamed("conv", "first")
    head = shared.join(convs.select("conv", "first", "h"), "first").filter("pos <= h").select("conv", "pos", "unit", "size")
    return own.unionByName(head), convs.select("conv", "length")


def segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv, length, seg, units, sizes``: runs of ``SEGMENT`` turns; a conversation without turns has an empty one."""
    grouped = turns.groupBy("conv", F.floor((F.col("pos") - 1) / SEGMENT).alias("seg")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "unit", "size"))).alias("t"))
    return stored(convs.join(grouped, "conv", "left").select(
        "conv", "length", F.coalesce("seg", F.lit(0).cast("long")).alias("seg"),
        F.coalesce(F.col("t.unit"), F.array().cast("array<binary>")).alias("units"),
        F.coalesce(F.col("t.size"), F.array().cast("array<bigint>")).alias("sizes"),
    ))


def _levels(units: list[bytes]) -> list[list[bytes]]:
    """Names of the whole blocks of 1, 2, 4, … units."""
    levels = [units]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_digest(below[i] + below[i + 1]) for i in range(0, len(below) - 1, 2)])
    return levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [_levels(u)[-1][0] for u in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary())], names=["conv", "i", "block"])


def cut_names(parts: DataFrame, longest: int) -> DataFrame | None:
    """Names of the nodes between segments: ``conv, seg, before, behind`` of every segment that has one.

    Blocks of 1, 2, 4, … whole segments are named first. Then the tries are
    cut, the highest first: each round names the nodes at half depth of all
    tries of one height, of the upper one and the lower ones alike.
    """
    if longest < SEGMENT:
        return None
    whole = parts.filter(F.size("units") == SEGMENT).select("conv", "seg", "units")
    levels = [stored(whole.mapInArrow(_blocks, "conv long, i long, block binary"))]
    while SEGMENT << len(levels) <= longest:
        pairs = levels[-1].groupBy("conv", F.floor(F.col("i") / 2).alias("i")).agg(
            F.min(F.when(F.col("i") % 2 == 0, F.col("block"))).alias("l"), F.min(F.when(F.col("i") % 2 == 1, F.col("block"))).alias("r"))
        levels.append(stored(pairs.filter("l is not null and r is not null").select("conv", "i", _digest_of(F.concat("l", "r")).alias("block"))))
    names = None
    for k in reversed(range(len(levels))):
        left = levels[k].filter("i % 2 = 0").select("conv", F.shiftleft("i", k).alias("at"), "block")
        if names is None:
            root = left.filter("at = 0").withColumn("name", F.lit(b""))
        else:
            root = left.filter("at = 0").withColumn("name", F.lit(b"")).unionByName(left.join(names, ["conv", "at"]))
        made = root.select("conv", (F.col("at") + (1 << k)).alias("at"), _digest_of(F.concat("name", "block")).alias("name"))
        names = stored(made if names is None else names.unionByName(made))
    edges = names.select("conv", F.col("at").alias("seg"), F.col("name").alias("before"), F.lit(None).cast("binary").alias("behind")).unionByName(
        names.select("conv", (F.col("at") - 1).alias("seg"), F.lit(None).cast("binary").alias("before"), F.col("name").alias("behind")))
    return edges.groupBy("conv", "seg").agg(F.min("before").alias("before"), F.min("behind").alias("behind"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of all nodes of each segment, the one it hangs on included."""
    for batch in batches:
        out = []
        for units, before, behind in zip(*(batch.column(i).to_pylist() for i in (3, 5, 6))):
            levels = _levels(units)
            names = [before or b""]
            for d in range(1, len(units) + 1):
                low = d & -d
                k = low.bit_length() - 1
                names.append(_digest(names[d - low] + levels[k][d // low - 1]))
            if behind is not None:
                names[-1] = behind
            out.append(names)
        columns = [batch.column(i) for i in (0, 1, 2, 4)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.binary()))], names=["conv", "length", "seg", "sizes", "names"])


def paths(parts: DataFrame, longest: int) -> DataFrame:
    """``conv, length, seg, sizes, names`` of every segment; ``names`` begins with the node before its first turn."""
    cuts = cut_names(parts, longest)
    if cuts is None:
        parts = parts.withColumn("before", F.lit(None).cast("binary")).withColumn("behind", F.lit(None).cast("binary"))
    else:
        parts = parts.join(cuts, ["conv", "seg"], "left").select("conv", "length", "seg", "units", "sizes", "before", "behind")
    return stored(parts.mapInArrow(_named, "conv long, length long, seg long, sizes array<long>, names array<binary>"))


def nodes(found: DataFrame) -> DataFrame:
    """One row a node: ``name, depth, conv, n_convs, size, parent, inner``; ``inner`` says that it has children."""
    at = F.expr("transform(names, (n, i) -> struct(n as name, i as i, if(i > 0, names[i - 1], null) as parent, if(i > 0, sizes[i - 1], 0L) as size))")
    rows = found.select("conv", "length", "seg", F.explode(at).alias("n")).select(
        "conv", "length", (F.col("seg") * SEGMENT + F.col("n.i")).alias("depth"), "n.*",
    ).filter("i > 0 or seg = 0")
    return stored(rows.groupBy("name").agg(
        F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"),
        F.min("parent").alias("parent"), F.max(F.col("length") > F.col("depth")).alias("inner"),
    ))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node over its pieces in order; a piece at a time is held."""
    node, state = None, None

    def made(names: list[bytes], sums: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sums, pa.string())], names=["name", "ends"])

    for batch in batches:
        names, sums = [], []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if name != node:
                if state is not None:
                    names.append(node)
                    sums.append(state.hexdigest())
                node, state = name, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield made(names, sums)
    if state is not None:
        yield made([node], [state.hexdigest()])


def ends(found: DataFrame) -> DataFrame:
    """``name, ends``: SHA-256 of the ascending ids of the conversations that end at a node.

    Ids go in pieces of a fixed range, so that the list of a node that very
    many conversations share is never held; a digest has to be taken in order.
    """
    last = found.filter((F.col("length") - F.col("seg") * SEGMENT <= SEGMENT) & (F.size("names") == F.col("length") - F.col("seg") * SEGMENT + 1))
    pieces = last.select("conv", F.element_at("names", -1).alias("name")).groupBy("name", F.floor(F.col("conv") / ENDS).alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    return pieces.repartition("name").sortWithinPartitions("name", "piece").mapInArrow(_hashed, "name binary, ends string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``. ``(conv_id, depth)`` is unique.

    Turns are ordered by ``turn``, null first; rows of one turn by role and
    then by a digest of role and text, and repeated rows are turns of their
    own. Null roles and texts are empty ones. Rows without a ``conv_id`` belong
    to no conversation. A conversation left without turns is a member of the
    root only. An empty table has no nodes. Other columns are not looked at. A
    very long text counts by its digest and its length alone; a very long
    conversation is spread over many segments.
    """
    turns, convs = rebuilt(*units(conversations))
    parts = segments(turns, convs)
    longest = parts.agg(F.max("length")).first()[0] or 0
    found = paths(parts, longest)
    tree = nodes(found).withColumn("seg", F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / SEGMENT))
    saved, leaf = (F.col("n_convs") - 1) * F.col("size"), F.when(F.col("inner"), 0).otherwise(1).cast("long")
    valued = tree.withColumn("saved", saved).withColumn("leaves", leaf)
    # The rest of a chain: what follows in the segment, and whole later segments.
    runs = valued.groupBy("conv", "seg").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.min("depth").alias("top"))
    chains = stored(runs)
    later = W.partitionBy("conv").orderBy(F.col("seg").desc()).rowsBetween(W.unboundedPreceding, -1)
    behind = chains.select("conv", "seg", F.sum("l").over(later).alias("later_l"), F.sum("s").over(later).alias("later_s")).filter("later_l is not null")
    inside = W.partitionBy("conv", "seg").orderBy(F.col("depth").desc())
    owned = valued.withColumn("leaves", F.sum("leaves").over(inside)).withColumn("saved", F.sum("saved").over(inside)).join(
        behind, ["conv", "seg"], "left").select(
        "name", "conv", "depth", "n_convs", (F.col("leaves") + F.coalesce("later_l", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("later_s", F.lit(0))).alias("saved"))
    whole = stored(chains.groupBy("conv").agg(F.sum("l").alias("leaves"), F.sum("s").alias("saved"), F.min("top").alias("top")))
    grafted = found.join(whole, "conv").select(
        "leaves", "saved", F.explode(F.expr(f"slice(names, if(seg = 0, 1, 2), greatest(0, cast(least(top - seg * {SEGMENT}, size(names)) as int) - if(seg = 0, 0, 1)))")).alias("name"))
    tops = stored(whole.filter("top > 0").join(tree.select("conv", F.col("depth").alias("top"), "name", "parent"), ["conv", "top"]).select(
        "name", F.col("parent").alias("parent_name")))
    owners = tree.select(F.col("name").alias("parent_name"), F.col("conv").alias("parent_conv"))
    parents = met(tops, owners, "parent_name").select("name", "parent_conv")
    children = tree.filter("parent is not null").select(F.col("parent").alias("name"), F.lit(1).cast("long").alias("children"))

    every = None
    for table in (owned, grafted, parents, children, ends(found)):
        every = table if every is None else every.unionByName(table, allowMissingColumns=True)
    one = every.groupBy("name").agg(
        F.max("conv").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv").alias("parent_conv"), F.max("n_convs").alias("n_convs"),
        F.coalesce(F.sum("children"), F.lit(0)).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        F.coalesce(F.max("ends"), F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
    return one.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv", "conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )
