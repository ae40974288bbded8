"""Conversation prefix trie: every shared beginning of conversations, counted by ROLLUP over positional turn columns.

A turn is known by its digest (role and text) and its bytes. Turns are numbered inside their conversation by places in a
range partition, so that a conversation of very many turns is spread over tasks. Equal conversations become one weighted
sequence. Sequences are laid out in blocks of ``WIDTH`` columns; one ROLLUP over these columns, with grouping_id, gives all
nodes of a block at once, and a block continues below the node at which the block before it ended. Only sequences that
still share their node go on to the next block: below the last shared node a sequence is alone, and its nodes follow from
itself, without grouping. A node is named by its depth and its smallest member.

A first ROLLUP finds that member for each node, and so for each sequence c the depth s from which it is the smallest one
and the node it branches from. Then every sum over a subtree is a plain sum over members, which a second ROLLUP takes for
all blocks together: with B(c, d) the bytes of c's first d turns and m the node's smallest member, the saved bytes below a
node at depth d are the sum of B(c, s_c - 1) over all members c but m, less (members - 1) * B(m, d - 1).

The lists of members that end at a node are digested in order: range-sorted, joined to texts of bounded length, and these
read in order by one hash a node, a batch at a time.

Rows without a conv_id are left out; null turns come first; rows that repeat a turn number are ordered by the turn's
digest; null roles and texts are empty. No rows give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import join_counted, shuffle_partitions, written

#: Columns of a block, the longest beginning that can come from another conversation, and how many conversations share one donor.
WIDTH, HEADS, FAMILY = 16, 8, 5
#: Turns of a conversation that a task handles together, and ids of a joined text.
STRETCH, CHUNK = 1 << 15, 1 << 13
EMPTY = hashlib.sha256(b"").hexdigest()
TURN = "struct<id:binary,bytes:long>"


def numbered_turns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, part, place, turn), (conv, part, before, last)): a turn's number is before + place; runs jobs.

    ``before`` counts the conversation's turns in earlier partitions, less the place of its first turn in this one; ``last``
    is the number of its turns. Joins by (conv, part) meet a conversation's turns partition by partition.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"),
        F.struct(F.unhex(F.substring(mark, 1, 32)).alias("id"), F.octet_length(text).cast("long").alias("bytes")).alias("turn"))
    order = [F.col("conv"), F.col("at").asc_nulls_first(), F.col("turn")]
    placed = turns.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id())
    placed = written(placed.select("conv", F.shiftright("n", 33).alias("part"), F.col("n").bitwiseAND((1 << 33) - 1).alias("place"), "turn"), "turns")
    runs = placed.groupBy("conv", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # A conversation has at most a run for each partition.
    w = "partition by conv order by part"
    runs = runs.select("conv", "part", F.expr(f"sum(n) over ({w}) - n + 1 - first").alias("before"), F.expr("sum(n) over (partition by conv)").alias("last"))
    return placed, written(runs, "runs")


def rebuilt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, pos, turn), (conv, len)): conversations that begin with turns of their family's first one; runs jobs."""
    placed, runs = numbered_turns(df)
    family = F.col("conv") - F.col("conv") % FAMILY
    own = F.col("conv") == family
    taken = F.when(own, 0).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % (HEADS + 1)).cast("int")
    heads = runs.where(own).join(placed, ["conv", "part"]).where(F.col("before") + F.col("place") <= HEADS)
    heads = heads.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct((F.col("before") + F.col("place")).alias("pos"), "turn"))).alias("heads"))  # HEADS turns at most
    convs = runs.select("conv", "last").distinct().withColumn("h", taken).join(heads.select(F.col("conv").alias("donor"), "heads"), (F.col("donor") == family) & (F.col("h") > 0), "left")
    got = F.least("h", F.coalesce(F.size("heads"), F.lit(0)))
    convs = convs.select("conv", "h", F.when(F.col("heads").isNotNull(), F.slice("heads", 1, F.greatest("h", F.lit(1)))).alias("heads"), got.alias("got"), (F.greatest(F.col("last") - F.col("h"), F.lit(0)) + got).alias("len"))
    convs = written(convs, "conversations")
    first = convs.where("got > 0").select("conv", F.explode("heads").alias("t")).select("conv", F.col("t.pos").alias("pos"), "t.turn")
    shifts = runs.join(convs.select("conv", "h", "got"), "conv").select("conv", "part", (F.col("before") - F.col("h")).alias("before"), "got")
    rest = placed.join(shifts, ["conv", "part"]).where(F.col("before") + F.col("place") > 0).select("conv", (F.col("before") + F.col("place") + F.col("got")).alias("pos"), "turn")
    return first.union(rest), convs.select("conv", "len")


def sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, len, bytes, k1, k2) for each conversation: equal keys and lengths are equal sequences.

    A key is the exclusive or of 128-bit digests of the turns with their places, so it is combined before the shuffle,
    whatever the length of a conversation.
    """
    mark = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.hex("turn.id")), 256)
    lane = lambda k: F.conv(F.substring(mark, k, 15), 16, 10).cast("long")
    keys = turns.groupBy("conv").agg(F.sum("turn.bytes").alias("bytes"), F.bit_xor(lane(1)).alias("k1"), F.bit_xor(lane(17)).alias("k2"))
    zero = F.lit(0).cast("long")
    return convs.join(keys, "conv", "left").select("conv", "len", *[F.coalesce(c, zero).alias(c) for c in ("bytes", "k1", "k2")])


def _blocks(turns: DataFrame, whole: DataFrame, width: int) -> DataFrame:
    """(conv, block, base, t1 ...): the turns of the kept sequences in blocks, with the bytes before each block."""
    stretch = STRETCH * width
    spans = whole.where("len > 0").select("conv", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / stretch))).alias("span"))
    kept = turns.withColumn("span", F.floor((F.col("pos") - 1) / stretch)).join(spans, ["conv", "span"])
    place = (F.col("pos") - 1) % width
    cells = [F.max(F.when(place == j, F.col("turn"))).alias(f"t{j + 1}") for j in range(width)]
    blocks = kept.groupBy("conv", "span", F.floor((F.col("pos") - 1) / width).alias("block")).agg(F.sum("turn.bytes").alias("own"), *cells)
    inside = blocks.withColumn("base", F.expr("sum(own) over (partition by conv, span order by block) - own"))
    spans = blocks.groupBy("conv", "span").agg(F.sum("own").alias("own"))  # few for a conversation
    spans = spans.select("conv", "span", F.expr("sum(own) over (partition by conv order by span) - own").alias("more"))
    return inside.join(spans, ["conv", "span"]).select("conv", "block", (F.col("base") + F.col("more")).alias("base"), *[f"t{j + 1}" for j in range(width)])


def _rolled(rows: DataFrame, width: int, values: str) -> DataFrame:
    """block, top, base, g, path and the ``values`` of every node: the first g columns of a block below its node ``top``."""
    cols = ", ".join(f"t{j + 1}" for j in range(width))
    rolled = rows.sparkSession.sql(
        f"""SELECT block, top, base, {cols}, {width} - bit_count(grouping_id(block, top, base, {cols})) AS g, {values}
            FROM {{rows}} GROUP BY block, top, base, ROLLUP({cols})""", rows=rows)
    path = F.slice(F.array(*[f"t{j + 1}" for j in range(width)]), F.lit(1), F.col("g"))
    last = F.coalesce(*[F.when((F.col("g") == j + 1), F.col(f"t{j + 1}").isNotNull()) for j in range(width)], F.col("block") == 0)
    own = [c for c in rolled.columns if c not in {f"t{j + 1}" for j in range(width)}]
    return rolled.where(last).select(*own, path.alias("path"))


def _before(path: str = "path") -> Column:
    """Bytes of a node's turns but its last one."""
    return F.col("base") + F.aggregate(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, t: a + t["bytes"])


def _first_nodes(rows: DataFrame, blocks: DataFrame, width: int) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(rows of each block with their top, (conv, s, before, top), (conv, alone)): who is smallest where; runs jobs.

    ``top`` in the second is the smallest member of the node above the first node whose smallest member conv is; ``alone`` is
    the first depth at which no other sequence shares conv's node.
    """
    parts, found, firsts, alone, block = shuffle_partitions(rows.sparkSession), [], [], [], 0
    while True:
        found.append(rows)
        nodes = written(_rolled(rows, width, "min(conv) AS conv, count(*) AS shared"), "nodes")
        depth = F.col("g") + block * width
        own = nodes.groupBy("conv").agg(F.min_by(F.struct("top", "base", "path", "g", _before().alias("before")), "g").alias("f"), F.min(F.when(F.col("shared") == 1, depth)).alias("alone"))
        own = written(own, "owners")
        alone.append(own.where("alone IS NOT NULL").select("conv", "alone"))
        new = own.select("conv", "f.*").where("conv <> top OR g = 0")
        done = [F.col("conv"), (F.col("g") + block * width).alias("s"), F.col("before")]
        firsts.append(new.where("g < 2").select(*done, F.when(F.col("g") == 1, F.col("top")).alias("top")))
        above = new.where("g >= 2").select("conv", "g", "before", "top", "base", F.slice("path", F.lit(1), F.col("g") - 1).alias("path"))
        seen = above.groupBy("top", "base", "path").agg(F.count("*").alias("n"))
        upper = nodes.select("top", "base", "path", F.col("conv").alias("above")).join(seen, ["top", "base", "path"])
        firsts.append(join_counted(above, upper, ["top", "base", "path"], "n", parts).select(*done, F.col("above").alias("top")))
        # Sequences that share the node at the end of the block and have turns beyond it go on.
        shared = nodes.where((F.col("g") == width) & (F.col("shared") > 1)).select("top", "base", "path", F.col("conv").alias("next"))
        only = nodes.where((F.col("g") == width) & (F.col("shared") == 1)).select("conv")
        on = rows.where(F.col("len") > (block + 1) * width).join(only, "conv", "left_anti").select("conv", "len", "copies", "top", "base", F.array(*[f"t{j + 1}" for j in range(width)]).alias("path"))
        seen = on.groupBy("top", "base", "path").agg(F.count("*").alias("n"))
        on = join_counted(on, shared.join(seen, ["top", "base", "path"]), ["top", "base", "path"], "n", parts).select("conv", "len", "copies", F.col("next").alias("top"))
        block += 1
        rows = written(on.join(blocks.where(F.col("block") == block), "conv").select("conv", "len", "copies", "top", "block", "base", *[f"t{j + 1}" for j in range(width)]), "rows")
        if rows.isEmpty():
            break
    return found, reduce(DataFrame.union, firsts), reduce(DataFrame.union, alone).groupBy("conv").agg(F.min("alone").alias("alone"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seq, conv) in order as rows (seq, first conv, the ids joined), a bounded number of ids each."""
    for b in batches:
        rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
        at, out = 0, []
        while at < len(rows):
            end = at
            while end < len(rows) and end - at < CHUNK and rows[end][0] == rows[at][0]:
                end += 1
            out.append((*rows[at], ",".join(str(c) for _, c in rows[at:end])))
            at = end
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["seq", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (seq, first, ids) in order as one digest for each seq; the hash goes from batch to batch."""
    seq = state = None
    out: list[tuple] = []
    for b in batches:
        for s, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if state is None or s != seq:
                if state is not None:
                    out.append((seq, state.hexdigest()))
                seq, state = s, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["seq", "ends"])
            out = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([state.hexdigest()])], ["seq", "ends"])


def _ends(all_: DataFrame, whole: DataFrame) -> DataFrame:
    """(conv, ends): for each sequence the digest of the ids of all its conversations, ascending."""
    parts = shuffle_partitions(all_.sparkSession)
    single = whole.where("copies = 1").select("conv", F.sha2(F.col("conv").cast("string"), 256).alias("ends"))
    several = whole.where("copies > 1").select(F.col("conv").alias("seq"), "len", "k1", "k2", "copies")
    members = join_counted(all_.select("conv", "len", "k1", "k2"), several, ["len", "k1", "k2"], "copies", parts).select("seq", "conv")
    texts = members.repartitionByRange(parts, "seq", "conv").sortWithinPartitions("seq", "conv").mapInArrow(_joined_ids, "seq long, first long, ids string")
    digests = texts.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_digested, "seq long, ends string")
    return single.union(digests)


def prefix_trie(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node; runs jobs."""
    turns, convs = rebuilt(df)
    turns = written(turns, "rebuilt")
    all_ = written(sequences(turns, convs), "keys")
    whole = written(all_.groupBy("len", "k1", "k2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"), F.min("bytes").alias("bytes")), "sequences")
    root = whole.agg(F.min("conv")).first()[0]
    blocks = written(_blocks(turns, whole, width), "blocks")
    cells = [f"t{j + 1}" for j in range(width)]
    # Conversations without a turn have a row of nulls in the first block: they end at the root.
    start = whole.select("conv", "len", "copies", F.lit(root).cast("long").alias("top")).join(blocks.where("block = 0").select("conv", *cells), "conv", "left")
    start = written(start.select("conv", "len", "copies", "top", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("base"), *cells), "rows")
    found, firsts, alone = _first_nodes(start, blocks, width)
    own = whole.join(firsts, "conv", "left").join(alone, "conv", "left").select("conv", "copies", "len", "bytes", "s", "top", "alone", F.coalesce("before", "bytes").alias("before"))
    own = written(own, "owners")
    # Bytes before each sequence's own first node, for it and (all bytes) for its copies, which have no node of their own.
    weights = own.select("conv", ((F.col("copies") - 1) * F.col("bytes") + F.col("before")).alias("weight"), F.when(F.col("alone").isNotNull(), 1).otherwise(0).alias("leaf"))
    rows = reduce(DataFrame.union, found).join(weights, "conv")
    nodes = _rolled(rows, width, "min(conv) AS conv, sum(copies) AS n_convs, sum(leaf) AS n_leaves, sum(weight) AS weight, min(struct(len, conv)) AS ender")
    depth = F.col("g") + F.col("block") * width
    nodes = nodes.select("conv", depth.alias("depth"), "n_convs", "n_leaves", "weight", "ender", _before().alias("upto"))
    nodes = nodes.join(own.select("conv", "s", "top", F.col("before").alias("own_before")), "conv")
    shared = written(nodes.select(
        "conv", "depth", F.when(F.col("depth") > F.col("s"), F.col("conv")).otherwise(F.col("top")).alias("parent"), "n_convs", "n_leaves",
        (F.col("weight") - F.col("own_before") - (F.col("n_convs") - 1) * F.col("upto")).alias("saved"), F.when(F.col("ender.len") == F.col("depth"), F.col("ender.conv")).alias("ends_of")), "shared")
    # Below the block in which a sequence is first alone at its end, all nodes are its own.
    lone = own.where(F.col("alone").isNotNull()).withColumn("block", F.greatest(F.ceil(F.col("alone") / width), F.lit(1))).where(F.col("len") > F.col("block") * width)
    spans = lone.select("conv", "copies", "len", "bytes", F.col("block").alias("from"), F.explode(F.sequence(F.floor(F.col("block") / STRETCH), F.floor((F.col("len") - 1) / (width * STRETCH)))).alias("span"))
    tail = blocks.withColumn("span", F.floor(F.col("block") / STRETCH)).join(spans, ["conv", "span"]).where(F.col("block") >= F.col("from"))
    tail = tail.withColumn("path", F.filter(F.array(*cells), lambda t: t.isNotNull())).select(
        "conv", "copies", "len", "bytes", "block", F.posexplode(F.transform("path", lambda t, i: F.col("base") + F.aggregate(F.slice("path", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["bytes"]))).alias("j", "upto"))
    tail = tail.select("conv", (F.col("block") * width + F.col("j") + 1).alias("depth"), "copies", "len", "bytes", "upto")
    below = tail.select("conv", "depth", F.col("conv").alias("parent"), F.col("copies").alias("n_convs"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("copies") - 1) * (F.col("bytes") - F.col("upto"))).alias("saved"),
                        F.when(F.col("depth") == F.col("len"), F.col("conv")).alias("ends_of"), F.when(F.col("depth") < F.col("len"), 1).otherwise(0).alias("n_children"))
    edges = shared.select("parent", (F.col("depth") - 1).alias("depth")).where("parent IS NOT NULL").union(lone.select("conv", F.col("block") * width))
    children = edges.groupBy(F.col("parent").alias("conv"), "depth").agg(F.count("*").alias("n_children"))
    above = shared.join(children, ["conv", "depth"], "left").select(*shared.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"))
    every = above.unionByName(below)
    ends = _ends(all_, whole)
    named = every.where("ends_of IS NOT NULL").join(ends.withColumnRenamed("conv", "ends_of"), "ends_of").drop("ends_of")
    rest = every.where("ends_of IS NULL").drop("ends_of").withColumn("ends", F.lit(EMPTY))
    return named.unionByName(rest).select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").cast("long").alias("parent_conv_id"), F.col("n_convs").cast("long").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved").cast("long").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
