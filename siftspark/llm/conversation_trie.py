"""Prefix trie of rebuilt conversations, with count-min screening of prefix digests.

A node is a distinct sequence of first turns. Most prefixes belong to one conversation, and a count-min sketch
over digests of all prefixes proves that for nearly all of these: an estimate of one can't be too small. Such
nodes are written from the row at hand; only prefixes that may be shared are shuffled and grouped exactly.

1. Turns become a digest of role and text and a length; texts don't leave their task. Places of turns come from
   a sort by ranges, so that a conversation of any length is spread over many tasks: each task counts its part,
   and parts that continue others add the counts before them.
2. Conversations are rebuilt, and each turn gets the digest of the prefix that ends with it: sums over the turns
   so far of hashes that hold the turn and its depth. Sums are taken in runs of ``RUN`` depths, then over runs.
3. Each task sketches its prefixes; the sketches, of a fixed size, are added up slice by slice.
4. Prefixes with a higher estimate are grouped by their digest: members, smallest member, length of the last text.
5. The nodes whose smallest member is c are a chain: all of c's path below some depth, hanging from a node of a
   smaller owner. So sums over subtrees are sums down a chain plus what chains that hang there bring. A chain
   adds its total once to each other owner on its path, never to each node above it.
6. Ids of members that end at a shared node are joined in sorted ranges and then hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.window import Window

from siftspark.llm.shared import mixed, written

RUN = 1_024  # depths that are summed at once
ROWS = 4  # of the sketch
CELLS = 1 << 22  # of each row of the sketch, at most; a fuller sketch proves less, results stay the same
SLICES = 32
_JOINED = 1 << 20  # bytes of joined ids in one row
NONE = hashlib.sha256(b"").hexdigest()
_LIMBS = ("l0", "l1", "l2", "l3")


def turns(conversations: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(c, turn, said, chars): rows of conversations with an id; null role and text are empty."""
    role, text = (f"coalesce(`{columns[k]}`, '')" for k in ("role", "text"))
    return conversations.selectExpr(f"`{columns['conv']}` AS c", f"`{columns['turn']}` AS turn", f"{role} AS r", f"{text} AS t").selectExpr(
        "c", "turn", "sha2(concat(char_length(r), ':', r, t), 256) AS said", "cast(char_length(t) AS bigint) AS chars",
    ).filter("c IS NOT NULL")


def placed(said: DataFrame) -> DataFrame:
    """(c, part, i, said, chars): the place of each turn in its part, and the part of the sorted whole it lies in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            c = batch.column("c").to_numpy()
            fresh = np.r_[True, c[1:] != c[:-1]] if len(c) else np.zeros(0, bool)
            if len(c) and c[0] == last:
                fresh[0] = False
            at = np.arange(len(c))
            begun = np.maximum.accumulate(np.where(fresh, at, -1)) if len(c) else at
            i = np.where(begun < 0, count + at, at - begun)
            if len(c):
                last, count = c[-1], int(i[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), batch.column("part"), pa.array(i, pa.int64()), batch.column("said"), batch.column("chars")],
                ["c", "part", "i", "said", "chars"])

    order = [F.asc("c"), F.asc_nulls_first("turn"), F.asc("said"), F.asc("chars")]
    n = max(1, int(said.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = said.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    return ranged.select("c", "part", "said", "chars").mapInArrow(run, "c bigint, part int, i bigint, said string, chars bigint")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, depth, said, chars) of the rebuilt turns, and (c, m): their number for each conversation."""
    parts = written(rows.groupBy("c", "part").agg(F.count("*").alias("n")), "parts")
    # As many rows for a conversation as it has parts.
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("ahead > 0").select("c", "part", "ahead")
    convs = parts.groupBy("c").agg(F.sum("n").alias("n")).selectExpr(
        "c", "n", "c - c % 100 AS g", "crc32(cast(cast(c AS string) AS binary)) % 6 AS h")
    # Parts that begin a conversation hold its first turns, unless several of them do.
    known = rows.join(ahead, ["c", "part"], "left").withColumn("i", F.expr("i + coalesce(ahead, 0)")).select("c", "i", "said", "chars")
    heads = written(known.filter("i < 5 AND c % 100 = 0"), "heads")
    sizes = convs.selectExpr("c AS g", "least(n, 5) AS g_n")
    facts = written(convs.join(sizes, "g", "left").selectExpr(
        "c", "g", "h", "least(h, coalesce(g_n, 0)) AS k", "least(h, coalesce(g_n, 0)) + greatest(n - h, 0) AS m"), "conversations")
    own = known.join(facts.select("c", "h", "k"), "c").filter("i >= h").selectExpr("c", "i - h + k + 1 AS depth", "said", "chars")
    shared = facts.filter("k > 0").join(heads.withColumnRenamed("c", "g"), "g").filter("i < k").selectExpr(
        "c", "i + 1 AS depth", "said", "chars")
    return own.unionByName(shared), facts.select("c", "m")


def running(rows: DataFrame, key: str, sums: dict[str, str], down: bool = False) -> DataFrame:
    """``rows`` with sums of columns over all rows of ``key`` up to the same depth (from it on, if ``down``).

    Runs of ``RUN`` depths are summed apart, then one row for each of them, so no group grows with its key's rows
    but by one for every ``RUN`` of them.
    """
    order = F.desc if down else F.asc
    cut = rows.withColumn("run", F.expr(f"depth div {RUN}"))
    inside = Window.partitionBy(key, "run").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    total = cut.groupBy(key, "run").agg(*(F.sum(c).alias(c) for c in sums))
    before = Window.partitionBy(key).orderBy(order("run")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = total.select(key, "run", *(F.sum(c).over(before).alias(f"{c}_ahead") for c in sums))
    one = cut.select("*", *(F.sum(c).over(inside).alias(f"{c}_here") for c in sums))
    both = one.join(ahead, [key, "run"])
    return both.select(*rows.columns, *(F.expr(f"{c}_here + coalesce({c}_ahead, 0)").alias(name) for c, name in sums.items()))


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, depth, m, k1, k2, chars): every prefix of every conversation with its digest; depth 0 is the root."""
    tagged = rows.withColumn("tag", F.expr("sha2(concat(depth, ':', said), 256)")).select(
        "c", "depth", "chars", *(F.expr(f"cast(conv(substring(tag, {8 * k + 1}, 8), 16, 10) AS bigint)").alias(x) for k, x in enumerate(_LIMBS)))
    summed = running(tagged, "c", {x: f"s{x}" for x in _LIMBS})
    digest = F.expr("sha2(concat_ws(',', depth, " + ", ".join(f"s{x}" for x in _LIMBS) + "), 256)")
    keyed = summed.withColumn("digest", digest).select(
        "c", "depth", "chars", *(F.expr(f"cast(conv(substring(digest, {a}, 15), 16, 10) AS bigint)").alias(k) for a, k in ((1, "k1"), (16, "k2"))))
    root = convs.selectExpr("c", "0L AS depth", "0L AS chars", "0L AS k1", "0L AS k2")
    # In the order in which ``screened`` can tell that the prefix before is no other conversation's either.
    return keyed.unionByName(root).join(convs, "c").select("c", "depth", "m", "k1", "k2", "chars").sortWithinPartitions("c", "depth")


def cells_of(k1: np.ndarray, k2: np.ndarray, width: int) -> np.ndarray:
    """The cell of each row of the sketch, one line for each row."""
    a, b = k1.view(np.uint64), mixed(k2.view(np.uint64)) | np.uint64(1)
    return np.stack([(mixed(a + np.uint64(r) * b) & np.uint64(width - 1)).astype(np.int64) + r * width for r in range(ROWS)])


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """Counts 0, 1 and 2 (two or more) of a count-min sketch over all digests: ``ROWS * width`` bytes."""
    size = ROWS * width // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ROWS * width, np.uint8)
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for line in cells_of(k1, k2, width):
                cell, n = np.unique(line, return_counts=True)
                counts[cell] = np.minimum(counts[cell] + np.minimum(n, 2), 2)
        for s in range(SLICES):
            part = counts[s * size:(s + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                s, more = batch.column("slice")[k].as_py(), np.frombuffer(batch.column("counts")[k].as_buffer(), np.uint8)
                total[s] = np.minimum(total[s] + more, 2) if s in total else more.copy()
        for s, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["slice", "counts"])

    kind = "slice int, counts binary"
    slices = rows.select("k1", "k2").mapInArrow(count, kind).repartition(SLICES, "slice").mapInArrow(add, kind)
    out = np.zeros(ROWS * width, np.uint8)
    for row in slices.collect():
        out[row["slice"] * size:(row["slice"] + 1) * size] = np.frombuffer(row["counts"], np.uint8)
    return out


def screened(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """``rows`` with ``alone``: no other conversation has the prefix; and ``follows``: nor has it the one before.

    ``follows`` is only known where the row before it in the table is that of the depth before.
    """
    width = len(counts) // ROWS
    held = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = held.value, (None, 0, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            c, depth, k1, k2 = (batch.column(x).to_numpy() for x in ("c", "depth", "k1", "k2"))
            alone = (table[cells_of(k1, k2, width)].min(axis=0) == 1) & (depth > 0)
            follows = np.r_[end[2] and c[0] == end[0] and depth[0] == end[1] + 1,
                            (c[1:] == c[:-1]) & (depth[1:] == depth[:-1] + 1) & alone[:-1]]
            end = (c[-1], depth[-1], bool(alone[-1]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(alone), pa.array(follows.astype(bool))], [*batch.schema.names, "alone", "follows"])

    schema = ST.StructType([*rows.schema.fields, ST.StructField("alone", ST.BooleanType()), ST.StructField("follows", ST.BooleanType())])
    return rows.mapInArrow(run, schema)


def ends(members: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of (owner, depth, c): the hash of the members' ids, ascending, comma-joined.

    A task joins the ids of its range of the sorted whole; the joined pieces of a node are hashed one after
    another, so a node that a great part of all conversations end at is never held whole.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([first], pa.int64()),
                 pa.array([",".join(held)], pa.string())], ["owner", "depth", "first", "ids"])
        for batch in batches:
            for owner, depth, c in zip(*(batch.column(x).to_pylist() for x in ("owner", "depth", "c")), strict=True):
                if (owner, depth) != node or size > _JOINED:
                    if held:
                        yield row()
                    node, first, held, size = (owner, depth), c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(
                (pa.int64(), pa.int64(), pa.string()))], ["owner", "depth", "ends_sha256"])
        for batch in batches:
            for owner, depth, ids in zip(*(batch.column(x).to_pylist() for x in ("owner", "depth", "ids")), strict=True):
                if (owner, depth) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (owner, depth), hashlib.sha256(ids.encode())
            if out:
                yield rows()
                out = []
        if node is not None:
            out.append((*node, state.hexdigest()))
            yield rows()

    n = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = members.select("owner", "depth", "c").repartitionByRange(n, "owner", "depth", "c").sortWithinPartitions(
        "owner", "depth", "c").mapInArrow(join, "owner bigint, depth bigint, first bigint, ids string")
    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").select(
        "owner", "depth", "ids").mapInArrow(digest, "owner bigint, depth bigint, ends_sha256 string")


def trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    cells: int = CELLS,
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    Conversation c is rebuilt from the first h turns of conversation ``c - c % 100`` (the sign of ``%`` is that of
    c) and its own behind its first h, with h the remainder of crc32 of the decimal c by 6. Turns are ordered by
    number, null first, and equal numbers by the SHA-256 of role and text; repeated rows are turns of their own.
    Null role and text are empty; rows without an id belong to no conversation and are left out; other columns are
    ignored. An empty table has no members, so no node and no row. ``cells`` is a power of two, the largest width
    of the sketch: it decides what is shuffled, never the result.
    """
    if cells < SLICES or cells & (cells - 1):
        raise ValueError(f"cells is a power of two and at least {SLICES}")
    said = turns(conversations, {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col})
    rows, convs = rebuilt(written(placed(said), "turns"))
    every = written(prefixes(rows, convs), "prefixes")
    width = min(cells, max(1 << 12, 1 << (4 * every.count()).bit_length()))
    every = written(screened(every, sketch(every, width)), "screened")

    # Prefixes that may be shared, grouped exactly. Copies collapse in the tasks.
    maybe = every.filter("NOT alone")
    nodes = written(maybe.groupBy("k1", "k2", "depth").agg(
        F.count("*").alias("n"), F.min("c").alias("owner"), F.max("chars").alias("chars")), "nodes")
    path = written(maybe.join(nodes.select("k1", "k2", "depth", "owner"), ["k1", "k2", "depth"]).select("c", "depth", "m", "owner"), "paths")

    # The deepest node of each other owner on a conversation's path; the deepest of all is where its chain hangs.
    above = written(path.filter("owner <> c").groupBy("c", "owner").agg(F.max("depth").alias("e"), F.max("m").alias("m")), "owners")
    hang = above.groupBy("c").agg(F.max(F.struct("e", "owner")).alias("at"), F.max("m").alias("m"))
    chains = convs.join(hang.select("c", "at"), "c", "left").selectExpr("c", "m", "at.owner AS parent", "coalesce(at.e, -1) AS e")
    chains = written(chains.filter("e < m"), "chains")  # conversations that own a node
    hung = chains.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("owner"), F.col("e").alias("depth")).agg(F.count("*").alias("n_hung"))
    hung = written(hung, "hung")
    # A chain's last node has no children unless chains hang there: then it is no leaf.
    leafless = hung.selectExpr("owner AS c", "depth AS m", "true AS more")
    worth = nodes.groupBy(F.col("owner").alias("c")).agg(F.sum(F.expr("(n - 1) * chars")).alias("worth"))
    totals = written(chains.join(leafless, ["c", "m"], "left").join(worth, "c", "left").selectExpr(
        "c", "m", "parent", "e", "cast(more IS NULL AS bigint) AS leaf", "coalesce(worth, 0) AS worth"), "totals")
    brought = above.join(totals.select("c", "leaf", "worth"), "c").groupBy("owner", F.col("e").alias("depth")).agg(
        F.sum("leaf").alias("leaves"), F.sum("worth").alias("worth"))

    # Sums down the chain of each owner, over the nodes that were grouped.
    own = nodes.select("owner", "depth", "n", F.expr("(n - 1) * chars").alias("value")).join(brought, ["owner", "depth"], "left").selectExpr(
        "owner", "depth", "n", "value + coalesce(worth, 0) AS value", "coalesce(leaves, 0) AS leaves")
    summed = running(own, "owner", {"value": "saved_tokens", "leaves": "below"}, down=True)
    facts = totals.selectExpr("c AS owner", "m", "parent", "e", "leaf")
    finished = ends(path.filter("depth = m"))
    grouped = (
        summed.join(facts, "owner").join(hung, ["owner", "depth"], "left").join(finished, ["owner", "depth"], "left").selectExpr(
            "owner AS conv_id", "depth", "CASE WHEN depth > e + 1 THEN owner ELSE parent END AS parent_conv_id", "n AS n_convs",
            "coalesce(n_hung, 0) + cast(depth < m AS bigint) AS n_children", "leaf + below AS n_leaves", "saved_tokens",
            f"coalesce(ends_sha256, '{NONE}') AS ends_sha256"))

    # Tails: nothing but the first node of each asks for anything that its row does not hold.
    tail = every.filter("alone")
    last = f"CASE WHEN depth = m THEN sha2(cast(cast(c AS string) AS binary), 256) ELSE '{NONE}' END AS ends_sha256"
    columns = ("1L AS n_convs", "cast(depth < m AS bigint) AS n_children", "1L AS n_leaves", "0L AS saved_tokens", last)
    inner = tail.filter("follows").selectExpr("c AS conv_id", "depth", "c AS parent_conv_id", *columns)
    edge = tail.filter("NOT follows").join(totals.select("c", "parent", "e"), "c").selectExpr(
        "c AS conv_id", "depth", "CASE WHEN depth > e + 1 THEN c ELSE parent END AS parent_conv_id", *columns)
    return grouped.unionByName(inner).unionByName(edge)
