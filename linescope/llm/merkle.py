"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf.  The leaves of a group, in order, form a binary tree; the
roots of the groups form one more.  Each node has a label (tree, round, block,
level, place) and the work follows the order of labels: a node is made when all
messages to it have come, and sends its digest to its parent's label.

The external priority queue is Spark's own shuffle and sort: messages are dealt
by (tree, block), where a block holds 1,024 neighbours, and sorted by place.  A
task sweeps its sorted messages block by block; a small heap orders the
messages that are sent inside the block.  A round turns a block into one node of
the next round, so a billion rows need three rounds.  The reversed sweep goes
from the root down: a block gets the suffix that its leaves' proofs have in
common as its first message, and hands every node its own suffix.  At the leaves
the proof is folded and digested at once and never leaves the task.

Skew: a group's size is of no matter, as its blocks are dealt out one by one;
places are numbered by ranges of the order, not by group.  Only the number of
rows at the edges of the ranges and the root reach the driver.

Odd nodes: "every two neighbours, the last run may have one" means that a lone
node at the end is hashed again, once a level, while its tree has others.

Defined cases: a null field counts as `-`, an empty text as `0:`; null groups
form a group, the first one; a null id comes first in its group; rows with equal
ids are ordered by their leaf digest, and equal rows each have a leaf; a single
row is leaf, subroot and root at once with the proof of no sibling.  An empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linescope.llm.storage import python_tasks, saved

BITS = 10  # a block holds up to 2 ** BITS nodes
HEIGHT = BITS
BATCH = 2048

#: Steps of a proof from a node to the root: the sibling stands right or left, or
#: the node is alone in its run.
RIGHT, LEFT, ALONE = "R", "L", "N"
_MARKS = str.maketrans("", "", RIGHT + LEFT + ALONE)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- leaves ----------------------------------------------------------------------------


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def document_leaves(docs: DataFrame, divisor: int = 7) -> DataFrame:
    """(id, group, leaf, altered) of `documents`.  Where `divisor` divides the
    CRC-32 of the decimal doc_id, `altered` is the leaf with n_chars + 1."""
    plain = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = [*plain[:3], more, plain[4]]
    hit = F.crc32(F.col("doc_id").cast("string")) % divisor == 0
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("group"),
        leaf(*plain).alias("leaf"),
        F.when(hit & F.col("n_chars").isNotNull(), leaf(*changed)).alias("altered"),
    )


# ---- places ----------------------------------------------------------------------------


def _ranked(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Number the rows of each run of one tree; `at` is the tree's column."""
    part = TaskContext.get().partitionId()
    tree, rank, run = None, -1, -1
    for batch in batches:
        ranks, runs = [], []
        for value in batch.column(at).to_pylist():
            if run < 0 or value != tree:
                tree, rank, run = value, -1, run + 1
            rank += 1
            ranks.append(rank)
            runs.append(run)
        more = [pa.array([part] * len(ranks), pa.int64()), pa.array(ranks, pa.int64()), pa.array(runs, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "rank", "run"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add `pos`, the place in the order within `tree`, from 0.

    Rows are dealt to ranges of (tree, order), so a tree of any size spreads.
    Only the first run of a range can go on with an earlier range's tree; what
    stood there before is one number for each range.
    """
    spark = rows.sparkSession
    keys = [F.col(name).asc_nulls_first() for name in ("tree", *order, "tie")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    at = dealt.columns.index("tree")
    schema = StructType(list(dealt.schema.fields)).add("part", "long").add("rank", "long").add("run", "long")
    ranked = saved(dealt.mapInArrow(lambda batches: _ranked(batches, at), schema))
    edges = ranked.groupBy("part").agg(
        F.max(F.when(F.col("run") == 0, F.struct("rank", "tree"))).alias("first"),
        F.max(F.struct("run", "rank", "tree")).alias("last"),
    )
    before, held, tree = [], 0, ""
    for row in edges.orderBy("part").collect():  # one row for each range
        going_on = held > 0 and row.first.tree == tree
        start = held if going_on else 0
        before.append((row.part, start))
        held = row.last.rank + 1 + (start if row.last.run == 0 else 0)
        tree = row.last.tree
    offsets = spark.createDataFrame(before, "part bigint, before bigint")
    place = F.col("rank") + F.when(F.col("run") == 0, F.col("before")).otherwise(0)
    return ranked.join(F.broadcast(offsets), "part").withColumn("pos", place).drop("part", "rank", "run", "before")


# ---- sweeps ----------------------------------------------------------------------------


def forward(digests: list[str], whole: bool) -> list[list[str]]:
    """The levels of a block, lowest first.

    `whole`: the block is its whole tree, which ends with its only node; other
    blocks end at the block height.
    """
    levels = [digests]
    if whole and len(digests) == 1:
        return levels
    queue = [(1, place >> 1, place, value) for place, value in enumerate(digests)]  # ascending, so a heap
    while queue:
        level, node = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, node):
            children.append(heapq.heappop(queue)[3])
        made = digest("".join(children))
        if level == len(levels):
            levels.append([])
        levels[level].append(made)
        alone = node == 0 and len(levels[level - 1]) <= 2
        if not (level == HEIGHT or (whole and alone)):
            heapq.heappush(queue, (level + 1, node >> 1, node, made))
    return levels


def backward(levels: list[list[str]], suffix: str) -> list[str]:
    """The proof steps of a block's lowest nodes; `suffix` holds those of its top."""
    above = [suffix]
    for level in reversed(levels[:-1]):
        steps = []
        for place in range(len(level)):
            other = place ^ 1
            if other >= len(level):
                step = ALONE
            else:
                step = (LEFT if place & 1 else RIGHT) + level[other]
            steps.append(step + above[place >> 1])
        above = steps
    return above


def fold(value: str, steps: str) -> str:
    """The root that a node's digest and its proof steps lead to."""
    at = 0
    while at < len(steps):
        kind, sibling = steps[at], steps[at + 1 : at + 65]
        if kind == ALONE:
            value, at = digest(value), at + 1
        else:
            value, at = digest(value + sibling if kind == RIGHT else sibling + value), at + 65
    return value


def siblings(steps: str) -> str:
    """All digests of a proof, from the leaf up."""
    return steps.translate(_MARKS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, list[dict]]]:
    rows = (row for batch in batches for row in batch.to_pylist())
    for (tree, block), found in itertools.groupby(rows, key=lambda row: (row["tree"], row["block"])):
        yield tree, block, list(found)


def _whole(block: int, size: int) -> bool:
    """Is the block all of its tree?  A full first block ends at the same node
    either way."""
    return block == 0 and size < 1 << BITS


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(itertools.islice(rows, BATCH)):
        yield pa.RecordBatch.from_pylist(some, schema)


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string())])

    def made() -> Iterator[dict]:
        for tree, block, rows in _blocks(batches):
            levels = forward([row["digest"] for row in rows], _whole(block, len(rows)))
            yield {"tree": tree, "pos": block, "digest": levels[-1][0]}

    return _batched(made(), schema)


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, pa.int64() if name == "pos" else pa.string()) for name in ("tree", "pos", "digest", "name", "subroot", "suffix")])

    def made() -> Iterator[dict]:
        for _, block, (first, *rows) in _blocks(batches):
            levels = forward([row["digest"] for row in rows], _whole(block, len(rows)))
            for row, steps in zip(rows, backward(levels, first["suffix"])):
                yield row | {"suffix": steps, "subroot": first["subroot"]}

    return _batched(made(), schema)


def _at_leaves(batches: Iterator[pa.RecordBatch], with_proof: bool) -> Iterator[pa.RecordBatch]:
    names = ["leaf", "subroot", "proof_sha256", "folded_root", *["proof"] * with_proof]
    schema = pa.schema([("id", pa.int64()), *((name, pa.string()) for name in names)])

    def made() -> Iterator[dict]:
        for _, block, (first, *rows) in _blocks(batches):
            levels = forward([row["digest"] for row in rows], _whole(block, len(rows)))
            for row, steps in zip(rows, backward(levels, first["suffix"])):
                folded = fold(row["altered"] or row["digest"], steps)
                yield {
                    "id": row["id"],
                    "leaf": row["digest"],
                    "subroot": first["subroot"],
                    "proof_sha256": digest(siblings(steps)),
                    "folded_root": folded,
                    "proof": steps,
                }

    return _batched(made(), schema)


def _dealt(rows: DataFrame) -> DataFrame:
    """The queue: messages by block, in the order of their labels."""
    return rows.repartition("tree", "block").sortWithinPartitions(F.col("tree").asc_nulls_first(), "block", "pos")


def _block() -> Column:
    return F.shiftright("pos", BITS).alias("block")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (tree, pos, digest) and the rounds above them, up to one node a tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("pos")).first()[0] or 0) > 0:
        rows = rounds[-1].select("tree", _block(), "pos", "digest")
        rounds.append(saved(_dealt(rows).mapInArrow(_up, "tree string, pos bigint, digest string")))
    return rounds


def _with_suffixes(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes behind the message of their block (tree, pos, subroot, suffix)."""
    first = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), "subroot", "suffix")
    return _dealt(nodes.select("*", _block()).unionByName(first, allowMissingColumns=True))


_DOWN = "tree string, pos bigint, digest string, name string, subroot string, suffix string"


def descend(rounds: list[DataFrame], suffixes: DataFrame) -> DataFrame:
    """Hand suffixes (tree, pos, subroot, suffix) of the last round's nodes down
    to the first; the same columns, digest and name of the first round's nodes."""
    for nodes in reversed(rounds[:-1]):
        if "name" not in nodes.columns:
            nodes = nodes.withColumn("name", F.lit(None).cast("string"))
        suffixes = saved(_with_suffixes(nodes.select("tree", "pos", "digest", "name"), suffixes).select(*_DOWN_IN).mapInArrow(_down, _DOWN))
    return suffixes


_DOWN_IN = ["tree", "block", "pos", "digest", "name", "subroot", "suffix"]


def manifest(leaves: DataFrame, with_proof: bool = False) -> DataFrame:
    """One row a leaf of (id, group, leaf, altered): id, leaf, subroot, root,
    proof_sha256, folded_root, verified, and with `with_proof` the proof itself,
    the steps from the leaf to the root.

    subroot and root are of the unaltered leaves.  folded_root is what the
    altered leaf, where there is one, and the unaltered siblings lead to.
    """
    python_tasks(leaves.sparkSession)
    rows = leaves.select(F.col("id").cast("bigint"), F.col("group").cast("string").alias("tree"), F.col("leaf").alias("digest"), "altered")
    nodes = saved(numbered(rows, ["id", "digest"]))
    rounds = climb(nodes.select("tree", "pos", "digest"))
    if nodes.isEmpty():
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
        empty = nodes.select("id", *(F.lit("").alias(name) for name in names), F.lit(True).alias("verified"))
        return empty.withColumn("proof", F.lit("")) if with_proof else empty
    tops = rounds[-1].select(F.col("tree").alias("name"), "digest", F.lit("").alias("tree"))
    tops = saved(numbered(tops, ["name"]))
    upper = climb(tops)
    root = upper[-1].first().digest
    whole = descend(upper, upper[-1].withColumns({"subroot": F.lit(""), "suffix": F.lit("")}))
    groups = whole.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), F.col("digest").alias("subroot"), "suffix")
    blocks = descend(rounds[1:], groups)
    below = _with_suffixes(nodes, blocks).select("tree", "block", "pos", "id", "digest", "altered", "subroot", "suffix")
    schema = "id bigint, leaf string, subroot string, proof_sha256 string, folded_root string" + ", proof string" * with_proof
    found = below.mapInArrow(lambda batches: _at_leaves(batches, with_proof), schema)
    found = found.withColumn("root", F.lit(root)).withColumn("verified", F.col("folded_root") == F.col("root"))
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return found.select(*names, *["proof"] * with_proof)


# ---- SQL -------------------------------------------------------------------------------

#: CRC-32, bit by bit: a step is a byte to mix in, or -1 for one shift.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({text}, ''),
    lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, o: case when o >= 0 then xor(c, o) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end))"""


def _sql_field(value: str) -> str:
    return f"coalesce(concat(strlen(cast({value} as varchar)), ':', cast({value} as varchar)), '-')"


def _sql_leaf(*values: str) -> str:
    return f"sha256(concat({', '.join(map(_sql_field, values))}))"


def manifest_sql(divisor: int = 7) -> str:
    """DuckDB SQL of the manifest of `documents`, level by level.

    `up` holds all nodes of all group trees, `high` those of the tree over the
    groups; `path` lists each leaf's levels, `folded` walks them.
    """
    plain = _sql_leaf("doc_id", "source", "lang", "n_chars", "text")
    changed = _sql_leaf("doc_id", "source", "lang", "n_chars::hugeint + 1", "text")
    hit = f"n_chars is not null and {_CRC.format(text='cast(doc_id as varchar)')} % {divisor} = 0"
    return f"""
with recursive hashed as (
  select doc_id, lang, {plain} as leaf, case when {hit} then {changed} else {plain} end as altered from documents),
placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as size from hashed),
up as (
  select lang, 0 as level, place, leaf as node, size from placed
  union all
  select a.lang, a.level + 1, a.place // 2, sha256(concat(a.node, b.node)), (a.size + 1) // 2
  from up a left join up b on a.lang is not distinct from b.lang and b.place = a.place + 1 and b.level = a.level
  where a.size > 1 and a.place % 2 = 0),
tops as (
  select lang, node as subroot, level as height, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as size from up where size = 1),
high as (
  select 0 as level, place, subroot as node, size from tops
  union all
  select a.level + 1, a.place // 2, sha256(concat(a.node, b.node)), (a.size + 1) // 2
  from high a left join high b on b.place = a.place + 1 and b.level = a.level
  where a.size > 1 and a.place % 2 = 0),
path as (
  select p.doc_id, p.lang, p.place as leaf_place, u.level, p.place // (1 << u.level) as place, s.node as sibling
  from placed p join up u on u.lang is not distinct from p.lang and u.size > 1 and u.place = p.place // (1 << u.level)
  left join up s on s.lang is not distinct from p.lang and s.level = u.level and s.place = xor(u.place, 1)
  union all
  select p.doc_id, p.lang, p.place, t.height + u.level, u.place, s.node
  from placed p join tops t on t.lang is not distinct from p.lang
  join high u on u.size > 1 and u.place = t.place // (1 << u.level)
  left join high s on s.level = u.level and s.place = xor(u.place, 1)),
folded as (
  select lang, place as leaf_place, 0 as level, altered as node, '' as proof from placed
  union all
  select f.lang, f.leaf_place, f.level + 1,
         sha256(case when p.place % 2 = 0 then concat(f.node, p.sibling) else concat(p.sibling, f.node) end), concat(f.proof, p.sibling)
  from folded f join path p on p.lang is not distinct from f.lang and p.leaf_place = f.leaf_place and p.level = f.level),
ends as (
  select lang, leaf_place, max_by(node, level) as folded_root, sha256(max_by(proof, level)) as proof_sha256 from folded group by all)
select p.doc_id, p.leaf, t.subroot, r.node as root, e.proof_sha256, e.folded_root, e.folded_root = r.node as verified
from placed p join ends e on e.lang is not distinct from p.lang and e.leaf_place = p.place
join tops t on t.lang is not distinct from p.lang join high r on r.size = 1"""
