"""Merkle manifest of a data set, its upper proofs passed round by butterfly exchange.

Leaves are cut into blocks of ``fanout ** BLOCK_LEVELS`` that are aligned with the
tree, so a block's subtree is hashed where the block lies. Above, the blocks swap:
in round j, aligned groups of ``fanout`` groups of ``fanout ** j`` blocks exchange
their roots, each block with one block of every other group of its run. Every
block then hashes the common ancestor itself (redundantly), so after the last round
it holds the root and all siblings on its way, and nothing has to travel back
down. The same goes over the groups' roots.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, _arrow_schema

FANOUT = 3
BLOCK_LEVELS = 7
BATCH = 1024        # rows made at once
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:string,right:string>"  # what stands beside a node in its run


def digest(fields: list[Column]) -> Column:
    """sha256 of all fields: ``-`` for a null, else the UTF-8 byte count, ``:`` and the value."""
    def said(c: Column) -> Column:
        v = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[said(c) for c in fields]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(proof, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings from leaf to root, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def _levels(nodes: list[str], n: int, fanout: int, most: int) -> list[list[str]]:
    """The block's nodes level by level, while a tree of ``n`` leaves has levels, at most ``most`` above."""
    out = [nodes]
    while n > 1 and len(out) <= most:
        now = out[-1]
        out.append([hashlib.sha256("".join(now[i:i + fanout]).encode()).hexdigest()
                    for i in range(0, len(now), fanout)])
        n = -(-n // fanout)
    return out


def _blocks(batches, columns):
    """((tree, block), rows) of batches that come sorted; holds one block at a time."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("tree", "block", *columns)]):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], []
            held.append(row[2:])
    if held:
        yield key, held


def _numbered(nodes: DataFrame, order: list[str], block: int, scratch: Written) -> DataFrame:
    """``nodes`` with pos (place in its tree), n (the tree's leaves) and block.

    Rows are range-partitioned by tree and ``order``; places come from counts per
    partition and tree, so a tree with a third of all rows is spread over tasks.
    """
    ranged = scratch.put(
        nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
        .withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()), "ranged")
    parts = ranged.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                         F.sum("_n").over(Window.partitionBy("tree")).alias("n"))
    pos = F.col("_mono") - F.col("_first") + F.col("_before")
    return scratch.put(ranged.join(parts, ["tree", "_part"]).withColumn("pos", pos)
                       .withColumn("block", F.call_function("div", F.col("pos"), F.lit(block)))
                       .drop("_part", "_mono", "_first", "_before"), "numbered")


def _by_block(df: DataFrame) -> DataFrame:
    return df.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _block_roots(numbered: DataFrame, fanout: int, levels: int) -> DataFrame:
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("root", pa.string())])

    def run(batches):
        made = []
        for (tree, block), rows in _blocks(batches, ("digest", "n")):
            top = _levels([r[0] for r in rows], rows[0][1], fanout, levels)[-1]
            made.append({"tree": tree, "block": block, "n": rows[0][1], "root": top[0]})
            if len(made) == BATCH:
                yield pa.RecordBatch.from_pylist(made, schema=schema)
                made = []
        yield pa.RecordBatch.from_pylist(made, schema=schema)

    return _by_block(numbered.select("tree", "block", "pos", "n", "digest")).mapInArrow(
        run, "tree string, block long, n long, root string")


def _butterfly(roots: DataFrame, fanout: int, levels: int, scratch: Written) -> DataFrame:
    """(tree, block, n, root, proof): every block with its tree's root and its siblings above the block."""
    width = fanout ** levels
    state = scratch.put(roots.withColumn("proof", F.array().cast(f"array<{STEP}>")), "round-0")
    most, j = state.agg(F.max("n")).first()[0] or 0, 0
    while most > width * fanout ** j:
        size = fanout ** j
        div = lambda a, b: F.call_function("div", a, F.lit(b))
        blocks = div(F.col("n") + (width - 1), width)
        group, last = div(F.col("block"), size), div(blocks - 1, size)
        run = div(F.col("block"), size * fanout) * fanout
        swaps = last > 0
        # the block with the same place in each group of the run (the last group may be smaller)
        asked = state.withColumn("_peer", F.explode(F.sequence(
            F.when(swaps, run).otherwise(group), F.when(swaps, F.least(run + (fanout - 1), last)).otherwise(group))))
        place = F.pmod(F.col("block"), F.lit(size))
        theirs = F.least(F.lit(size), blocks - F.col("_peer") * size)
        asked = asked.select("tree", "block", "n", "proof", "_peer", swaps.alias("_swaps"), group.alias("_own"),
                             (F.col("_peer") * size + F.pmod(place, theirs)).alias("_from"))
        told = asked.join(state.select("tree", F.col("block").alias("_from"), "root"), ["tree", "_from"])
        met = told.groupBy("tree", "block", "n", "_swaps", "_own").agg(
            F.any_value("proof").alias("proof"), F.sort_array(F.collect_list(F.struct("_peer", "root"))).alias("_run"))
        text = lambda keep: F.array_join(F.transform(F.filter("_run", keep), lambda x: x["root"]), "")
        step = F.struct(text(lambda x: x["_peer"] < F.col("_own")).alias("left"),
                        text(lambda x: x["_peer"] > F.col("_own")).alias("right"))
        everyone = F.array_join(F.transform("_run", lambda x: x["root"]), "")
        state = scratch.put(met.select(
            "tree", "block", "n",
            F.when(F.col("_swaps"), F.sha2(everyone, 256)).otherwise(F.col("_run")[0]["root"]).alias("root"),
            F.when(F.col("_swaps"), F.concat("proof", F.array(step))).otherwise(F.col("proof")).alias("proof")),
            f"round-{j + 1}")
        j += 1
    return state


def _proofs(numbered: DataFrame, state: DataFrame, columns: list[str], above: list[str], fanout: int,
            levels: int) -> DataFrame:
    """tree, digest and ``columns`` of every leaf, ``above`` of its block, and its whole proof.

    A block's row of ``state`` comes first in its block (pos -1) and is held while
    the block's leaves pass.
    """
    kinds = dict(numbered.dtypes)
    none = lambda kind: F.lit(None).cast(kind)
    leaves = numbered.select("tree", "block", "pos", "n", "digest", *columns,
                             *[none("string").alias(c) for c in above], none(f"array<{STEP}>").alias("proof"))
    heads = state.select("tree", "block", F.lit(-1).cast("long").alias("pos"), "n", none("string").alias("digest"),
                         *[none(kinds[c]).alias(c) for c in columns], *above, "proof")
    schema = ", ".join(["tree string", "digest string", *[f"`{c}` {kinds[c]}" for c in columns],
                        *[f"{c} string" for c in above], f"proof array<{STEP}>"])
    arrow = _arrow_schema(numbered.sparkSession, schema)
    top = 1 + len(columns)

    def run(batches):
        made = []
        for (tree, _), ((n, *head), *rows) in _blocks(batches, ("n", "digest", *columns, *above, "proof")):
            head = head[top:]  # the columns above and the upper proof
            below = _levels([r[1] for r in rows], n, fanout, levels)
            for i, r in enumerate(rows):
                proof, at = [], i
                for level in below[:-1]:
                    lo = at - at % fanout
                    proof.append({"left": "".join(level[lo:at]), "right": "".join(level[at + 1:lo + fanout])})
                    at //= fanout
                made.append((tree, *r[1:1 + top], *head[:-1], proof + head[-1]))
                if len(made) == BATCH:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)
                    made = []
        if made:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    return _by_block(leaves.unionByName(heads)).mapInArrow(run, schema)


def _tree(nodes: DataFrame, order: list[str], fanout: int, levels: int, scratch: Written):
    numbered = _numbered(nodes, order, fanout ** levels, scratch)
    return numbered, _butterfly(_block_roots(numbered, fanout, levels), fanout, levels, scratch)


def manifest(docs: DataFrame, fields: tuple = FIELDS, group: str = "source", order: str = "doc_id",
             check: Column | None = None, fanout: int = FANOUT, levels: int = BLOCK_LEVELS,
             scratch: Written | None = None) -> DataFrame:
    """(group, order, leaf, subroot, root, proof) of every row, and ``checked`` if ``check`` is given.

    ``proof`` holds, level by level from the leaf to the root of everything, what
    stands left and right of the node in its run; ``fold(leaf, proof)`` is the
    root. ``check`` is a digest to be verified later by the proofs (e.g. of the
    row as another copy of the data has it). Rows come in any order; a
    repeated ``order`` value is ordered by leaf, a null one comes first, a
    null group is a group of its own before all others. Null and empty texts
    have different leaves. Columns outside ``fields`` do not matter, whatever
    their names. An empty table gives no rows.
    """
    scratch = scratch or Written(docs.sparkSession, "merkle")
    nodes = scratch.put(docs.select(
        F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit("")).alias("tree"),
        docs[order].alias("_order"), digest([docs[c] for c in fields]).alias("digest"),
        (F.lit(None).cast("string") if check is None else check).alias("checked")), "leaves")
    numbered, state = _tree(nodes, ["_order", "digest"], fanout, levels, scratch)
    # the same over the groups' roots
    upper = Written(docs.sparkSession, "merkle-groups")
    subroots = state.filter("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("_group"),
                                                F.col("root").alias("digest"))
    groups = upper.put(_proofs(*_tree(subroots, ["_group"], fanout, levels, upper), ["_group"], ["root"],
                               fanout, levels), "proofs")
    # each block with both roots and all siblings above it
    heads = state.withColumnRenamed("root", "subroot").join(groups.select(
        F.col("_group").alias("tree"), "root", F.col("proof").alias("_above")), "tree")
    heads = heads.withColumn("proof", F.concat("proof", "_above"))
    out = _proofs(numbered, heads, ["_order", "checked"], ["subroot", "root"], fanout, levels)
    named = F.when(F.col("tree") != "", F.expr("substr(tree, 2)")).cast(docs.schema[group].dataType)
    return out.select(named.alias(group), F.col("_order").alias(order), F.col("digest").alias("leaf"), "subroot",
                      "root", "proof", *(["checked"] if check is not None else []))


def manifest_digests(docs: DataFrame) -> DataFrame:
    """The manifest with proof digests, verified against documents whose line breaks are
    deleted where 2 divides crc32(doc_id).

    Rows without a doc_id are not tampered with.
    """
    hit = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(2)) == 0
    text = F.when(hit, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    tampered = digest([text if c == "text" else docs[c] for c in FIELDS])
    return manifest(docs, check=tampered).withColumn("folded_root", fold(F.col("checked"), F.col("proof"))).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
