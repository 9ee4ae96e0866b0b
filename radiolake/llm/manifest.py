"""Merkle manifest of a feedback store: proofs for every record by butterfly exchange between blocks of leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.session import cut_lineage

FANOUT = 2
BLOCK = 1024  # leaves
FEEDBACK_FIELDS = (
    "feedback_id", "timestamp", "session_id", "event_id", "source", "anomaly_type", "severity", "detector", "cell_id",
    "verdict", "comment", "evidence",
)


def digest(parts: Sequence[str]) -> str:
    """H: lowercase hex SHA-256 of the parts put together."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a record: each field as ``-`` if null, else its UTF-8 byte count, ``:`` and the value as text."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown]), 256)


def numbered(rows: DataFrame, part: str, order: Sequence[str], label: str) -> DataFrame:
    """Rows with ``pos``, their place from 0 within ``part`` (nulls first), whatever the size of a part.

    Rows are dealt by ranges of (part, order), so a large part spreads over many tasks, and written with
    their place in the range; the counts of the ranges, one row per range and part, give the rest.
    """
    at = [F.col(part).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = rows.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut_lineage(dealt, label).withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy(part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range", part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    ranges = ranges.select(F.col("_range").alias("_r"), F.col(part).alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    met = dealt.join(ranges, (F.col("_range") == F.col("_r")) & F.col(part).eqNullSafe(F.col("_p")))
    return met.select(*rows.columns, (F.col("_base") + F.col("_at") - F.col("_first")).alias("pos"))


def levels_over(count: int, fanout: int) -> int:
    """Levels until that many nodes are one."""
    levels = 0
    while count > 1:
        count, levels = -(-count // fanout), levels + 1
    return levels


def climb(nodes: list[str], levels: int, fanout: int) -> tuple[str, list[list[list[str]]]]:
    """Root after ``levels`` levels, and per level the runs of nodes that were hashed together."""
    kept = []
    for _ in range(levels):
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        kept.append(runs)
        nodes = [digest(run) for run in runs]
    return nodes[0], kept


def path_of(place: int, kept: list[list[list[str]]], fanout: int) -> list[tuple[list[str], list[str]]]:
    """Per level the siblings before and after a leaf's ancestor."""
    out = []
    for runs in kept:
        run, at = runs[place // fanout], place % fanout
        out.append((run[:at], run[at + 1 :]))
        place //= fanout
    return out


def fold(node: str, path: Sequence[tuple[Sequence[str], Sequence[str]]]) -> str:
    """Root that a leaf and its siblings give."""
    for left, right in path:
        node = digest([*left, node, *right])
    return node


def _inner(size: int, total: int, block: int, fanout: int) -> int:
    """Levels inside a block: those of its own leaves if it is the only one of its part, else those of a full block."""
    return levels_over(block if total > block else size, fanout)


def _block_roots(block: int, fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for leaves, total in zip(batch.column("leaves"), batch.column("total").to_pylist()):
                names = leaves.values.field("leaf").to_pylist()
                roots.append(climb(names, _inner(len(names), total, block, fanout), fanout)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "root"])

    return run


def butterfly(nodes: DataFrame, part: str, fanout: int = FANOUT) -> DataFrame:
    """part, place, root of the part, and ``path``, the siblings left and right of a node's ancestors, level by level.

    ``nodes`` is (part, place, count, root), place running from 0 below count. In round r the nodes whose places differ in
    digit r alone (base ``fanout``) swap the roots of the subtrees they are in, so each holds the next
    ancestor and its siblings; a subtree's root is hashed again by every node in it, and no
    pass goes down again. Places are filled up to a power of the fanout by empty nodes, which learn and
    hand on their subtree's root as all others do, so a last, shorter group misses nobody. An
    exchange is at most ``fanout`` rows, and there is a round per level.

    Parts of any number of nodes share a round; those that are done stay as they are.
    """
    powers = [fanout**i for i in range(levels_over(1 << 62, fanout))]
    state = nodes.withColumn("levels", F.size(F.filter(F.array(*[F.lit(p) for p in powers]), lambda p: p < F.col("count"))))
    side = "array<struct<before:array<string>,after:array<string>>>"
    real = state.select(part, "place", "levels", F.lit(True).alias("real"), "root", F.array().cast(side).alias("path"))
    full = F.pow(F.lit(fanout), F.col("levels")).cast("long")
    empty = state.where("place = count - 1").where(F.col("count") < full).select(
        part, F.explode(F.sequence(F.col("count").cast("long"), full - 1)).alias("place"), "levels",
        F.lit(False).alias("real"), F.lit(None).cast("string").alias("root"), F.array().cast(side).alias("path"),
    )
    state = cut_lineage(real.unionByName(empty), "butterfly")
    rounds = state.agg(F.max("levels")).first()[0] or 0
    for r in range(rounds):
        step = fanout**r
        digit = F.pmod(F.floor(F.col("place") / step), F.lit(fanout))
        open_part = F.col("levels") > r
        w = Window.partitionBy(part, "levels", F.when(open_part, F.col("place") - digit * step).otherwise(F.col("place")))
        met = F.sort_array(F.collect_list(F.when(F.col("root").isNotNull(), F.struct(digit.alias("digit"), "root"))).over(w))
        swapped = state.withColumn("_met", F.when(open_part, met)).withColumn("_digit", digit)
        side_of = lambda keep: F.transform(F.filter("_met", keep), lambda x: x["root"])
        step_of = F.struct(side_of(lambda x: x["digit"] < F.col("_digit")).alias("before"), side_of(lambda x: x["digit"] > F.col("_digit")).alias("after"))
        parent = F.when(F.size("_met") > 0, F.sha2(F.array_join(F.transform("_met", lambda x: x["root"]), ""), 256))
        state = swapped.select(
            part, "place", "levels", "real",
            F.when(open_part, parent).otherwise(F.col("root")).alias("root"),
            F.when(open_part & F.col("real"), F.concat("path", F.array(step_of))).otherwise(F.col("path")).alias("path"),
        )
        if r % 8 == 7:
            state = cut_lineage(state, "butterfly")
    return state.where("real").select(part, "place", "root", "path")


def _proofs(block: int, fanout: int):
    """Per block of leaves with the siblings above it: a row per leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["leaves", "total", "path", "subroot", "top_path", "root"]).to_pylist():
                leaves = row["leaves"]
                names = [x["leaf"] for x in leaves]
                kept = climb(names, _inner(len(names), row["total"], block, fanout), fanout)[1]
                above = [(s["before"], s["after"]) for s in row["path"] + row["top_path"]]
                proofs, folded = [], []
                for place, x in enumerate(leaves):
                    path = path_of(place, kept, fanout) + above
                    proofs.append(digest([d for sides in path for side in sides for d in side]))
                    folded.append(fold(x["claimed"], path))
                n = len(leaves)
                yield pa.RecordBatch.from_pydict({
                    "id": [x["id"] for x in leaves], "leaf": names, "subroot": [row["subroot"]] * n, "root": [row["root"]] * n,
                    "proof_sha256": proofs, "folded_root": folded, "verified": [f == row["root"] for f in folded],
                }, schema=_proof_schema(batch.schema.field("leaves").type.value_type.field("id").type))

    return run


def _proof_schema(id_type: pa.DataType) -> pa.Schema:
    texts = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return pa.schema([("id", id_type), *[(t, pa.string()) for t in texts], ("verified", pa.bool_())])


def feedback_manifest(
    records: DataFrame, fields: Sequence[str] = FEEDBACK_FIELDS, feedback_id: str = "feedback_id", source: str = "source",
    claimed: dict[str, Column] | None = None, fanout: int = FANOUT, block: int = BLOCK,
) -> DataFrame:
    """Leaf, roots and proof of every feedback record, and whether the record as claimed folds to the root.

    A leaf is the digest of the record's ``fields`` in that order. The leaves of a source, ascending by
    feedback_id (nulls first, ties by leaf, then by claimed leaf), are one subtree: every ``fanout`` nodes in a row become their digest, a last
    run may be shorter, until one remains, the subroot. The subroots, ordered by source
    (null first, then by UTF-8 bytes), give the root in the same way. ``claimed`` maps fields to what a
    record claims to hold there (default: the record itself); that leaf is folded with the proof of the true one.

    Returns feedback_id, leaf, subroot, root, proof_sha256 (digest of the siblings, level by level to the root, left to
    right), folded_root and verified. Nulls in any field are part of the leaf; a null source is a source. Repeated rows are leaves
    each. No rows in, no rows out; other columns are ignored.

    Leaves are numbered without a window over a source and cut into aligned blocks of ``block`` leaves, a
    power of the fanout, so a source may hold most of the records. A block hashes its own subtree; blocks of
    a source, then sources, swap subtree roots in a butterfly (see ``butterfly``). Each block then has all
    siblings above it and writes its records' proofs, with no pass down the tree.
    """
    if levels_over(block, fanout) and fanout ** levels_over(block, fanout) != block:
        raise ValueError("a block must be a power of the fanout")
    now = [records[c] for c in fields]
    said = [(claimed or {}).get(c, records[c]) for c in fields]
    leaves = records.select(records[source].cast("string").alias("part"), records[feedback_id].alias("id"), leaf(now).alias("leaf"), leaf(said).alias("said"))
    leaves = leaves.select("part", "id", "leaf", F.when(F.col("said") != F.col("leaf"), F.col("said")).alias("said"))
    placed = numbered(leaves, "part", ["id", "leaf", "said"], "manifest-leaves")
    gathered = F.sort_array(F.collect_list(F.struct("pos", "id", "leaf", F.coalesce("said", "leaf").alias("claimed"))))
    blocks = placed.groupBy("part", F.floor(F.col("pos") / block).alias("place")).agg(gathered.alias("leaves"))
    sizes = blocks.select("part", "place", "leaves", F.size("leaves").alias("size"))
    totals = placed.groupBy("part").agg(F.count(F.lit(1)).alias("total"), (F.floor((F.count(F.lit(1)) - 1) / block) + 1).alias("count"))
    totals = totals.select(F.col("part").alias("_p"), "total", "count")
    met = sizes.join(totals, F.col("part").eqNullSafe(F.col("_p"))).select("part", "place", "count", "total", "leaves")
    kind = met.withColumn("root", F.lit("")).schema
    blocks = cut_lineage(met.mapInArrow(_block_roots(block, fanout), kind), "manifest-blocks")

    upper = cut_lineage(butterfly(blocks.select("part", "place", "count", "root"), "part", fanout), "manifest-uppers")
    subroots = upper.where("place = 0").select("part", F.col("root").alias("subroot"))
    ordered = numbered(subroots.withColumn("all", F.lit(0)), "all", ["part"], "manifest-subroots")
    many = ordered.agg(F.count(F.lit(1))).first()[0]
    tops = butterfly(ordered.select("all", F.col("pos").alias("place"), F.lit(many).alias("count"), F.col("subroot").alias("root")), "all", fanout)
    tops = ordered.join(tops, ordered.pos == tops.place).select(F.col("part").alias("_t"), "subroot", F.col("path").alias("top_path"), tops.root.alias("root"))
    above = upper.select(F.col("part").alias("_u"), F.col("place").alias("_place"), "path").join(tops, F.col("_u").eqNullSafe(F.col("_t")))
    ready = blocks.drop("root").join(above, F.col("part").eqNullSafe(F.col("_u")) & (F.col("place") == F.col("_place")))
    ready = ready.select("leaves", "total", "path", "subroot", "top_path", "root")
    out = records.select(records[feedback_id].alias("id"), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified")).schema
    return ready.mapInArrow(_proofs(block, fanout), out).withColumnRenamed("id", feedback_id)
