"""Merkle manifest of a table: a tree of digests per source, folded from saved hash states."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS = "tree string, size bigint, idx bigint, digest string"


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values as text: `-` for null, else UTF-8 byte count, colon, value."""
    spelled = []
    for v in values:
        s = v.cast("string")
        spelled.append(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*spelled), 256)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """`df` with idx, the place of a row (from 0) in its `tree` by `order`, and size, the tree's rows.

    Rows are range-partitioned and sorted by (tree, order); a tree's place goes on from partition to
    partition by counts, one row per tree and partition. A tree of any size is spread over partitions.
    """
    rows = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "__tie")
    rows = cut(rows.sortWithinPartitions("tree", *order, "__tie").drop("__tie"))
    rows = rows.withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    own = rows.groupBy("tree", "__part").agg(F.count("*").alias("__n"), F.min("__seq").alias("__first"))
    by_part = Window.partitionBy("tree").orderBy("__part")
    whole = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.select(
        "tree", "__part", "__first", F.coalesce(F.sum("__n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("size"))
    out = rows.join(own, ["tree", "__part"]).withColumn("idx", F.col("__before") + F.col("__seq") - F.col("__first"))
    return cut(out.drop("__part", "__seq", "__first", "__before"))


class Parents:
    """Some consecutive nodes and the levels above them; every parent keeps its hash state before each child slot."""

    def __init__(self, digests: list[str], height: int):
        self.levels, self.states = [digests], []
        for _ in range(height):
            below, above, states = self.levels[-1], [], []
            for k in range(0, len(below), ARITY):
                h, kept = sha256(), []
                for child in below[k : k + ARITY]:
                    kept.append(h.copy())
                    h.update(child.encode())
                states.append(kept)
                above.append(h.hexdigest())
            self.levels.append(above)
            self.states.append(states)

    def siblings(self, k: int) -> list[tuple[str, str]]:
        """What stands left and right of node k and of its ancestors, level by level."""
        out = []
        for level in self.levels[:-1]:
            a = k - k % ARITY
            out.append(("".join(level[a:k]), "".join(level[k + 1 : a + ARITY])))
            k //= ARITY
        return out

    def fold(self, k: int, digest: str) -> str:
        """The top if node k were `digest`: the state before its slot goes on with it and its right siblings."""
        for level, states in zip(self.levels, self.states):
            at, slot = divmod(k, ARITY)
            h = states[at][slot].copy()
            h.update(digest.encode())
            for right in level[k + 1 : (at + 1) * ARITY]:
                h.update(right.encode())
            digest, k = h.hexdigest(), at
        return digest


class Upper:
    """The way from a block's top to the root: the states before its slots, and what follows them."""

    def __init__(self, path: str):
        pairs = [p.split("|") for p in path.split(";") if p]
        self.siblings = "".join(a + b for a, b in pairs)
        self.steps = [(sha256(a.encode()), b.encode()) for a, b in pairs]

    def fold(self, digest: str) -> str:
        for state, right in self.steps:
            h = state.copy()
            h.update(digest.encode())
            h.update(right)
            digest = h.hexdigest()
        return digest


def _height(size: int, levels: int) -> int:
    """Levels inside a block: all of a tree that is one block, else `levels`."""
    h = 0
    while h < levels and size > 1:
        size, h = -(-size // ARITY), h + 1
    return h


def _by_block(rows: DataFrame, handle: Callable[[list[dict], Parents], list[dict]], schema: pa.Schema, ddl: str, levels: int) -> DataFrame:
    """Send each block of ARITY ** levels neighbours to one task, in order, and `handle` it there.

    A row with idx -1, if any, comes first in its block: what is known about the block as a node.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> list[dict]:
            own = [r for r in block if r["idx"] >= 0]
            return handle(block, Parents([r["digest"] for r in own], _height(own[0]["size"], levels))) if own else []

        block, at, out = [], None, []
        for batch in batches:
            for r in batch.to_pylist():
                if at != (r["tree"], r["block"]):
                    if block:
                        out += done()
                    block, at = [], (r["tree"], r["block"])
                    if len(out) >= 2_000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                block.append(r)
        if block:
            out += done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx").mapInArrow(scan, ddl)


def _blocks(levels: int) -> Column:
    return F.floor(F.col("idx") / F.lit(ARITY**levels)).cast("long").alias("block")


def climb(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (tree, size, idx, digest): the leaves, then every level that ends a block, up to single tops."""
    schema = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("idx", pa.int64()), ("digest", pa.string())])

    def top(block: list[dict], parents: Parents) -> list[dict]:
        r = block[0]
        return [{"tree": r["tree"], "size": -(-r["size"] // ARITY**levels), "idx": r["block"], "digest": parents.levels[-1][0]}]

    tables = [leaves.select("tree", "size", "idx", "digest")]
    first = True
    while first or tables[-1].where("size > 1").limit(1).count():
        rows = tables[-1] if first else tables[-1].where("size > 1")
        tables.append(cut(_by_block(rows.select("*", _blocks(levels)), top, schema, ROWS, levels)))
        first = False
    return tables


def descend(tables: list[DataFrame], tops: DataFrame, levels: int, last: int) -> DataFrame:
    """(tree, idx, path): the siblings from each node of tables[last] to the root; `tops` is (tree, path) of whole trees."""
    schema = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("path", pa.string())])

    def paths(block: list[dict], parents: Parents) -> list[dict]:
        above = block[0]["path"]
        own = lambda k: ";".join(f"{a}|{b}" for a, b in parents.siblings(k))
        return [{"tree": r["tree"], "idx": r["idx"], "path": ";".join(x for x in (own(k), above) if x)} for k, r in enumerate(block[1:])]

    known = None
    for k in range(len(tables) - 1, last - 1, -1):
        ended = tables[k].where("size = 1").join(tops, "tree").select("tree", "idx", "path") if k or len(tables) == 1 else None
        if known is not None:
            rows = tables[k].where("size > 1") if k else tables[k]
            rows = rows.select("tree", "size", "idx", "digest", _blocks(levels), F.lit(None).cast("string").alias("path"))
            heads = known.select("tree", F.lit(0).cast("long").alias("size"), F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("string").alias("digest"), F.col("idx").alias("block"), "path")
            inner = _by_block(rows.unionByName(heads), paths, schema, "tree string, idx bigint, path string", levels)
            ended = inner if ended is None else ended.unionByName(inner)
        known = cut(ended)
    return known


def merkle_manifest(
    df: DataFrame, tampered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, tree_col: str = "source", id_col: str = "doc_id", levels: int = 7,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of `df`.

    A leaf is the digest of the `fields`. Each value of `tree_col` has a tree over its leaves by
    `id_col`: every ARITY neighbours become the digest of their digests until one node, the subroot,
    is left; the subroots, null first and then by UTF-8 bytes, have a tree of the same kind, its top
    is the root. proof_sha256 is the digest of a leaf's siblings up to the root. folded_root comes from
    the leaf with the columns of `tampered` in place of its own and the siblings of the original
    tree: in the leaf's block each parent resumes the state it kept before the child's slot, above
    it the states before the block's slots do. verified says that it equals the root.

    Blocks of ARITY ** `levels` neighbours are one unit of work; a tree of any size has as many as it
    needs, and each is built where its leaves were sent once more for the proofs. `levels` changes cost
    only. Null values are `-` in a leaf, and a null id comes first. Rows with one id are ordered by
    leaf; equal rows are interchangeable. An empty table gives no rows. Other columns are not read.
    """
    old = leaf_digest(*[F.col(c) for c in fields])
    new = leaf_digest(*[(tampered or {}).get(c, F.col(c)) for c in fields])
    # "" is before every other key, and UTF-8 bytes order the rest
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col(tree_col).cast("string")), F.lit("")).alias("tree"), old.alias("digest"), new.alias("changed"))
    rows = numbered(rows, "doc_id", "digest", "changed")
    tables = climb(rows, levels)
    subroots = None
    for t in tables[1:]:
        ended = t.where("size = 1").select(F.col("tree").alias("source"), "digest")
        subroots = ended if subroots is None else subroots.unionByName(ended)
    tops = numbered(subroots.withColumn("tree", F.lit("")), "source")
    upper = climb(tops, levels)
    root = upper[-1].where("size = 1").select("digest").first()  # one row, none of an empty table
    way = descend(upper, upper[-1].where("size = 1").select("tree", F.lit("").alias("path")), levels, 0)
    way = cut(tops.select("idx", "source", F.col("digest").alias("subroot")).join(way.select("idx", "path"), "idx").select(F.col("source").alias("tree"), "subroot", "path"))
    blocks = descend(tables, way.select("tree", "path"), levels, 1).join(way.select("tree", "subroot"), "tree")
    heads = blocks.withColumn("root", F.lit(root and root[0]))

    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def prove(block: list[dict], parents: Parents) -> list[dict]:
        head, upper_way, out = block[0], Upper(block[0]["path"]), []
        for k, r in enumerate(block[1:]):
            near = "".join(a + b for a, b in parents.siblings(k))
            folded = upper_way.fold(parents.fold(k, r["changed"]))
            out.append({
                "doc_id": r["doc_id"], "leaf": r["digest"], "subroot": head["subroot"], "root": head["root"],
                "proof_sha256": sha256((near + upper_way.siblings).encode()).hexdigest(), "folded_root": folded, "verified": folded == head["root"],
            })
        return out

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    leaves = rows.select("tree", _blocks(levels), "idx", "size", "doc_id", "digest", "changed", none("string", "path"), none("string", "subroot"), none("string", "root"))
    heads = heads.select("tree", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), none("bigint", "size"), none("bigint", "doc_id"), none("string", "digest"), none("string", "changed"), "path", "subroot", "root")
    ddl = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _by_block(leaves.unionByName(heads), prove, schema, ddl, levels)


def without_newlines(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """Tampering that deletes the \\n of the texts whose id has an even CRC-32; a null id has none."""
    even = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 2 == 0
    return {text_col: F.when(F.coalesce(even, F.lit(False)), F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))}
