"""A manifest of a dataset as a Merkle tree, by pivoting children into the slots of their parent.

Each row is a leaf: the digest of its fields. The leaves of a language, in order of doc_id, are the
bottom of that language's tree; the roots of all languages are the leaves of a last tree, whose root
stands for the dataset. Every ``FANOUT`` consecutive nodes have one parent. A level is one
grouping by parent with a conditional aggregate for each slot, so a parent's row holds its children
side by side: all slots concatenated and hashed are its digest, all slots but one are the siblings of
that one. Proofs are handed down from the top the same way: each parent's proof is joined to the row
of its slots, an eighth as many rows as there are nodes, and the slots are taken apart again.
So no level is ever joined to all documents.

A digest H is the lowercase hex sha256 of its inputs one after the other, digests as hex text; it is
held as 32 bytes in between. A field is ``-`` if null, else its length in UTF-8 bytes, ``:`` and
its value, integers in decimal.

Work grows with the rows (each level has an eighth of the one below); the driver holds one number for
each level and the row counts of sort ranges, at most one for each shuffle partition and language.

Defined results: a null doc_id comes first in its language, a null language is one of its own and the
first of all. Rows that share language and doc_id are ordered by their digest, those equal in all
fields by their place in the input; the input must therefore be read from files or be kept. Empty and
null texts differ (``0:`` and ``-``). No rows, no tree: the result is empty. Further columns are
ignored. The checksum of a null doc_id is that of the empty text, 0, which 3 divides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import store

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SLOTS = [f"slot_{k}" for k in range(FANOUT)]
_STEP = "struct<before:binary,after:binary>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """H of text parts, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def as_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    return digest(*(field(changed.get(c, F.col(c))) for c in FIELDS))


def leaves_of(documents: DataFrame) -> DataFrame:
    """(tree, place, nodes, node) of each row, where node has doc_id, digest and altered, the digest
    after tampering or null; place counts from 0 in the tree, which has so many nodes."""
    altered = leaf_of(text=F.translate("text", _UPPER, _LOWER))
    touched = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 0
    rows = store(
        documents.select(*FIELDS).select(
            # A name that is never null and sorts as the language does, null first.
            F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree"),
            "doc_id", leaf_of().alias("digest"), F.when(touched, altered).alias("altered"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("at")]
    ranges = store(
        rows.repartitionByRange(F.col("tree"), *order).withColumn("range_no", F.spark_partition_id())
    )
    return _numbered(ranges, order).select(
        "tree", "place", "nodes", F.struct("doc_id", "digest", "altered").alias("node")
    )


def _numbered(ranges: DataFrame, order: list[Column]) -> DataFrame:
    """Adds the place of each row in its tree, and the tree's rows. Ranges are numbered each by itself
    and begin where those before them end; a tree of any size is thus cut into ranges."""
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("tree", "range_no").agg(F.count(F.lit(1)).alias("n")).select(
        "tree", "range_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"),
        F.sum("n").over(whole).alias("nodes"),
    )
    within = F.row_number().over(Window.partitionBy("tree", "range_no").orderBy(*order))
    return (
        ranges.withColumn("within", within - 1)
        .join(starts, ["tree", "range_no"])
        .withColumn("place", F.col("first") + F.col("within"))
    )


def pivoted(nodes: DataFrame) -> DataFrame:
    """A row for each parent: (tree, place, nodes) of the parent, its children in slot columns, and its
    digest."""
    slot = F.col("place") % FANOUT
    spread = [F.max(F.when(slot == k, F.col("node"))).alias(name) for k, name in enumerate(_SLOTS)]
    up = nodes.groupBy(
        "tree", F.expr(f"place DIV {FANOUT}").alias("place"),
        F.expr(f"(nodes + {FANOUT - 1}) DIV {FANOUT}").alias("nodes"),
    ).agg(*spread)
    return up.withColumn("digest", F.unhex(F.sha2(_hex([f"{s}.digest" for s in _SLOTS]).cast("binary"), 256)))


def _hex(names: list[str]) -> Column:
    """The digests of some slots one after the other as hex text; empty slots add nothing."""
    return F.concat_ws("", *(as_text(F.col(n)) for n in names)) if names else F.lit("")


def _bytes(names: list[str]) -> Column:
    return F.concat(*(F.coalesce(F.col(n), F.lit(b"")) for n in names)) if names else F.lit(b"")


def climb(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees, from the bottom, and (tree, digest) of their roots."""
    levels, roots, nodes = [], None, leaves
    while True:
        tops = nodes.where("nodes = 1").select("tree", "node.digest")
        roots = tops if roots is None else roots.unionByName(tops)
        level = store(pivoted(nodes.where("nodes > 1")))
        if level.isEmpty():
            return levels, roots
        levels.append(level)
        nodes = level.select("tree", "place", "nodes", F.struct("digest").alias("node"))


def _apart(level: DataFrame, proofs: DataFrame) -> DataFrame:
    """(tree, place, node, proof) of a level's nodes, where ``proofs`` has the proof of each parent.
    A step of a proof has the siblings to the left and to the right; the node's own step is first."""
    held = level.drop("digest").join(proofs, ["tree", "place"])

    def own(k: int) -> Column:
        before = _bytes([f"{s}.digest" for s in _SLOTS[:k]])
        after = _bytes([f"{s}.digest" for s in _SLOTS[k + 1 :]])
        step = F.struct(before.alias("before"), after.alias("after"))
        return F.struct(
            (F.col("place") * FANOUT + k).alias("place"), F.col(_SLOTS[k]).alias("node"),
            F.concat(F.array(step), F.col("proof")).alias("proof"),
        )

    children = F.filter(F.array(*(own(k) for k in range(FANOUT))), lambda c: c["node"].isNotNull())
    return held.select("tree", F.explode(children).alias("child")).select("tree", "child.*")


def proven(leaves: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, node, proof) of each leaf; ``above`` has (tree, proof) of each tree's root."""
    found = None
    lone = leaves.where("nodes = 1").select("tree", "node").join(above, "tree").select("tree", "node", "proof")
    proofs = None
    for level in reversed(levels):
        tops = level.where("nodes = 1").select("tree", "place").join(above, "tree")
        known = tops if proofs is None else proofs.select("tree", "place", "proof").unionByName(tops)
        proofs = _apart(level, known)
    if proofs is not None:
        found = proofs.select("tree", "node", "proof")
    return lone if found is None else found.unionByName(lone)


def folded(start: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(
        "proof", start,
        lambda so_far, step: digest(as_text(step["before"]), as_text(so_far), as_text(step["after"])),
    )


def manifest(documents: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    leaves = store(leaves_of(documents))
    levels, subroots = climb(leaves)
    subroots = store(subroots)
    # The last tree has a leaf for each language; they are numbered as the rows were.
    ranges = store(subroots.repartitionByRange("tree").withColumn("range_no", F.spark_partition_id()))
    top = _numbered(
        ranges.select(F.lit("").alias("tree"), F.col("tree").alias("language"), "digest", "range_no"),
        [F.col("language")],
    ).select("tree", "place", "nodes", F.struct("language", "digest").alias("node"))
    top = store(top)
    top_levels, root = climb(top)
    ends = root.select("tree", F.col("digest").alias("root"))
    none = root.select("tree", F.expr(f"CAST(array() AS array<{_STEP}>)").alias("proof"))
    above = (
        proven(top, top_levels, none).join(ends, "tree")
        .select(
            F.col("node.language").alias("tree"), F.col("node.digest").alias("subroot"), "root", "proof"
        )
    )
    above = store(above)
    rows = proven(leaves, levels, above.select("tree", "proof")).join(above.drop("proof"), "tree")
    node = F.col("node")
    siblings = F.concat_ws(
        "", F.transform("proof", lambda s: F.concat(as_text(s["before"]), as_text(s["after"])))
    )
    start = F.coalesce(node["altered"], node["digest"])
    return rows.select(
        node["doc_id"].alias("doc_id"), as_text(node["digest"]).alias("leaf"),
        as_text(F.col("subroot")).alias("subroot"), as_text(F.col("root")).alias("root"),
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        as_text(folded(start)).alias("folded_root"), (folded(start) == F.col("root")).alias("verified"),
    )
