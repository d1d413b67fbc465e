"""Document fingerprints: a Merkle tree over the paragraphs and sections of each text. Native expressions only.

A section ends after a blank line or before a heading (a line that begins with #), a paragraph after a run of line
ends. Separators belong to the piece they end, so every character is under the root. A paragraph's node is the SHA-256
of its text, a section's that of its paragraphs' nodes, the root that of its sections' nodes; each level has its own
prefix. Equal roots mean equal texts. Below a paragraph stand its leaves, one for each clause (up to 48 characters, ended by
punctuation) in order: 48 bits of XXH64 and 16 bits of length.

Trees are compared branch by branch: ``changed_branches`` lists the paragraphs whose nodes differ without entering equal
sections, ``first_change`` walks on to the leaf where the first of them differs. ``likeness`` is the share of characters under
leaves that two trees have in common (Dice over distinct leaves; equal branches have equal leaves); it is 1 exactly where
the roots are equal.

Nulls count as empty texts, an empty text has one empty paragraph, repeated rows get equal fingerprints, extra columns
stay as they are (those of the names that are added are replaced), an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SECTION = r"(?<=\n\n)(?!\n)|(?<=\n)(?=#)"
PARAGRAPH = r"(?<=\n)(?!\n)"
CLAUSE = r"[^.,!?;:|\n]{1,48}[.,!?;:|\s]*|[.,!?;:|\n]+"
#: Documents in a bucket of the ordered pass.
ROWS_PER_BUCKET = 8192


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def leaves(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(0)),
        lambda x: F.shiftleft(F.shiftright(F.xxhash64(x), 16), 16).bitwiseOR(F.length(x).cast("long")),
    )


def tree(text: Column) -> Column:
    """Array of sections: node, paragraphs (node, leaves)."""
    paragraph = lambda p: F.struct(F.sha2(F.concat(F.lit("p:"), p), 256).alias("node"), leaves(p).alias("leaves"))
    joined = lambda ps: F.sha2(F.concat(F.lit("s:"), F.array_join(F.transform(ps, lambda p: p["node"]), "")), 256)
    section = lambda s: _let(F.transform(F.split(s, PARAGRAPH), paragraph), lambda ps: F.struct(joined(ps).alias("node"), ps.alias("paragraphs")))
    return F.transform(F.split(text, SECTION), section)


def root(sections: Column) -> Column:
    return F.sha2(F.concat(F.lit("d:"), F.array_join(F.transform(sections, lambda s: s["node"]), "")), 256)


def _characters(codes: Column) -> Column:
    return F.aggregate(codes, F.lit(0).cast("long"), lambda total, x: total + x.bitwiseAND(F.lit(65535).cast("long")))


def distinct_leaves(sections: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["leaves"])))))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """Of two trees, by their roots and distinct leaves."""
    both = _characters(leaves_a) + _characters(leaves_b)
    shared = 2.0 * _characters(F.array_intersect(leaves_a, leaves_b)) / F.greatest(both, F.lit(1))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(F.least(shared, F.lit(0.999999)))


def fingerprint(df: DataFrame, text: str = "text", prefix: str = "fp_") -> DataFrame:
    """Add <prefix>root and <prefix>sections; columns of these names are replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    both = _let(tree(whole), lambda t: F.struct(root(t).alias("root"), t.alias("sections")))
    (held,) = common.free_names(df, "tree")
    stay = [F.col(f"`{x}`") for x in df.columns if x.lower() not in (f"{prefix}root".lower(), f"{prefix}sections".lower())]
    return df.withColumn(held, both).select(*stay, F.col(held)["root"].alias(f"{prefix}root"), F.col(held)["sections"].alias(f"{prefix}sections"))


def _differing(a: Column, b: Column, node: Callable[[Column], Column]) -> Column:
    """Positions at which two arrays differ by node, or that only one of them has."""
    longest = F.greatest(F.size(a), F.size(b))
    at = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.filter(at, lambda i: ~node(F.get(a, i)).eqNullSafe(node(F.get(b, i))))


_NODE = lambda x: x["node"]


def changed_branches(sections_a: Column, sections_b: Column) -> Column:
    """(section, paragraph) positions, from 0, whose nodes differ; equal section nodes aren't entered."""

    def walk(x: Column) -> Column:
        def inside(i: Column) -> Column:
            of = lambda s: F.get(s, i)["paragraphs"]
            # Size is -1 for a section that the other tree lacks.
            return F.transform(_differing(of(x["a"]), of(x["b"]), _NODE), lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

        return F.flatten(F.transform(_differing(x["a"], x["b"], _NODE), inside))

    return _let(F.struct(sections_a.alias("a"), sections_b.alias("b")), walk)


def first_change(sections_a: Column, sections_b: Column) -> Column:
    """Struct of the first differing section, paragraph and leaf, from 0, and the number of differing paragraphs; null for equal trees."""

    def walk(x: Column) -> Column:
        def found(branches: Column) -> Column:
            first = F.get(branches, F.lit(0))
            own = lambda s: F.get(F.get(s, first["section"])["paragraphs"], first["paragraph"])["leaves"]
            leaf = _let(F.struct(own(x["a"]).alias("a"), own(x["b"]).alias("b")), lambda y: F.get(_differing(y["a"], y["b"], lambda z: z), F.lit(0)))
            return F.when(F.size(branches) > 0, F.struct(first["section"].alias("section"), first["paragraph"].alias("paragraph"), F.coalesce(leaf, F.lit(0)).alias("leaf"), F.size(branches).cast("long").alias("paragraphs")))

        return _let(changed_branches(x["a"], x["b"]), found)

    return _let(F.struct(sections_a.alias("a"), sections_b.alias("b")), walk)


def with_next(df: DataFrame, key: str, text: str, derive: dict) -> DataFrame:
    """Each row's key and text with those of the next row in ascending key order, and derive's columns of both.

    One shuffle of the texts: rows go to buckets of the ordered key, and the first row of a bucket also goes, as a
    border row, to the bucket before it; so no row waits for another task. Rows of equal keys follow by text.
    """
    slim = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"), common.order_key(key).alias("k"))
    bounds = common.bucket_bounds(df.select(common.order_key(key).alias("k")), F.col("k"), ROWS_PER_BUCKET)
    last = max(len(bounds) - 1, 0)
    slim = slim.withColumn("own", common.bucket_of(F.col("k"), bounds))
    first = F.col("k") == F.get(F.lit(bounds or [0]), F.col("own"))
    place = lambda bucket, border, k: F.struct(bucket.cast("int").alias("bucket"), F.lit(border).alias("border"), k.alias("k"))
    wrapped = F.col("own") == 0
    border = place(F.when(wrapped, last).otherwise(F.col("own") - 1), 1, F.when(wrapped, F.lit(2**63 - 1)).otherwise(F.col("k")))
    own = place(F.col("own"), 0, F.col("k"))
    dealt = slim.select("id", "body", F.explode(F.when(first, F.array(own, border)).otherwise(F.array(own))).alias("at"))
    dealt = dealt.select("id", "body", "at.*").repartition("bucket")
    dealt = dealt.withColumns({name: make(F.col("body")) for name, make in derive.items()})
    order = Window.partitionBy("bucket").orderBy("k", "border", "body")
    return dealt.withColumn("next", F.lead(F.struct("body", *derive)).over(order)).where("border = 0").drop("bucket", "border", "k")


def edited_pairs(documents: DataFrame) -> DataFrame:
    """The digest columns of the registered query, over whole texts."""
    pairs = with_next(documents, "doc_id", "text", {"tree": tree})
    pairs = pairs.withColumn("n", F.length("body"))
    pairs = pairs.withColumn("edited", F.expr("concat(substring(body, 1, n - n div 2), substring(next.body, 1, cast(n div 2 as int)))"))

    def compared(x: Column) -> Column:
        def digest(y: Column) -> Column:
            change = first_change(x["own"], x["edited"])
            near = lambda name: likeness(y["own"], y["own_leaves"], y[name], y[f"{name}_leaves"])
            return F.struct(y["own"].alias("own"), y["edited"].alias("edited"), near("edited").alias("near_edited"), near("next").alias("near_next"), change.alias("change"))

        names = ("own", "edited", "next")
        return _let(F.struct(*[root(x[n]).alias(n) for n in names], *[distinct_leaves(x[n]).alias(f"{n}_leaves") for n in names]), digest)

    trees = F.struct(F.col("tree").alias("own"), tree(F.col("edited")).alias("edited"), F.col("next.tree").alias("next"))
    near = pairs.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), _let(trees, compared).alias("x"))
    change = F.col("x.change")
    return near.select(
        "doc_id", "n_chars", "edited_sha256",
        F.col("x.own").alias("fingerprint"), F.col("x.edited").alias("edited_fingerprint"), F.col("x.near_edited").alias("near_edited"), F.col("x.near_next").alias("near_next"),
        F.when(change.isNotNull(), F.concat_ws(".", change["section"], change["paragraph"], change["leaf"])).alias("first_change"),
        F.coalesce(change["paragraphs"], F.lit(0)).alias("changed_paragraphs"),
    )


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(common.table(spark, sf_dir, "documents"))
