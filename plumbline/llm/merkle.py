"""Merkle-tree fingerprints of documents, with SQL functions only.

A text is a tree: sections (split at empty lines) hold paragraphs (lines), paragraphs hold
pieces (a sentence, or 16 words of a longer one). A leaf is the digest of a piece, an inner
node the digest of its children, so equal roots mean equal texts, and the pieces whose
digests differ show where two texts differ. The pieces of a tree cover its text fully.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import row_chunks, with_previous

#: Up to 16 words, ending early after a word that ends a sentence; white space stays with them.
PIECE = r"\s*(?:\S*[^\s.!?]\s+){0,15}\S+\s*|\s+"
#: Digits of a leaf that a fingerprint shows; the root is made from whole digests.
LEAF_DIGITS = 8


def tree(text: Column) -> Column:
    """The tree of a text: array of sections, arrays of paragraphs, arrays of leaf digests."""
    section = lambda s: F.transform(F.split(s, "\n", -1), paragraph)
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), F.md5)
    return F.transform(F.split(text, "\n\n", -1), section)


def fingerprint_of(nodes: Column) -> Column:
    """``root|leaves``: the root decides equality; leaves part at ``,``, paragraphs at ``/``, sections at ``;``."""
    paragraph = lambda p: F.md5(F.concat(F.lit("p"), F.concat_ws(",", p)))
    section = lambda s: F.md5(F.concat(F.lit("s"), F.concat_ws(",", F.transform(s, paragraph))))
    sections = F.transform(nodes, section)
    root = F.sha2(F.concat(F.lit("d"), F.concat_ws(",", sections)), 256)
    shown = lambda p: F.concat_ws(",", F.transform(p, lambda x: F.substring(x, 1, LEAF_DIGITS)))
    body = F.concat_ws(";", F.transform(nodes, lambda s: F.concat_ws("/", F.transform(s, shown))))
    return F.concat(root, F.lit("|"), body)


def leaves_of(fingerprint: Column) -> Column:
    """The distinct leaf digests written in a fingerprint."""
    body = F.substring_index(fingerprint, "|", -1)
    return F.array_distinct(F.array_remove(F.split(body, "[,/;]"), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of leaves that two leaf sets have in common: 2 * common / (a + b); 1 for two empty ones."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Add ``n_chars``, ``fingerprint`` and ``leaves`` to (doc_id, text); a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
    out = out.withColumn("fingerprint", fingerprint_of(tree(F.col("text"))))
    return out.withColumn("leaves", leaves_of(F.col("fingerprint")))


def differing_branches(a: Column, b: Column) -> Column:
    """The places (section, paragraph, piece; from 1) of the leaves of tree ``a`` that differ from tree ``b``."""
    at = lambda nodes, i: F.get(nodes, i)

    def in_section(s, i):
        other = at(b, i)
        return F.flatten(F.transform(s, lambda p, j: in_paragraph(p, i, j, at(other, j))))

    def in_paragraph(p, i, j, other):
        places = F.transform(p, lambda x, k: F.when(~x.eqNullSafe(F.get(other, k)), F.struct((i + 1).alias("section"), (j + 1).alias("paragraph"), (k + 1).alias("piece"))))
        return F.array_compact(places)

    return F.flatten(F.transform(a, in_section))


def with_edited(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text) with ``edited`` and ``next_leaves``.

    In the edited text the last third of the code points (rounded down) gives way to as
    many from the start of the next document, or all of it. Next means the next smaller
    doc_id, and the largest one after the smallest. ``next_leaves`` are the leaves of the
    next document's fingerprint.

    A null text counts as empty. Rows with one doc_id are separate documents that share
    their next document; as a next document the one with the smallest start stands for
    them. A null doc_id sorts below all others. No documents give no rows.
    """
    # a null id is a key of its own
    kind = docs.schema["doc_id"].dataType
    key = lambda c: (c.isNull(), F.coalesce(c, F.lit(0).cast(kind)))
    null, filled = key(F.col("doc_id"))
    # both joins below read these columns and no others, so they share one exchange of the texts
    clean = docs.select(null.alias("_null"), filled.alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    doc_id = F.when(~F.col("_null"), F.col("_id"))
    third = F.floor(F.char_length("text") / 3).cast("int")
    thirds = docs.select("doc_id", F.floor(F.coalesce(F.char_length("text"), F.lit(0)) / 3).cast("int").alias("_third"))
    ids = row_chunks(thirds.groupBy("doc_id").agg(F.max("_third").alias("_third")), [], ["doc_id"])
    ordered = ids.withColumn("_order", F.struct(F.col("doc_id").isNotNull(), "doc_id"))
    linked = with_previous(ordered, [], "_order", "_chunk", ["doc_id"], "_next")
    largest = F.lit(ids.agg(F.max("doc_id")).first()[0]).cast(kind)
    after = linked.withColumn("_from", F.when(F.col("_next").isNull(), largest).otherwise(F.col("_next.doc_id")))
    (for_null, for_id), (from_null, from_id) = key(F.col("doc_id")), key(F.col("_from"))
    links = after.select(
        for_null.alias("_for_null"), for_id.alias("_for_id"), from_null.alias("_null"), from_id.alias("_id"), "_third"
    )
    heads = (
        clean.join(links, ["_null", "_id"])
        .select(F.col("_for_null").alias("_null"), F.col("_for_id").alias("_id"), F.substring("text", F.lit(1), F.col("_third")).alias("head"), leaves_of(fingerprint_of(tree(F.col("text")))).alias("leaves"))
        .groupBy("_null", "_id")
        .agg(F.min(F.struct("head", "leaves")).alias("_head"))
    )
    kept = F.substring("text", F.lit(1), F.char_length("text") - third)
    return clean.join(heads, ["_null", "_id"]).select(
        doc_id.alias("doc_id"),
        "text",
        F.concat(kept, F.substring(F.col("_head.head"), F.lit(1), third)).alias("edited"),
        F.col("_head.leaves").alias("next_leaves"),
    )


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and its edited text, and how alike they are."""
    out = with_edited(docs)
    out = out.withColumn("fingerprint", fingerprint_of(tree(F.col("text"))))
    out = out.withColumn("edited_fingerprint", fingerprint_of(tree(F.col("edited"))))
    out = out.withColumn("_own", leaves_of(F.col("fingerprint")))
    return out.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("_own"), leaves_of(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(F.col("_own"), F.col("next_leaves")).alias("near_next"),
    )
