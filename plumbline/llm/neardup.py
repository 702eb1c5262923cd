"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every distinct shingle set gets ``TREES`` labels of ``DEPTH`` minimum hashes. A tree is the
sorted order of its labels: sets that agree on a long prefix are neighbours. A prefix of
``START`` values opens a region; where a region is crowded, the sorted order itself goes
deeper, as only neighbours by longest common prefix are compared. Candidates come in three
rounds: first each set with the smallest id of its region, then the neighbours that are not
yet in one component, last (:func:`crowd_links`) what these two leave in regions of more
sets than a set has neighbours: an exact join on the rarest shingles. Every link is
confirmed on the full sets, so two sets are missed only if no tree has them in one region.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textops
from plumbline.llm.components import components
from plumbline.session import materialize

TREES, DEPTH, START = 12, 8, 3
#: So many rows before a row in the sorted order of a tree are its neighbours.
NEIGHBOURS = 4
#: In the exact join, a shingle of more sets than this is worked on in blocks of sets.
POSTINGS, BLOCK = 64, 256
#: Copies of a shingle's count, so that a common shingle is no single key.
SALTS = 8

_draw = np.random.default_rng(41)
_A = _draw.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = _draw.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle."""
    hashes, bounds = textops.words(texts)
    joint = hashes
    for _ in range(width - 1):
        # the hash of w words from that of w - 1 words and the word after
        joint = textops.mix(joint[:-1] * _STEPS[0] + hashes[len(hashes) - len(joint) + 1 :] * _STEPS[1]) if len(joint) > 1 else joint[:0]
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= width:
            out.append(np.unique(joint[lo : hi - width + 1]))
        elif hi > lo:
            whole = np.array([hi - lo], np.uint64)
            for i in range(lo, hi):
                whole = textops.mix(whole * _STEPS[0] + hashes[i : i + 1] * _STEPS[1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        part = values[at : at + 2048]
        np.minimum(low, (part[:, None] * _A + _B).min(0), out=low)
    return (low >> np.uint64(32)).astype(">u4")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, labels): size, 128-bit name and tree labels of each set."""

    def run(batches):
        for part, texts in textops.pieces(batches):
            sizes, first, second, labels = [], [], [], []
            for s in shingle_sets(texts, width):
                sizes.append(len(s))
                first.append(textops.mix(s).sum(dtype=np.uint64))
                second.append(textops.mix(s ^ _STEPS[1]).sum(dtype=np.uint64))
                row = signature(s).tobytes() if len(s) else b""
                labels.append([row[i * 4 * DEPTH : (i + 1) * 4 * DEPTH] for i in range(TREES)] if row else [])
            arrays = [
                part.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(np.array(first, np.uint64).view(np.int64)),
                pa.array(np.array(second, np.uint64).view(np.int64)),
                pa.array(labels, pa.list_(pa.binary())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_a", "set_b", "labels"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, set_a long, set_b long, labels array<binary>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _neighbours(batches):
    """Pairs of neighbours from the sorted rows of one partition, with its first and last rows."""
    recent: list = []
    opening: list = []

    def compare(row, others, out):
        for other in others:
            if row[0] == other[0] and row[1][: 4 * START] == other[1][: 4 * START] and row[2] != other[2]:
                out.append((row[2], other[2], row[3], other[3]))

    for batch in batches:
        out: list = []
        columns = [batch.column(c).to_pylist() for c in ("tree", "label", "id", "n_shingles")]
        for row in zip(*columns):
            compare(row, recent, out)
            recent = [*recent[-NEIGHBOURS + 1 :], row]
            if len(opening) < NEIGHBOURS:
                opening.append(row)
        if out:
            yield _edge_batch([(a, b, m, n, None, None, None) for a, b, m, n in out])
    rows = [(r[2], None, r[3], None, side, r[0], r[1]) for side, part in (("first", opening), ("last", recent)) for r in part]
    if rows:
        yield _edge_batch(rows)


def _edge_batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary()]
    names = ["a", "b", "n_a", "n_b", "side", "tree", "label"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def neighbour_pairs(forest: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) for rows of (tree, label, id, n_shingles) that are neighbours in their tree.

    The rows are range-partitioned and sorted, so a region of any size spans several
    tasks. Only the first and last rows of each partition meet again, to pair across the
    borders: a few rows per partition.
    """
    parts = int(forest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = forest.repartitionByRange(parts, "tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    schema = "a long, b long, n_a long, n_b long, side string, tree int, label binary"
    found = materialize(ordered.mapInArrow(_neighbours, schema), "neighbours")
    edges = found.where(F.col("side").isNotNull()).select("tree", "label", F.col("a").alias("id"), F.col("n_a").alias("n_shingles")).distinct()
    across = edges.coalesce(1).sortWithinPartitions("tree", "label", "id").mapInArrow(_neighbours, schema)
    return found.where(F.col("side").isNull()).select("a", "b", "n_a", "n_b").unionByName(
        across.where(F.col("side").isNull()).select("a", "b", "n_a", "n_b")
    )


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the documents named in ``ids`` (id)."""

    def run(batches):
        for part, texts in textops.pieces(batches):
            rows = [s.tobytes() for s in shingle_sets(texts, width)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, pa.binary())], names=["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")
    return texts.mapInArrow(run, "id long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap by at least ``percent`` of their union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_x"), batch.column("_y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_x"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_y"))
    # sets and candidate ids grow with the corpus: joined by key at every size.
    # the side with the smaller id, often shared by many pairs, joins last
    near = F.greatest("a", "b"), F.least("a", "b")
    ready = pairs.select(near[0].alias("a"), near[1].alias("b")).distinct().join(first.hint("merge"), "a").join(second.hint("merge"), "b")
    return ready.select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


def _shingle_rows(batches):
    """One row per shingle of a set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("shingles")]
            place = np.repeat(np.arange(part.num_rows), [len(x) for x in sets])
            arrays = [part.column(c).take(pa.array(place)) for c in ("id", "comp", "n")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate(sets))], names=["id", "comp", "n", "shingle"])


def _block_links(percent: int):
    def links(table: pa.Table) -> pa.Table:
        """The linked pairs between two blocks of sets, or inside one, that are in different components."""
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        ids, comp, block = (table.column(c).to_numpy() for c in ("id", "comp", "block"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sizes = np.array([len(x) for x in sets])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        kinds, names = np.unique(np.concatenate(sets), return_inverse=True)
        mark, out = np.zeros(len(kinds), bool), []
        for i in np.flatnonzero(block == lo):
            own = names[starts[i] : starts[i + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[names], starts[:-1], dtype=np.int64)
            mark[own] = False
            near = (100 * both >= percent * (sizes + sizes[i] - both)) & (comp != comp[i]) & (block == hi)
            out += [(ids[i], ids[j]) for j in np.flatnonzero(near)]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def crowd_links(forest: DataFrame, grouped: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) that leaders and neighbours can have missed: between components that share a crowded region.

    A region with no more than ``NEIGHBOURS`` + 1 sets has had all its pairs compared. The
    sets of the others are joined exactly by prefixes: put the shingles of a set in order
    of how many sets hold them; of two sets that overlap by ``percent``, the first
    ``n - ceil(percent * n / 100) + 1`` shingles of each have one in common. A shingle of up
    to ``POSTINGS`` sets gives their pairs; the sets of a commoner one are compared block by
    block across components, which emits links only.
    """
    comp = F.coalesce("component", "id")
    region = F.xxhash64(F.substring("label", 1, 4 * START))
    rows = forest.select("tree", region.alias("region"), "id").join(grouped, "id", "left").select("tree", "region", "id", comp.alias("comp"))
    open_ones = rows.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    open_ones = open_ones.where((F.col("n") > NEIGHBOURS + 1) & (F.col("lo") != F.col("hi"))).select("tree", "region")
    ids = rows.join(open_ones.hint("merge"), ["tree", "region"]).select("id", "comp").distinct()
    crowd = sets.join(ids.hint("merge"), "id").select("id", "comp", (F.octet_length("shingles") / 8).cast("long").alias("n"), "shingles")
    crowd = materialize(crowd, "crowd")

    every = crowd.mapInArrow(_shingle_rows, "id long, comp long, n long, shingle long")
    shared = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > 1)
    shared = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counted = every.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(shared.hint("merge"), ["shingle", "_salt"], "left")
    # a shingle of one set takes its place in the order, but finds nobody
    alone = F.count_if(F.col("held").isNull())
    held = counted.groupBy("id", "comp", "n").agg(alone.alias("alone"), F.sort_array(F.collect_list(F.when(F.col("held").isNotNull(), F.struct("held", "shingle")))).alias("_held"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")
    firsts = held.where(prefix > 0).select("id", "comp", "n", F.explode(F.slice("_held", F.lit(1), prefix.cast("int"))).alias("_s"))
    firsts = materialize(firsts.select("id", "comp", "n", "_s.held", "_s.shingle"), "prefixes")

    rare = firsts.where(F.col("held") <= POSTINGS).groupBy("shingle").agg(F.collect_list(F.struct("id", "comp", "n")).alias("_all"))
    fits = lambda x, y: F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
    pairs = rare.select("_all", F.explode("_all").alias("x")).select(
        F.col("x.id").alias("a"),
        F.explode(F.filter("_all", lambda y: (y["id"] < F.col("x.id")) & (y["comp"] != F.col("x.comp")) & fits(F.col("x"), y))).alias("y"),
    )
    found = confirm(pairs.select("a", F.col("y.id").alias("b")), sets, percent)

    # sets of one component need no comparison: those of a shingle's largest component stand in
    # blocks of their own, which meet the blocks of the others only
    hot = firsts.where(F.col("held") > POSTINGS).select("shingle", "id", "comp")
    parts = hot.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    major = parts.groupBy("shingle").agg(F.max_by("comp", "n").alias("major"), blocks(F.max("n")).alias("_many"), blocks(F.sum("n") - F.max("n")).alias("_few"))
    hot = hot.join(major.where(F.col("_few") > 0), "shingle")
    few = F.col("comp") != F.col("major")
    mine = F.pmod(F.xxhash64("id"), F.when(few, F.col("_few")).otherwise(F.col("_many"))).cast("int") + F.when(few, 0).otherwise(F.col("_few"))
    others = F.sequence(F.lit(0), F.col("_few") - 1 + F.when(few, F.col("_many")).otherwise(0))
    hot = hot.select("shingle", "id", mine.alias("block"), F.explode(others).alias("other"))
    hot = hot.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).join(crowd.select("id", "comp", "shingles").hint("merge"), "id")
    dense = hot.groupBy("shingle", "lo", "hi").applyInArrow(_block_links(percent), "a long, b long")
    return found.unionByName(dense).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id (an integer), n_shingles, component_id, kept.

    Words are runs of characters other than ASCII white space, A-Z folded; shingles have
    ``width`` words, and a text with fewer words is one shingle. A null, empty or blank text
    has no shingle and is linked with nothing. Equal sets are linked; one stands for all.
    Rows with one doc_id are one node of the link graph. A null doc_id is in no component
    (null) and kept. Other columns of ``docs`` are ignored.
    """
    known = materialize(signatures(docs, width), "signatures")
    usable = known.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    name = ["set_a", "set_b", "n_shingles"]
    classes = materialize(usable.groupBy(*name).agg(F.min("doc_id").cast("long").alias("rep")), "classes")
    labelled = usable.select(F.col("doc_id").cast("long").alias("rep"), *name, "labels").join(classes.hint("merge"), ["rep", *name], "left_semi")
    forest = materialize(
        labelled.select(F.col("rep").alias("id"), "n_shingles", F.posexplode("labels").alias("tree", "label")), "forest"
    )
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    sized = large * F.lit(percent) <= small * F.lit(100)

    # regions with more than one set; the rest of the forest has no candidates at this depth
    region = ["tree", F.xxhash64(F.substring("label", 1, 4 * START)).alias("region")]
    rows = forest.select(*region, "id", "n_shingles")
    leaders = rows.groupBy("tree", "region").agg(F.min(F.struct("id", "n_shingles")).alias("lead"), F.max("id").alias("_last"))
    leaders = leaders.where(F.col("_last") > F.col("lead.id")).drop("_last")
    crowded = materialize(rows.join(leaders.hint("merge"), ["tree", "region"]), "crowded")
    sets = materialize(_sets(docs, crowded.select("id").distinct(), width), "sets")

    led = crowded.where(F.col("id") != F.col("lead.id")).select(
        F.col("id").alias("a"), F.col("lead.id").alias("b"), F.col("n_shingles").alias("n_a"), F.col("lead.n_shingles").alias("n_b")
    )
    links = materialize(confirm(led.where(sized).select("a", "b"), sets, percent), "confirmed")
    grouped = materialize(components(links), "grouped")

    # what the first round has not joined yet
    pairs = neighbour_pairs(forest).where(sized).select("a", "b").distinct()
    at = grouped.select(F.col("id").alias("a"), F.col("component").alias("_ca"))
    bt = grouped.select(F.col("id").alias("b"), F.col("component").alias("_cb"))
    open_pairs = pairs.join(at, "a", "left").join(bt, "b", "left").where(
        F.coalesce("_ca", "a") != F.coalesce("_cb", "b")
    )
    more = materialize(confirm(open_pairs.select("a", "b"), sets, percent), "confirmed")
    # components of the first round are one link each to their smallest id, so few rounds follow
    stars = lambda grouped: grouped.select(F.col("id").alias("a"), F.col("component").alias("b"))
    grouped = materialize(components(stars(grouped).unionByName(more)), "grouped")
    last = materialize(crowd_links(forest, grouped, sets, percent), "confirmed")
    grouped = components(stars(grouped).unionByName(last)).withColumnRenamed("id", "rep")

    named = known.drop("labels").join(classes, name, "left").join(grouped, "rep", "left")
    kind = docs.schema["doc_id"].dataType
    component = F.coalesce(F.col("component"), F.col("rep").cast("long"), F.col("doc_id").cast("long")).cast(kind)
    out = named.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
