"""Near-duplicate groups of documents by SetSketch registers.

1. Each text becomes its set of distinct 5-word shingles, a 128-bit digest of the sorted set, and a sketch of it; texts of
   equal sets are one class from then on, however many copies there are, so copies cost one row each. A class has a
   number of its own, which stands for it below where a ``doc_id`` is read, so that texts which share an id stay apart.
2. Runs of registers are keys of bands. A band's bucket links every member to the bucket's smallest document: as many
   pairs as members. Pairs that pass exact size bounds and the likelihood estimate are verified on full sets.
3. Buckets that still hold several components compare all members outside their leader's component with all others, on
   full sets, so that no candidate pair between components stays unverified; pairs inside a component can't change the
   result, and pairs are never rows.
4. A bucket that one block can't hold isn't compared whole, as pages of one template that fall short of the threshold may
   fill it. Its members meet again under their rarest shingles: sets at the threshold must share one of the first
   n - ceil(threshold * n) + 1 in any common order, and in the order of rarity a template's shingles come last. Rarity is
   estimated from a table of counts of fixed size; a wrong estimate costs time, not links. Where members are so near each
   other that even their rarest shingles are common, buckets may be the shorter way; both find the same links, and the one
   with fewer comparisons is taken.

With 5 registers a band and 30 bands, a pair at similarity 0.85 shares no band with probability
(1 - 0.85 ** 5) ** 30 < 3e-8, one at 0.8 with (1 - 0.8 ** 5) ** 30 < 7e-6. The estimate drops pairs only five standard
deviations below the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.scratch import materialize, release
from lodestone.llm.setsketch import band_keys, estimate_jaccard, sketch
from lodestone.llm.textarrays import SPACED, groups, shingle_sets, words_of

SHINGLE_WORDS = 5
#: Two sets are linked when 100 * intersection >= percent * union; this is the default.
PERCENT = 85
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: Bounds of the blocks in which a bucket's members are compared.
BLOCK_ELEMENTS, BLOCK_ROWS = 500_000, 2048
#: Counters that the rarity of shingles is estimated with, 8 MB; it does not grow with the corpus.
COUNTERS = 1 << 20
_KEYS = "doc_id long, text_key long, n long, key_a long, key_b long, registers binary"


def _least(percent: int) -> int:
    """Sets of fewer elements reach the threshold only when they are equal: n of n + 1 is the best that n elements do."""
    return -(-percent // max(1, 100 - percent))


def _sketches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for part, texts in groups(batch):
                n, a, b, registers = [], [], [], []
                for elements in shingle_sets(words_of(texts, SPACED), SHINGLE_WORDS):
                    n.append(len(elements))
                    one, two = np.frombuffer(hashlib.blake2b(elements.tobytes(), digest_size=16).digest(), dtype=np.int64)
                    a.append(int(one))
                    b.append(int(two))
                    registers.append(sketch(elements, REGISTERS).tobytes() if len(elements) >= least else b"")
                yield pa.record_batch([ids[part].cast(pa.int64()), batch.column("text_key")[part], pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(registers, pa.binary())], names=["doc_id", "text_key", "n", "key_a", "key_b", "registers"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            registers = np.frombuffer(b"".join(part.column("registers").to_pylist()), dtype=np.uint16).reshape(part.num_rows, REGISTERS)
            keys = band_keys(registers, BANDS, ROWS).view(np.int64)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(ids, BANDS))], names=["band", "doc_id"])


def _likely(percent: int):
    share = percent / 100
    limit = share - 5 * (share * (1 - share) / REGISTERS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint16).reshape(part.num_rows, REGISTERS) for c in ("ra", "rb"))
                near = estimate_jaccard(a, b, *(part.column(c).to_numpy().astype(float) for c in ("na", "nb"))) >= limit
                yield part.select(["a", "b"]).filter(pa.array(near))

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in groups(batch):
            sets = [s.tobytes() for s in shingle_sets(words_of(texts, SPACED), SHINGLE_WORDS)]
            yield pa.record_batch([batch.column("doc_id")[part].cast(pa.int64()), pa.array(sets, pa.large_binary())], names=["doc_id", "elements"])


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs (a, b) that are linked: by sizes, then by estimate, then on full sets."""
    a = reps.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    b = reps.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    sized = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    likely = sized.mapInArrow(_likely(percent), "a long, b long")
    with_sets = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("sb")), "b")
    return with_sets.mapInArrow(_verified(percent), "a long, b long")


def _mixed(named: DataFrame) -> DataFrame:
    """(band, blocks) of the buckets that hold several components, with the number of blocks that hold their members."""
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_ELEMENTS), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int")
    return named.groupBy("band").agg(F.count_if("stray").alias("strays"), F.min("component").alias("low"), F.max("component").alias("high"), blocks.alias("blocks")).where("strays > 0 and low <> high").select("band", "blocks")


def _comparisons(named: DataFrame) -> int:
    """How many comparisons of two sets ``_across`` would make of these buckets."""
    sides = named.groupBy("band").agg(F.count_if("stray").alias("strays"), F.count("*").alias("rows"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return int(sides.agg(F.sum(F.col("strays").cast("double") * F.col("rows"))).first()[0] or 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's count of elements by counter."""
    total = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for value in batch.column("elements"):
            np.add.at(total, (np.frombuffer(value.as_buffer(), dtype=np.uint64) & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
    held = np.flatnonzero(total)
    yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["counter", "n"])


def _rarest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(band, doc_id, n, component, stray): members (doc_id, n, component) under each of the rarest shingles of their sets."""
    spark = members.sparkSession
    own = materialize(members.join(sets, "doc_id"), "members")
    counts = own.select("elements").mapInArrow(_counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(COUNTERS, dtype=np.int64)
    common[counts.column("counter").to_numpy()] = counts.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(common)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, chosen = whole.slice(at, 256), []
                for value in batch.column("elements"):
                    elements = np.frombuffer(value.as_buffer(), dtype=np.uint64)
                    first = len(elements) - -(-percent * len(elements) // 100) + 1
                    often = shared.value[(elements & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    chosen.append(elements[np.lexsort((elements, often))[:first]])
                rows = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
                own = batch.select(["doc_id", "n", "component"]).take(pa.array(rows))
                yield pa.record_batch([pa.array(np.concatenate(chosen).view(np.int64)), *own.columns], names=["band", "doc_id", "n", "component"])

    rows = materialize(own.mapInArrow(keyed, "band long, doc_id long, n long, component long"), "rarest")
    release(own)
    lead = rows.groupBy("band").agg(F.min("component").alias("leads"), F.max("component").alias("high")).where("leads <> high").select("band", "leads")
    return rows.join(lead, "band").select("band", "doc_id", "n", "component", F.expr("component <> leads").alias("stray"))


def _across(named: DataFrame, mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside the ``mixed`` buckets: of each bucket, the members outside the leader's component against all.

    Both sides are dealt into blocks of bounded size, every pair of blocks is compared at once on full sets, and a pair of
    blocks returns no more links than join its components to each other.
    """
    rows = named.join(mixed, "band").withColumn("own", F.pmod(F.hash("doc_id"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    members = rows.select("band", F.col("own").alias("right"), F.lit(False).alias("asks"), "doc_id", "n", "component", every).withColumnRenamed("other", "left")
    asking = rows.where("stray").select("band", F.col("own").alias("left"), F.lit(True).alias("asks"), "doc_id", "n", "component", every).withColumnRenamed("other", "right")
    sides = asking.unionByName(members).join(sets, "doc_id")

    def compared(table: pa.Table) -> pa.Table:
        return _compared(table, percent)

    return sides.groupBy("band", "left", "right").applyInArrow(compared, "a long, b long")


def _compared(table: pa.Table, percent: int) -> pa.Table:
    asks = table.column("asks").to_numpy()
    ids, n, component = (table.column(c).to_numpy() for c in ("doc_id", "n", "component"))
    parts = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in table.column("elements").combine_chunks()]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    _, at, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    # an element of one row alone is in no intersection
    number = np.cumsum(count > 1) - 1
    row, at = row[count[at] > 1], number[at[count[at] > 1]]
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    both = np.zeros((len(x), len(y)), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, 1024):
        part = slice(*np.searchsorted(at, [low, low + 1024]))
        dense = np.zeros((len(parts), 1024), dtype=np.float32)
        dense[row[part], at[part] - low] = 1
        both += dense[x] @ dense[y].T
    union = n[x][:, None] + n[y][None, :] - both
    linked = (100 * both >= percent * union) & (component[x][:, None] != component[y][None, :])
    found, root = [], {}

    def top(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c

    i, j = np.nonzero(linked)
    _, once = np.unique(np.stack([component[x[i]], component[y[j]]]), axis=1, return_index=True)
    for k in once:
        a, b = x[i[k]], y[j[k]]
        ca, cb = top(int(component[a])), top(int(component[b]))
        if ca != cb:
            root[ca] = cb
            found.append((int(ids[a]), int(ids[b])))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text, ...); other columns are ignored. The bands are made for ``percent`` of 80 or more.

    Null and wordless texts have no shingles and stay alone. Rows that repeat a doc_id are one document, whether their
    texts are equal or not: they share a component, and each gets a row; ``kept`` is whether doc_id is the component's
    smallest. A null doc_id belongs to the class of equal sets, links nothing else and is never kept. Very long texts are
    read whole, one at a time; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = materialize(docs.mapInArrow(_sketches(_least(percent)), _KEYS), "sketches")
    keys = ["n", "key_a", "key_b"]
    # written, so that numbers stay and the join below deals both sides anew, and a class of many copies can be split over tasks
    first_row = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("first_row")
    classes = materialize(found.where("n > 0").groupBy(*keys).agg(first_row).select(*keys, F.col("first_row.doc_id").alias("rep"), F.col("first_row.text_key").alias("rep_key"), F.monotonically_increasing_id().alias("class")), "classes")
    members = materialize(found.select("doc_id", *keys).join(classes.drop("rep_key"), keys, "left"), "members")

    many = classes.where((F.col("n") >= _least(percent)) & F.col("rep").isNotNull()).select(*keys, F.col("rep").alias("doc_id"), F.col("rep_key").alias("text_key"), "class")
    reps = materialize(found.join(many, ["doc_id", "text_key", *keys]).dropDuplicates(["class"]).select(F.col("class").alias("doc_id"), "n", "registers"), "representatives")
    banded = reps.select("doc_id", "registers").mapInArrow(_bands, "band long, doc_id long")
    shared = banded.groupBy("band").agg(F.count("*").alias("size"), F.min("doc_id").alias("leader")).where("size > 1").select("band", "leader")
    buckets = materialize(banded.join(shared, "band"), "buckets")
    wanted = buckets.select(F.col("doc_id").alias("class")).distinct().join(many, "class").select("doc_id", "text_key", "class")
    texts = docs.join(wanted, ["doc_id", "text_key"]).select(F.col("class").alias("doc_id"), "text")
    sets = materialize(texts.mapInArrow(_sets, "doc_id long, elements binary"), "sets")

    # every member of a bucket goes to its leader; pairs of several bands are one pair
    stars = buckets.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    first = materialize(components(_links(stars, reps, sets, percent)), "components")

    named = buckets.join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = named.join(first.select(F.col("id").alias("leader"), F.col("component").alias("leads")), "leader", "left").withColumn("leads", F.coalesce("leads", "leader"))
    # the leader itself was compared with every member already
    named = materialize(named.where("doc_id <> leader").join(reps.select("doc_id", "n"), "doc_id").select("band", "doc_id", "n", "component", F.expr("component <> leads").alias("stray")), "named")
    mixed = materialize(_mixed(named), "mixed")
    # written, so that the joins with it deal both sides anew and a full bucket can be split over tasks
    more = _across(named, mixed.where("blocks = 1"), sets, percent)
    if mixed.where("blocks > 1").limit(1).collect():
        large = named.join(mixed.where("blocks > 1").select("band"), "band", "left_semi")
        # the leader was compared with each member already, so members alone meet again
        rare = materialize(_rarest(large.select("doc_id", "n", "component").distinct(), sets, percent), "rare")
        shorter = _comparisons(rare) < _comparisons(large)
        more = more.unionByName(_across(rare, materialize(_mixed(rare), "mixed"), sets, percent) if shorter else _across(named, mixed.where("blocks > 1"), sets, percent))
    edges = first.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more)
    final = components(edges.unionByName(_of_one_document(members)))
    smallest = final.join(classes.select(F.col("class").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("smallest"))
    final = materialize(final.join(smallest, "component").select(F.col("id").alias("class"), "smallest"), "components")
    release(found, classes, buckets, sets, reps, first, named, mixed)

    labelled = members.join(final, "class", "left")
    component = F.coalesce("smallest", "rep", "doc_id")
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _of_one_document(members: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes of each doc_id that has several."""
    held = members.where("class is not null and doc_id is not null")
    several = materialize(held.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z").select("doc_id", "a"), "several")
    return held.join(several, "doc_id").where(F.col("a") != F.col("class")).select("a", F.col("class").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows that another document of their group stands for; rows without a doc_id stay."""
    gone = near_duplicates(docs, percent).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
