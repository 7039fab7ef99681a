"""Near-duplicate documents: an exact Jaccard join of word-shingle sets.

A document's set holds its distinct shingles of five words (A-Z lower-cased, words split at
space and 0x09-0x0D); with fewer words the whole sequence is its one element. Two documents
link when ``100 * |intersection| >= THRESHOLD * |union|``.

1. Shingle frequencies over the whole corpus, in hash buckets (a fixed-size table),
   give every set one global order: rare buckets first, then the hash. Any shared order keeps
   the join exact; rare-first keeps passages that many documents share out of the prefixes.
2. Documents with equal sets are one set (``sid``). Each set posts the first
   ``n - ceil(0.8 n) + 1`` shingles of its order: linked sets must share one of them.
3. Per posted shingle the sets are ordered by size. A first round verifies only neighbours in
   that order and the smallest set (linear in the postings); its links form components. Of up
   to ``ALL_PAIRED`` sets these are all pairs, so only fuller shingles go on. No round takes a
   pair of a round before again.
4. Up to ``TURNS`` further linear rounds take neighbours of different components in a random
   order, so that large groups of near copies become one component without all their pairs.
   The last round takes every pair of sets that share a posted shingle and still lie in
   different components, under the length filter and the positional filter. After it no
   candidate pair that could join two components is unverified, so components are exact.
5. Pairs of all rounds pass the suffix filter (a lower bound of the sets' difference from their
   counts in ``RANGES`` hash ranges) before any set is made; in the last round only pairs that
   pass leave the task. Sets that share a shingle by chance, whose number grows faster than the
   documents, go here.
6. Verification fetches both sets once per distinct pair and intersects them. A set is made
   from its text when the first pair that holds it is to be verified, and kept for later ones.
   Texts, counts and sets that no pair needs are dropped before the shuffle of their join.

Shingles and sets are compared by 64-bit hashes.

Defined cases: NULL or empty text and text without words: empty set, linked with nothing, its
own component; NULL doc_id: a row like others, component_id is the smallest non-NULL id of
the component (NULL if none); repeated rows and copies share a set; an empty table gives no
rows; extra columns pass through :func:`keep_first`, which takes rows by (doc_id, set), so
that repeated and NULL ids with different texts are different documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import among, free_name, release, stored
from .textstats import inner_shingles, mix, parts, shingle_sets, utf8

THRESHOLD = 80
TURNS = 1
ALL_PAIRED = 4  # near_pairs takes all pairs of so many sets
RANGES = 128
BUCKET_BITS = 22
CHUNKS = 64
SET_BYTES = 1 << 22  # of sets that leave a task at a time
COUNT = "chunk int, counts binary"
SKETCH = "doc_id long, n long, sid long, keys array<long>, ranges binary"
SET = "sid long, elements binary"


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_levels(docs: DataFrame) -> np.ndarray:
    """How frequent the shingles of each hash bucket are: a fixed-size array of one byte a
    bucket (eighths of the logarithm to base 2, so the order by frequency stays).

    Each task counts its documents; the counts are cut into ``CHUNKS`` ranges, summed per
    range in streaming tasks and made levels there.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int32)
        for batch in batches:
            for body, offs in parts(batch.column(0)):
                np.add.at(total, _bucket(inner_shingles(body, offs)), 1)
        yield chunked({i: c for i, c in enumerate(np.split(total, CHUNKS))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(*(batch.column(i).to_pylist() for i in range(2))):
                own = np.frombuffer(counts, np.int32).astype(np.int64)
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        yield chunked({i: np.minimum(np.log2(c + 1.0) * 8, 255).astype(np.uint8)
                       for i, c in sums.items()})

    def chunked(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int32()),
             pa.array([c.tobytes() for c in parts.values()], pa.binary())],
            names=["chunk", "counts"])
    rows = docs.select("text").mapInArrow(count, COUNT).repartition("chunk").mapInArrow(
        add, COUNT).collect()
    out = np.zeros((CHUNKS, (1 << BUCKET_BITS) // CHUNKS), np.uint8)
    for row in rows:
        out[row["chunk"]] = np.frombuffer(row["counts"], np.uint8)
    return out.reshape(-1)


def set_id(elements: np.ndarray) -> int:
    """64-bit fingerprint of a set."""
    with np.errstate(over="ignore"):
        total = mix(elements ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(elements))]))[0].view(np.int64))


def range_counts(elements: np.ndarray) -> bytes:
    """Elements per hash range, 16 bits each; a fuller range counts as full (still a bound).
    All low bytes come before the high ones, nearly always zero, so that shuffles compress them."""
    shift = np.uint64(64 - (RANGES - 1).bit_length())
    counts = np.bincount((elements >> shift).astype(np.int64), minlength=RANGES)
    counts = np.minimum(counts, 0xFFFF)
    return np.concatenate([counts & 0xFF, counts >> 8]).astype(np.uint8).tobytes()


def counts_of(column: pa.Array) -> np.ndarray:
    """The rows of :func:`range_counts` as numbers."""
    both = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2, RANGES)
    return both[:, 0].astype(np.int32) | both[:, 1].astype(np.int32) << 8


def prefix_length(n: int) -> int:
    return n - -(-THRESHOLD * n // 100) + 1


def sketches(docs: DataFrame) -> DataFrame:
    """Per document its set size, set id and posted shingles. Of the documents of one task
    with equal sets only the first carries the shingles."""
    levels = docs.sparkSession.sparkContext.broadcast(bucket_levels(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, ids, keys, ranges = [], [], [], []
            for elements in shingle_sets(batch.column(1)):
                n = len(elements)
                sizes.append(n)
                sid = set_id(elements) if n else None
                ids.append(sid)
                if n and sid not in seen:
                    seen.add(sid)
                    order = np.lexsort((elements, levels.value[_bucket(elements)]))
                    keys.append(elements[order[:prefix_length(n)]].view(np.int64))
                    ranges.append(range_counts(elements))
                else:
                    keys.append(None)
                    ranges.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(ranges, pa.binary())],
                names=["doc_id", "n", "sid", "keys", "ranges"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, SKETCH)


def _may_link(n1: Column, i: Column, n2: Column, j: Column) -> Column:
    """Length filter, and the positional filter for a first common shingle at places i, j."""
    need = F.ceil((n1 + n2) * THRESHOLD / (100.0 + THRESHOLD) - 1e-9)
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * THRESHOLD) & (
        F.least(n1 - i, n2 - j) >= need)


def shared_postings(sketch: DataFrame) -> DataFrame:
    """Posted shingles of at least two sets (``sets`` of them), with their neighbours by size."""
    posts = sketch.where("keys is not null").select(
        "sid", "n", F.posexplode("keys").alias("pos", "key")).repartition("key").groupBy(
        "key", "sid").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    own = Window.partitionBy("key")
    by_size = own.orderBy("n", "sid")
    me = F.struct("sid", "n", "pos")
    return posts.select(
        "key", "sid", "n", "pos", F.lag(me, 1).over(by_size).alias("prev"),
        F.lag(me, 2).over(by_size).alias("prev2"), F.first(me).over(by_size).alias("hub"),
        F.count(F.lit(1)).over(own).alias("sets")).where("sets > 1")


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_pairs(posts: DataFrame) -> DataFrame:
    """Pairs of neighbours in the size order of a posted shingle, and with its smallest set.
    Of ``ALL_PAIRED`` sets and fewer that is every pair."""
    other = F.explode(F.array("prev", "prev2", "hub"))
    pairs = posts.select("sid", "n", "pos", other.alias("o")).where(
        F.col("o").isNotNull() & (F.col("o.sid") != F.col("sid"))
        & _may_link(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos")))
    return _distinct_pairs(pairs.select(F.col("sid").alias("a"), F.col("o.sid").alias("b")))


def mixed_postings(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings (with their set's component) of shingles that several components post."""
    labelled = posts.select("key", "sid", "n", "pos", "sets").join(
        labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "label", F.coalesce("label", "sid"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    return labelled.join(mixed.where("x <> y").select("key"), "key", "left_semi")


def next_pairs(mixed: DataFrame, turn: int) -> DataFrame:
    """Pairs of different components that stand next to each other in a random order of a
    shingle's sets (another order in each turn)."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("sid", F.lit(turn)), "sid")
    other = F.lag(F.struct("sid", "n", "pos", "label")).over(order)
    pairs = mixed.withColumn("o", other).where(
        (F.col("o.label") != F.col("label"))
        & _may_link(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos")))
    return _distinct_pairs(pairs.select(F.col("sid").alias("a"), F.col("o.sid").alias("b")))


def _need(n1, n2):
    """Common elements that sets of these sizes need to link."""
    return -(-THRESHOLD * (n1 + n2) // (100 + THRESHOLD))


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components among the sets of each shingle (rows sorted by shingle
    and size) that pass the length, positional and suffix filters."""
    def pairs_of(table: pa.Table) -> pa.RecordBatch:
        key, sid, n, pos, label = (table.column(c).to_numpy() for c in (
            "key", "sid", "n", "pos", "label"))
        ranges = counts_of(table.column("ranges"))
        ends = np.searchsorted(key, key, "right")
        left, right = [], []
        for i in range(len(key)):
            high = i + 1 + int(np.searchsorted(
                n[i + 1:ends[i]] * THRESHOLD, 100 * n[i], "right"))
            for at in range(i + 1, high, 8192):
                j = np.arange(at, min(high, at + 8192))
                need = _need(n[i], n[j])
                j = j[(label[j] != label[i]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)]
                apart = np.abs(ranges[j] - ranges[i]).sum(1)
                j = j[n[i] + n[j] - apart >= 2 * _need(n[i], n[j])]
                left.append(np.minimum(sid[j], sid[i]))
                right.append(np.maximum(sid[j], sid[i]))
        both = np.stack([np.concatenate(left or [sid[:0]]), np.concatenate(right or [sid[:0]])])
        both = np.unique(both, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pa.Table.from_batches([batch])
        held = own if held is None else pa.concat_tables([held, own])
        key = held.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield pairs_of(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None:
        yield pairs_of(held)


def set_counts(sketch: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sid, size, ranges`` of the wanted sets."""
    held = among(sketch.where("ranges is not null").select("sid", "n", "ranges"), "sid", wanted)
    return held.join(wanted, "sid", "left_semi").groupBy("sid").agg(
        F.min("n").alias("size"), F.min("ranges").alias("ranges"))


def possible(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            apart = np.abs(counts_of(batch.column("x")) - counts_of(batch.column("y"))).sum(1)
            keep = n + m - apart >= 2 * _need(n, m)
            yield batch.select([0, 1]).filter(pa.array(keep))
    counts = set_counts(sketch, _members(pairs))
    return pairs.join(counts.toDF("a", "n", "x"), "a").join(
        counts.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y").mapInArrow(
        run, "a long, b long")


def cross_pairs(mixed: DataFrame, ranges: DataFrame) -> DataFrame:
    """All pairs of sets of different components that share a posted shingle and may link."""
    rows = mixed.join(ranges, "sid").select("key", "sid", "n", "pos", "label", "ranges")
    return rows.repartition("key").sortWithinPartitions("key", "n", "sid").mapInArrow(
        _cross, "a long, b long").distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links: components of the graph whose nodes are components."""
    of = labels.select("node", "label")
    ends = links.join(of.toDF("a", "la"), "a", "left").join(of.toDF("b", "lb"), "b", "left")
    ends = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    moved = components(ends)
    old = labels.join(moved.toDF("label", "new"), "label", "left").select(
        "node", F.coalesce("new", "label").alias("label"))
    fresh = moved.join(labels.select("node"), "node", "left_anti")
    return stored(old.unionByName(fresh), "jaccard-labels")


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()


def set_table(docs: DataFrame, sketch: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sid, elements`` (sorted hashes) of the wanted sets, made from one document each.

    A set takes the text of its smallest id. Ids (or NULL) that several rows have are not
    joined by, as each of their texts would meet each of their sets: these texts are hashed
    and one of each set is taken by the set's own id. So each set comes out once, and no
    elements are shuffled to drop others.
    """
    owners = stored(sketch.where("sid is not null").join(wanted, "sid", "left_semi").groupBy(
        "sid").agg(F.min("doc_id").alias("of")), "jaccard-owners")
    repeated = sketch.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = stored(owners.select("of").distinct().join(repeated, F.col("of").eqNullSafe(
        F.col("doc_id")), "left_semi"), "jaccard-shared")
    rows = among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id",
                 owners.select("of"))
    same = F.col("doc_id").eqNullSafe(F.col("of"))
    if shared.isEmpty():
        texts = rows.join(owners, same).select("sid", "text")
    else:
        held = shared.withColumnRenamed("of", "held")
        several = F.col("of").eqNullSafe(F.col("held"))
        chosen = rows.join(shared, same, "left_semi").select(
            _text_set("text").alias("sid"), "text").where("sid is not null").groupBy("sid").agg(
            F.min("text").alias("text"))
        texts = rows.join(owners.join(held, several, "left_anti"), same).select(
            "sid", "text").unionByName(chosen.join(
                owners.join(held, several, "left_semi").select("sid"), "sid", "left_semi"))

    def made(ids: list[int], packed: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["sid", "elements"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed, size = [], [], 0
            for sid, elements in zip(batch.column(0).to_pylist(),
                                     shingle_sets(batch.column(1))):
                ids.append(sid)
                packed.append(elements.tobytes())
                size += len(packed[-1])
                if size >= SET_BYTES:
                    yield made(ids, packed)
                    ids, packed, size = [], [], 0
            yield made(ids, packed)
    return texts.mapInArrow(run, SET)


def with_members(docs: DataFrame, sketch: DataFrame, pairs: DataFrame,
                 sets: DataFrame | None = None) -> DataFrame:
    """``sets`` and the sets of ``pairs`` that it lacks."""
    wanted = _members(pairs)
    if sets is not None:
        wanted = stored(wanted.join(sets.select("sid"), "sid", "left_anti"), "jaccard-wanted")
        if wanted.isEmpty():
            return sets
    found = stored(set_table(docs, sketch, wanted), "jaccard-sets")
    release(docs.sparkSession)
    return found if sets is None else sets.unionByName(found)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    total = len(x) + len(y)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= THRESHOLD * (total - same)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    sets = among(sets, "sid", _members(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, i), (y, j) = utf8(batch.column(2)), utf8(batch.column(3))
            keep = [linked(x[i[k]:i[k + 1]].view(np.uint64), y[j[k]:j[k + 1]].view(np.uint64))
                    for k in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    left = sets.select(F.col("sid").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
        run, "a long, b long")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches, and ``label, sid, least`` (smallest id of its documents) of every set."""
    spark = docs.sparkSession

    sketch = stored(sketches(docs), "jaccard-sketch")
    release(spark)
    posts = stored(shared_postings(sketch), "jaccard-posts")
    release(spark)
    tried = stored(near_pairs(posts), "jaccard-near")
    pairs = stored(possible(tried, sketch), "jaccard-pairs")
    release(spark)
    sets = with_members(docs, sketch, pairs)
    links = stored(verified(pairs, sets), "jaccard-links")
    release(spark)
    labels = components(links)
    release(spark)
    mixed = stored(mixed_postings(posts, labels), "jaccard-mixed").where(
        F.col("sets") > ALL_PAIRED)
    release(spark)
    for turn in range(TURNS):
        near = stored(next_pairs(mixed, turn).join(tried, ["a", "b"], "left_anti"),
                      "jaccard-near")
        tried = tried.unionByName(near)
        pairs = stored(possible(near, sketch), "jaccard-pairs")
        sets = with_members(docs, sketch, pairs, sets)
        found = stored(verified(pairs, sets), "jaccard-links")
        if found.isEmpty():
            break
        labels = merged(labels, found)
        release(spark)
        mixed = stored(mixed_postings(mixed, labels), "jaccard-mixed")
    release(spark)
    ranges = set_counts(sketch, mixed.select("sid").distinct()).select("sid", "ranges")
    pairs = stored(cross_pairs(mixed, ranges).join(tried, ["a", "b"], "left_anti"),
                   "jaccard-pairs")
    release(spark)
    sets = with_members(docs, sketch, pairs, sets)
    found = stored(verified(pairs, sets), "jaccard-links")
    release(spark)
    if not found.isEmpty():
        labels = merged(labels, found)
    groups = sketch.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    groups = groups.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "label", F.coalesce("label", "sid"))
    return sketch, stored(groups, "jaccard-groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    sketch, groups = _grouped(docs)
    named = groups.join(groups.groupBy("label").agg(F.min("least").alias("component_id")),
                        "label").select(F.col("sid").alias("of"), "component_id")
    return sketch.join(named, F.col("sid") == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(
            F.col("component_id")).alias("component_id"))


def _set_ids(texts: pa.Array) -> pa.Array:
    return pa.array([set_id(x) if len(x) else None for x in shingle_sets(texts)], pa.int64())


def _text_set(text: str) -> Column:
    """The set id of each text. Nondeterministic to the optimiser, which else repeats it in the
    filters it derives: each text is then hashed twice, by two Python workers a task."""
    return F.arrow_udf(_set_ids, "long").asNondeterministic()(text)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: of its smallest non-NULL id (NULL if it has
    none), of that id's smallest set, and of equal sets of that id the row with the smallest
    hash. Rows without words are each their own component and stay."""
    _, groups = _grouped(docs)
    first = groups.groupBy("label").agg(F.min(F.struct(
        F.col("least").isNull().alias("none"), "least", "sid")).alias("f"))
    key, own, set_, least = (free_name(docs, n) for n in ("_key", "_own", "_set", "_least"))
    first = first.select(F.col("f.sid").alias(set_), F.col("f.least").alias(least))
    rows = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(own, _text_set("text"))
    kept = rows.join(first, (F.col(own) == F.col(set_)) & F.col(key).eqNullSafe(
        F.col(least)), "left_semi")
    order = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t])
    once = kept.groupBy(key, own).agg(F.min_by(F.struct(*[
        F.col(f"`{c}`") for c in docs.columns]), order).alias("_row")).select("_row.*")
    return once.unionByName(rows.where(F.col(own).isNull()).drop(key, own))
