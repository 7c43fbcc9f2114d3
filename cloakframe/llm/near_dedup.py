"""MinHash near-duplicate detection by a signature-coordinate inverted join (operator 10).

A document's set is that of its distinct word shingles; two documents are linked
if the Jaccard similarity of their full sets is at least ``similarity``.

1. Every set gets a MinHash signature of ``COORDINATES`` values and a 128-bit
   fingerprint; documents of equal sets are one vertex from here on.
2. Pairs must agree in ``MATCHES`` coordinates. So they share one of any
   ``COORDINATES - MATCHES + 1`` of them: each document is posted under its
   rarest coordinate-value pairs only (prefix), by one order for all documents
   that a fixed-size count sketch gives. Frequent pairs, those of passages that
   many documents share, are thereby skipped.
3. In each posting list, matches are counted over all coordinates. Documents
   that a chain of enough matches has already brought together aren't compared
   again (skip), so a list of m documents gives m - 1 candidate links at most.
4. Candidate links form clusters. In each cluster the full sets are compared,
   and only links that hold on them are kept; these form the components.

A true link of similarity 0.8 has 38 of 64 coordinates in common but for a
chance of about 1 in 100,000. Posting lists and clusters beyond a task's size
are dealt into blocks by the hash of the id, and each block is compared by
itself first. What the links found so far have brought together needs no more
comparing: one representative of each component is compared with the others,
and then only the documents outside a group's largest component with all the
others. So a group of near copies is posted once or twice, whatever its size,
and still no pair of different components is left out; none is capped.

Defined results: a row without words or with null text has an empty set and is
linked with nothing; a null id links with nothing and is its own (null)
component, kept; repeated rows of one id are one vertex; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, blocks, bounded_batches, discard, materialize, mix, sized, spread, sums, without, words
from .components import connected_components

COORDINATES = 64
#: Coordinates in which a candidate pair agrees, for a similarity of 0.8.
MATCHES = 38
#: Counters of the sketch that orders coordinate-value pairs, and of one row of it.
SKETCH_BITS = 18
SKETCH, SKETCH_ROW = 1 << SKETCH_BITS, 1 << 10
#: Documents of a posting list in one block, and of a cluster.
LIST_DOCS, BLOCK_DOCS = 2048, 256
#: Shingles of a cluster in one block.
BLOCK_SHINGLES = 2_000_000
#: Blocks of a group are numbered below it.
MOST_BLOCKS = 1 << 31
#: Cells of the table in which a cluster's full sets are compared.
TABLE_CELLS = 128 << 20

_rng = np.random.default_rng(20)
#: A random odd factor for each word of a shingle.
_ROLL = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each row, and each row's offsets.

    A row of fewer than ``width`` words has its whole sequence as one shingle.
    """
    hashes, at = words(texts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(hashes), np.uint64)
        n = len(hashes)
        for j in range(min(width, n)):
            rolled[: n - j] += hashes[j:] * _ROLL[j]
    out, sizes = [], []
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if high - low >= width:
            own = np.unique(rolled[low : high - width + 1])
        elif high > low:
            with np.errstate(over="ignore"):
                own = mix((hashes[low:high] * _ROLL[: high - low]).sum(keepdims=True), 7 + high - low)
        else:
            own = hashes[:0]
        out.append(own)
        sizes.append(len(own))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def minhash(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Signatures (rows, COORDINATES) of 32-bit values; empty rows: all ones."""
    out = np.full((len(at) - 1, COORDINATES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        starts = at[:-1][some]
        with np.errstate(over="ignore"):
            for k in range(COORDINATES):
                values = (((shingles ^ _XOR[k]) * _MUL[k]) >> np.uint64(32)).astype(np.uint32)
                out[some, k] = np.minimum.reduceat(values, starts)
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of equal bytes as a binary column."""
    rows = np.ascontiguousarray(rows)
    n, width = len(rows), rows.nbytes // max(1, len(rows))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def _rows_of(column: pa.Array | pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def signatures(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, f1, f2, sig): size, fingerprint and signature of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in blocks(batch.column(1)):
                part = batch.slice(low, high - low)
                shingles, at = shingle_sets(Texts(part.column(1)), width)
                prints = [sums(mix(shingles, s), at).view(np.int64) for s in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), *map(pa.array, prints), _fixed(minhash(shingles, at))], ["id", "n", "f1", "f2", "sig"])

    bounded_batches(df.sparkSession)
    picked = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {dict(picked.dtypes)['id']}, n bigint, f1 bigint, f2 bigint, sig binary")


def _tokens(sig: np.ndarray) -> np.ndarray:
    """A 64-bit token for each coordinate-value pair of signatures."""
    return mix(sig.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))


def count_sketch(sets: DataFrame) -> np.ndarray:
    """Counts of coordinate-value pairs by hash, SKETCH counters in all.

    A task sends its counters as a fixed number of rows, whatever it has read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros(SKETCH, np.int64), False
        for batch in batches:
            if batch.num_rows:
                some = True
                tokens = _tokens(_rows_of(batch.column(0), np.uint32, COORDINATES))
                counts += np.bincount((tokens.ravel() >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=SKETCH)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH // SKETCH_ROW)), _fixed(counts.reshape(-1, SKETCH_ROW))], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # one row for each part, however many tasks sent it
        for batch in batches:
            for part, row in zip(batch.column(0).to_pylist(), _rows_of(batch.column(1), np.int64, SKETCH_ROW), strict=True):
                total[part] = total[part] + row if part in total else row
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), _fixed(np.stack(list(total.values())))], ["part", "counts"])

    schema = "part bigint, counts binary"
    sent = sets.select("sig").mapInArrow(run, schema)
    rows = sent.repartition("part").mapInArrow(add, schema).toArrow()
    counts = np.zeros((SKETCH // SKETCH_ROW, SKETCH_ROW), np.int64)
    if rows.num_rows:
        counts[rows["part"].to_numpy()] = _rows_of(rows["counts"], np.int64, SKETCH_ROW)
    return np.minimum(counts.ravel(), 2**31 - 1).astype(np.int32)


def _nibbles(sig: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, two in a byte: equal values stay equal."""
    low = (sig & 15).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def postings(sets: DataFrame, sketch: np.ndarray, matches: int, list_docs: int, hot: bool = False) -> DataFrame:
    """(key, block, id, n, nib): each set under its rarest coordinate-value pairs.

    A pair that the sketch counts more than ``list_docs`` times has its
    documents dealt into blocks by their ids, differently for each pair; each
    is posted once. ``hot`` gives those rows only.
    """
    spark = sets.sparkSession
    shared = spark.sparkContext.broadcast(sketch)
    prefix = COORDINATES - matches + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _rows_of(batch.column(2), np.uint32, COORDINATES)
            tokens = _tokens(sig)
            often = counts[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = (np.minimum(often, 2**15 - 1).astype(np.uint64) << np.uint64(48)) | (tokens >> np.uint64(16))
            first = np.argpartition(order, prefix - 1, axis=1)[:, :prefix] if prefix < COORDINATES else np.tile(np.arange(COORDINATES), (len(sig), 1))
            key = np.take_along_axis(tokens, first, 1).ravel()
            row = np.repeat(np.arange(len(sig)), prefix)
            parts = -(-np.take_along_axis(often, first, 1).ravel().astype(np.int64) // list_docs)
            if hot:
                some = np.flatnonzero(parts > 1)
                key, row, parts = key[some], row[some], parts[some]
            draw = mix(batch.column(3).to_numpy().view(np.uint64)[row] ^ key, 3)
            block = (draw % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(block), batch.column(0).take(at), batch.column(1).take(at), _fixed(_nibbles(sig)[row])], ["key", "block", "id", "n", "nib"])

    return sets.select("id", "n", "sig", F.xxhash64("id").alias("h")).mapInArrow(run, f"key bigint, block bigint, id {dict(sets.dtypes)['id']}, n bigint, nib binary")


def by_key(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]], kind: str) -> DataFrame:
    """Edges (a, b) that ``work`` makes of whole groups of equal keys.

    Rows are dealt by key and sorted; groups pass by one after the other, so a
    task holds a batch and one group. ``work`` gets a table of whole groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for a, b in work(table):
                if len(a):
                    ids = table.column("id").combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(keys))]
            changed = np.zeros(batch.num_rows, bool)
            for c in columns:
                changed[1:] |= c[1:] != c[:-1]
            changed[0] = last is not None and tuple(c[0] for c in columns) != last
            cuts = np.flatnonzero(changed)
            last = tuple(c[-1] for c in columns)
            if not len(cuts):
                held.append(batch)
                continue
            cut = int(cuts[-1])
            whole = [*held, batch.slice(0, cut)] if cut else held
            yield from out(pa.Table.from_batches(whole))
            held = [batch.slice(cut)]
        if held:
            yield from out(pa.Table.from_batches(held))

    # without a number, so that small partitions are joined at run time
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"a {kind}, b {kind}")


def group_bounds(columns: list[np.ndarray]) -> np.ndarray:
    """Starts of the groups of equal keys, and the end."""
    n = len(columns[0])
    changed = np.ones(n + 1, bool)
    if n:
        changed[1:n] = False
        for c in columns:
            changed[1:n] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def chain(m: int, alike: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Links that span the components of m things, where ``alike(i, others)``
    says which of others are linked with i. What is reached isn't asked again."""
    links, left, front = [], np.arange(1, m), [0]
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
            continue
        i = front.pop()
        yes = alike(i, left)
        if yes.any():
            links.append((i, left[yes]))
            front += left[yes].tolist()
            left = left[~yes]
    return links


def candidate_links(posted: DataFrame, matches: int, percent: int) -> DataFrame:
    """Edges that span each posting list's candidate pairs: enough equal
    coordinates, and sizes that the similarity allows."""

    def work(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bounds = group_bounds([table.column(k).to_numpy() for k in ("key", "block")])
        sizes = np.diff(bounds)
        n = table.column("n").to_numpy()
        nib = table.column("nib").combine_chunks()
        twos = bounds[:-1][sizes == 2]
        wanted = np.flatnonzero(np.repeat(sizes, sizes) > 1)
        if not len(wanted):
            return
        spot = np.full(len(n), -1)
        spot[wanted] = np.arange(len(wanted))
        packed = _rows_of(nib.take(pa.array(wanted)), np.uint8, COORDINATES // 2)
        if len(twos):
            x = packed[spot[twos]] ^ packed[spot[twos + 1]]
            same = ((x & 15) == 0).sum(1) + ((x >> 4) == 0).sum(1)
            small, large = np.minimum(n[twos], n[twos + 1]), np.maximum(n[twos], n[twos + 1])
            yes = (same >= matches) & (100 * small >= percent * large)
            yield twos[yes], twos[yes] + 1
        a, b = [], []
        for low, high in zip(bounds[:-1][sizes > 2].tolist(), bounds[1:][sizes > 2].tolist(), strict=True):
            own, size = packed[spot[low] : spot[low] + high - low], n[low:high]

            def alike(i: int, others: np.ndarray, own=own, size=size) -> np.ndarray:
                x = own[others] ^ own[i]
                same = ((x & 15) == 0).sum(1) + ((x >> 4) == 0).sum(1)
                return (same >= matches) & (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))

            for i, others in chain(high - low, alike):
                a.append(np.full(len(others), low + i))
                b.append(low + others)
        if a:
            yield np.concatenate(a), np.concatenate(b)

    return by_key(posted, ["key", "block"], work, dict(posted.dtypes)["id"])


def exact_links(shingles: np.ndarray, at: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """Links that span the components of rows whose full sets are alike."""
    m, sizes = len(at) - 1, np.diff(at)

    def enough(both: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
        return (both > 0) & (100 * both >= percent * (sizes[others] + sizes[i] - both))

    values, inverse, counts = np.unique(shingles, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    column = np.cumsum(counts > 1) - 1
    often = counts[inverse] > 1
    width = int((counts > 1).sum())
    if m > 3 and width * m <= TABLE_CELLS:
        cells = np.zeros((width, m), np.uint8)
        cells[column[inverse[often]], row[often]] = 1
        held = np.concatenate([[0], np.cumsum(np.bincount(row[often], minlength=m))])
        columns = column[inverse[often]]

        def alike(i: int, others: np.ndarray) -> np.ndarray:
            return enough(cells[columns[held[i] : held[i + 1]]].sum(axis=0, dtype=np.int64)[others], i, others)

    else:

        def alike(i: int, others: np.ndarray) -> np.ndarray:
            own = shingles[at[i] : at[i + 1]]
            both = [len(np.intersect1d(own, shingles[at[j] : at[j + 1]], assume_unique=True)) for j in others.tolist()]
            return enough(np.array(both, np.int64), i, others)

    return chain(m, alike)


def verified_links(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges that hold on full sets, of members (key, block, id, text)."""

    def work(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bounds = group_bounds([table.column(k).to_numpy() for k in ("key", "block")])
        texts = table.column("text").combine_chunks()
        a, b = [], []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if high - low < 2:
                continue
            parts = [shingle_sets(Texts(texts.slice(low + i, j - i)), width) for i, j in blocks(texts.slice(low, high - low))]
            shingles = np.concatenate([p[0] for p in parts])
            at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
            for i, others in exact_links(shingles, at, percent):
                a.append(np.full(len(others), low + i))
                b.append(low + others)
        if a:
            yield np.concatenate(a), np.concatenate(b)

    return by_key(members, ["key", "block"], work, dict(members.dtypes)["id"])


def _parts(docs: Column, weight: Column, most_docs: int, most_weight: int) -> Column:
    """Number of blocks for so many documents of such weight."""
    return F.greatest(F.lit(1), F.ceil(docs / most_docs), F.ceil(weight / most_weight)).cast("long")


def dealt_clusters(clusters: DataFrame, sizes: DataFrame, most_docs: int, most_weight: int) -> DataFrame:
    """(key, id, n, parts, block): clusters' members, large ones' in blocks."""
    known = clusters.join(sizes, "id")
    whole = known.groupBy("key").agg(_parts(F.count(F.lit(1)), F.sum("n"), most_docs, most_weight).alias("parts"))
    return known.join(whole, "key").select("key", "id", "n", "parts", F.pmod(F.xxhash64("id", "key"), F.col("parts")).alias("block"))


def across_blocks(edges: DataFrame, large: DataFrame, links: Callable[[DataFrame], DataFrame], most_docs: int, most_weight: int) -> DataFrame:
    """``edges`` (found inside blocks) and more, so that they span all links in
    each group ``key`` of ``large`` (key, id, n, ...).

    First one representative of each component of a group is compared with the
    others; then each document outside the group's largest component with all
    that aren't of its block. ``links`` makes edges of rows with key and block.
    """
    spark = large.sparkSession
    rows = [c for c in large.columns if c != "block"]
    for last in (False, True):
        roots = connected_components(edges)
        own = large.select(*rows).join(roots, F.col("id") == F.col("node"), "left").select(*rows, F.coalesce("root", "id").alias("_part"))
        own = materialize(spark, own, "parts")
        parts = own.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("weight"), F.min("id").alias("_first"))
        whole = parts.groupBy("key").agg(F.count(F.lit(1)).alias("_of"), F.sum("docs").alias("docs"), F.sum("weight").alias("weight"), F.max(F.struct("docs", "weight", "_part")).alias("_top")).where("_of > 1")
        whole = materialize(spark, whole, "groups")
        if whole.isEmpty():
            discard(own, whole, roots)
            break
        if not last:
            first = parts.select("key", F.col("_first").alias("id"))
            picked = own.join(first, ["key", "id"]).join(whole.select("key", _parts(F.col("_of"), F.col("weight") * F.col("_of") / F.col("docs"), most_docs, most_weight).alias("_n")), "key")
            dealt = picked.withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("_n")))
        else:
            half = (max(1, most_docs // 2), max(1, most_weight // 2))
            rest = _parts(F.col("docs") - F.col("_top.docs"), F.col("weight") - F.col("_top.weight"), *half)
            sized_groups = whole.select("key", F.col("_top._part").alias("_top"), rest.alias("_rest"), _parts(F.col("_top.docs"), F.col("_top.weight"), *half).alias("_main"))
            both = own.join(sized_groups, "key").withColumn("_is_top", F.col("_part") == F.col("_top"))
            at = F.when(F.col("_is_top"), F.col("_rest") + F.pmod(F.xxhash64("id"), F.col("_main"))).otherwise(F.pmod(F.xxhash64("id"), F.col("_rest")))
            others = F.sequence(F.lit(0).cast("long"), F.when(F.col("_is_top"), F.col("_rest")).otherwise(F.col("_rest") + F.col("_main")) - 1)
            spread_out = both.withColumn("_at", at).withColumn("_other", F.explode(others))
            dealt = spread_out.withColumn("block", F.least("_at", "_other") * F.lit(MOST_BLOCKS) + F.greatest("_at", "_other"))
        before, edges = edges, materialize(spark, edges.unionByName(links(dealt.select(*rows, "block"))), "links")
        discard(before, own, whole, roots)
    return edges


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, matches: int = MATCHES,
    block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES, list_docs: int = LIST_DOCS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; component_id is the
    least id that links lead to, kept says whether that is the row's own."""
    spark = df.sparkSession
    signed = materialize(spark, signatures(df, id_col, text_col, width), "signatures")
    filled = signed.where("n > 0 and id is not null")
    sets = filled.groupBy("f1", "f2").agg(F.min("id").alias("rep"))
    # A set of n has a partner of another set only if n / (n + 1) is enough.
    least = next(n for n in range(1, 10_000) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 40
    wide = filled.where(F.col("n") >= least).groupBy("f1", "f2").agg(F.min(F.struct("id", "n", "sig")).alias("x")).select("x.id", "x.n", "x.sig")
    wide = materialize(spark, wide, "sets")
    sketch = count_sketch(wide)
    candidates = materialize(spark, candidate_links(postings(wide, sketch, matches, list_docs), matches, percent), "links")
    if int(sketch.max()) > list_docs:
        hot = materialize(spark, postings(wide, sketch, matches, list_docs, hot=True), "hot")
        if not hot.isEmpty():
            candidates = across_blocks(candidates, hot, lambda rows: candidate_links(rows, matches, percent), list_docs, MOST_BLOCKS * list_docs)
        discard(hot)
    roots = connected_components(candidates)
    clusters = roots.select(F.col("node").alias("id"), F.col("root").alias("key"))
    dealt = materialize(spark, dealt_clusters(clusters, wide.select("id", "n"), block_docs, block_shingles), "clusters")
    discard(candidates, wide, roots)
    texts = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))

    def verified(rows: DataFrame) -> DataFrame:
        narrow = sized(materialize(spark, rows.select("key", "block", "id"), "members"))
        return verified_links(texts.join(narrow, "id").select("key", "block", "id", "text"), width, percent)

    links = materialize(spark, verified(dealt), "verified")
    large = dealt.where("parts > 1")
    if not large.isEmpty():
        links = across_blocks(links, large.drop("parts"), verified, block_docs, block_shingles)
    roots = connected_components(links)
    found = roots.select(F.col("node").alias("rep"), "root")
    of_set = sets.join(found, "rep", "left").select("f1", "f2", F.coalesce("root", "rep").alias("component_id"))
    of_set = materialize(spark, of_set, "components")  # so that a set of many copies is split in the join below
    discard(dealt, links, roots)
    out = signed.join(of_set.withColumns({"_f1": F.col("f1"), "_f2": F.col("f2")}).drop("f1", "f2"), (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one document of each group of near-duplicates: that of the
    least id. Of rows that repeat id and text, one stays. Texts of one id are
    documents of their own, each judged by itself; of near copies under one id
    one stays. A null id links with nothing, so its rows stay."""
    spark = df.sparkSession
    ids = df.where(F.col(id_col).isNotNull()).groupBy(id_col).count()
    if ids.where("count > 1").isEmpty():
        found = materialize(spark, near_duplicates(df, id_col, text_col, width, percent), "groups")
        gone = found.where(F.col(id_col).isNotNull() & ~F.col("kept"))
        left = without(df, id_col, gone.select(F.col(id_col).alias("id")))
        nulls = left.where(F.col(id_col).isNull()).dropDuplicates([text_col])
        return left.where(F.col(id_col).isNotNull()).unionByName(nulls)
    # a number for each pair of id and text, in the order of the ids
    digest = F.unhex(F.sha2(F.coalesce(F.concat(F.lit("t"), F.col(text_col).cast("string")), F.lit("")).cast("binary"), 256))
    row = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), digest.alias("_digest"), F.col(text_col).cast("string").alias("_text"))
    pairs = row.select("_id", "_digest").distinct().repartitionByRange(spread(spark), "_id", "_digest").sortWithinPartitions("_id", "_digest")
    numbers = materialize(spark, pairs.withColumn("_node", F.monotonically_increasing_id()), "numbers")
    right = numbers.select(F.col("_id").alias("_id2"), F.col("_digest").alias("_digest2"), "_node")
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_digest") == F.col("_digest2"))
    numbered = materialize(spark, row.join(right, same).select("_row", "_text", "_node", F.when(F.col("_id").isNotNull(), F.col("_node")).alias("_own")).dropDuplicates(["_node"]), "numbered")
    found = materialize(spark, near_duplicates(numbered, "_own", "_text", width, percent), "groups")
    gone = found.where(F.col("_own").isNotNull() & ~F.col("kept"))
    return without(numbered, "_node", gone.select(F.col("_own").alias("id"))).select("_row.*")
