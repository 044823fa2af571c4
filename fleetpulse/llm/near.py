"""MinHash near-duplicates with an LSH forest, confirmed on full shingle sets.

1. Each text's distinct 5-word shingles are hashed to 64 bits. Texts with equal
   sets form one class (a 128-bit fingerprint and the size); classes, not texts,
   are compared, so exact copies cost one row.
2. The trees: ``TREES`` disjoint runs of ``SHALLOW`` signature values. Classes that
   share a run form a region. Within a region, neighbours whose signatures agree
   enough are joined by a spanning forest, not by all pairs. A region above
   ``REGION_ROWS`` is dealt to blocks, by another hash in each tree; then its members
   outside the region's largest cluster are compared with all of its blocks, a bounded
   number at a time, so that a pair meets at any size of a region.
3. Components of these candidate edges are clusters. Their full sets are brought
   together once and compared exactly, breadth first: everything within 0.75 of
   a member joins it and is not compared again. Only sets that share one of their
   rarest shingles (the first quarter and one more in a common order) can be that
   close. Clusters too large for one task are cut into blocks; the leaders of the
   parts found there are compared with each other, and then what is outside the
   cluster's largest part is joined with all members over these rarest shingles,
   so that no link between parts is missed and no task holds a cluster.
4. Components of the confirmed links give each text its smallest identifier.

A pair of similarity 0.75 shares a region of some tree with probability above
0.999 (16 trees, 3 values). Defined results: null text or text without words
has an empty set, no link, and its own identifier as component; fewer than five
words are one shingle; null identifiers don't count as smallest unless a group
has no other; repeated rows are alike; an empty table gives no rows. Only
identifier and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.graph import components
from fleetpulse.llm.rows import over_groups, slices, with_results, words_of
from fleetpulse.plans.shared import cut

WORDS = 5
TREES = 16
SHALLOW = 3  # values that a region shares
SIGNATURE = 64
AGREE = 36  # of SIGNATURE bytes: 3.5 standard deviations below what 0.75 gives
REGION_ROWS = 2_000
BLOCK_SHINGLES = 2_000_000  # full sets compared in one task at a time
LINK = 75  # per cent
PLACES = 1 << 20  # counts of shingles, by their last bits

_rng = np.random.default_rng(20_261)
_POWERS = _rng.integers(1, 1 << 62, 1, dtype=np.uint64)[0] * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCALE = _rng.integers(1, 1 << 62, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(1, 1 << 62, SIGNATURE, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed hash of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(per_text: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in a row, and the number of words of each text."""
    counts = np.fromiter(map(len, per_text), np.int64, len(per_text))
    words = [w for ws in per_text for w in ws]
    if not words:
        return np.zeros(0, np.uint64), counts
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _POWERS, np.uint64), dtype=np.uint64)
    return mixed(np.add.reduceat(letters * powers[place], starts) + sizes.astype(np.uint64)), counts


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, counts = word_hashes([words_of(t) for t in texts])
    scaled = [hashes * p for p in _PLACES]
    out, first = [], 0
    n = len(hashes)
    runs = np.zeros(0, np.uint64)
    if n >= WORDS:
        runs = mixed(sum(scaled[k][k:n - WORDS + 1 + k] for k in range(WORDS)))
    for count in counts.tolist():
        if count >= WORDS:
            out.append(np.unique(runs[first:first + count - WORDS + 1]))
        elif count:
            whole = sum((scaled[k][first + k] for k in range(count)), np.uint64(count))
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        first += count
    return out


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums of each set's elements."""
    flat, sizes = _flat(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    np.add.at(one, owner, mixed(flat + np.uint64(0x1234567)))
    np.add.at(two, owner, mixed(flat ^ np.uint64(0x5851F42D4C957F2D)))
    return one.view(np.int64), two.view(np.int64)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)), sizes


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, (sets, SIGNATURE), unsigned 32-bit; empty sets get zeros."""
    out = np.zeros((len(sets), SIGNATURE), np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        flat, sizes = _flat([sets[i] for i in some])
        starts = np.cumsum(sizes) - sizes
        for k in range(SIGNATURE):
            out[some, k] = np.minimum.reduceat((flat * _SCALE[k] + _SHIFT[k]) >> np.uint64(32), starts).astype(np.uint32)
    return out


def shingled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: size and fingerprint of its set, and the signature."""
    def apply(texts: list[str]) -> list:
        sets = shingle_sets(texts)
        one, two = fingerprints(sets)
        return [list(map(len, sets)), one.tolist(), two.tolist(), [s.tobytes() for s in signatures(sets)]]

    return with_results(docs, [id_col], text_col, "_n bigint, _f1 bigint, _f2 bigint, _signature binary",
                        lambda: apply, most=1 << 20)


def _keyed(classes: DataFrame) -> DataFrame:
    """(node, tree, region): the region of a class in each tree."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, SIGNATURE).astype(np.uint64)
            keys = np.empty((n, TREES), np.int64)
            for t in range(TREES):
                key = np.full(n, t + 1, np.uint64)
                for k in range(SHALLOW * t, SHALLOW * (t + 1)):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
                keys[:, t] = key.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)),
                 pa.array(keys.ravel())], names=["node", "tree", "region"])

    return classes.select("node", "_signature").mapInArrow(run, "node long, tree int, region long")


def regions(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(region, node) of the groups to compare, none much above REGION_ROWS; and (region, block, blocks, node) of
    the regions that were dealt to blocks, if there are any."""
    keyed = _keyed(classes)
    counts = cut(keyed.groupBy("region").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > 1))
    small, large = counts.filter(F.col("_rows") <= REGION_ROWS), counts.filter(F.col("_rows") > REGION_ROWS)
    whole = keyed.join(small.select("region"), "region", "left_semi").select("region", "node")
    if large.isEmpty():
        return whole, None
    blocks = F.ceil(F.col("_rows") / REGION_ROWS).cast("long")
    crowded = cut(keyed.join(large.select("region", blocks.alias("blocks")), "region")
                  .withColumn("block", F.pmod(F.xxhash64("node", "tree"), F.col("blocks")))
                  .select("region", "block", "blocks", "node"))
    return whole.unionByName(crowded.select(F.xxhash64("region", "block").alias("region"), "node")), crowded


def spanning(n: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest; ``near(i, others)`` flags which of the others are linked to i."""
    edges, left = [], np.arange(n)
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = near(i, left)
            found = left[hit]
            edges.extend((i, int(j)) for j in found)
            todo.extend(found.tolist())
            left = left[~hit]
    return edges


def candidate_edges(members: DataFrame) -> DataFrame:
    """(a, b): spanning forests of the regions over pairs whose signatures agree in AGREE bytes."""
    def apply(rows: pa.Table, bounds: list[int]) -> list:
        node = rows.column("node").to_numpy()
        bytes_ = np.frombuffer(b"".join(rows.column("_bytes").to_pylist()), np.uint8).reshape(len(node), SIGNATURE)
        a, b = [], []
        for low, high in zip(bounds, bounds[1:]):
            own = bytes_[low:high]
            if high - low == 2:
                edges = [(0, 1)] if (own[0] == own[1]).sum() >= AGREE else []
            else:
                edges = spanning(high - low, lambda i, others: (own[others] == own[i]).sum(axis=1) >= AGREE)
            a.extend(int(node[low + i]) for i, _ in edges)
            b.extend(int(node[low + j]) for _, j in edges)
        return [a, b]

    return over_groups(members, ["region"], apply, "a long, b long").distinct()


def crowded_edges(crowded: DataFrame, clusters: DataFrame, low_bytes: DataFrame) -> DataFrame:
    """(a, b): what links different clusters within the regions that were dealt to blocks.

    Members outside a region's largest cluster meet all of its blocks, REGION_ROWS of them at a time.
    """
    def apply(rows: pa.Table, bounds: list[int]) -> list:
        node, part = rows.column("node").to_numpy(), rows.column("component").to_numpy()
        rest = np.asarray(rows.column("_rest").to_pylist(), bool)
        bytes_ = np.frombuffer(b"".join(rows.column("_bytes").to_pylist()), np.uint8).reshape(len(node), SIGNATURE)
        a, b = [], []
        for low, high in zip(bounds, bounds[1:]):
            others = low + np.flatnonzero(~rest[low:high])
            theirs = bytes_[others]
            for i in (low + np.flatnonzero(rest[low:high])).tolist():
                hit = others[((theirs == bytes_[i]).sum(axis=1) >= AGREE) & (part[others] != part[i])]
                for j in np.unique(part[hit], return_index=True)[1].tolist():
                    a.append(int(node[i]))
                    b.append(int(node[hit[j]]))
        return [a, b]

    own = cut(crowded.join(clusters, "node", "left").join(low_bytes, "node")
              .withColumn("component", F.coalesce("component", "node")))
    most = (own.groupBy("region", "component").agg(F.count("*").alias("_size"))
            .groupBy("region").agg(F.max(F.struct("_size", "component"))["component"].alias("_main")))
    outside = cut(own.join(most, "region").filter(F.col("component") != F.col("_main")).drop("_main"))
    chunks = cut(outside.groupBy("region").agg(F.ceil(F.count("*") / REGION_ROWS).cast("long").alias("_chunks")))
    last = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = (outside.join(chunks, "region").withColumn("_chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("_chunks")))
            .withColumn("block", last("blocks")).withColumn("_rest", F.lit(True)))
    every = own.join(chunks, "region").withColumn("_chunk", last("_chunks")).withColumn("_rest", F.lit(False))
    met = rest.unionByName(every).select("region", "block", "_chunk", "node", "component", "_rest", "_bytes")
    return over_groups(met, ["region", "block", "_chunk"], apply, "a long, b long").distinct()


def _linked(size_a, size_b, common):
    return 100 * common >= LINK * (size_a + size_b - common)


def _first(size):
    """How many of a set's shingles, in any order common to all sets, hold one of every set linked to it."""
    return size + LINK * size // -100 + 1


def _forest(own: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the confirmed links among some sets."""
    flat, sizes = _flat(own)
    _, flat, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    owner = np.repeat(np.arange(len(own)), sizes)
    flat = rank[flat]
    flat = flat[np.lexsort((flat, owner))]  # each set's rarest shingles first
    starts, first = np.cumsum(sizes) - sizes, _first(sizes)
    rare, _ = _gathered(flat, starts, first)
    holders = np.repeat(np.arange(len(own)), first)[np.argsort(rare, kind="stable")]
    held = np.bincount(rare, minlength=len(counts))
    lists = np.cumsum(held) - held
    mark, left, edges = np.zeros(len(counts), bool), np.ones(len(own), bool), []
    for at in range(len(own)):
        todo = [at] if left[at] else []
        left[at] = False
        while todo:
            i = todo.pop()
            mine = flat[starts[i]:starts[i] + sizes[i]]
            others, _ = _gathered(holders, lists[mine[:first[i]]], held[mine[:first[i]]])
            others = np.unique(others[left[others]])
            if not len(others):
                continue
            mark[mine] = True
            part, n = _gathered(flat, starts[others], sizes[others])
            common = np.add.reduceat(mark[part], np.cumsum(n) - n, dtype=np.int64)
            mark[mine] = False
            found = others[_linked(sizes[i], n, common)]
            left[found] = False
            edges.extend((i, int(j)) for j in found)
            todo.extend(found.tolist())
    return edges


def exact_edges(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): spanning forests of the confirmed links within each group of sets."""
    def apply(rows: pa.Table, bounds: list[int]) -> list:
        node = rows.column("node").to_numpy()
        packed = rows.column("_set").to_pylist()
        a, b = [], []
        for low, high in zip(bounds, bounds[1:]):
            own = [np.frombuffer(packed[i], np.uint64) for i in range(low, high)]
            if high - low == 2:
                common = len(np.intersect1d(*own, assume_unique=True))
                edges = [(0, 1)] if _linked(len(own[0]), len(own[1]), common) else []
            else:
                edges = _forest(own)
            a.extend(int(node[low + i]) for i, _ in edges)
            b.extend(int(node[low + j]) for _, j in edges)
        return [a, b]

    return over_groups(sets, keys, apply, "a long, b long").filter(F.col("a") != F.col("b")).distinct()


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of some sets, one set after another."""
    total = int(sizes.sum())
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
    return flat[at], sizes


def _confirmed(docs: DataFrame, classes: DataFrame, clusters: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links on full sets that join all linked members of each cluster."""
    def make():
        def apply(texts: list[str]) -> list:
            sets = shingle_sets(texts)
            one, two = fingerprints(sets)
            return [list(map(len, sets)), one.tolist(), two.tolist(), [s.tobytes() for s in sets]]
        return apply

    members = classes.join(clusters, "node").select("node", "component", F.col("_id").alias("_own"), "_n", "_f1", "_f2")
    sizes = members.groupBy("component").agg(F.sum("_n").alias("_all"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_all") / BLOCK_SHINGLES)).cast("long")
    wanted = members.select("_own").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = texts.join(wanted, texts["_id"].eqNullSafe(wanted["_own"]), "left_semi")
    sets = (with_results(texts, ["_id"], "_text", "_n bigint, _f1 bigint, _f2 bigint, _set binary", make, most=1 << 20)
            .join(members, ["_n", "_f1", "_f2"]).filter(F.col("_id").eqNullSafe(F.col("_own")))
            .join(sizes.withColumn("_blocks", blocks), "component")
            .select("component", F.pmod(F.xxhash64("node"), F.col("_blocks")).alias("_block"), "_blocks", "node", "_set")
            .dropDuplicates(["node"]))
    sets = cut(sets)
    found = cut(exact_edges(sets, ["component", "_block"]))
    large = sets.filter(F.col("_blocks") > 1)
    if large.isEmpty():
        return found
    # Leaders of the parts found in blocks are compared with each other.
    parts = _parts(large, found)
    leaders = large.join(parts.select(F.col("part").alias("node")).distinct(), "node", "left_semi")
    found = cut(found.unionByName(_among(leaders)))
    # Whatever is outside its cluster's largest part is looked up over its rarest shingles.
    parts = _parts(large, found)
    by_part = parts.groupBy("component", "part").agg(F.count("*").alias("_size"))
    most = by_part.groupBy("component").agg(F.max(F.struct("_size", "part"))["part"].alias("_main"))
    parts = cut(parts.join(most, "component").select("node", "part", (F.col("part") != F.col("_main")).alias("outside")))
    if parts.filter("outside").isEmpty():
        return found
    return found.unionByName(_between(large, parts))


def _between(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b): all confirmed links between different parts of a cluster, at least one of them outside its largest part."""
    def tally(batches):
        total = np.zeros(PLACES, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                np.add.at(total, _place(np.frombuffer(packed, np.uint64)), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "n"])

    counted = sets.select("_set").mapInArrow(tally, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(PLACES, np.uint8)  # eighths of powers of two: any order that all sets share will do
    often[counted.column("place").to_numpy()] = np.minimum(8 * np.log2(counted.column("n").to_numpy().astype(float)), 255)

    def rarest(batches):
        for batch in batches:
            packed = batch.column(1).to_pylist()
            for low, high in slices(packed):
                own = [np.frombuffer(p, np.uint64) for p in packed[low:high]]
                flat, sizes = _flat(own)
                owner = np.repeat(np.arange(len(own)), sizes)
                flat = flat[np.lexsort((flat, often[_place(flat)], owner))]
                first = _first(sizes)
                rare, _ = _gathered(flat, np.cumsum(sizes) - sizes, first)
                owner = np.repeat(np.arange(len(own)), first)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(first) - first, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low).take(pa.array(owner)), pa.array(rare.view(np.int64)),
                     pa.array(sizes[owner]), pa.array(sizes[owner] - at)], names=["node", "shingle", "n", "to_come"])

    def listed(batches):
        for batch in batches:
            packed = batch.column(1).to_pylist()
            for low, high in slices(packed):
                own = [np.frombuffer(p, np.int64) for p in packed[low:high]]
                flat, sizes = _flat(own)
                bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(bounds, pa.array(flat))],
                                                 names=["node", "shingles"])

    rows = (sets.select("node", "_set").mapInArrow(rarest, "node long, shingle long, n long, to_come long")
            .join(sets.select("component", "node"), "node").join(parts, "node"))
    rows = cut(rows)
    a, b = rows.filter("outside").alias("a"), rows.alias("b")
    least = F.least(F.col("a.to_come"), F.col("b.to_come"))  # a pair's first common shingle is followed by all others
    pairs = (a.join(b, (F.col("a.component") == F.col("b.component")) & (F.col("a.shingle") == F.col("b.shingle")))
             .filter((F.col("a.part") != F.col("b.part")) & (~F.col("b.outside") | (F.col("a.node") < F.col("b.node"))))
             .filter((100 + LINK) * least >= LINK * (F.col("a.n") + F.col("b.n")))
             .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())
    arrays = cut(sets.select("node", "_set").mapInArrow(listed, "node long, shingles array<long>"))
    common = F.size(F.array_intersect("_a", "_b"))
    return (pairs.join(arrays.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), "a")
            .join(arrays.select(F.col("node").alias("b"), F.col("shingles").alias("_b")), "b")
            .filter(_linked(F.size("_a"), F.size("_b"), common)).select("a", "b"))


def _place(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(PLACES)).astype(np.int64)


def _parts(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, node, part) of the members under the edges found so far."""
    own = components(edges).withColumnRenamed("component", "part")
    return cut(members.select("component", "node").join(own, "node", "left")
               .select("component", "node", F.coalesce("part", "node").alias("part")))


def _among(leaders: DataFrame) -> DataFrame:
    """Links among leaders, in blocks of their own while a cluster has too many of them."""
    sizes = leaders.groupBy("component").agg(F.sum(F.octet_length("_set") / 8).alias("_all"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_all") / BLOCK_SHINGLES)).cast("long")
    dealt = (leaders.drop("_block", "_blocks").join(sizes.select("component", blocks.alias("_blocks")), "component")
             .withColumn("_block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("_blocks"))).drop("_blocks"))
    return exact_edges(dealt, ["component", "_block"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: identifier, set size, smallest identifier reachable over links, and whether it is that one."""
    own = cut(shingled(docs, id_col, text_col).withColumnRenamed(id_col, "_id"))
    keys = ["_n", "_f1", "_f2"]
    classes = cut(own.filter(F.col("_n") > 0).groupBy(*keys)
                  .agg(F.min("_id").alias("_id"), F.min("_signature").alias("_signature"))
                  .withColumn("node", F.monotonically_increasing_id()))
    step = SIGNATURE * 4
    low_bytes = F.concat(*[F.substring("_signature", i + 1, 1) for i in range(0, step, 4)])
    bytes_ = classes.select("node", low_bytes.alias("_bytes"))
    groups, crowded = regions(classes)
    clusters = cut(components(candidate_edges(groups.join(bytes_, "node"))))
    if crowded is not None:
        further = crowded_edges(crowded, clusters, bytes_)
        known = clusters.select(F.col("node").alias("a"), F.col("component").alias("b"))
        clusters = cut(components(known.unionByName(further)))
    links = _confirmed(docs, classes, clusters, id_col, text_col)
    groups = components(links)
    least = classes.join(groups, "node").groupBy("component").agg(F.min("_id").alias("_least"))
    named = (classes.join(groups, "node", "left").join(least, "component", "left")
             .select(*keys, F.coalesce("_least", "_id").alias("_least")))
    return (own.join(named, keys, "left")
            .select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"),
                    F.when(F.col("_n") > 0, F.col("_least")).otherwise(F.col("_id")).alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))
