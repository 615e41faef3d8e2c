"""N-gram Jaccard self-join by vertical partitioning, and the connected components of its links.

Each document is the set of its 5-word shingles (64-bit hashes). The global order of the
shingles is cut into fragments; each fragment is worked on by its own task, which sees
only that part of every set, and what the fragments count is summed:

1.  Equal sets are one class (copies cost nothing further).
2.  Fragment by fragment of the lower half of the order, count for each class the shingles
    that another class has too. A class linked with another lacks at most 20 % of its shingles
    there, so a class that has k of its n shingles in the half and shares fewer than
    k - 0.2 n of them is settled. Small sets are dealt and counted whole. In practice few stay.
3.  Of these, shingles are ordered by frequency; two linked sets meet within their rarest
    20 % and at places that leave room for the overlap they need (prefix and position
    filters), so only pairs that meet there are candidates.
4.  Candidates are verified fragment by fragment: partial overlaps are counted separately
    and summed per pair.

A large group of near copies is not expanded into its pairs: each bucket first compares
all members with a few of its densest ones, which joins almost all of the group; then only
pairs of which the components still differ are compared, all of them. So no link that
would join two components is lost. Where every link is wanted, all candidates are compared.

What is shuffled grows with the number of shingles and pairs: an entry of step 2 is twelve
bytes whatever the number of fragments, and a pair goes to VERIFY_FRAGMENTS tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import attach, bounded_batches, materialise, number_rows, small, table
from ledgerline.llm.text_arrays import U64, mix, sets_of

SHINGLE, PERCENT = 5, 80
PIVOTS = 8
#: Members of a bucket are ranked in so many parts first, and the best of each again.
SALTS = 32
#: Rows of a bucket on one side of a task that compares all of its pairs.
BUCKET_PART = 2048
#: A block of pairs to verify holds about so many pairs and shingles at most; an `a` with many pairs is dealt to several blocks.
PAIRS_IN_BLOCK, SHINGLES_IN_BLOCK = 1 << 18, 1 << 25
VERIFY_FRAGMENTS = 8
#: Pairs of elements looked up at once.
PROBES = 1 << 20
#: Sets of up to so many shingles are counted whole, and dealt whole where one of them may be linked with them; of others the lower half of the order.
WHOLE = 32
DEALT_WHOLE = WHOLE * 100 // PERCENT
HALF = U64(1 << 63)
#: Shingles of a fragment when shared ones are counted, on average; and fragments at least.
SHINGLES_IN_FRAGMENT = 1 << 21
COUNT_FRAGMENTS = 48
#: Sets are dealt together until each fragment gets about so many shingles of them, or there are so many in all.
SHINGLES_IN_ROW, SHINGLES_DEALT = 64, 1 << 20


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in sets], np.int64)
    s1, s2 = np.zeros(len(sets), U64), np.zeros(len(sets), U64)
    full = np.flatnonzero(n)
    if full.size:
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        with np.errstate(over="ignore"):
            s1[full] = np.add.reduceat(mix(flat + U64(0x1B873593)), at)
            s2[full] = np.bitwise_xor.reduceat(mix(flat * U64(0xCC9E2D51) + U64(7)), at)
    return n, s1.view(np.int64), s2.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, k, s1, s2: size of the set, how many of it are counted first, and its signature."""
    for batch in batches:
        ids = batch.column(0)
        for a, sets in sets_of(batch.column(1), SHINGLE):
            n, s1, s2 = _signatures(sets)
            k = np.array([len(s) if len(s) <= WHOLE else int(np.searchsorted(s, HALF)) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([ids.slice(a, len(sets)), pa.array(n), pa.array(k), pa.array(s1), pa.array(s2)], names=["doc_id", "n", "k", "s1", "s2"])


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


_DEALT = "fragment int, shingles binary, classes binary, known binary, local binary"


def _deal(fragments: int):
    """Cut the sets along the global order; a row holds one fragment of many sets.

    shingles and classes: an entry for each shingle that one class here has; known: shingles
    that several classes here have; local: how many of those a class has, beside classes.
    """
    wanted = min(SHINGLES_DEALT, SHINGLES_IN_ROW * fragments)

    def rows_of(sets: list[np.ndarray], s1: np.ndarray, turn: int) -> pa.RecordBatch:
        own, first = np.unique(s1, return_index=True)
        parts = [sets[i] for i in first]
        flat = np.concatenate(parts)
        ref = np.repeat(np.arange(len(first), dtype=np.uint32), [len(x) for x in parts])
        order = np.argsort(flat, kind="stable")
        flat, ref = flat[order], ref[order]
        # within these sets: a shingle of two classes is shared, whatever others hold
        begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([begins, [len(flat)]]))
        shared = times > 1
        local = np.bincount(ref[np.repeat(shared, times)], minlength=len(first)).astype(np.int64)
        flat, classes = flat[begins], own[ref[begins]]
        part = (((flat & (HALF - U64(1))) >> U64(31)) * U64(fragments)) >> U64(32)
        order = np.argsort(part, kind="stable")  # the upper half of the order, of small sets alone, is folded over the lower
        flat, classes, shared, part = flat[order].astype(np.uint32), classes[order], shared[order], part[order]
        places, begins = np.unique(part, return_index=True)
        rows = []
        for f, a, b in zip(places.tolist(), begins, [*begins[1:], len(part)], strict=True):
            known = shared[a:b]
            rows.append((f, _blob(flat[a:b][~known]), _blob(classes[a:b][~known]), _blob(flat[a:b][known]), None))
        some = local > 0
        rows.append((turn % fragments, None, _blob(own[some]), None, _blob(local[some])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["fragment", "shingles", "classes", "known", "local"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, size, held, names = 0, 0, [], []
        for batch in batches:
            for _, sets in sets_of(batch.column(0), SHINGLE):
                n, s1, _ = _signatures(sets)
                full = np.flatnonzero(n)
                held += [sets[i].copy() if n[i] <= DEALT_WHOLE else sets[i][: np.searchsorted(sets[i], HALF)].copy() for i in full]
                names.append(s1[full])
                size += sum(len(s) for s in held[len(held) - len(full) :])
                if held and size >= wanted:
                    yield rows_of(held, np.concatenate(names), turn)
                    turn, size, held, names = turn + 1, 0, [], []
        if held:
            yield rows_of(held, np.concatenate(names), turn)

    return deal


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One fragment: per class, how many of its shingles here another class has too."""
    held: dict[int, tuple[list, list, list]] = {}
    for batch in batches:
        for f, shingles, classes, known, local in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            own = np.frombuffer(classes, np.int64)
            if local is not None:
                counts = np.frombuffer(local, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts), pa.array(np.ones(len(own), bool))], names=["s1", "shared", "local"])
                continue
            for store, x in zip(held.setdefault(f, ([], [], [])), (np.frombuffer(shingles, np.uint32), own, np.frombuffer(known, np.uint32)), strict=True):
                store.append(x)
    for stores in held.values():
        s, own, known = (np.concatenate(x) for x in stores)
        if not s.size:
            continue
        known = np.unique(known)
        order = np.argsort(s, kind="stable")
        s, own = s[order], own[order]
        begins = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        times = np.diff(np.concatenate([begins, [len(s)]]))
        shared = np.minimum.reduceat(own, begins) != np.maximum.reduceat(own, begins)
        if known.size:
            shared |= known[np.minimum(np.searchsorted(known, s[begins]), len(known) - 1)] == s[begins]
        take = np.repeat(shared, times)
        at, own = np.repeat(np.arange(len(begins)), times)[take], own[take]
        order = np.lexsort((at, own))
        at, own = at[order], own[order]
        if own.size:
            fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1])])
            names, counts = np.unique(own[fresh], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts.astype(np.int64)), pa.array(np.zeros(len(names), bool))], names=["s1", "shared", "local"])


def _alive_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, n, s1, s2, text) -> (cid, n, shingles), where the text is that of the class."""
    for batch in batches:
        cid, wanted = batch.column(0), [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
        for a, sets in sets_of(batch.column(4), SHINGLE):
            right = np.ones(len(sets), bool)
            for x, y in zip(_signatures(sets), wanted, strict=True):
                right &= x == y[a : a + len(sets)]
            at = np.flatnonzero(right)
            if at.size:
                yield pa.RecordBatch.from_arrays([cid.take(pa.array(at + a)), pa.array([len(sets[i]) for i in at], pa.int64()), pa.array([sets[i].view(np.int64) for i in at], pa.list_(pa.int64()))], names=["cid", "n", "shingles"])


_SEGMENTS = "place int, cid long, segment binary, a binary, b binary, sizes binary"


def _segment_batch(rows: list) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["place", "cid", "segment", "a", "b", "sizes"])


def _segments(fragments: int):
    """(cid, block, shingles) -> one row per fragment."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cid, block, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingles.values.to_numpy().view(np.uint64)
                part = ((s >> U64(32)) * U64(fragments)) >> U64(32)
                cuts = np.searchsorted(part, np.arange(fragments + 1, dtype=np.uint64))
                rows += [(block * fragments + f, cid, _blob(s[x:y]), None, None, None) for f, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
                if len(rows) > 20_000:
                    yield _segment_batch(rows)
                    rows = []
            if rows:
                yield _segment_batch(rows)

    return cut


def _asked(fragments: int):
    """(block, a, b, size) -> for each block here a row per fragment with all its pairs; only the first carries the sizes, of both sets."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, *rest = (batch.column(i).to_numpy() for i in range(4))
            order = np.argsort(block, kind="stable")
            block, rest = block[order], [x[order] for x in rest]
            for x in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1) if len(block) else ():
                a, b, size = (_blob(c[x[0] : x[-1] + 1]) for c in rest)
                yield _segment_batch([(int(block[x[0]]) * fragments + f, None, None, a, b, None if f else size) for f in range(fragments)])

    return pack


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of size[0] numbers, then those of the next."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One fragment of one block of pairs: the overlap of each pair here, where there is one; the first fragment gives every pair and the sizes."""
    held: dict[int, tuple[list, list, list]] = {}
    for batch in batches:
        for place, cid, segment, *pair in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            names, segments, asked = held.setdefault(place, ([], [], []))
            if segment is None:
                a, b, size = (None if x is None else np.frombuffer(x, np.int64) for x in pair)
                asked.append((a, b, np.zeros(len(a), np.int64) if size is None else size))
            else:
                names.append(cid)
                segments.append(np.frombuffer(segment, np.uint64))
    for names, segments, asked in held.values():
        if not asked:
            continue
        a, b, size = (np.concatenate(x) for x in zip(*asked, strict=True))
        counts = np.zeros(len(a), np.int64)
        if names:
            cid = np.array(names, np.int64)
            order = np.argsort(cid)
            cid, lengths = cid[order], np.array([len(s) for s in segments])[order]
            values, rank = np.unique(np.concatenate([segments[i] for i in order]), return_inverse=True)
            begin = np.cumsum(lengths) - lengths
            codes = np.repeat(np.arange(len(cid)), lengths) * len(values) + rank  # ascending: set by set, shingle by shingle
            left, right = (np.minimum(np.searchsorted(cid, x), len(cid) - 1) for x in (a, b))
            here = np.flatnonzero((cid[left] == a) & (cid[right] == b))
            here = here[np.argsort(left[here], kind="stable")]
            probes = np.cumsum(lengths[right[here]])
            at = 0
            while at < len(here):
                end = max(at + 1, int(np.searchsorted(probes, (probes[at - 1] if at else 0) + PROBES, side="right")))
                some = here[at:end]
                n = lengths[right[some]]
                wanted = np.repeat(left[some], n) * len(values) + rank[_ranges(begin[right[some]], n)]
                hit = codes[np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)] == wanted
                counts[some] = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
                at = end
        some = (counts > 0) | (size > 0)
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (a, b, counts, size)], names=["a", "b", "overlap", "size"])


def _blocked(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(pairs with the block in which each is verified, number of blocks).

    Pairs go by their a, so that its set is sent once; an a with many pairs by parts of them.
    """
    n_pairs, weight = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest("n_a", "n_b")), F.lit(0))).first()
    blocks = 1 + max(n_pairs // PAIRS_IN_BLOCK, weight // SHINGLES_IN_BLOCK)
    if blocks == 1:
        return pairs.withColumn("block", F.lit(0)), 1
    part = max(1, n_pairs // blocks // 8)  # a block gets eight parts or so
    often = materialise(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > part), "often")
    dealt = pairs.join(small(often), "a", "left").withColumn("_part", F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("c") / part), F.lit(1))))
    return dealt.withColumn("block", F.pmod(F.xxhash64("a", "_part"), F.lit(blocks)).cast("int")).drop("c", "_part"), blocks


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b, overlap) among the pairs (a < b, n_a, n_b): overlaps counted per fragment and summed."""
    cut, blocks = _blocked(pairs)
    needed = cut.select(F.col("a").alias("cid"), "block").union(cut.select("b", "block")).distinct()
    own = sets.select("cid", "shingles").join(needed, "cid").select("cid", "block", "shingles")
    segments = own.mapInArrow(_segments(VERIFY_FRAGMENTS), _SEGMENTS)
    asked = cut.select("block", "a", "b", (F.col("n_a") + F.col("n_b")).alias("size")).mapInArrow(_asked(VERIFY_FRAGMENTS), _SEGMENTS)
    dealt = segments.unionByName(asked).repartitionById(VERIFY_FRAGMENTS * blocks, F.col("place"))
    counted = dealt.mapInArrow(_overlaps, "a long, b long, overlap long, size long")
    overlaps = counted.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.sum("size").alias("size"))
    return overlaps.filter(F.lit(100) * F.col("overlap") >= F.lit(PERCENT) * (F.col("size") - F.col("overlap"))).select("a", "b", "overlap")


def _room(n: Column, at: Column, m: Column, other_at: Column) -> Column:
    """Whether sets of n and m shingles that first meet at these places can still overlap enough."""
    need = F.lit(PERCENT) * (n + m)
    return ((n - at) * (100 + PERCENT) >= need) & ((m - other_at) * (100 + PERCENT) >= need)


def _met(joined: DataFrame) -> DataFrame:
    """Distinct pairs (a < b, n_a, n_b) of rows that hold two sets x and y which meet in a shingle."""
    less = F.col("x.cid") < F.col("y.cid")
    pick = lambda c, d: F.when(less, F.col(c)).otherwise(F.col(d))
    found = joined.filter((F.col("x.cid") != F.col("y.cid")) & _room(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at")))
    return found.select(pick("x.cid", "y.cid").alias("a"), pick("y.cid", "x.cid").alias("b"), pick("x.n", "y.n").alias("n_a"), pick("y.n", "x.n").alias("n_b")).distinct()


def _pivot_pairs(prefix: DataFrame, buckets: DataFrame, n_rows: int) -> DataFrame:
    """Pairs of each row of prefix with the PIVOTS densest of its bucket."""
    dense = [F.col("density").desc(), F.col("cid")]
    salted = prefix.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)))
    best = salted.withColumn("r", F.row_number().over(Window.partitionBy("shingle", "salt").orderBy(*dense))).filter(F.col("r") <= PIVOTS)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("shingle").orderBy(*dense))).filter(F.col("r") <= PIVOTS)
    pivots = best.groupBy("shingle").agg(F.collect_list(F.struct("cid", "n", "at")).alias("pivots"))  # PIVOTS at most
    met = attach(prefix.select("shingle", F.struct("cid", "n", "at").alias("x")), buckets.join(pivots, "shingle"), ["shingle"], "size", n_rows, "inner")
    return _met(met.select("x", F.explode("pivots").alias("y")))


def _all_pairs(x: DataFrame, y: DataFrame, also: Column) -> DataFrame:
    """Pairs of a row of x and a row of y in the same bucket (shingle, size) of which also holds; a large bucket is split."""
    splits = F.ceil(F.col("size") / BUCKET_PART).cast("int")
    row = F.struct("cid", "n", "at", "comp")
    left = x.select("shingle", F.pmod(F.xxhash64("cid"), splits).cast("int").alias("part"), row.alias("x"))
    right = y.select("shingle", F.explode(F.sequence(F.lit(0), splits - 1)).alias("part"), row.alias("y"))
    return _met(left.join(right, ["shingle", "part"]).filter(also))


def _digest(edges: DataFrame) -> tuple:
    """Number of rows and two sums over their hashes: equal for equal sets of edges."""
    hashes = [F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *hashes).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component of links (a, b).

    Large-star and small-star steps alternate until nothing changes; hubs are met by attach().
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = _digest(edges)
    while True:
        before, n_rows = state, state[0]
        # large star: every larger neighbour of u points to the least of u and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).withColumn("m", F.least("m", "u"))
        large = attach(both.filter("v > u"), least, ["u"], "c", 2 * n_rows, "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u != v").distinct(), "large")
        # small star: the smaller neighbours of u, and u, point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        near = attach(large, least, ["u"], "c", n_rows, "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        near = near.union(least.select("u", F.col("m").alias("v")))
        edges = materialise(near.filter("u != v").distinct(), "edges")
        state = _digest(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _join(docs: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members with the signature s1, s2, n of their set, links); see ngram_join()."""
    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    signed = materialise(texts.mapInArrow(_sign, texts.select("doc_id").schema.simpleString()[7:-1].replace(":", " ") + ", n long, k long, s1 long, s2 long"), "signed")
    n_rows, n_counted = signed.agg(F.count(F.lit(1)), F.coalesce(F.sum("k"), F.lit(0))).first()
    key = ["s1", "s2", "n"]
    classes, n_classes = number_rows(signed.filter("n > 0").groupBy(key).agg(F.min("doc_id").alias("rep"), F.min("k").alias("k"), F.count(F.lit(1)).alias("copies")), key, "cid")

    # 2. shared shingles, by fragment
    fragments = max(COUNT_FRAGMENTS, n_counted // SHINGLES_IN_FRAGMENT)
    dealt = texts.select("text").mapInArrow(_deal(fragments), _DEALT)
    counted = dealt.repartitionById(fragments, F.col("fragment")).mapInArrow(_count_shared, "s1 long, shared long, local boolean")
    most = counted.groupBy("s1").agg((F.coalesce(F.sum(F.expr("case when not local then shared end")), F.lit(0)) + F.coalesce(F.max(F.expr("case when local then shared end")), F.lit(0))).alias("shared"))
    alive = classes.join(most, "s1", "left").filter(F.lit(100) * (F.col("k") - F.coalesce("shared", F.lit(0))) <= F.lit(100 - PERCENT) * F.col("n"))
    alive = materialise(alive.select("cid", "n", "s1", "s2", "rep"), "alive")

    # 3. candidates among the classes left
    n_alive = alive.count()
    found = texts.join(small(alive), F.col("doc_id").eqNullSafe(F.col("rep"))).select("cid", "n", "s1", "s2", "text")
    sets = materialise(found.mapInArrow(_alive_sets, "cid long, n long, shingles array<long>"), "sets")
    if sets.count() > n_alive:  # rows repeated with their doc_id
        sets = materialise(sets.dropDuplicates(["cid"]), "sets")
    rows = sets.select("cid", "n", F.explode("shingles").alias("shingle"))
    n_tokens = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = materialise(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "frequent")
    shared = attach(rows, frequent, ["shingle"], "df", n_tokens, "inner")
    of_set = Window.partitionBy("cid")
    shared = shared.withColumns({"k": F.count(F.lit(1)).over(of_set), "density": F.sum("df").over(of_set) / F.col("n")}).filter(F.lit(100) * F.col("k") >= F.lit(PERCENT) * F.col("n"))
    shared = shared.withColumn("at", F.col("n") - F.col("k") + F.row_number().over(of_set.orderBy("df", "shingle")) - 1)
    prefix = shared.filter(F.lit(100) * (F.col("n") - F.col("at")) >= F.lit(PERCENT) * F.col("n"))
    prefix = materialise(prefix.select("shingle", "cid", "n", "at", "density"), "prefix")
    buckets = materialise(prefix.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    n_prefix = prefix.count()

    if every:
        placed = attach(prefix.select("shingle", "cid", "n", "at", F.col("cid").alias("comp")), buckets, ["shingle"], "size", n_prefix, "inner")
        asked = materialise(_all_pairs(placed, placed, F.col("x.cid") < F.col("y.cid")), "pairs")
        links = materialise(_verified(asked, sets), "links")
        reached = materialise(components(links), "reached")
    else:
        # a few dense members of each bucket against all of it
        first = materialise(_pivot_pairs(prefix, buckets, n_prefix), "pairs")
        links = materialise(_verified(first, sets), "links")

        # then all pairs that would still join two components
        reached = materialise(components(links), "reached")
        placed = prefix.join(reached, F.col("cid") == F.col("node"), "left").select("shingle", "cid", "n", "at", F.coalesce("component", "cid").alias("comp"))
        placed = materialise(placed, "placed")
        parts = placed.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("c"))
        mixed = parts.groupBy("shingle").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("size")).filter("comps > 1")
        open_rows = materialise(attach(placed, mixed, ["shingle"], "size", n_prefix, "inner"), "open")
        rest = _all_pairs(open_rows.filter("comp != main"), open_rows, F.col("x.comp") != F.col("y.comp"))
        rest = materialise(rest.join(first.select("a", "b"), ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            links = materialise(links.unionByName(_verified(rest, sets)), "links")
            reached = materialise(components(links), "reached")

    named = classes.join(reached, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("members"))
    more = []
    if every:
        # a document is linked with the other copies of its set and with all copies of the sets linked with it
        ends = links.select("a", "b").union(links.select("b", "a")).join(classes.select(F.col("cid").alias("b"), "copies"), "b")
        degree = ends.groupBy(F.col("a").alias("cid")).agg(F.sum("copies").alias("partners"))
        named = named.join(degree, "cid", "left").withColumn("n_links", F.coalesce("partners", F.lit(0)) + F.col("copies") - 1)
        more = ["n_links"]
    named = attach(named.select(*key, "copies", "component", *more), ids, ["component"], "members", n_rows, "inner").select(*key, "copies", "component", "component_id", *more)
    members = attach(signed.filter("n > 0"), named, key, "copies", n_rows, "inner").select("doc_id", *key, "component", "component_id", *more)
    alone = signed.filter("n = 0").select("doc_id", *key, F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"), *(F.lit(0).cast("long").alias(c) for c in more))
    return members.unionByName(alone), links


def ngram_join(docs: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: doc_id, n_shingles, component_id, one row per row of docs; component_id is the
    smallest doc_id of the rows reachable by links. links: a, b, overlap among class
    numbers, the verified links found on the way (a spanning part of all links). With every,
    all links between different sets, and members has n_links, the number of other rows that
    a row is linked with; this work grows with the number of links, the square of a group.

    A null or blank text has an empty set and is linked with nothing; equal sets are linked;
    repeated rows are members like any other; a null doc_id is a member, named by the
    smallest id of its component, or by null; an empty table gives empty results.
    """
    members, links = _join(docs, every)
    return members.select("doc_id", F.col("n").alias("n_shingles"), "component_id", *(["n_links"] if every else [])), links


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each group: the one whose doc_id names the component.

    Where doc_ids are missing or repeated, rows are told apart by their sets too, and of
    rows with equal doc_id and set one stays; a row without words, or without text, always stays;
    an empty table stays empty; other columns, whatever their names, go along.
    """
    members = materialise(_join(docs)[0], "members")
    if members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("doc_id is null or c > 1").isEmpty():
        gone = materialise(members.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")), "gone")
        return docs.alias("a").join(small(gone).alias("b"), F.col("a.doc_id") == F.col("b._gone"), "left_anti")

    key = ["doc_id", "s1", "s2", "n"]
    first = F.min_by(F.struct(*key), F.struct(F.col("doc_id").isNull(), *key))
    stays = materialise(members.filter("n > 0").groupBy("component").agg(first.alias("k")).select("k.*"), "stays")

    @F.arrow_udf("n long, s1 long, s2 long")
    def signature(text: pa.Array) -> pa.Array:
        found = [_signatures(sets) for _, sets in sets_of(text, SHINGLE)]
        n, s1, s2 = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pa.StructArray.from_arrays([pa.array(n), pa.array(s1), pa.array(s2)], names=["n", "s1", "s2"])

    rows = docs.select("doc_id", signature("text").alias("s"), F.struct(*docs.columns).alias("_row")).select("doc_id", "s.*", "_row")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.s1") == F.col("b.s1")) & (F.col("a.s2") == F.col("b.s2")) & (F.col("a.n") == F.col("b.n"))
    kept = rows.filter("n > 0").alias("a").join(small(stays).alias("b"), same, "left_semi").dropDuplicates(key)
    return kept.unionByName(rows.filter("n = 0")).select("_row.*")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))[0]
