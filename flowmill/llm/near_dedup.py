"""Near-duplicate detection by an LSH forest of MinHash signatures.

A document is the set of its word shingles; equal sets are one class from the start. Each tree of
the forest sorts all classes by its own sequence of minima. Candidates are longest-common-prefix
neighbours: in sorted order, the classes that follow each other and share at least ``MIN_DEPTH``
minima.

Candidates are verified on full sets, in rounds: first each class with the neighbours it shares
most with; then, for every two components that candidates still join, their best candidate; in the
last round whatever still crosses components. What lies in one component already needs no proof.

A run of equal prefixes that is longer than the neighbourhood and still holds several components is
then decided whole, block against block. The bits of a class are the parities of its shingles'
buckets: two classes differ in at least as many shingles as their bits differ in, so a pair that
differs in too many bits is excluded by proof, and every other pair is a candidate. A pair is thus
missed only if no tree gives it a common prefix, however many classes share that prefix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.components import merge
from flowmill.llm.exchange import partitions
from flowmill.llm.text import Words, arrow_bytes, mix, run_hashes, slices, split_words, word_hashes
from flowmill.session import Scope, scratch_scope, stage

TREES = 16
#: A label holds four minima of 16 bits; three equal ones make a candidate. A pair of similarity 0.8
#: is missed by one tree with probability 0.49, by all with 1 in 100,000.
DEPTH, MIN_DEPTH = 4, 3
NEIGHBOURS = 3
#: Classes of a run that meet at once, and the least and most bits of a class.
BLOCK = 4096
MIN_BITS, MAX_BITS = 256, 32768
_RNG = np.random.Generator(np.random.PCG64(97))
_A = _RNG.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of texts, rows ascending; short texts are one shingle."""
    hashes = word_hashes(words)
    count = np.diff(words.first)
    length = np.repeat(np.minimum(count, size), count)
    at = np.flatnonzero(words.position + length <= np.repeat(count, count))
    row = words.row[at]
    values = mix(run_hashes(hashes, at, length[at]) + length[at].astype(np.uint64))
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    return row[new], values[new]


def _signatures(size: int):
    def run(batches):
        for batch in batches:
            texts = arrow_bytes(batch.column(1))
            for a, b in slices(texts):
                row, values = shingles(split_words(texts[a:b], lower=True), size)
                first = np.searchsorted(row, np.arange(b - a))
                count = np.diff(np.append(first, len(row)))
                full = np.flatnonzero(count)
                labels = np.zeros((b - a, TREES), np.uint64)
                digest = np.zeros((2, b - a), np.uint64)
                if len(full):
                    start = first[full]
                    digest[0, full] = np.add.reduceat(mix(values), start)
                    digest[1, full] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), start)
                    for k in range(TREES * DEPTH):
                        least = np.minimum.reduceat((values * _A[k] + _B[k]) >> np.uint64(32), start)
                        least = mix(least) >> np.uint64(48)
                        labels[full, k // DEPTH] = labels[full, k // DEPTH] << np.uint64(16) | least
                flat = pa.array(labels.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array(count.astype(np.int64)),
                        pa.array(digest[0].view(np.int64)),
                        pa.array(digest[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * TREES), flat),
                    ],
                    names=["id", "hash", "n_shingles", "d0", "d1", "labels"],
                )

    return run


def _neighbours(batches):
    """Candidates along one range of the sorted trees; the ends of the range are for its neighbours."""
    last: list[tuple[int, int, int]] = []
    edge: list[tuple] = []
    for batch in batches:
        tree, label, node = (batch.column(i).to_numpy() for i in range(3))
        if last:
            tree, label, node = (np.concatenate([[x[i] for x in last], y]) for i, y in enumerate((tree, label, node)))
        prefix = label >> 16 * (DEPTH - MIN_DEPTH)
        a, b = [], []
        for gap in range(1, NEIGHBOURS + 1):
            same = (tree[gap:] == tree[:-gap]) & (prefix[gap:] == prefix[:-gap])
            same[: max(0, len(last) - gap)] = False  # met in the batch before
            at = np.flatnonzero(same)
            a.append(node[at])
            b.append(node[at + gap])
        if not edge:
            edge += [("first", i, *x) for i, x in enumerate(zip(tree[:NEIGHBOURS].tolist(), label[:NEIGHBOURS].tolist(), node[:NEIGHBOURS].tolist(), strict=True))]
        last = list(zip(tree[-NEIGHBOURS:].tolist(), label[-NEIGHBOURS:].tolist(), node[-NEIGHBOURS:].tolist(), strict=True))
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(a), pa.string()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))],
            names=["edge", "n", "tree", "label", "a", "b"],
        )
    rows = edge + [("last", i, *x) for i, x in enumerate(last)]
    if rows:
        kind, n, tree, label, node = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind), pa.array(n, pa.int32()), pa.array(tree, pa.int32()), pa.array(label, pa.int64()), pa.array(node, pa.int64()), pa.array(node, pa.int64())],
            names=["edge", "n", "tree", "label", "a", "b"],
        )


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b, trees): neighbours in some tree and the number of trees where they are."""
    with scratch_scope(classes.sparkSession) as scope:
        return scope.keep(_candidates(classes))


def _candidates(classes: DataFrame) -> DataFrame:
    # ranges of a few rows would hide neighbours from each other
    count = max(1, min(partitions(classes.sparkSession), classes.count() * TREES // 64))
    rows = classes.select(F.posexplode("labels").alias("tree", "label"), F.col("node"))
    # the tree and label order of unsigned prefixes does not matter, only that equal ones meet
    line = rows.repartitionByRange(count, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    met = line.mapInArrow(_neighbours, "edge string, n int, tree int, label long, a long, b long").withColumn("part", F.spark_partition_id())
    met = stage(met, "neighbours")
    inner = met.where("edge IS NULL").select("a", "b")
    # a few rows per range: the last ones meet the first ones of the next
    ends = met.where("edge IS NOT NULL").select("part", "edge", "n", "tree", F.shiftright("label", 16 * (DEPTH - MIN_DEPTH)).alias("prefix"), F.col("a").alias("node"))
    order = ends.select("part").distinct().select("part", F.lead("part").over(Window.orderBy("part")).alias("next"))
    last, first = ends.where("edge = 'last'").alias("l"), ends.where("edge = 'first'").alias("f")
    across = last.join(order, "part").join(first, F.expr("next = f.part AND l.tree = f.tree AND l.prefix = f.prefix"))
    across = across.select(F.least("l.node", "f.node").alias("a"), F.greatest("l.node", "f.node").alias("b"))
    pairs = inner.union(across).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("trees"))
    return stage(pairs, "candidates")


def _bits(size: int):
    """(node, n, bits) of texts: parities of the numbers of shingles per bucket, about 8 buckets a shingle."""

    def run(batches):
        for batch in batches:
            texts = arrow_bytes(batch.column(1))
            for a, b in slices(texts):
                row, values = shingles(split_words(texts[a:b], lower=True), size)
                count = np.bincount(row, minlength=b - a)
                width = 1 << np.ceil(np.log2(np.clip(8 * count, MIN_BITS, MAX_BITS))).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(width)])
                bucket = (mix(values ^ np.uint64(0x2545F4914F6CDD1D)) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
                packed = np.packbits((np.bincount(first[row] + bucket, minlength=first[-1]) & 1).astype(np.uint8)).tobytes()
                at = (first // 8).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(count.astype(np.int64)), pa.array([packed[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    names=["node", "n", "bits"],
                )

    return run


def _signs(bits: list[bytes], width: int) -> np.ndarray:
    """-1 for a set and 1 for a clear bit, longer bits folded to ``width`` (parities add up)."""
    packed = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
    while packed.shape[1] > width // 8:
        half = packed.shape[1] // 2
        packed = packed[:, :half] ^ packed[:, half:]
    return 1 - 2 * np.unpackbits(packed, axis=1).astype(np.float32)


def _possible(side: np.ndarray, component: np.ndarray, n: np.ndarray, bits: list[bytes], percent: int):
    """(i, j, bits that differ) of the pairs of one block, or of two blocks, that may be similar enough.

    Only pairs across components; ``side`` tells two blocks apart.
    """
    order = np.argsort(component, kind="stable")
    width = np.array([8 * len(x) for x in bits])
    two = side.min() < side.max()
    for w in np.unique(width).tolist():
        for v in np.unique(width[(width >= w) & (width * percent <= 200 * w)]).tolist():
            x, y = order[width[order] == w], order[width[order] == v]
            if two:
                low, high = side == side.min(), side == side.max()
                sides = [(x[low[x]], y[high[y]])] + ([(x[high[x]], y[low[y]])] if v > w else [])
            else:
                sides = [(x, y)]
            step = max(64, min(2048, (1 << 22) // w))
            for left, right in sides:
                for s in range(0, len(left), step):
                    i, own = left[s : s + step], None
                    for t in range(s if v == w and not two else 0, len(right), step):
                        j = right[t : t + step]
                        if component[i[0]] == component[i[-1]] == component[j[0]] == component[j[-1]]:
                            continue
                        own = _signs([bits[k] for k in i], w) if own is None else own
                        differ = (w - (own @ _signs([bits[k] for k in j], w).T).astype(np.int64)) // 2
                        good = (100 + percent) * differ <= (100 - percent) * (n[i][:, None] + n[j])
                        good &= component[i][:, None] != component[j]
                        if v == w and not two and s == t:
                            good = np.triu(good, 1)
                        p, q = np.nonzero(good)
                        yield i[p], j[q], differ[p, q]


def _decide(percent: int):
    """Pairs of every group of rows (tree, prefix, low, high, side, node, component, n, bits) sorted by the first four."""

    def pairs(rows: pa.Table):
        side, node, component, n = (rows.column(i).to_numpy() for i in range(4, 8))
        for i, j, differ in _possible(side, component, n, rows.column(8).to_pylist(), percent):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(-differ)], names=["a", "b", "trees"]
            )

    def run(batches):
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if a == b:
                    continue
                key = tuple(keys[:, a].tolist())
                if key != current and held:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                current = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _open_pairs(classes: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, trees): of every long run with several components, all pairs across them not excluded by proof."""
    with scratch_scope(classes.sparkSession) as scope:
        return scope.keep(_open_pairs_of_runs(classes, labels, texts, size, percent))


def _open_pairs_of_runs(classes: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    line = classes.select(F.posexplode("labels").alias("tree", "label"), F.col("node"))
    line = line.select("tree", F.shiftright("label", 16 * (DEPTH - MIN_DEPTH)).alias("prefix"), "node")
    line = line.join(labels, "node", "left").select("tree", "prefix", "node", F.coalesce("component", "node").alias("component"))
    runs = line.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("least"), F.max("component").alias("most"))
    # the neighbours of a shorter run are all its pairs
    runs = stage(runs.where((F.col("size") > NEIGHBOURS + 1) & (F.col("least") < F.col("most"))).select("tree", "prefix", "size"), "runs")
    members = stage(line.join(runs, ["tree", "prefix"]), "members")
    bits = texts.join(members.select("node").distinct(), "node").select("node", "text").mapInArrow(_bits(size), "node long, n long, bits binary")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = members.join(stage(bits, "bits"), "node").withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("tree", "prefix", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "component", "n", "bits")
    group = ["tree", "prefix", "low", "high"]
    placed = placed.repartition(partitions(classes.sparkSession), *group).sortWithinPartitions(*group)
    found = placed.mapInArrow(_decide(percent), "a long, b long, trees long")
    return stage(found.groupBy("a", "b").agg(F.max("trees").alias("trees")), "open-pairs")


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that are similar enough, by their full sets."""

    def run(batches):
        for batch in batches:
            texts_ = [arrow_bytes(batch.column(i)) for i in (2, 3)]
            good = np.zeros(batch.num_rows, bool)
            both = [x for pair in zip(*texts_, strict=True) for x in pair]
            for a, b in _even(both):
                row, values = shingles(split_words(both[a:b], lower=True), size)
                pair = row // 2
                # a value both texts of a pair hold occurs twice in the pair
                order = np.lexsort((values, pair))
                twice = np.flatnonzero((pair[order][1:] == pair[order][:-1]) & (values[order][1:] == values[order][:-1]))
                common = np.bincount(pair[order][twice], minlength=(b - a) // 2)
                union = np.bincount(pair, minlength=(b - a) // 2) - common
                good[a // 2 : b // 2] = (union > 0) & (100 * common >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], names=["a", "b"])

    left = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    full = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return full.mapInArrow(run, "a long, b long")


def _even(texts: list[bytes]):
    """Slices that keep pairs together."""
    pairs = [texts[i] + texts[i + 1] for i in range(0, len(texts), 2)]
    for a, b in slices(pairs):
        yield 2 * a, 2 * b


def _best_per_node(pairs: DataFrame) -> DataFrame:
    """Of each node's candidates the one met in most trees, and of those with the smallest id."""
    sides = pairs.select(F.col("a").alias("node"), "a", "b", "trees", F.col("b").alias("other")).union(
        pairs.select(F.col("b").alias("node"), "a", "b", "trees", F.col("a").alias("other"))
    )
    best = sides.groupBy("node").agg(
        F.min(F.struct((-F.col("trees")).alias("t"), "other", "a", "b")).alias("x"),
        F.min(F.struct("other", "a", "b")).alias("y"),
    )
    return best.select("x.a", "x.b").union(best.select("y.a", "y.b")).distinct()


def _settle(pairs: DataFrame, labels: DataFrame | None, texts: DataFrame, size: int, percent: int, rounds: int) -> DataFrame:
    """The components (node, component) once no pair crosses them that could be a link.

    In all rounds but the last each two components that pairs still join try their best pair. A pair
    that was tried and is no link is left out of later rounds; new links only merge components.
    """
    spark = pairs.sparkSession
    with scratch_scope(spark) as scope:
        for turn in range(rounds):
            known = labels if labels is not None else spark.createDataFrame([], "node long, component long")
            a = known.select(F.col("node").alias("a"), F.col("component").alias("ca"))
            b = known.select(F.col("node").alias("b"), F.col("component").alias("cb"))
            crossing = pairs.join(a, "a", "left").join(b, "b", "left")
            crossing = crossing.select("a", "b", "trees", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
            tried = crossing
            if turn < rounds - 1:
                ends = [F.least("ca", "cb").alias("c"), F.greatest("ca", "cb").alias("d")]
                tried = crossing.groupBy(*ends).agg(F.min(F.struct((-F.col("trees")).alias("t"), "a", "b")).alias("x")).select("x.a", "x.b")
            tried = stage(tried.select("a", "b"), "tried")
            if not tried.limit(1).count():
                break
            links = stage(_verify(tried, texts, size, percent), "links")
            if turn < rounds - 1:
                left = stage(crossing.select("a", "b", "trees").join(tried, ["a", "b"], "left_anti"), "crossing")
                scope.free(pairs)
                pairs = left
            if links.limit(1).count():
                merged = merge(labels, links)
                scope.free(labels)
                labels = merged
        if labels is None:
            labels = stage(spark.createDataFrame([], "node long, component long"), "components")
        return scope.keep(labels)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 80, rounds: int = 3) -> DataFrame:
    """(key, n_shingles, component_id): the smallest key reachable by links, per distinct key.

    Two documents are linked if ``100 * common shingles >= percent * union``. Texts without words are
    linked with nothing; fewer words than a shingle are one shingle. Of rows that share a key the one
    with the smallest text hash stands for it; rows with a null key are left out.
    """
    with scratch_scope(docs.sparkSession) as scope:
        found = stage(_near_duplicates(docs, key, text, shingle, percent, rounds, scope), "near-duplicates")
        return scope.keep(found).withColumnRenamed("id", key)


def _near_duplicates(docs: DataFrame, key: str, text: str, shingle: int, percent: int, rounds: int, scope: Scope) -> DataFrame:
    plain = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    plain = plain.withColumn("hash", F.xxhash64("text"))
    signed = plain.select("id", "text", "hash").mapInArrow(
        _signatures(shingle), "id long, hash long, n_shingles long, d0 long, d1 long, labels array<long>"
    )
    chosen = signed.groupBy("id").agg(F.min(F.struct("hash", "n_shingles", "d0", "d1", "labels")).alias("s"))
    signed = stage(chosen.select("id", "s.*"), "signatures")
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("d0", "d1").agg(F.min(F.struct("id", "hash", "labels")).alias("s"))
    classes = stage(classes.select("d0", "d1", F.col("s.id").alias("node"), "s.hash", "s.labels"), "classes")
    pairs = candidates(classes)
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # only the texts of classes that have a candidate go on
    asked = classes.join(met, "node").select("node", "hash")
    texts = plain.join(asked, (plain["id"] == asked["node"]) & (plain["hash"] == asked["hash"])).select("node", "text")
    texts = stage(texts.dropDuplicates(["node"]), "texts")
    tried = stage(_best_per_node(pairs), "tried")
    links = stage(_verify(tried, texts, shingle, percent), "links")
    labels = merge(None, links)
    left = stage(pairs.join(tried, ["a", "b"], "left_anti"), "crossing")
    scope.free(tried, links)
    labels = _settle(left, labels, texts, shingle, percent, rounds)
    more = _open_pairs(classes, labels, texts, shingle, percent)
    if more.limit(1).count():
        # a neighbour that still crosses components was verified and is not similar enough
        fresh = stage(more.join(pairs, ["a", "b"], "left_anti"), "crossing")
        scope.free(more, pairs)
        labels = _settle(fresh, labels, texts, shingle, percent, rounds)
    scope.free(texts)
    of_class = classes.select("d0", "d1", "node").join(labels, "node", "left").select("d0", "d1", F.coalesce("component", "node").alias("component_id"))
    named = full.select("id", "n_shingles", "d0", "d1").join(of_class, ["d0", "d1"]).select("id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return named.union(alone)
