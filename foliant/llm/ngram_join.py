"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

1. Every text gets a digest of its words, MinHash bands and a small sketch; equal word sequences become one node.
2. Nodes meet in band buckets. A bucket first links each member to its smallest or, where not all are like that one, its
   largest member or both. Edges whose sketches agree in less than ``LOOSE`` of the places are dropped.
   Where that leaves members apart, all that are not settled (``SETTLED``) meet each other, by size class and in blocks of
   ``CELL``: no pair of a bucket that may be within the threshold is left unconnected.
3. Components of the candidate edges are compared by whole n-gram sets, block by block: large components are cut into
   blocks of ``BLOCK`` nodes and every pair of blocks is one group. A group gives counts and a spanning forest, not pairs.

Bands and rows are the cheapest that find a pair at the threshold with probability ``RECALL``; as links join into
classes, a class is found more often than that.

Defined cases: words are lower-cased and split at white space; a text with fewer than n words has its words as one n-gram;
null and wordless texts have no links and are classes of their own; a null doc_id is kept, and a class takes its smallest
id that isn't null; repeated rows are copies of each other; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.components import connected_components
from foliant.functions.shared import boxed, stored

N = 5
THRESHOLD = (4, 5)  # the fraction 0.8
RECALL = 0.9995
NOISE = (0.4, 0.06)  # a pair of this similarity may share a bucket with this probability
LOOSE = 0.5
# Disagreement of sketches is a metric. Whatever agrees in LOOSE + 1 - SETTLED = 0.65 of the places (over five deviations
# below 0.8) with a node that agrees in SETTLED with a third agrees in LOOSE with the third, so all three are connected.
SETTLED = 0.85
CELL = 2048
SIZE_CLASS = 1.26  # over 1 / 0.8: sizes of linked nodes are at most one class apart
BLOCK = 256
REMEMBERED = 200_000  # words, by each worker


def bands_and_rows(threshold: float, recall: float = RECALL, noise: tuple[float, float] = NOISE) -> tuple[int, int]:
    """The fewest hash functions that reach the recall at the threshold and keep dissimilar pairs apart."""
    best = None
    for rows in range(1, 16):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if 1 - (1 - noise[0] ** rows) ** bands <= noise[1] and (best is None or bands * rows < best[0] * best[1]):
            best = (bands, rows)
    return best


class WordHashes(dict):
    """64-bit word hashes, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str, hashes: WordHashes, n: int = N) -> tuple[np.ndarray, bytes]:
    """The sorted distinct n-gram hashes of a text and a 128-bit digest of its word hashes."""
    import xxhash

    words = text.lower().split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    digest = xxhash.xxh3_128_digest(w.tobytes())
    if not len(w):
        return w, digest
    size = min(n, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = (h + w[k : len(w) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return np.unique(h), digest


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, tkey, key, size, bands, sketch) for every document."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    mix = rng.integers(1, 2**62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            keys, sizes, banded, sketches = [], [], [], []
            for t in batch.column(2).to_pylist():
                h, digest = shingles(t or "", hashes, n)
                least = np.full(bands * rows, 2**32 - 1, np.uint32)
                x = (h >> np.uint64(32)).astype(np.uint32)
                for i in range(0, len(x), 2048):
                    np.minimum(least, (x[None, i : i + 2048] * a[:, None] + b[:, None]).min(axis=1), out=least)
                v = (least.reshape(bands, rows).astype(np.uint64) * mix).sum(axis=1, dtype=np.uint64) + salt
                v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                keys.append(digest)
                sizes.append(len(h))
                banded.append(v.view(np.int64) if len(h) else v.view(np.int64)[:0])
                sketches.append((least & np.uint32(255)).astype(np.uint8).tobytes())
            offsets = np.cumsum([0, *map(len, banded)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(banded)))
            cols = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists, pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tkey", "key", "size", "bands", "sketch"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("tkey"), "text")
    return rows_.mapInArrow(sign, "doc_id long, tkey long, key binary, size long, bands array<long>, sketch binary")


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The part of the places in which the rows of two sketch tables, or of a table and one sketch, are equal."""
    return np.count_nonzero(x == y, axis=1) / x.shape[1]


def _connected(keys: list[bytes], sketches: np.ndarray, loose: float) -> Iterator[tuple[bytes, bytes]]:
    """Edges that connect every two nodes of a group that may be within the threshold, fewer than nodes.

    Each node in turn is compared with all that are not settled yet.
    """
    label, todo = np.arange(len(keys)), np.arange(len(keys))
    while len(todo) > 1:
        pivot, same = todo[0], _agreement(sketches[1:], sketches[0])
        for other in np.unique(label[todo[1:][same >= loose]]):
            if other != label[pivot]:
                yield max(keys[pivot], keys[other]), min(keys[pivot], keys[other])
                label[label == other] = label[pivot]
        todo, sketches, stay = todo[1:], sketches[1:], same < SETTLED
        if not stay.all():
            todo, sketches = todo[stay], sketches[stay]


def _unsettled_edges(nodes: DataFrame, judged: DataFrame, loose: float) -> DataFrame:
    """(a, b) among the members of buckets that the star edges leave in pieces."""
    inner = judged.where("inside and n > 3").where((F.col("inner_low") < loose) & (F.col("inner_high") < loose))
    left = inner.groupBy("band", "key").agg(F.max("same").alias("same")).where(F.col("same") < SETTLED).select("band", "key")
    size = F.floor(F.log("size") / F.lit(float(np.log(SIZE_CLASS))))
    left = left.join(nodes.select("key", size.alias("c")).hint("merge"), "key").select("band", "key", F.explode(F.array("c", F.col("c") + 1)).alias("c"))
    left = stored(left, "unsettled")
    cells = left.groupBy("band", "c").agg(F.count("*").alias("n")).where("n > 1").select("band", "c", F.ceil(F.col("n") / CELL).cast("int").alias("g"))
    left = left.join(cells.hint("merge"), ["band", "c"]).select("*", F.pmod(F.xxhash64("key"), F.col("g")).cast("int").alias("block"))
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")).where("g = 1 or block != other")
    left = left.select("band", "c", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key")
    grouped = left.join(nodes.select("key", "sketch").hint("merge"), "key").select("band", "c", "i", "j", "key", "sketch")
    grouped = grouped.repartition("band", "c", "i", "j").sortWithinPartitions("band", "c", "i", "j")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        out = []
        for _, group in groupby(rows, lambda r: r[:4]):
            keys, sketches = zip(*[r[4:] for r in group], strict=True)
            out += _connected(keys, np.frombuffer(b"".join(sketches), np.uint8).reshape(len(keys), -1), loose)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])

    return grouped.mapInArrow(connect, "a binary, b binary")


def candidate_edges(nodes: DataFrame, loose: float = LOOSE) -> DataFrame:
    """(a, b): edges between nodes of a bucket whose sketches agree, which connect all that may be within the threshold."""
    placed = nodes.select("key", F.explode("bands").alias("band"))
    buckets = placed.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).where("low < high")
    met = placed.join(buckets.hint("merge"), "band").select("band", "key", "n", ((F.col("key") != F.col("low")) & (F.col("key") != F.col("high"))).alias("inside"), F.posexplode(F.array("low", "high")).alias("side", "end"))
    met = stored(met.where("key != end").select("band", "key", "n", "inside", "side", F.greatest("key", "end").alias("a"), F.least("key", "end").alias("b")), "met")
    one, two = nodes.select(F.col("key").alias("a"), F.col("sketch").alias("x")), nodes.select(F.col("key").alias("b"), F.col("sketch").alias("y"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_agreement(x, y))], ["a", "b", "same"])

    both = met.select("a", "b").distinct().join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "x", "y")
    compared = stored(both.mapInArrow(agree, "a binary, b binary, same double"), "compared")
    met = stored(met.join(compared.hint("merge"), ["a", "b"]), "ends")
    least = lambda side, inside: F.min(F.when((F.col("side") == side) & (F.col("inside") | (not inside)), F.col("same")))
    worst = met.groupBy("band").agg(least(0, False).alias("low"), least(1, False).alias("high"), least(0, True).alias("inner_low"), least(1, True).alias("inner_high"))
    judged = stored(met.join(worst.hint("merge"), "band"), "judged")
    # where all agree with one end, its star connects the bucket
    star = F.when(F.col("low") >= loose, F.col("side") == 0).when(F.col("high") >= loose, F.col("side") == 1).otherwise(F.col("same") >= loose)
    return judged.where(star).select("a", "b").distinct().unionAll(_unsettled_edges(nodes, judged, loose))


def _verified(group: list[tuple], n: int, hashes: WordHashes) -> Iterator[tuple[bytes, int, bytes]]:
    """For one group of (key, side, copies, text): (key, linked documents, smallest key it is joined with)."""
    num, den = THRESHOLD
    group = sorted(group)
    sets = [shingles(t, hashes, n)[0] for *_, t in group]
    sizes = np.array([len(s) for s in sets], np.int64)
    side = np.array([g[1] for g in group])
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = np.bincount(where, minlength=len(every)) > 1
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    keep = common[where]
    where, owner = where[keep], owner[keep]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    if len(where):
        dense = np.cumsum(np.append(0, np.diff(where) > 0))
        for lo in range(0, int(dense[-1]) + 1, 4096):
            i, j = np.searchsorted(dense, [lo, lo + 4096])
            x = np.zeros((len(sets), 4096), np.float32)
            x[owner[i:j], dense[i:j] - lo] = 1
            shared += x @ x.T
    shared = np.rint(shared).astype(np.int64)
    linked = shared * den >= num * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(linked, False)
    if side.any():  # two blocks: pairs inside one block belong to another group
        linked &= side[:, None] != side[None, :]
    copies = np.array([g[2] for g in group], np.int64)
    counts = linked @ copies
    root = np.arange(len(sets))
    while True:
        near = np.where(linked, root[None, :], len(sets)).min(axis=1)
        new = np.minimum(root, near)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    for i, g in enumerate(group):
        yield g[0], int(counts[i]), group[root[i]][0]


def verified_links(grouped: DataFrame, n: int) -> DataFrame:
    """(component, i, j, key, side, copies, text), sorted in its partitions by group -> (key, links, root)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        out = []
        for _, group in groupby(rows, lambda r: r[:3]):
            out += _verified([r[3:] for r in group], n, hashes)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "links", "root"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "links", "root"])

    return grouped.mapInArrow(verify, "key binary, links long, root binary")


def jaccard_classes(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, tkey, class_id (smallest doc_id of the class) and n_links (other documents within the threshold)."""
    bands, rows = bands_and_rows(THRESHOLD[0] / THRESHOLD[1])
    signed = stored(signatures(docs, n, bands, rows), "signatures")
    first = F.min(F.struct("doc_id", "tkey"))
    ids = signed.where("size > 0").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low_id"), first.alias("first"))
    nodes = stored(signed.where("size > 0").select("key", "size", "bands", "sketch").dropDuplicates(["key"]), "nodes")
    parts = stored(connected_components(candidate_edges(nodes)), "parts")
    sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"))
    member = parts.withColumnRenamed("id", "key").join(sizes.hint("merge"), "component").join(ids.hint("merge"), "key")
    block = F.pmod(F.xxhash64("key"), F.col("g")).cast("int")
    member = member.select("key", "component", "g", block.alias("block"), "copies", F.col("first.tkey").alias("tkey"), F.col("first.doc_id").alias("d"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("tkey"), "text")
    full = texts.join(member.hint("merge"), "tkey").where(F.col("doc_id").eqNullSafe(F.col("d"))).dropDuplicates(["key"])
    spread = full.select("*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(i == j, 0).otherwise(F.when(F.col("block") == i, 1).otherwise(2))
    grouped = spread.select("component", i.alias("i"), j.alias("j"), "key", side.alias("side"), "copies", "text")
    grouped = grouped.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = stored(verified_links(grouped, n), "links")
    roots = connected_components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    known = ids.select("key", "copies", "low_id").join(counts.hint("merge"), "key", "left").join(roots.withColumnRenamed("id", "key").hint("merge"), "key", "left")
    known = known.select("key", F.coalesce("component", "key").alias("root"), "low_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = stored(known, "known")
    named = known.join(known.groupBy("root").agg(F.min("low_id").alias("class_id")).hint("merge"), "root").select("key", "class_id", "n_links")
    found = signed.select("doc_id", "tkey", "key", "size").join(named.hint("merge"), "key", "left")
    wordless = F.col("size") == 0
    return found.select("doc_id", "tkey", F.when(wordless, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(wordless, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, n: int = N) -> DataFrame:
    """The documents without all but the smallest doc_id of every class; wordless ones all stay. Columns as before.

    Of repeated rows and of rows that share the smallest id, one stays.
    """
    classes = jaccard_classes(docs, n)
    null = F.lit(-(2**63))
    keep = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(F.coalesce("class_id", null).alias("kept_id")).agg(F.min("tkey").alias("kept_key"))
    own = docs.select(
        boxed(docs), F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("doc_id").cast("long"), null).alias("id"), (~F.coalesce("text", F.lit("")).rlike(r"\S")).alias("wordless")
    )
    kept = own.where("not wordless").join(keep.hint("merge"), (F.col("key") == F.col("kept_key")) & (F.col("id") == F.col("kept_id")), "left_semi")
    return kept.dropDuplicates(["key", "id"]).select("doc.*").unionByName(own.where("wordless").select("doc.*"))
