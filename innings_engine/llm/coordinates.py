"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set is its distinct word shingles; documents with one set are one class. A class has a signature of ``COORDINATES`` values, each made of
``MINIMA`` minima, and is posted under each (coordinate, value) pair. Two minima rather than one keep lists of merely common shingles short. Two
classes of similarity 0.8 agree on 0.64 of the coordinates, 41 of 64 on average; they are candidates from ``MATCHES`` = 20 agreements on (a pair at
exactly 0.8 stays below with odds of 3e-8).

*Prefix and skip.* Lists are ordered by length. Classes with ``MATCHES`` agreements share a list among their COORDINATES - MATCHES + 1
shortest, so the longest MATCHES - 1 lists of a class are skipped, and lists of one are no lists. That order is one for all classes,
so it skips the lists of frequent shingles without losing a pair. Most classes have no list left and are done.

*Merging.* Instead of making the pairs of a list, all lists with the same leader (of a list's classes the one that shares most with
others) are merged into one star: its classes are all of those lists. Two classes of a list are in the star of its leader, so stars
hold every candidate pair, once or a few times rather than once a list. A star is cut into blocks of bounded size by hash, each with the leader; its shingles are cut from the texts again, only for classes in a star. A task takes one block,
counts agreements of signatures, keeps the pairs above the threshold, confirms those on the full sets (as a product of incidence
matrices) and returns a spanning forest of the links, never the pairs themselves. Components of these links join most of a star. What
is left are pairs of classes in different blocks and different components: blocks of the classes outside a star's
largest component meet all its blocks, in a second round of the same step. A large group of copies thus costs blocks, not rows.

Sets are compared as 64-bit hashes of their shingles: two sets of 1,000 are misjudged with odds of 1e-13. Classes are told by 128 bits.

Sets of fewer than ``1 / (1 - similarity) - 1`` shingles (4 at 0.8) can only be similar to an equal set and need no signature. With fewer words than a
shingle, the whole sequence is the set's one element; without words or text the set is empty and linked with nothing. A repeated doc_id is a row each; all rows get the smallest doc_id of their component. A row without doc_id is
linked like others; its component_id is the smallest there is (none if no row has one) and it is kept only then. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import words as wd
from .components import components
from .scratch import keep

SHINGLE = 2
SIMILARITY = Fraction(4, 5)
COORDINATES = 64
#: Minima of which a coordinate's value is made.
MINIMA = 2
MATCHES = 20
#: Classes of a block, and shingles of it, on average.
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 2_000_000
#: Words of 64 bits in the filter of documents whose texts are read again: at most so many rows (8 MB) are broadcast.
FILTER_WORDS = 1 << 19
#: Columns of an incidence matrix multiplied at a time.
_COLUMNS = 8192
_SETS = "doc_id long, n_shingles long, h1 long, h2 long, sig binary"
_LINKS = "a long, b long"


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and where each text's begin."""
    cut = wd.cut(texts, lower=True)
    n = np.where(cut.counts >= size, cut.counts - size + 1, (cut.counts > 0).astype(np.int64))
    first = wd.ragged(cut.docs[:-1], n)
    doc = np.repeat(np.arange(len(n)), n)
    length = np.minimum(np.repeat(cut.counts, n), size)
    of_word = cut.hashes()
    with np.errstate(over="ignore"):
        h = wd.mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for i in range(size):
            more = i < length
            h[more] = wd.mix(h[more] * np.uint64(0x9E3779B97F4A7C15) + of_word[first[more] + i])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(h: np.ndarray, begins: np.ndarray, size: int = COORDINATES, minima: int = MINIMA) -> np.ndarray:
    """Rows of ``size`` coordinates, each made of ``minima`` minima of scrambled hashes; a text without shingles has zeros."""
    rng = np.random.default_rng(12)
    factors = rng.integers(1, 1 << 63, (size, minima), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flips = rng.integers(0, 1 << 63, (size, minima), dtype=np.uint64)
    out = np.zeros((len(begins) - 1, size), np.uint32)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        x = np.empty(len(h), np.uint64)
        for c in range(size):
            value = np.zeros(len(full), np.uint64)
            for r in range(minima):
                np.bitwise_xor(h, flips[c, r], out=x)
                np.multiply(x, factors[c, r], out=x)
                value = wd.mix(value + np.minimum.reduceat(x, begins[full]))
            out[full, c] = value >> np.uint64(32)
    return out


def _names(h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each text's set, as two signed numbers."""
    body = h.tobytes()
    names = [xxhash.xxh3_128_intdigest(body[8 * a:8 * b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
    return tuple(np.array(half, np.uint64).view(np.int64) for half in ([x >> 64 for x in names], [x & (1 << 64) - 1 for x in names]))


def sets_of(docs: DataFrame, size: int = SHINGLE, coordinates: int = COORDINATES, least: int = 4) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig); sets below ``least`` have no signature."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wd.slices(batch):
                h, begins = shingle_sets(part.column("text"), size)
                n = np.diff(begins)
                sig = signatures(h, begins, coordinates)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(n.astype(np.int64)), *map(pa.array, _names(h, begins)),
                    pa.array([None if m < least else s.tobytes() for m, s in zip(n.tolist(), sig)], pa.binary())],
                    ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, _SETS)


def shingles_of(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(cls, shingles) of the wanted classes (cls, h1, h2, first_doc), cut from the text of their first document."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wd.slices(batch):
                h, begins = shingle_sets(part.column("text"), size)
                h1, h2 = _names(h, begins)
                # Other rows with that doc_id may have other texts.
                own = np.flatnonzero((h1 == part.column("h1").to_numpy()) & (h2 == part.column("h2").to_numpy())).tolist()
                yield pa.RecordBatch.from_arrays([
                    part.column("cls").take(pa.array(own, pa.int64())), pa.array([h[begins[i]:begins[i + 1]].tobytes() for i in own], pa.binary())], ["cls", "shingles"])

    # A text is shuffled only if the filter, whose size is fixed, has the bit of its doc_id; once most bits are set it lets all through.
    word = lambda c: F.expr(f"cast(pmod(xxhash64({c}), {FILTER_WORDS}) as int)")
    bit = lambda c: f"cast(pmod(shiftright(xxhash64({c}), 32), 64) as int)"
    bits = wanted.groupBy(word("first_doc").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit('first_doc')}))").alias("mask"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").withColumn("word", word("doc_id"))
    texts = texts.join(F.broadcast(bits), "word").where(F.expr(f"shiftrightunsigned(mask, {bit('doc_id')}) & 1L = 1L"))
    # Both sides are dealt by doc_id, so equal rows are in one task already.
    rows = texts.select("doc_id", "text").join(wanted.withColumnRenamed("first_doc", "of"), F.col("doc_id").eqNullSafe(F.col("of"))).dropDuplicates(["of", "cls", "text"])
    return rows.select("cls", "h1", "h2", "text").mapInArrow(of, "cls long, shingles binary")


def postings(classes: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """(cls, key): the class under each of its (coordinate, value) pairs."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.arange(coordinates, dtype=np.int64) << 32
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, coordinates)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("cls").to_numpy(), coordinates)), pa.array((values + high).ravel())], ["cls", "key"])

    return classes.select("cls", "sig").mapInArrow(of, "cls long, key long")


def stars(classes: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(leader, cls): every two classes that agree on ``matches`` coordinates are in one star; a leader is in its own."""
    posted = keep(postings(classes, coordinates), "postings")
    lists = keep(posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "lists")
    shared = posted.join(lists, "key")
    own = Window.partitionBy("cls")
    # Lists of one come first in the order: a class has so many fewer among its shortest.
    ranked = shared.withColumn("place", F.row_number().over(own.orderBy("df", "key"))).withColumn("n", F.count("*").over(own)).withColumn(
        "weight", F.sum(F.log2("df")).over(own))
    short = keep(ranked.where(F.col("place") + (coordinates - F.col("n")) <= coordinates - matches + 1).select("key", "cls", "weight"), "short")
    leaders = short.groupBy("key").agg(F.max(F.struct("weight", "cls"))["cls"].alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    return short.join(keep(leaders, "leaders"), "key").select("leader", "cls").distinct()


def _forest(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Indices of the pairs (a, b) that join groups not joined before."""
    head = {int(g): int(g) for g in group}

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    out = []
    for i, (x, y) in enumerate(zip(group[a].tolist(), group[b].tolist())):
        x, y = find(x), find(y)
        if x != y:
            head[y] = x
            out.append(i)
    return np.array(out, np.int64)


def block_links(left: list[int], right: list[int], sigs: np.ndarray, sets: list[np.ndarray], group: np.ndarray, similarity: Fraction, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows of ``sigs``) between left and right rows of different groups, enough to connect what the links connect."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    size = np.array([len(s) for s in sets])
    up, down = similarity.numerator, similarity.denominator
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    same = np.zeros((len(left), len(right)), np.int16)
    for c in range(sigs.shape[1]):
        same += sigs[left, c][:, None] == sigs[right, c][None, :]
    smaller, larger = np.minimum(size[left][:, None], size[right][None, :]), np.maximum(size[left][:, None], size[right][None, :])
    i, j = np.nonzero((same >= matches) & (group[left][:, None] != group[right][None, :]) & (down * smaller >= up * larger))
    a, b = left[i], right[j]
    if not len(a):
        return none
    # Only shingles of two sets or more can be shared.
    rows = np.unique(np.concatenate([a, b]))
    owner = np.repeat(np.arange(len(rows)), size[rows])
    names, code, count = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    used = count[code] > 1
    owner, code = owner[used], rank[code[used]]
    common = np.zeros((len(rows), len(rows)))
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, _COLUMNS):
        x, y = np.searchsorted(code, [at, at + _COLUMNS])
        dense = np.zeros((len(rows), _COLUMNS), np.float32)
        dense[owner[x:y], code[x:y] - at] = 1
        common += dense @ dense.T
    place = np.searchsorted(rows, a), np.searchsorted(rows, b)
    both = common[place].astype(np.int64)
    link = np.flatnonzero(down * both >= up * (size[a] + size[b] - both))
    link = link[np.argsort(-both[link], kind="stable")]
    link = link[_forest(a[link], b[link], group)]
    return a[link], b[link]


def _block_task(similarity: Fraction, matches: int):
    """Task: the links of one block (side 0 in both roles), or between the two sides of a pair of blocks."""
    def of(block: pa.Table) -> pa.Table:
        cls = block.column("cls").to_numpy()
        sigs = np.stack([np.frombuffer(s, np.uint32) for s in block.column("sig").to_pylist()])
        sets = [np.frombuffer(s, np.uint64) for s in block.column("shingles").to_pylist()]
        side = block.column("side").to_numpy()
        right = np.flatnonzero(side == 1) if (side == 1).any() else np.arange(len(side))
        a, b = block_links(np.flatnonzero(side == 0), right, sigs, sets, block.column("grp").to_numpy(), similarity, matches)
        return pa.table({"a": cls[a], "b": cls[b]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return of


def _blocks(members: DataFrame, by: list[str], classes_of_block: int, shingles_of_block: int) -> DataFrame:
    """Number of blocks of each group of ``members``: bounded by its classes and by its shingles."""
    return members.groupBy(*by).agg(F.greatest(
        F.ceil(F.count("*") / classes_of_block), F.ceil(F.sum("n_shingles") / shingles_of_block)).cast("int").alias("blocks"), F.count("*").alias("size"))


def similar_classes(classes: DataFrame, docs: DataFrame, similarity: Fraction = SIMILARITY, size: int = SHINGLE, coordinates: int = COORDINATES, matches: int = MATCHES,
                    block_classes: int = BLOCK_CLASSES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(cls, root): the component of every class that has a link."""
    star = keep(stars(classes, coordinates, matches).join(classes.select("cls", "n_shingles"), "cls").select("leader", "cls", "n_shingles"), "stars")
    blocks = keep(_blocks(star, ["leader"], block_classes, block_shingles).where("size > 1"), "blocks")
    wanted = star.select("cls").distinct().join(classes, "cls").select("cls", "h1", "h2", "first_doc")
    bodies = keep(shingles_of(docs, keep(wanted, "wanted"), size).join(classes.select("cls", "sig"), "cls"), "bodies")
    task, part = _block_task(similarity, matches), lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")

    def linked(rows: DataFrame, by: list[str]) -> DataFrame:
        """Links inside each group of (by, cls, side, grp) rows."""
        return keep(rows.join(bodies, "cls").groupBy(*by).applyInArrow(task, _LINKS), "links")

    dealt = star.join(blocks, "leader")
    inner = dealt.where("cls <> leader").select("leader", "cls", part("blocks").alias("block"))
    lead = blocks.select("leader", F.col("leader").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    first = linked(inner.union(lead).select("leader", "block", "cls", F.lit(0).alias("side"), F.col("cls").alias("grp")), ["leader", "block"])
    roots = keep(components(first), "roots").select(F.col("node").alias("cls"), "root")

    # What a block can't see: classes of different blocks and components.
    wide = keep(dealt.where("blocks > 1").join(roots, "cls", "left").select("leader", "cls", "n_shingles", "blocks", F.coalesce("root", "cls").alias("grp")), "wide")
    largest = wide.groupBy("leader", "grp").count().groupBy("leader").agg(F.max(F.struct("count", "grp"))["grp"].alias("most"))
    rest = keep(wide.join(keep(largest, "largest"), "leader").where("grp <> most").drop("most"), "rest")
    cuts = keep(_blocks(rest, ["leader"], block_classes, block_shingles).select("leader", F.col("blocks").alias("cuts")), "cuts")
    all_of = F.sequence(F.lit(0), F.col("other") - 1)
    outside = rest.join(cuts, "leader").select("leader", "cls", "grp", F.lit(0).alias("side"), part("cuts").alias("cut"), F.col("blocks").alias("other"))
    outside = outside.select("leader", "cut", F.explode(all_of).alias("block"), "cls", "side", "grp")
    inside = wide.join(cuts, "leader").select("leader", "cls", "grp", F.lit(1).alias("side"), part("blocks").alias("block"), F.col("cuts").alias("other"))
    inside = inside.select("leader", F.explode(all_of).alias("cut"), "block", "cls", "side", "grp")
    second = linked(outside.unionByName(inside), ["leader", "cut", "block"])
    return components(first.union(second)).select(F.col("node").alias("cls"), "root")


def near_duplicates(docs: DataFrame, similarity: Fraction = SIMILARITY, size: int = SHINGLE, coordinates: int = COORDINATES, matches: int = MATCHES,
                    block_classes: int = BLOCK_CLASSES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked by the similarity of their shingle sets."""
    least = int(1 / (1 - similarity)) - 1
    sets = keep(sets_of(docs, size, coordinates, least), "sets")
    classes = sets.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = keep(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    roots = similar_classes(classes.where(F.col("n_shingles") >= least), docs, similarity, size, coordinates, matches, block_classes, block_shingles)
    rooted = keep(classes.join(roots, "cls", "left").select("h1", "h2", "first_doc", F.coalesce("root", "cls").alias("root")), "rooted")
    heads = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = keep(rooted.join(heads, "root").select("h1", "h2", "component_id"), "components")
    full = sets.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return full.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH RECURSIVE cut AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM cut),
size AS (SELECT doc_id, count(g) AS n FROM cut LEFT JOIN shingle USING (doc_id) GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM size UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach JOIN size USING (doc_id) GROUP BY doc_id, n
"""
