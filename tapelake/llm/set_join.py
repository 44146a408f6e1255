"""Exact n-gram Jaccard join by set relations: index lists that are skipped by position, answers taken from like sets.

A document's set holds its distinct runs of `k` words (A-Z lower-cased, words cut at ASCII white space), as 64-bit
hashes. Two sets link when |A and B| / |A or B| >= percent / 100. Equal sets are one vertex, so copies cost nothing more.

Index lists. A set's elements, in hash order, are cut at fixed positions of the hash range into more segments than two
linked sets can differ in elements, so linked sets agree on a whole segment; each segment's sum is a list key. Sets are
indexed by size class and a set is looked up in its own class and the next one only where sizes can qualify, so lists
of other sizes are skipped. (Lists of single elements need a rarity order, that is, a count of every shingle of the
corpus, which moves more data than the corpus; the key of a segment is rare without counting.) Lists are split and sorted by range of
(key, vertex), so one list of very many sets is spread over tasks; keys of one set go at once. Linked sets meet in several lists of a size class
(`least_shared`); a set that shares fewer of them with any others leaves these, so that sets with no more than a line in common seldom meet.

Answers. Each list's first set is its leader and is compared with the rest: one comparison for each entry, not one for each
pair. What the leader links is one component already. For what is left, a set's answers come from its leader's: sets of one leader are compared
through their differences from it, which are small and seldom shared. Two of them that link, but not both to the leader, must share so many
differences that their first ones, rarest in the family first, meet; an index over those is joined and skipped by position
(what is left of both lists after a match must be enough). Pairs that pass are compared in full, so no link between different components is lost.

NULL and empty texts and texts without words have empty sets, which link with nothing and keep their own id. Repeated
rows are equal sets. NULL ids take part; a component without any other id has the id NULL. Further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.llm.common import HASHES, fresh, giving_back, mixed, shingle_hashes, small_batches, small_side, texts
from tapelake.llm.components import components
from tapelake.session import written

K, PERCENT = 3, 90
RATIO = 1.45  # of the sizes in one class
CLASSES = 128  # that the low bits of a list key can name
BROADCAST_ROWS = 1_000_000  # of two 64-bit columns


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower and bytes.split know ASCII only."""
    return np.unique(shingle_hashes(HASHES.of(text.lower().split()), k))


@functools.cache
def _class_ends(percent: int) -> tuple[int, ...]:
    ends, low = [], 1
    while low < 1 << 40:
        low = max(low + 1, int(low * RATIO) + 1)
        ends.append(low)
    return tuple(ends)


@functools.cache
def _segments(size_class: int, percent: int) -> tuple[int, int]:
    """(segments, spare) of a class. Linked sets differ in (1 - t) / (1 + t) * (|A| + |B|) elements at most, both sizes below the class's
    end, so of one segment more and `spare` others they agree on spare + 1. Each set leaves out the spare + 1 - `least_shared` segments that
    come first by (elements, sum, place). The last `least_shared` of those that both agree on have as many before them in either set, so neither
    leaves them out. What stays are full segments, which seldom meet by chance."""
    differ = (100 - percent) * 2 * (_class_ends(percent)[size_class] - 1) // (100 + percent)
    spare = differ // 2 + 1
    return (differ + 1 + spare if differ else 0), spare


@functools.cache
def least_shared(size_class: int, percent: int) -> int:
    """Lists under a class that two linked sets share at least: each more is one more key for every set."""
    return 1 + _segments(size_class, percent)[1] // 8


@functools.cache
def _cuts(segments: int) -> np.ndarray:
    return np.array([(i << 64) // segments for i in range(segments)], np.uint64)


def keys(found: np.ndarray, percent: int) -> np.ndarray:
    """List keys of a set: one for each segment, under its own size class and, if larger sets of the next can link, that."""
    n = len(found)
    ends = _class_ends(percent)
    own = int(np.searchsorted(ends, n, "right"))
    out = []
    for c in (own, own + 1):
        low = ends[c - 1] if c else 0
        if c > own and 100 * n < percent * low:
            break
        segments, spare = _segments(c, percent)
        if not segments:
            continue  # linked sets of this class are equal
        at = np.append(np.searchsorted(found, _cuts(segments)), n)
        totals = np.append(np.zeros(1, np.uint64), np.cumsum(found, dtype=np.uint64))
        sums = totals[at[1:]] - totals[at[:-1]]
        kept = np.lexsort((sums, np.diff(at)))[spare + 1 - least_shared(c, percent):]
        found_keys = mixed(sums[kept] ^ mixed(kept.astype(np.uint64) + np.uint64(c << 40)))
        out.append(found_keys & ~np.uint64(CLASSES - 1) | np.uint64(c))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """Per row: row (unique), id, text_hash, n (set size), digest of the set, and its list keys."""
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), text_hash(F.col(text)).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes, digests, lists = [], [], []
            for value in texts(batch.column(1)):
                found = shingles(value, k)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                lists.append(keys(found, percent).view(np.int64))
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(sizes))), batch.column(0), batch.column(2), pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["row", "id", "text_hash", "n", "digest", "keys"])
            row += len(sizes)

    return named.mapInArrow(giving_back(run), f"row long, id {kind}, text_hash long, n long, digest binary, keys array<long>")


def text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(text))


def shared_entries(entries: DataFrame) -> DataFrame:
    """The (key, v, ...) entries whose key comes again, most of them with another vertex.

    Entries come sorted by range; those of a partition's first and last key stay, as the list may go on elsewhere.
    """
    ordered = entries.repartitionByRange("key", "v").sortWithinPartitions("key", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # entries of the last key seen so far (it may go on in the next batch); of a very long list one that is known to be shared
        held, first, known = None, True, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = batch.column(0).to_numpy(zero_copy_only=False)
            new = np.append(True, key[1:] != key[:-1])
            last = int(np.flatnonzero(new)[-1])
            again = ~new | np.append(~new[1:], False)
            again[0] |= known
            known = len(key) - last > 200_000
            if known:
                last = len(key) - 1
            if first:
                again |= np.cumsum(new) == 1
            if new[:last + 1].sum() > 1:
                first = False
            yield batch.take(pa.array(np.flatnonzero(again[:last])))
            held = batch.slice(last)
        if held is not None:
            yield held

    return ordered.mapInArrow(giving_back(run), entries.schema)


def _often_shared(lists: DataFrame, percent: int) -> DataFrame:
    """The entries of sets that share as many lists of a size class as linked sets do at least."""
    least = F.array(*[F.lit(least_shared(c, percent)) for c in range(len(_class_ends(percent)))])
    own = lists.groupBy("v", F.col("key").bitwiseAND(CLASSES - 1).cast("int").alias("class")).agg(F.collect_list("key").alias("keys"))
    return own.where(F.size("keys") >= F.get(least, F.col("class"))).select(F.explode("keys").alias("key"), "v")


def _verified(pairs: DataFrame, bodies: DataFrame, k: int, percent: int, differ: bool = False) -> DataFrame:
    """Pairs (a, b) with the sizes of both sets and of what they share, from their texts.

    With `differ`, also the elements that only b has (`own`), and those that only a has (`other`) where the first of b's differences
    can reach them: of all |b xor a|, own ones first, `first` must be indexed (see `_within_families`).
    """
    one = bodies.select(F.col("v").alias("a"), F.col("text").alias("text_a"))
    two = bodies.select(F.col("v").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    c = (100 - percent) / (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, left = None, None
        for batch in batches:
            sizes, own, other = [], [], []
            for a, text_a, text_b in zip(batch.column(0).to_pylist(), texts(batch.column(2)), texts(batch.column(3))):
                if a != known:
                    known, left = a, shingles(text_a, k)
                right = shingles(text_b, k)
                shared = len(np.intersect1d(left, right, assume_unique=True))
                far = len(left) + len(right) - 2 * shared
                linked = 100 * shared >= percent * (far + shared)
                least = (far + c * (len(left) - len(right))) / 2 if linked else far - c * len(right) * (1 + 100 / percent)
                first = far - max(1, math.ceil(least - 1e-9)) + 1
                sizes.append((len(left), len(right), shared, first))
                if differ:
                    own.append(np.setdiff1d(right, left, assume_unique=True).view(np.int64))
                    reached = first > len(own[-1])
                    other.append(np.setdiff1d(left, right, assume_unique=True).view(np.int64) if reached else np.zeros(0, np.int64))
            columns = [batch.column(0), batch.column(1), *map(pa.array, np.array(sizes, np.int64).reshape(-1, 4).T.copy())]
            names = ["a", "b", "n_a", "n_b", "shared", "first"]
            if differ:
                columns += [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, part)]).astype(np.int32)),
                                                     pa.array(np.concatenate([np.zeros(0, np.int64), *part]))) for part in (own, other)]
                names += ["own", "other"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = ", own array<long>, other array<long>" if differ else ""
    done = both.mapInArrow(giving_back(run), "a long, b long, n_a long, n_b long, shared long, first long" + more)
    return done.withColumn("linked", 100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared")))


def _within_families(star: DataFrame, parts: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): pairs of different components that may link, among the sets that share a list of three or more with one leader.

    J(x, y) >= percent / 100 where |x xor y| <= c * (|x| + |y|), and x xor y is what only one of their differences from the leader has. So
    they share at least (|dx| + |dy| - c * (|x| + |y|)) / 2 differences. If x links to the leader, y does not: then |dy| > c * (|leader| + |y|). If x
    does not, |dy| >= |dx| - c * (|x| + |y|). Either way at least one difference is shared, and it is among the `first` of both.
    """
    c = (100 - percent) / (100 + percent)
    wide = (star.where("wide").join(parts.select(F.col("v").alias("b"), F.col("component").alias("part")), "b", "left")
            .select("a", "b", F.coalesce("part", "b").alias("part")))
    wide = written(wide, "wide")
    open_ = wide.groupBy("a").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("a")
    pairs = written(wide.join(open_, "a", "left_semi"), "open")
    near = written(_verified(pairs.select("a", "b"), bodies, k, percent, differ=True), "differences")
    d = F.col("n_a") + F.col("n_b") - 2 * F.col("shared")
    members = near.join(pairs, ["a", "b"]).select("a", F.col("b").alias("x"), F.col("n_b").alias("n"), "part", d.alias("d"), "first",
                                                  (F.col("n_b") - F.col("shared")).alias("owned"), (F.col("n_a") - F.col("shared")).alias("missed"))
    each = near.select("a", F.col("b").alias("x"), F.explode("own").alias("e"), F.lit(0).alias("side")).unionByName(
        near.select("a", F.col("b").alias("x"), F.explode("other").alias("e"), F.lit(1).alias("side")))
    often = each.groupBy("a", "e").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    met = each.join(often, ["a", "e"]).groupBy("a", "x", "side").agg(F.array_sort(F.collect_list(F.struct("times", "e"))).alias("es"))
    # own differences come first, on each side those that no other member has; they only take places
    before = F.when(F.col("side") == 0, F.col("owned")).otherwise(F.col("owned") + F.col("missed")) - F.size("es")
    entries = (members.join(met, ["a", "x"]).select("a", "x", "n", "part", "d", "first", before.alias("before"), F.posexplode("es").alias("i", "t"))
               .select("a", "x", "n", "part", "d", F.col("t.e").alias("e"), (F.col("before") + F.col("i")).alias("i"), "first").where("i < first"))
    entries = written(entries.drop("first"), "entries")
    x, y = entries.alias("x"), entries.alias("y")
    left = F.least(F.col("x.d") - F.col("x.i"), F.col("y.d") - F.col("y.i"))
    enough = 2 * left >= F.col("x.d") + F.col("y.d") - c * (F.col("x.n") + F.col("y.n")) - 1e-9
    found = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.x") < F.col("y.x"))
                   & (F.col("x.part") != F.col("y.part")) & _sizes_fit("x.n", "y.n", percent) & enough)
    return found.select(F.col("x.x").alias("a"), F.col("y.x").alias("b")).distinct()


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(sets, links): one row per document (row, id, text_hash, n, v, component) with v the vertex of its set (NULL
    for an empty one) and component the smallest vertex reached; and the links found between vertices, a spanning
    choice of them within each component."""
    with small_batches(docs.sparkSession):
        return _join(docs, key, text, k, percent)


def _join(docs: DataFrame, key: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    sets = written(_sets(docs, key, text, k, percent), "sets")
    vertices = written(sets.where("n > 0").groupBy("digest").agg(F.min("row").alias("v"), F.count(F.lit(1)).alias("copies")), "vertices")
    rows = first_rows(sets.where("n > 0").select("row", "digest", "keys"), vertices)
    entries = rows.select(F.explode("keys").alias("key"), F.col("row").alias("v"))
    lists = written(_often_shared(shared_entries(entries), percent), "lists")
    leaders = written(lists.groupBy("key").agg(F.min("v").alias("a"), F.max("v").alias("last"), F.count(F.lit(1)).alias("sets")).where("a <> last")
                      .select("key", "a", "sets"), "leaders")
    first = lists.join(leaders, "key").where(F.col("v") != F.col("a")).groupBy("a", F.col("v").alias("b")).agg(F.max(F.col("sets") > 2).alias("wide"))
    first = written(first, "pairs")
    bodies = bodies_of(docs, sets, lists.select(F.col("v").alias("row")).distinct(), key, text)
    star = written(_verified(first.select("a", "b"), bodies, k, percent), "star")
    links = star.where("linked").select("a", "b")
    parts = components(links)
    rest = written(_within_families(star.join(first, ["a", "b"]), parts, bodies, k, percent), "pairs")
    if not rest.isEmpty():
        more = written(_verified(rest, bodies, k, percent), "rest").where("linked").select("a", "b")
        links = links.unionByName(more)
        parts = components(links)
    done = (sets.drop("keys").join(vertices.drop("copies"), "digest", "left").withColumn("v", F.when(F.col("n") > 0, F.col("v")))
            .join(parts, "v", "left").withColumn("component", F.coalesce("component", "v")))
    return done.select("row", "id", "text_hash", "n", "v", "component"), links


def first_rows(rows: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row for each digest: only rows that have copies meet the table of vertices."""
    many = written(vertices.where("copies > 1").select("digest", F.col("v").alias("_first")), "copies")
    return rows.join(small_side(many, BROADCAST_ROWS // 4), "digest", "left").where("_first IS NULL OR _first = row").drop("_first")


def bodies_of(docs: DataFrame, sets: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(v, text) of the rows named in `rows` as a written table. A row is found again by its id and text."""
    needed = written(sets.select("row", "id", "text_hash").join(rows, "row", "left_semi")
                     .groupBy("id", "text_hash").agg(F.min("row").alias("v")), "needed")
    here = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("text_hash", text_hash(F.col("text")))
    side = small_side(needed.withColumnsRenamed({"id": "id2", "text_hash": "hash2"}), BROADCAST_ROWS)
    found = here.join(side, F.col("text_hash").eqNullSafe(F.col("hash2")) & F.col("id").eqNullSafe(F.col("id2")))
    return written(found.select("v", "text").dropDuplicates(["v"]), "bodies")


def clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """Per document row: key, n_shingles, component_id (the smallest key its links reach, its own included)."""
    done, _ = join(docs, key, text, k, percent)
    done = written(done, "clusters")
    least = done.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    least = written(least.where("rows > 1").drop("rows"), "least")
    own = done.join(small_side(least, BROADCAST_ROWS), "component", "left")
    return own.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """The documents with one row left of each component: that of the smallest key. Empty sets all stay."""
    done = written(join(docs, key, text, k, percent)[0], "clusters")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    kept = done.where("component IS NOT NULL").groupBy("component").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("rows")) \
        .where("rows > 1").select("first.row")
    many = done.join(done.where("component IS NOT NULL").groupBy("component").count().where("count > 1"), "component", "left_semi")
    gone = many.join(kept, "row", "left_anti").groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("gone"))
    stays = many.join(kept, "row", "left_semi").groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("stays"))
    same = gone.alias("g").join(stays.alias("s"), F.col("g.text_hash").eqNullSafe(F.col("s.text_hash"))
                                & F.col("g.id").eqNullSafe(F.col("s.id")), "left")
    gone = written(same.select("g.id", "g.text_hash", F.col("stays").isNotNull().alias("one_stays")), "gone")
    names = {c: fresh(docs, f"_{c}") for c in gone.columns}
    side, one_stays = small_side(gone.withColumnsRenamed(names), BROADCAST_ROWS), F.col(names["one_stays"])
    match = text_hash(F.col(text)).eqNullSafe(F.col(names["text_hash"])) & F.col(key).eqNullSafe(F.col(names["id"]))
    out = docs.join(side.where(~one_stays), match, "left_anti")
    if gone.where("one_stays").isEmpty():
        return out
    # repeated rows of one id and text, of which one stays
    twice = docs.join(side.where(one_stays), match, "left_semi").withColumn(names["text_hash"], text_hash(F.col(text)))
    return out.join(side.where(one_stays), match, "left_anti").unionByName(
        twice.dropDuplicates([key, names["text_hash"]]).drop(names["text_hash"]))
