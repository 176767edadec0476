"""Operator 9: a size-aware heavy-light join of documents by the Jaccard similarity of word 5-grams.

Two sets A, B link when 100 |A & B| >= 80 |A | B|, that is 9 |A & B| >= 4 (|A| + |B|),
so a link needs an overlap of at least ov(|A|, |B|) = ceil(4 (|A| + |B|) / 9).

Equal sets are one class, and only classes are joined. Small sets (up to a boundary)
enumerate subsets of fixed size: for sizes s <= t that can link, the subsets of size
ov(s, t), keyed with (s, t). Sharing a key with a set of size s *is* a link, so each
key's sets are tied to one of them and no pair is looked at.

Larger sets scan inverted lists, in an order of shingles by hash first: a set posts its
first n - ceil(0.8 n) + l shingles, and two sets that link share l of these. Shingles
posted once are dropped, and so are sets with too few left. This is done with l = n / 20
for all sets, then with l = 3 n / 10 for what remains; most documents resemble nothing
and go no further. The last sets are posted in order of exact frequency, in which a set's
unique shingles come first and use up its prefix. A posting list is not expanded into
pairs: first each list is tied to its member with the fewest unique shingles, these pairs
are verified, and components are formed. Then lists with several components are joined
with themselves across components: a set of size n with pos shingles before the list's
can, if this is the first that two sets share, link with sizes up to (5 n - 9 pos) / 4. So
only sets that may link with their own size or more are looked up (pos <= n / 9), by
shingle and size class, and a set looks up the sizes from 0.8 n to what its pos allows.
Sets that have a passage in common and are too different for a link don't meet.
Both steps are verified by exact intersection, so no link between components is lost
and none is made up.

The boundary is where the cost of subsets, by the histogram of set sizes, passes
that of posting and reading the set.

Sets are of 64-bit hashes of shingles; classes by a 128-bit digest of the set. What is
broadcast is summed up first; above common.BROADCAST bytes rows are joined by shuffle, and
texts meet a bitmap of fixed size before that. Ties in every choice go by row number.

Defined results: null or empty texts, or of white space only, have size 0, link with
nothing and are their own component; with fewer than five words the whole sequence is
the one shingle; a very long text is one set, whole; a null id is a row of its own, and
never the name of a component that has another id; repeated rows are repeated; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import bounded, few, files_for, forget, fresh, from_files, locator, materialize, sliced, whole_text
from evigraph.llm.components import connected_components

WORDS = 5
#: Small sets are kept whole up to this size; the boundary is chosen at or under it.
MOST_SMALL = 12


def overlap(s: int, t: int) -> int:
    return -(-4 * (s + t) // 9)


def partners(s: int) -> list[tuple[int, int]]:
    """(s, t) or (t, s), smaller first, of the sizes that a set of size s can link with."""
    return [(min(s, t), max(s, t)) for t in range(1, 2 * s + 1) if 5 * min(s, t) >= 4 * max(s, t)]


def n_subsets(s: int) -> int:
    return sum(comb(s, overlap(a, b)) for a, b in partners(s))


def prefix_length(n: int, share: float) -> int:
    """Postings of a set of size n in the order of hashes: two sets that link share ceil(share * n)
    of these, n the smaller size."""
    return min(n, n - -(-4 * n // 5) + ceil(share * n))


def choose_boundary(sizes: dict[int, int]) -> int:
    """The largest size up to which enumerating subsets costs no more than posting and reading the sets."""
    best, best_cost, cost = 0, 0.0, 0.0
    for s in range(1, MOST_SMALL + 1):
        cost += sizes.get(s, 0) * (n_subsets(s) - (prefix_length(s, FIRST) + s))
        if cost <= best_cost:
            best, best_cost = s, cost
    return best


#: Rows of documents for each file of a table of shingles.
EACH = 2000
#: The shares of a set's size that the two rounds of the filter ask for.
FIRST, SECOND = 0.05, 0.3
#: Postings that a task compares among its own at once; 16 bytes each.
AT_ONCE = 250_000

C5 = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of the text's word 5-grams. bytes.lower and bytes.split are
    the contract's rules: A-Z only, and space and the controls tab to carriage return."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        acc = acc * C5 + h[k : len(h) - width + 1 + k]
    acc ^= acc >> np.uint64(31)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def _members(docs: DataFrame) -> DataFrame:
    """rid, loc, doc_id, n, cls, small (a small set whole) and prefix (the postings in the order of
    hashes), the last two only for the first row of a class in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        rid, seen = TaskContext.get().partitionId() << 40, set()
        for b in sliced(batches):
            out = []
            for text in b.column("text").to_pylist():
                s = shingles(text)
                cls = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                new = cls is not None and cls not in seen
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(cls)
                out.append((rid, len(s), cls, s.view(np.int64) if new and len(s) <= MOST_SMALL else None, s[: prefix_length(len(s), FIRST)].view(np.int64) if new else None))
                rid += 1
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            made = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([made[0], b.column("loc"), b.column("doc_id"), *made[1:]], names=["rid", "loc", "doc_id", "n", "cls", "small", "prefix"])

    rows = docs.select(locator(docs).alias("loc"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "rid long, loc string, doc_id long, n long, cls binary, small array<long>, prefix array<long>")


def _small_links(small: DataFrame) -> DataFrame:
    """a, b: links by shared subsets. small: rid, n, small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rids, first = [], [], []
            for rid, n, s in zip(b.column("rid").to_pylist(), b.column("n").to_pylist(), b.column("small").to_pylist(), strict=True):
                for low, high in partners(n):
                    for c in combinations(s, overlap(low, high)):
                        keys.append(hashlib.blake2b(np.array([low, high, *c], np.int64).tobytes(), digest_size=16).digest())
                        rids.append(rid)
                        first.append(n == low)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(rids, pa.int64()), pa.array(first, pa.bool_())], names=["key", "rid", "first"])

    keyed = materialize(small.mapInArrow(run, "key binary, rid long, first boolean"), "subsets")
    hubs = keyed.filter("first").groupBy("key").agg(F.min("rid").alias("hub"))
    return keyed.join(hubs, "key").filter("rid <> hub").select(F.col("rid").alias("a"), F.col("hub").alias("b")).distinct()


def _sharing(postings: DataFrame, share: float) -> DataFrame:
    """rid of the sets that may link with one of at least four fifths of their size: of their first
    shingles, enough are posted by another set. postings: rid, n, prefix.

    A task first compares the postings it has. What two of its sets share is known there, and of each
    shingle it sends one row on, so a shingle that a third of all documents have is sent once by each
    task. Rows of one shingle then meet in order, and the sets that posted it alone in their task hear of it."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, owner = np.concatenate(tokens), np.concatenate(owners)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            alone = np.diff(np.append(first, len(token))) == 1
            shared = np.ones(len(token), bool)
            shared[first[alone]] = False
            rid, k = np.unique(owner[shared], return_counts=True)
            none = np.zeros(len(first) + len(rid), bool)
            token = pa.array(np.concatenate([token[first], rid]), mask=np.concatenate([none[: len(first)], np.ones(len(rid), bool)]))
            owner = pa.array(np.concatenate([owner[first], rid]), mask=np.concatenate([~alone, none[: len(rid)]]))
            tokens.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays([token, owner, pa.array(np.concatenate([np.ones(len(first), np.int32), k.astype(np.int32)]))], names=["token", "rid", "k"])

        for b in sliced(batches, 2048):
            prefix = b.column("prefix")
            flat = prefix.flatten().to_numpy(zero_copy_only=False)
            if len(flat):
                tokens.append(flat)
                owners.append(np.repeat(b.column("rid").to_numpy(), prefix.value_lengths().to_numpy(zero_copy_only=False)))
                size += len(flat)
            if size >= AT_ONCE:
                yield flush()
                size = 0
        if size:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of token, nulls first. Of rows with one token each known rid is told that it has company;
        the last row waits for the next batch, and nothing else, however many rows a token has."""
        last, waiting = None, None  # the last row's token, and its rid unless that is told or unknown

        for b in batches:
            has = b.column("token").is_valid().to_numpy(zero_copy_only=False)
            counted = b.filter(pa.array(~has))
            if counted.num_rows:
                yield pa.RecordBatch.from_arrays([counted.column("rid"), counted.column("k")], names=["rid", "k"])
            b = b.filter(pa.array(has))
            if not b.num_rows:
                continue
            token, known = b.column("token").to_numpy(), b.column("rid").is_valid().to_numpy(zero_copy_only=False)
            rid = b.column("rid").fill_null(-1).to_numpy()
            same = token[1:] == token[:-1]
            again = last is not None and token[0] == last
            before, behind = np.concatenate([[again], same]), np.concatenate([same, [False]])
            met = rid[known & (before | behind)]
            if again and waiting is not None:
                met = np.append(met, waiting)
            last, waiting = token[-1], int(rid[-1]) if known[-1] and not before[-1] else None
            if len(met):
                yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(np.ones(len(met), np.int32))], names=["rid", "k"])

    sent = postings.select("rid", "prefix").mapInArrow(local, "token long, rid long, k int")
    dealt = sent.repartition(F.coalesce("token", "rid")).sortWithinPartitions("token")
    counts = dealt.mapInArrow(meet, "rid long, k int").groupBy("rid").agg(F.sum("k").alias("k"))
    return counts.join(postings.select("rid", "n"), "rid").filter(F.col("k") >= F.ceil(F.lit(0.8 * share) * F.col("n") - 1e-6)).select("rid")


def _shingled(docs: DataFrame, wanted: DataFrame, share: float | None) -> DataFrame:
    """rid, n, set of the rows in `wanted` (rid, loc); given a share, only the set's prefix, as `prefix`."""
    name = "set" if share is None else "prefix"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [shingles(t).view(np.int64) for t in b.column("text").to_pylist()]
            sizes = [len(s) for s in sets]
            if share is not None:
                sets = [s[: prefix_length(len(s), share)] for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(sizes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["rid", "n", name])

    return _fetched(docs, wanted).mapInArrow(run, f"rid long, n long, {name} array<long>")


#: Bits, in buckets of 32768, of the bitmap that texts meet before a shuffle: 64 MB at most, whatever the input.
BITS = 1 << 29


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid and text of the rows in `wanted` (rid, loc): by a broadcast of two hashes of the locators if they are few,
    else by a shuffle of what a bitmap of hashed locators lets through."""
    rows = docs.select(locator(docs).alias("loc"), whole_text().alias("text"))
    keys = [F.xxhash64("loc").alias("h"), F.xxhash64(F.lit(1), "loc").alias("g")]
    small = wanted.select("rid", *keys)
    if few(small):
        return rows.select("text", *keys).join(F.broadcast(small), ["h", "g"]).select("rid", "text")
    at = F.pmod(F.xxhash64("loc"), F.lit(BITS)) + 1
    bits = wanted.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = materialize(bits, "wanted-bits")
    place = F.bitmap_bit_position(at)
    byte = F.ascii(F.decode(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    found = rows.withColumn("bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "bucket")
    found = found.select("loc", "text", byte.alias("byte"), (place % 8).cast("int").alias("place")).filter(F.expr("shiftright(byte, place) & 1 = 1"))
    return found.select("loc", "text").join(wanted, "loc").select("rid", "text")


def _links(n: Column, m: Column, shared: Column) -> Column:
    return 9 * shared >= 4 * (n + m)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b that link, by the intersection of their sets."""
    a = sets.select(F.col("rid").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("rid").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(a, "a").join(b, "b")
    return both.filter(_links(F.size("set_a"), F.size("set_b"), F.size(F.array_intersect("set_a", "set_b")))).select("a", "b")


def _may_link(p: str, q: str) -> Column:
    """Size, overlap and position bounds for postings p and q of one shingle, taken as their first common one."""
    c = lambda x, f: F.col(f"{x}.{f}")
    need = F.ceil(4 * (c(p, "n") + c(q, "n")) / 9)
    return (
        (5 * F.least(c(p, "n"), c(q, "n")) >= 4 * F.greatest(c(p, "n"), c(q, "n")))
        & (F.least(c(p, "n") - c(p, "pos"), c(q, "n") - c(q, "pos")) >= need)
        & (F.least(c(p, "n") - c(p, "own"), c(q, "n") - c(q, "own")) >= need)
    )


def _components(docs: DataFrame, large: DataFrame, small_links: DataFrame, rows: int) -> DataFrame:
    """node, component by all links, those of small sets given. large: rid, loc, n, prefix. rows: the documents' number."""
    files, more = (files_for(docs.sparkSession, rows, each) for each in (EACH * 10, EACH))
    located = large.select("rid", "loc")
    some = materialize(_sharing(large, FIRST).join(located, "rid"), "candidates", files)
    fewer = materialize(_shingled(docs, some, SECOND), "candidate-prefixes")
    some = materialize(_sharing(fewer, SECOND).join(some, "rid"), "candidates", files)
    sets = materialize(_shingled(docs, some, None), "candidate-sets")

    tokens = sets.select("rid", F.col("n").cast("int").alias("n"), F.explode("set").alias("token"))
    df = materialize(tokens.groupBy("token").agg(F.count("*").cast("int").alias("df")).filter("df > 1"), "frequencies", more)
    ranked = tokens.join(df, "token").groupBy("rid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    ranked = ranked.withColumn("own", F.col("n") - F.size("shared"))
    posted = ranked.select("rid", "n", "own", F.posexplode("shared").alias("k", "s")).withColumn("pos", F.col("own") + F.col("k"))
    posted = posted.filter(5 * (F.col("n") - F.col("pos")) >= 4 * F.col("n")).select(F.col("s.token").alias("token"), "rid", "n", "own", "pos")
    posted = materialize(posted, "postings", more)

    hubs = posted.groupBy("token").agg(F.min(F.struct("own", "rid", "n", "pos")).alias("h"))
    # a table of its own, so that the join with a shingle that very many sets have can be split
    hubs = materialize(hubs.select("token", "h.own", "h.rid", "h.n", "h.pos"), "hubs", more)
    near = posted.alias("p").join(hubs.alias("q"), F.col("p.token") == F.col("q.token")).filter((F.col("p.rid") != F.col("q.rid")) & _may_link("p", "q"))
    near = near.select(F.greatest("p.rid", "q.rid").alias("a"), F.least("p.rid", "q.rid").alias("b")).distinct()
    first = materialize(_verified(near, sets).union(small_links).repartition(files), "hub-links")

    comps = connected_components(first, files)
    placed = posted.join(comps.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("component", "rid")).drop("component")
    placed = materialize(placed, "placed-postings", more)
    mixed = materialize(placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token"), "mixed-tokens", more)
    placed = materialize(placed.join(mixed, "token").select("token", "rid", "n", "pos", "comp"), "mixed-lists")
    late = materialize(_verified(_met(placed), sets), "late-links")
    if late.isEmpty():
        return comps
    return connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late), files)


#: Sizes of one class are within so much of each other.
SIZE_CLASS = 1.02


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_CLASS)))


def _met(placed: DataFrame) -> DataFrame:
    """a, b: pairs of different components that may link, by their first common shingle. placed: token, rid, n, pos, comp."""
    most = F.floor((5 * F.col("n") - 9 * F.col("pos")) / F.lit(4))  # the largest size it can link with from here on
    looked_up = placed.filter(9 * F.col("pos") <= F.col("n")).select("token", _size_class(F.col("n")).alias("size"), F.col("rid").alias("q"), F.col("n").alias("m"), F.col("comp").alias("q_comp"), most.alias("q_most"))
    least, most = F.ceil(4 * F.col("n") / F.lit(5)), F.least(F.col("n"), most)
    looking = placed.withColumns({"least": least, "most": most}).filter("least <= most")
    looking = looking.withColumn("size", F.explode(F.sequence(_size_class(F.col("least")), _size_class(F.col("most")))))
    met = looking.join(looked_up, ["token", "size"]).filter((F.col("m").between(F.col("least"), F.col("most"))) & (F.col("n") <= F.col("q_most")) & (F.col("comp") != F.col("q_comp")) & ((F.col("m") < F.col("n")) | (F.col("q") < F.col("rid"))))
    return met.select(F.greatest("rid", "q").alias("a"), F.least("rid", "q").alias("b")).distinct()


def _grouped(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """loc, doc_id, n and component of every row; the component is null for a row that is alone in it. docs is as of from_files."""
    members = materialize(_members(docs), "members")
    rows = members.count()
    files = files_for(spark, rows)
    classes = materialize(members.filter("cls is not null").groupBy("cls").agg(F.min("rid").alias("rep"), F.count("*").alias("c")), "classes", files)
    firsts = members.filter("prefix is not null")
    spare = materialize(firsts.select("rid", "cls").join(classes, "cls").filter("rid <> rep").select("rid"), "spare")
    reps = firsts.join(bounded(spare), "rid", "left_anti")

    sizes = {r["n"]: r["c"] for r in reps.filter(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.count("*").alias("c")).collect()}
    x = choose_boundary(sizes)
    small = reps.filter(F.col("n") <= x).select("rid", "n", "small")
    large = reps.filter(5 * F.col("n") >= 4 * (x + 1)).select("rid", "loc", "n", "prefix")
    comps = _components(docs, large, materialize(_small_links(small), "small-links", files), rows)
    comps = comps.select(F.col("node").alias("rep"), F.col("component"))
    # sets are alone unless they have copies or links, so most rows need no more than this join
    classes = classes.join(comps, "rep", "left").filter("c > 1 or component is not null").select("cls", F.coalesce("component", "rep").alias("component"))
    classes = materialize(classes, "grouped-classes", files)
    return materialize(members.select("loc", "doc_id", "n", "cls").join(classes, "cls", "left").drop("cls"), "placed")


def near_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """loc, doc_id, n_shingles and component_id of every row."""
    placed = _grouped(spark, from_files(docs, "near-input"))
    together = placed.filter("component is not null")
    names = materialize(together.groupBy("component").agg(F.min("doc_id").alias("component_id")), "names")
    alone = placed.filter("component is null").select("loc", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return alone.union(together.join(names, "component").select("loc", "doc_id", "n", "component_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs of which each component keeps one, that of the smallest id (then locator); with docs' columns."""
    docs = from_files(docs, "near-input")
    loc = fresh("loc", docs.columns)
    together = _grouped(spark, docs).filter("component is not null")
    kept = materialize(together.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "loc")).alias("k")), "near-kept")
    gone = together.join(kept, "component").filter(F.col("loc") != F.col("k.loc")).select(F.col("loc").alias(loc))
    gone = materialize(gone.repartition(files_for(spark, docs.count())), "near-gone")
    return docs.select(*docs.columns, locator(docs).alias(loc)).join(gone, loc, "left_anti").select(*docs.columns)
