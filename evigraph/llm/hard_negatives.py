"""Operator 13: hard negatives by a kNN join over Voronoi cells.

Vectors are scaled to whole numbers, and a row's score for an anchor is their inner product. An
anchor's positives are its best other rows of the same label; for each positive the best rows
of other labels are mined whose score lies between two shares of the positive's.

With a further component sqrt(M^2 - |x|^2), M the longest norm, rows lie on a sphere and the
best score is the nearest row to (anchor, 0), so the triangle inequality holds. Pivots are the
centres of a bounded sample there, brought into the anchors' plane. Anchors are assigned to their nearest pivot's cell, and cells, in
order of likeness, form groups of about GROUP anchors; a cell of more is several groups. From
a row's distance to a pivot and the cell's radius follow the least and the highest score that
the row can have for any anchor of the cell. A row is sent to a group only if for some cell of
it these meet what the cell's anchors still need: for positives, at least the k-th best score
that each anchor has in the sample of its own label; for negatives, the band of its positives,
from the k-th best that the sample holds in that band. So bounds never lose a row, and in data
without structure, in which every row may serve every anchor, rows go to every group.

A group's rows are dealt in blocks to tasks, each with the group's anchors, by a hash of the
row, so that a hot cell or label isn't one task; a task reads its block in batches and keeps
the best of each anchor, and lists of blocks are merged by anchor. Scores are exact.

Defined results: rows with a null label or vector, a null or non-finite component, or one beyond
2^26 after scaling take no part; shorter vectors are as if zeros followed; an empty vector's
scores are 0; repeated rows are rows of their own, but rows with an anchor's own id never serve
it; a null id is no anchor and comes last among ties; anchors with fewer positives or negatives
have fewer rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import materialize, small_batches

POSITIVES, NEGATIVES, EVERY = 5, 3, 50
#: Shares, in hundredths, of a positive's score between which a negative's lies.
LOW, HIGH = 50, 95
#: Rows of the sample that pivots and first bounds are taken from, by the smallest hash; pivots at most.
SAMPLE, PIVOTS = 2048, 128
#: Anchors of a group, about; rows of a block at least, and blocks of a group at most; rows compared at a time.
GROUP, BLOCK, BLOCKS, BATCH = 1024, 2048, 256, 1024
#: Labels share so many bounds.
LABELS = 64
#: Components beyond this, after scaling, take no part: products of 2048 of them still fit 64 bits.
LARGEST = 1 << 26
#: What a null id counts as in tasks: it comes last among ties.
_NO_ID = (1 << 63) - 1
_NEVER = float("inf")


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), dims) if dims else np.zeros((len(column), 0))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def prepared(rows: DataFrame, scale: int, relabel: Column | None = None) -> DataFrame:
    """vec_id, label and q (array of doubles that are whole numbers) of the rows that take part."""
    small_batches(rows.sparkSession)
    label = F.col("label").cast("long") if relabel is None else relabel
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    plain = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * scale <= LARGEST), F.lit(False)))
    kept = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & plain)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), q.alias("q"))


@dataclass(frozen=True)
class Cells:
    """Pivots, in the anchors' plane of the space with one more component, and the longest squared norm, M^2."""

    pivots: np.ndarray
    longest: float

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        """Distances to every pivot; both have a zero as the last component."""
        square = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def scores(self, x: np.ndarray, reach: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the highest score that a row can have for anchors whose distance to a pivot is `reach` at most and
        whose squared norms lie between norms: by the triangle inequality, and by that of Cauchy and Schwarz."""
        dot, length = x @ self.pivots.T, np.sqrt((x * x).sum(1))[:, None]
        away = np.sqrt(np.maximum((self.pivots * self.pivots).sum(1)[None] + self.longest - 2 * dot, 0))
        least = np.maximum((norms[0] + self.longest - (away + reach) ** 2) / 2, dot - reach * length)
        most = np.minimum((norms[1] + self.longest - np.maximum(away - reach, 0) ** 2) / 2, dot + reach * length)
        slack = 1e-6 * (1 + self.longest)  # of rounding; bounds may be looser, never tighter
        return least - slack, most + slack


def choose_pivots(sample: np.ndarray, longest: float, k: int, rounds: int = 8) -> Cells:
    """Centres of the sample by Lloyd's method, from rows far from each other, with the component that evens the norms
    out; in an order in which neighbours are alike."""
    y = np.hstack([sample, np.sqrt(np.maximum(longest - (sample * sample).sum(1), 0))[:, None]])
    chosen, away = [0], ((y - y[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(y)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((y - y[chosen[-1]]) ** 2).sum(1))
    pivots = y[chosen].copy()
    for _ in range(rounds):
        near = ((y * y).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * y @ pivots.T).argmin(1)
        for c in np.unique(near):
            pivots[c] = y[near == c].mean(0)
    order, left = [0], set(range(1, len(pivots)))
    while left:
        order.append(min(left, key=lambda c: (((pivots[c] - pivots[order[-1]]) ** 2).sum(), c)))
        left.remove(order[-1])
    return Cells(pivots[order][:, :-1].copy(), longest)


def _exact(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers; doubles hold them unless they may pass 2^53."""
    return a @ b.T if exact else a.astype(np.int64) @ b.astype(np.int64).T


def _best(row: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each row: higher scores, then smaller ids."""
    order = np.lexsort((vec_id, -score, row))
    r = row[order]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    return order[rank < k]


def _band(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the highest score between low and high hundredths of the positive's, as whole numbers."""
    p = positive.astype(np.int64)
    return -(-low * p // 100), high * p // 100


class _Top:
    """The k best of each slot so far; slots are an anchor's, or its positives'."""

    def __init__(self, slots: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.astype(np.float64)
        self.slot, self.score, self.vec_id = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.slots = slots

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        slot, score, vec_id = np.r_[self.slot, slot], np.r_[self.score, score.astype(np.int64)], np.r_[self.vec_id, vec_id]
        keep = _best(slot, score, vec_id, self.k)
        self.slot, self.score, self.vec_id = slot[keep], score[keep], vec_id[keep]
        full = np.bincount(self.slot, minlength=self.slots) == self.k
        worst = np.full(self.slots, np.inf)
        np.minimum.at(worst, self.slot, self.score)
        self.least = np.where(full, np.maximum(self.least, worst), self.least)


def _serve(table: DataFrame, cells: Cells, reach: np.ndarray, norms: np.ndarray, need: np.ndarray, blocks: int, groups: dict[int, list[int]], dims: int) -> DataFrame:
    """Candidates: grp, blk and the row, for each group that the row might serve. reach: radius of each cell; norms: least
    and highest squared norm of its anchors; need: by cell and label's bound, the least and highest score of interest."""
    group_of = [(c, np.array(g, np.int32)) for c, g in sorted(groups.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                x, label = _vectors(b.column("vec"), dims), b.column("label").to_numpy()
                least, most = cells.scores(x, reach, norms)
                wanted = need[:, label % LABELS]
                serves = (most >= wanted[:, :, 0].T) & (least <= wanted[:, :, 1].T)
                pairs: list[np.ndarray] = []
                for c, g in group_of:
                    rows = np.flatnonzero(serves[:, c])
                    pairs.append(np.stack([np.repeat(rows, len(g)), np.tile(g, len(rows))], 1))
                sent = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), int)
                if len(sent):
                    row = pa.array(sent[:, 0])
                    yield pa.RecordBatch.from_arrays([pa.array(sent[:, 1].astype(np.int32)), b.column("blk").take(row), *(b.column(c).take(row) for c in ("vec_id", "label", "vec"))], names=["grp", "blk", "vec_id", "label", "vec"])

    rows = table.select("vec_id", "label", "vec", F.pmod(F.xxhash64("vec_id", "vec", F.lit(7)), F.lit(blocks)).cast("int").alias("blk"))
    return rows.mapInArrow(run, "grp int, blk int, vec_id long, label long, vec binary")


def _join(anchors: DataFrame, rows: DataFrame, blocks: int, dims: int, exact: bool, k: int, low: int, high: int, negatives: bool) -> DataFrame:
    """aid, slot, score, vec_id: the k best of each anchor (slot 0), or of each of its positives, in each block."""
    every = anchors.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    none = {"aid": "long", "bounds": "array<double>", "positives": "array<long>"}
    both = every.select("grp", "blk", F.lit(0).alias("kind"), "vec_id", "label", "vec", *none)
    both = both.union(rows.select("grp", "blk", F.lit(1), "vec_id", "label", "vec", *[F.lit(None).cast(t) for t in none.values()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, top = None, [], None

        def ready() -> None:
            """The group's anchors are all read: lay out their slots."""
            nonlocal top, x, own, label, first, counts, lo, hi
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x, own, label = _vectors(b.column("vec"), dims), _ids(b.column("vec_id")), b.column("label").to_numpy()
            if negatives:
                lists = b.column("positives").to_pylist()
                counts = np.array([len(p) for p in lists])
                lo, hi = _band(np.array([s for p in lists for s in p], np.int64), low, high)
            else:
                counts = np.ones(len(x), int)
                lo = hi = np.zeros(len(x))
            first = np.r_[0, np.cumsum(counts)]
            top = _Top(int(first[-1]), k, np.array([s for p in b.column("bounds").to_pylist() for s in p], np.float64))

        def compare(b: pa.RecordBatch) -> None:
            y, ids, labels = _vectors(b.column("vec"), dims), _ids(b.column("vec_id")), b.column("label").to_numpy()
            score = _exact(x, y, exact)
            other = own[:, None] != ids[None]
            fits = other & ((label[:, None] != labels[None]) if negatives else (label[:, None] == labels[None]))
            found = []
            for n in range(int(counts.max(initial=0))):
                a = np.flatnonzero(counts > n)
                slot = first[a] + n
                s = score[a]
                hit = fits[a] & (s >= top.least[slot][:, None])
                if negatives:
                    hit &= (s >= lo[slot][:, None]) & (s <= hi[slot][:, None])
                p, q = np.nonzero(hit)
                found.append((slot[p], s[p, q], ids[q]))
            if found:
                top.add(*(np.concatenate(c) for c in zip(*found, strict=True)))

        def close() -> Iterator[pa.RecordBatch]:
            if top is not None and len(top.slot):
                a = np.searchsorted(first, top.slot, side="right") - 1
                aid = pa.Table.from_batches(held).column("aid").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(aid[a]), pa.array((top.slot - first[a]).astype(np.int32)), pa.array(top.score), pa.array(top.vec_id)], names=["aid", "slot", "score", "vec_id"])

        x = own = label = first = counts = lo = hi = None
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                place = np.stack([b.column(c).to_numpy() for c in ("grp", "blk", "kind")], 1)
                cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
                for start, stop in zip(np.r_[0, cuts], np.r_[cuts, len(place)], strict=True):
                    part = b.slice(start, stop - start)
                    grp, blk, kind = place[start]
                    if (grp, blk) != cell:
                        yield from close()
                        cell, held, top = (grp, blk), [], None
                    if kind == 0:
                        held.append(part.select(["vec_id", "label", "vec", "aid", "bounds", "positives"]))
                    elif held:
                        if top is None:
                            ready()
                        compare(part)
        yield from close()

    cells = both.repartition("grp", "blk").sortWithinPartitions("grp", "blk", "kind")
    return cells.mapInArrow(run, "aid long, slot int, score long, vec_id long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """aid, slot and the k best of all blocks, best first; an anchor has as many lists as blocks at most."""
    entry = F.struct((-F.col("score")).alias("minus"), "vec_id")
    return found.groupBy("aid", "slot").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))


def _seeds(x: np.ndarray, own: np.ndarray, label: np.ndarray, sample: tuple[np.ndarray, np.ndarray, np.ndarray], exact: bool, k: int, positives: list[list[int]] | None, low: int, high: int) -> list[list[float]]:
    """For each anchor the k-th best score in the sample, or of each of its positives the k-th best in the band; -inf where there are fewer."""
    y, ids, labels = sample
    score = _exact(x, y, exact).astype(np.float64)
    out = []
    for a in range(len(x)):
        other = own[a] != ids
        if positives is None:
            s = score[a][other & (labels == label[a])]
            out.append([float(np.partition(s, -k)[-k]) if len(s) >= k else -_NEVER])
            continue
        s, bounds = score[a][other & (labels != label[a])], []
        for lo, hi in zip(*_band(np.array(positives[a], np.int64), low, high), strict=True):
            inside = s[(s >= lo) & (s <= hi)]
            bounds.append(float(np.partition(inside, -k)[-k]) if len(inside) >= k else float(lo))
        out.append(bounds)
    return out


def _anchored(table: DataFrame, cells: Cells, sample, dims: int, exact: bool, k: int, low: int, high: int) -> DataFrame:
    """Anchors with their cell, distance to its pivot, squared norm and bounds; with positives' scores if the table has them."""
    extra = "positives" in table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                x = _vectors(b.column("vec"), dims)
                d = cells.of_anchors(x)
                cell = d.argmin(1)
                positives = b.column("positives").to_pylist() if extra else None
                bounds = _seeds(x, _ids(b.column("vec_id")), b.column("label").to_numpy(), sample, exact, k, positives, low, high)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("aid", "vec_id", "label", "vec")), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell]), pa.array((x * x).sum(1)), pa.array(bounds, pa.list_(pa.float64())), pa.array(positives if extra else [[]] * len(x), pa.list_(pa.int64()))], names=["aid", "vec_id", "label", "vec", "cell", "away", "norm", "bounds", "positives"])

    return table.select("aid", "vec_id", "label", "vec", *["positives"] * extra).mapInArrow(run, "aid long, vec_id long, label long, vec binary, cell int, away double, norm double, bounds array<double>, positives array<long>")


def _round(anchors: DataFrame, table: DataFrame, n: int, cells: Cells, dims: int, exact: bool, k: int, low: int, high: int, negatives: bool, group: int, block: int) -> DataFrame:
    """One join: bounds of each cell, groups of cells, candidates by group, the best of each anchor."""
    n_cells = len(cells.pivots)
    highest = (F.array_max("positives") * high / 100).cast("double") if negatives else F.lit(_NEVER)
    stats = anchors.groupBy("cell", F.pmod("label", F.lit(LABELS)).cast("int").alias("part")).agg(F.count("*").alias("n"), F.max("away").alias("away"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.min(F.array_min("bounds")).alias("from"), F.max(highest).alias("to")).collect()  # cells times LABELS rows at most
    reach, norms = np.zeros(n_cells), np.stack([np.full(n_cells, np.inf), np.zeros(n_cells)])
    need = np.empty((n_cells, LABELS, 2))
    need[:, :, 0], need[:, :, 1] = np.inf, -np.inf
    held = np.zeros(n_cells, int)
    for r in stats:
        c, part = r["cell"], slice(None) if negatives else r["part"]  # a negative's label is any but the anchor's
        held[c] += r["n"]
        reach[c], norms[0, c], norms[1, c] = max(reach[c], r["away"]), min(norms[0, c], r["low"]), max(norms[1, c], r["high"])
        need[c, part, 0] = np.minimum(need[c, part, 0], r["from"])
        need[c, part, 1] = np.maximum(need[c, part, 1], r["to"])
    norms[0][held == 0] = 0
    groups: dict[int, list[int]] = {}
    at, size = 0, 0
    for c in np.flatnonzero(held):
        if size and size + held[c] > group:
            at, size = at + 1, 0
        pieces = -(-int(held[c]) // group)
        groups[int(c)] = list(range(at, at + pieces))
        at, size = (at + pieces, 0) if pieces > 1 else (at, size + int(held[c]))
    first = F.array(*[F.lit(groups.get(c, [0])[0]) for c in range(n_cells)])
    pieces = F.array(*[F.lit(len(groups.get(c, [0]))) for c in range(n_cells)])
    grp = F.get(first, F.col("cell")) + F.pmod(F.xxhash64("aid"), F.get(pieces, F.col("cell")).cast("long")).cast("int")
    blocks = min(BLOCKS, max(1, -(-n // block)))
    rows = _serve(table, cells, reach, norms, need, blocks, groups, dims)
    return _merged(_join(anchors.withColumn("grp", grp), rows, blocks, dims, exact, k, low, high, negatives), k)


def mine(spark: SparkSession, rows: DataFrame, *, scale: int = 256, relabel: Column | None = None, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, pivots: int = PIVOTS, sample: int = SAMPLE, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: vec_id, embedding, label; relabel
    gives another label (long) of a row; anchors are the rows whose id is divisible by `every`."""
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    ready = prepared(rows, scale, relabel)
    ready = ready.filter("label is not null")
    size = ready.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dims"), F.max(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)).alias("longest")).first()
    n, dims, longest = size["n"], size["dims"] or 0, float(size["longest"] or 0)
    if not n:
        return spark.createDataFrame([], schema)
    exact = longest < 2.0**53  # no inner product passes the longest squared norm

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = [np.asarray(q + [0.0] * (dims - len(q)), "<f8").tobytes() for q in b.column("q").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(vec, pa.binary())], names=["vec_id", "label", "vec"])

    table = materialize(ready.mapInArrow(packed, "vec_id long, label long, vec binary"), "vectors")
    few = table.orderBy(F.xxhash64("vec_id", "vec"), "vec_id", "label").limit(sample).collect()
    seen = np.frombuffer(b"".join(r["vec"] for r in few), "<f8").reshape(len(few), dims), np.array([_NO_ID if r["vec_id"] is None else r["vec_id"] for r in few], np.int64), np.array([r["label"] for r in few], np.int64)
    cells = choose_pivots(seen[0], longest, pivots)
    anchors = materialize(table.filter(F.col("vec_id") % every == 0).withColumn("aid", F.monotonically_increasing_id()), "anchors")
    first = materialize(_anchored(anchors, cells, seen, dims, exact, positives, low, high), "anchor-cells")
    found = materialize(_round(first, table, n, cells, dims, exact, positives, low, high, False, group, block), "positives")
    # only positives of a score above 0, or of 0 with a band of 0 alone, can have negatives
    scored = found.select("aid", F.filter("best", lambda p: p["minus"] <= 0).alias("best")).filter(F.size("best") > 0)
    lists = anchors.join(scored, "aid").withColumn("positives", F.transform("best", lambda p: -p["minus"]))
    second = materialize(_anchored(lists, cells, seen, dims, exact, negatives, low, high), "anchor-bands")
    mined = _round(second, table, n, cells, dims, exact, negatives, low, high, True, group, block)
    known = lists.select("aid", F.col("vec_id").alias("anchor_id"), F.col("best").alias("of"))
    out = mined.join(known, "aid").select("anchor_id", F.get("of", F.col("slot")).alias("p"), F.posexplode("best").alias("at", "q"))
    none = lambda c: F.when(c != _NO_ID, c)
    return out.select("anchor_id", none(F.col("p.vec_id")).alias("positive_id"), (F.col("at") + 1).alias("rank"), none(F.col("q.vec_id")).alias("negative_id"), (-F.col("p.minus")).alias("positive_score"), (-F.col("q.minus")).alias("negative_score"))
