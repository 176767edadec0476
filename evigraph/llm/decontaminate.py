"""Operator 8: benchmark decontamination by template canonicalisation.

Every word becomes a template word: numbers, names and units become a typed
placeholder, anything else its lower-case self without the punctuation around it.
Number words are numbers, and one letter after a number may be a unit. A capitalised
word at a sentence's start may be a name or not: windows with such words are hashed
with all of them as words, with all as names, and with all but common ones as names.
Windows of WINDOW template words of the benchmark are hash-joined with those of
the documents, so a question with other numbers or names still matches. Then
slots are checked by occurrence: matched windows with one distance between their
places in the document and in the item belong together. Over these, each slot value
of the item has to stand for one value in the document and the other way round;
windows that break the majority's reading of a slot don't count. Windows within an
item's length that fit the reading are added, so words put in or left out don't end
an occurrence. The best occurrence counts, or all matched windows read as one if
that is better. A document is contaminated by an item if at least COVERAGE of the
item's windows remain, or if the remaining windows of one occurrence cover RUN words
of the item in a row, whatever its length, RUN_LITERALS of them not placeholders.

A benchmark whose windows take up to BROADCAST bytes (counted first) is broadcast, as
columns sorted by hash, and met in each task; beyond that, windows of documents are
shuffled to it by hash. A window with fewer than LITERALS words that aren't placeholders
counts for nothing, unless the item has no better ones. An item shorter than a window
contaminates only documents whose whole text it is, with the very same numbers, names
and units, as a few words alone say nothing.

Defined results: null or empty texts and items match nothing; a very long text is read
whole; null ids are kept as null; repeated rows match each on its own; repeated items
are items of their own; of slot values equally frequent the smallest is the reading's;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import fresh, from_files, locator, materialize, sliced, sole, whole_text

WINDOW, COVERAGE, LITERALS, BROADCAST, CACHE = 8, 0.5, 3, 64 << 20, 150_000
RUN, RUN_LITERALS = 13, 7

#: Units that become a placeholder.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hrs ms hz khz mhz ghz w kw mw v mv a ma j kj cal kcal b kb mb gb tb bit byte bytes px dpi rpm mph kmh usd eur gbp jpy dollar dollars euro euros cent cents percent pct degrees celsius fahrenheit hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres".split())
#: Number words, with the digits they stand for. "one" is often a pronoun, so it stands for any number.
NUMBERS = {w: str(n) for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_TENS = {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
NUMBERS |= {w: str(n) for w, n in _TENS.items()} | {f"{w}-{d}": str(n + int(NUMBERS[d])) for w, n in _TENS.items() for d in "one two three four five six seven eight nine".split()}
NUMBERS |= {"one": "one", "dozen": "12", "hundred": "100", "thousand": "1000", "million": "1000000", "billion": "1000000000"}
#: Words that mostly aren't names where they begin a sentence.
COMMON = frozenset("a an the this that these those he she it they we you his her its their our your my there here if when while after before since because as at by for from in of on to with without and but or so then what which who whom whose where why how is are was were do does did has have had can could should would each every all some any both no not find calculate compute given suppose let assume determine write show explain".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_JOINED = re.compile(r"([+-]?[$€£]?\d[\d.,:/]*)([a-z°%]+)", re.I)
_EDGE = "\"'`.,;:!?()[]{}<>|#*&%$@~^=\\/_-…«»“”‘’—–"
WORD, NUMBER, NAME, UNIT, NONE, LETTER = 0, 1, 2, 3, 4, 5
#: Stands for a line's end among the words.
LINE = "\x00"


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s)


_PLACE = {k: _hash(f"<{k}>") for k in (NUMBER, NAME, UNIT)}


class Words(dict):
    """Numbers distinct words as they come; arrays by number hold what canonicalising them needs."""

    def __init__(self):
        self.forget()

    def forget(self):
        self.clear()
        self.cores: list[str] = []
        self.literal = array("Q")
        self.kind = array("b")  # away from a sentence's start
        self.ends = array("b")
        self.common = array("b")

    def __missing__(self, w: str) -> int:
        core = w if w.isalpha() else "" if w == LINE else w.strip(_EDGE)
        lower = core.lower()
        kind = WORD
        if not core:
            kind = NONE
        elif core[0].isdigit():
            if _NUMBER.fullmatch(core) or _JOINED.fullmatch(core):
                kind = NUMBER
        elif lower in NUMBERS:
            kind = NUMBER
        elif lower in UNITS:
            kind = UNIT if len(core) > 1 else LETTER
        elif len(core) > 1:
            if lower != core and core[0].isupper() and core[1:].islower():
                kind = NAME
        k = self[w] = len(self.cores)
        self.cores.append(core)
        self.literal.append(_hash(lower))
        self.kind.append(kind)
        self.ends.append(w == LINE or (core is not w and w.rstrip("\"')»”’")[-1:] in (".", "!", "?", ":")))
        self.common.append(lower in COMMON)
        return k

    def template(self, text: str) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The number of each template word, and its hashes and kinds in each variant, the first with words
        at a sentence's start as words; words of punctuation alone are left out."""
        if len(self) > CACHE:
            self.forget()
        words = text.replace("\n", f" {LINE} ").split()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        literal, kind, ends = np.frombuffer(self.literal, np.uint64)[ids], np.frombuffer(self.kind, np.int8)[ids], np.frombuffer(self.ends, np.int8)[ids]
        starts = np.concatenate([[True], ends[:-1] != 0]) if len(ids) else ends != 0
        full = kind != NONE
        literal, kind, ids = literal[full], kind[full], ids[full]
        letters = kind == LETTER
        kind[letters] = WORD
        kind[1:][letters[1:] & (kind[:-1] == NUMBER)] = UNIT
        unclear = (kind == NAME) & starts[full]
        kind[unclear] = WORD
        for k, v in _PLACE.items():
            literal[kind == k] = np.uint64(v)
        out = [(literal, kind)]
        if unclear.any():
            common = np.frombuffer(self.common, np.int8)[ids] != 0
            some = unclear & ~common
            for names in (unclear, some) if some.any() and (some != unclear).any() else (unclear,):
                out.append((np.where(names, np.uint64(_PLACE[NAME]), literal), np.where(names, np.int8(NAME), kind)))
        return ids, out


MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    if len(h) < width:
        return np.zeros(0, np.uint64)
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        acc = acc * MULTIPLY + h[k : len(h) - width + 1 + k]
    acc ^= acc >> np.uint64(29)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    return acc ^ (acc >> np.uint64(32))


def _words() -> Words:
    """One for each worker process, so that tasks share what was seen before."""
    return sole("words", Words)


def _slots(words: Words, kind: np.ndarray, ids: np.ndarray, at: int, width: int) -> list[str]:
    values = [(kind[k], words.cores[ids[k]].lower()) for k in range(at, at + width) if kind[k]]
    return [f"{k}{NUMBERS.get(v, v) if k == NUMBER else v}" for k, v in values]


def _variant_windows(variants: list[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions, hashes and the words' kinds of windows, variant by variant, each different hash of a position once."""
    seen: list[np.ndarray] = []
    for h, kind in variants:
        hashes = window_hashes(h, width)
        new = np.ones(len(hashes), bool)
        for before in seen:
            new &= hashes != before
        seen.append(hashes)
        at = np.flatnonzero(new)
        yield at, hashes[at], kind


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item (its locator), item_id, windows (of the item), width, pos, hash, slots and literal
    (a bit for each word of the window that isn't a placeholder)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words()
        for b in sliced(batches):
            out = []
            for item, item_id, text in zip(b.column("item").to_pylist(), b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids, variants = words.template(text)
                width = min(WINDOW, len(ids))
                if width:
                    literal = [sum(variants[0][1][p : p + width] == WORD) for p in range(len(ids) - width + 1)]
                    least = min(LITERALS, max(literal))
                    good = sum(n >= least for n in literal)
                    for at, hashes, kind in _variant_windows(variants, width):
                        for p, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
                            bits = sum(1 << k for k in range(width) if kind[p + k] == WORD)
                            if bits.bit_count() >= least:
                                out.append((item, item_id, good, width, p, h, _slots(words, kind, ids, p, width), bits))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32()]
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["item", "item_id", "windows", "width", "pos", "hash", "slots", "literal"])

    benchmark = from_files(benchmark, "benchmark")
    rows = benchmark.select(locator(benchmark).alias("item"), F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "item string, item_id long, windows int, width int, pos int, hash long, slots array<string>, literal int")


ANY = f"{NUMBER}one"

#: A matched window: position in the document, position in the item, the item's slots, the document's, bits of literal words.
Pair = tuple[int, int, list[str], list[str], int]


def _slot_pairs(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Values that have to stand for each other."""
    return [(x, y) for x, y in zip(a, b, strict=True) if ANY not in (x, y)]


def _reading(pairs: list[Pair]) -> tuple[dict[str, str], dict[str, str]]:
    """The most frequent reading of the slots, from the item to the document and back."""
    there: dict[str, Counter] = defaultdict(Counter)
    back: dict[str, Counter] = defaultdict(Counter)
    for _, _, a, b, _ in pairs:
        for x, y in _slot_pairs(a, b):
            there[x][y] += 1
            back[y][x] += 1
    best = lambda c: min(c, key=lambda v: (-c[v], v))
    return {x: best(c) for x, c in there.items()}, {y: best(c) for y, c in back.items()}


def consistent(pairs: list[Pair]) -> list[Pair]:
    """Windows whose slots agree, both ways, with the most frequent reading. Kinds agree by the hash."""
    to, fro = _reading(pairs)
    return [m for m in pairs if all(to[x] == y and fro[y] == x for x, y in _slot_pairs(m[2], m[3]))]


def occurrences(pairs: list[Pair], width: int) -> Iterator[list[Pair]]:
    """The consistent windows of each occurrence of an item in a document, and of all matches read as one."""
    pairs = sorted(pairs, key=lambda m: m[:2])
    yield consistent(pairs)
    by: dict[int, list[Pair]] = defaultdict(list)
    for m in pairs:
        by[m[0] - m[1]].append(m)
    if len(by) == 1:
        return
    places = [m[0] for m in pairs]
    reach = max(m[1] for m in pairs) + width
    for offset, own in by.items():
        kept = consistent(own)
        to = {x: y for _, _, a, b, _ in kept for x, y in _slot_pairs(a, b)}
        fro = {y: x for x, y in to.items()}
        have = {m[1] for m in kept}
        near = pairs[bisect_left(places, own[0][0] - reach) : bisect_right(places, own[-1][0] + reach)]
        for m in sorted((m for m in near if m[1] not in have), key=lambda m: abs(m[0] - m[1] - offset)):
            more = _slot_pairs(m[2], m[3])
            then, now = to | dict(more), fro | {y: x for x, y in more}
            if all(then[x] == y == to.get(x, y) and now[y] == x == fro.get(y, x) for x, y in more):
                to, fro = then, now
                kept.append(m)
        yield kept


def has_run(kept: list[Pair], width: int) -> bool:
    """Whether windows that lie alike in item and document cover a run of RUN words, RUN_LITERALS of them literal."""
    cover: dict[int, int] = defaultdict(int)
    literal: dict[int, int] = defaultdict(int)
    for at, p, _, _, bits in kept:
        cover[at - p] |= (1 << width) - 1 << p
        literal[at - p] |= bits << p
    for offset, words in cover.items():
        for run in re.finditer("1+", f"{words:b}"[::-1]):
            length = run.end() - run.start()
            if length >= RUN and (literal[offset] >> run.start() & (1 << length) - 1).bit_count() >= RUN_LITERALS:
                return True
    return False


def best_occurrence(pairs: list[Pair], width: int, windows: int) -> tuple[int, bool]:
    """The most windows of an item that one occurrence holds, and whether one has a run."""
    most, run = 0, False
    for kept in occurrences(pairs, width):
        most = max(most, len({m[1] for m in kept}))
        if most == windows:
            break
        run = run or has_run(kept, width)
    return most, run


def _doc_matches(text: str, words: Words, known: np.ndarray | None, widths: list[int]) -> list[tuple[int, int, list[str]]]:
    """(hash, position, slots) of the windows of a text that the benchmark has; all windows if known is None.
    Narrow windows are those of whole short texts only."""
    ids, variants = words.template(text)
    out = []
    for width in widths:
        if width < WINDOW and width != len(ids):
            continue
        for at, hashes, kind in _variant_windows(variants, width):
            if known is not None:
                k = np.searchsorted(known, hashes)
                met = known[np.minimum(k, len(known) - 1)] == hashes
                at, hashes = at[met], hashes[met]
            out += [(h, p, _slots(words, kind, ids, p, width)) for p, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True)]
    return out


RESULT = "loc string, doc_id long, item_id long, matched_windows int, item_windows int, coverage double"


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """(document, item) pairs above COVERAGE or with a run: loc, doc_id, item_id, matched_windows, item_windows, coverage."""
    items = materialize(item_windows(benchmark), "benchmark-windows")
    docs = from_files(docs, "decontaminate-input")
    rows = docs.select(locator(docs).alias("loc"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    widths = [r["width"] for r in items.select("width").distinct().collect()]
    if not widths:
        return spark.createDataFrame([], RESULT)
    size = 48 + F.octet_length(F.array_join("slots", "")) + 8 * F.size("slots")
    near = items.agg(F.sum(size.cast("long"))).first()[0] <= broadcast

    def judge(loc, doc_id, matches):
        """matches: item, item_id, windows, width, pos, the item's slots, its literal words, position in the document, its slots."""
        by = defaultdict(list)
        for item, item_id, windows, width, pos, a, bits, at, b in matches:
            by[item, item_id, windows, width].append((at, pos, a, b, bits))
        for (_, item_id, windows, width), pairs in sorted(by.items(), key=lambda x: x[0][0]):
            if width < WINDOW:  # a short item and a text that is no more than it
                n, run = int(any(a == b for _, _, a, b, _ in pairs)), False
            else:
                n, run = best_occurrence(pairs, width, windows)
            if run or n >= max(1, COVERAGE * windows):
                yield loc, doc_id, item_id, n, windows, n / windows

    def batch(out):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        cols = list(zip(*out, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])

    if near:
        table = items.select("hash", "item", "item_id", "windows", "width", "pos", "slots", "literal").toArrow()
        table = table.set_column(1, "item", pc.dictionary_encode(table.column("item").combine_chunks()))
        shared = spark.sparkContext.broadcast(table.take(np.argsort(table.column("hash").to_numpy().view(np.uint64), kind="stable")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, words = shared.value, _words()
            known = table.column("hash").to_numpy().view(np.uint64)

            @lru_cache(maxsize=20_000)
            def of(h: int) -> list[tuple]:
                low, high = (int(np.searchsorted(known, np.int64(h).view(np.uint64), side)) for side in ("left", "right"))
                return list(zip(*(c.to_pylist() for c in table.slice(low, high - low).columns[1:]), strict=True))

            for b in sliced(batches):
                out = []
                for loc, doc_id, text in zip(b.column("loc").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    if found := _doc_matches(text, words, known, widths):
                        out += judge(loc, doc_id, [(*m, at, slots) for h, at, slots in found for m in of(h)])
                yield batch(out)

        return rows.mapInArrow(run, RESULT)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words()
        for b in sliced(batches):
            for loc, doc_id, text in zip(b.column("loc").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if found := _doc_matches(text, words, None, widths):
                    h, at, slots = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([loc] * len(h)), pa.array([doc_id] * len(h), pa.int64()), pa.array(h), pa.array(at, pa.int32()), pa.array(slots, pa.list_(pa.string()))], names=["loc", "doc_id", "hash", "at", "found"])

    def groups(pdf):
        import pandas as pd

        matches = [(r.item, r.item_id, r.windows, r.width, r.pos, list(r.slots), r.literal, r.at, list(r.found)) for r in pdf.itertuples()]
        doc_id = None if pd.isna(pdf["doc_id"].iloc[0]) else int(pdf["doc_id"].iloc[0])
        return batch(judge(pdf["loc"].iloc[0], doc_id, matches)).to_pandas()

    joined = rows.mapInArrow(windows, "loc string, doc_id long, hash long, at int, found array<string>").join(items, "hash")
    return joined.groupBy("loc", "item").applyInPandas(groups, RESULT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates, with docs' columns."""
    docs = from_files(docs, "decontaminate-input")
    loc = fresh("loc", docs.columns)
    bad = materialize(contaminated(spark, docs, benchmark).select(F.col("loc").alias(loc)).distinct(), "contaminated")
    return docs.select(*docs.columns, locator(docs).alias(loc)).join(bad, loc, "left_anti").select(*docs.columns)
