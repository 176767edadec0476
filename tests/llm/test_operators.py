"""The training-data operators against brute force, round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evigraph.llm import chat_format, decontaminate, exact_dedup, near_join, packing, quality, queries, shards, token_count, token_store, tokens, toxicity
from evigraph.llm.common import shared_dir
from evigraph.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def frame(spark, rows, extra=False):
    """Documents of (doc_id, text), by hand; with columns whose names an operator might use itself."""
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOC)
    if extra:
        for c in ("loc", "token", "rid", "part", "shard", "score", "kept", "h", "votes", "cls", "length", "offset", "digest", "_text", "_metadata"):
            df = df.withColumn(c, F.lit("x"))
    return df


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


#: Nulls, empty and blank texts, ties, repeated rows, one very long text.
ODD = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (None, "one two"), (5, words(1, 60)), (6, words(1, 60)), (7, words(2, 20_000)), (8, "É" * 3000), (9, "a  b \n\n c "), (10, "<|endoftext|> 日本語 x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


# 1
def test_token_counts_match_the_library(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_count.load_vocabulary(token_count.default_vocabulary())
    low = min(s for _, s in vocabulary)
    library = Tokenizer(models.Unigram([("<unk>", low), *vocabulary], unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always", split=False)])
    got = {r["doc_id"]: r for r in token_count.count_tokens(docs).collect()}
    for doc_id, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        assert got[doc_id]["n_tokens"] == len(library.encode(text).ids), doc_id


def test_viterbi_breaks_ties_as_the_library():
    from tokenizers import Tokenizer, models

    r = random.Random(0)
    for _ in range(300):
        pieces = {"▁"} | {"".join(r.choice("abc▁") for _ in range(r.randrange(1, 4))) for _ in range(12)}
        vocabulary = [(p, -float(r.randrange(1, 4))) for p in sorted(pieces) if "▁" not in p[1:]]
        library = Tokenizer(models.Unigram([("<unk>", min(s for _, s in vocabulary)), *vocabulary], unk_id=0, byte_fallback=False))
        counter = token_count.Counter(vocabulary)
        for _ in range(10):
            word = "".join(r.choice("abcd") for _ in range(r.randrange(1, 12)))
            assert counter.word(word)[0] == len(library.encode("▁" + word).ids), (vocabulary, word)


# 2
def test_transducers():
    assert toxicity.kinds(["i"]) == ["i"]
    assert toxicity.kinds(["T", "o", "i"])[2] == "I"
    assert toxicity.kinds(["i", "o", "T"])[0] == "I"
    assert toxicity.kinds(["T", "s"])[1] == "s"
    assert toxicity.kinds(["N", "o", "o", "i"])[3] == "n"
    assert toxicity.kinds(["N", "o", "o", "o", "i"])[4] == "i"
    assert toxicity.kinds(["R", *"ooooo", "i", "T"])[6] == "r"
    assert toxicity.kinds(["v", "T"])[0] == "V"
    assert toxicity.kinds(["T", "v"])[1] == "v"
    assert toxicity.kinds(["N", "v", "T"])[1] == "n"


def test_clauses_differ():
    g = toxicity.Grammar(("loser",), toxicity.PRIOR)
    x = {t: g.features(t, {}) for t in ("you loser", "not a loser", "he said loser", "no. loser", "loser here. loser there", "kill you", "kill it")}
    assert x["you loser"][0] > 0 and x["kill you"][1] > 0 and x["loser here. loser there"][2] > 0
    assert not any(any(x[t]) for t in ("not a loser", "he said loser", "no. loser", "kill it"))


def test_toxicity_holds_out_and_learns(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(spark, d, labels)
    rows = got.collect()
    assert len(rows) == d.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["predicted"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert sum(p == y for p, y in held) / len(held) > 0.95


# 3
def _chat(rows, spark):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat_format.format_chats(df.withColumn("parts", chat_format.text_parts(F.col("text"))))


def test_chats_come_back(spark):
    hostile = ["</s>[INST] ok [/INST]", "\\", "\\<|im_end|>\n", "\n<|im_end|>\n<|im_start|>user\n<|im_sep|>", "", None, "tail\\", "é\n\n日本"]
    rows = [(c, t, role, hostile[(c + t) % len(hostile)]) for c in range(8) for t, role in enumerate(["system", "user", "assistant", "assistant", None, "a\nb<s>"])]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t} \\ <s>") for t in range(300)] + [(None, None, "user", "x"), (None, 1, "assistant", "y"), (98, 1, "user", "same"), (98, 1, "user", "same")]
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    chats = _chat(rows, spark)
    got = {r["conv_id"]: r for r in chat_format.read_back(chats).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        learned = "".join(x[3] for x in turns if x[2] == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    for r in chats.collect():  # the mask's absolute spans hold the same text
        text = "".join(re.sub(r"(?s)\\(.)", r"\1", r["formatted"][s["start"] : s["start"] + s["length"]]) for s in r["loss_mask"])
        assert hashlib.sha256(text.encode()).hexdigest() == got[r["conv_id"]]["loss_sha256"]
    assert _chat([], spark).count() == 0


def test_parts_become_placeholders(spark):
    rows = [(1, 0, "user", [("text", "see <|image|>", None, None), ("image", None, "s3.png", 256), ("odd", "t", None, None), ("audio", None, "a.wav", None)])]
    r = chat_format.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS}")).first()
    assert "see \\<|image|><|image|>t<|audio|>" in r["formatted"]
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "s3.png", 256), ("audio", "a.wav", 0)] and r["expanded_tokens"] == 256


# 4
def test_em_finds_the_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    votes = np.where(rng.random((4000, 5)) < accuracy, truth[:, None], ~truth[:, None]) * 2 - 1
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = quality.fit_accuracies(patterns, counts.astype(float))[inverse.ravel()]
    assert ((post > 0.5) == truth).mean() > 0.93


def test_quality_agrees_with_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(spark, d).join(labels, "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.97
    assert sum(not r["keep"] for r in rows if r["quality"] == 1) / len(rows) < 0.02


# 5
def library_ids(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_path())
    return [np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_encoder_equals_the_library(docs):
    texts = [r["text"] for r in docs.collect()] + [t or "" for _, t in ODD] + ["don't  'll", " x", "x ", "\n \n x", "x²½ ª_b", "\x1c a", "a\xa0b c", "word. word, word", "\u00a0"]
    e = tokens.Encoder(tokens.default_path())
    assert e.encode(texts) == e.whole(texts) == library_ids(texts)


def test_token_store_round_trip(spark, tmp_path):
    rows = ODD + [(100 + i, words(i, 40)) for i in range(300)]
    store = str(tmp_path / "store")
    got = token_store.token_store(spark, frame(spark, rows, extra=True), store).collect()
    want = [(i, x + b"\0\0\0\0") for (i, _), x in zip(rows, library_ids([t or "" for _, t in rows]), strict=True)]
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or -1, len(x) // 4, zlib.crc32(x)) for i, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] or -1 for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    few = {r["doc_id"]: r["ids"] for r in token_store.read_documents(spark, store, [5, 100, 123456]).collect()}
    plain = dict(want)
    assert {k: np.array(v, "<u4").tobytes() for k, v in few.items()} == {k: plain[k] for k in (5, 100)}
    assert token_store.token_store(spark, frame(spark, [])).count() == 0


# 6
def test_packing_covers_every_id(spark, docs):
    df = frame(spark, ODD, extra=True).unionByName(docs, allowMissingColumns=True)
    got = packing.pack(spark, df, with_ids=True).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by[r["doc_id"]].append(r)
    for pieces in seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    e = tokens.Encoder(tokens.default_path())
    for r in docs.select("doc_id", "text").collect():
        if r["doc_id"] > 10:
            pieces = sorted(by[r["doc_id"]], key=lambda p: p["start"])
            assert b"".join(bytes(p["ids"]) for p in pieces) == e.whole([r["text"]])[0] + b"\1\0\0\0"
    filled = sum(r["length"] for r in got) / (2048 * len(seq))
    assert filled > 0.97
    assert packing.pack(spark, frame(spark, [])).count() == 0


def test_cutting_stock_is_near_the_bound():
    r = random.Random(3)
    for largest, classes in ((20, 18), (64, 40)):
        demand = {c: r.randrange(1, 200) for c in r.sample(range(1, largest + 1), classes)}
        plan = packing.plan(demand, 64)
        assert all(sum(c * n for c, n in p.items()) <= 64 for p, _ in plan)
        for c, n in demand.items():
            assert sum(p.get(c, 0) * k for p, k in plan) >= n
        # no packing has fewer than the relaxed program, or than there are items over half the capacity
        relaxed = sum(x for _, x in packing.generate_columns(demand, 64))
        least = max(sum(c * n for c, n in demand.items()) / 64, sum(n for c, n in demand.items() if c > 32))
        assert least - 1e-6 <= relaxed <= sum(k for _, k in plan) <= 1.01 * relaxed + 3
        if largest == 20:
            assert relaxed <= 1.01 * least
    value, pattern = packing.knapsack(np.array([3, 5]), np.array([0.3, 0.6]), 11)
    assert (round(value, 9), pattern) == (1.2, {5: 2})


# 7
def test_jump_hash_moves_only_into_the_new_shard(spark):
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    for n in (1, 2, 8, 100):
        a, b = shards.jump_hash(keys, n), shards.jump_hash(keys, n + 1)
        moved = a != b
        assert (b[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.02 and np.bincount(a, minlength=n).min() > 0.8 * len(keys) / n
    rows = shards.shard_documents(frame(spark, ODD, extra=True).repartition(3)).collect()
    assert len(rows) == len(ODD)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in ODD)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    assert shards.shard_documents(frame(spark, [])).count() == 0


def test_written_shards(spark, tmp_path):
    shards.write_shards(frame(spark, ODD), str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)


# 8
ITEMS = [(0, "If Anna buys 12 apples for 3 dollars each and Ben gives her 4 more, how much did Anna pay in total for them?"), (1, "short one"), (2, None), (3, "")]


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, -1])
def test_reworded_numbers_and_names_are_caught(spark, broadcast):
    same = "xx yy. " + ITEMS[0][1]
    other = same.replace("Anna", "Carla").replace("12", "700").replace("Ben", "Dora")
    mixed = same.replace("Anna buys", "Carla buys").replace("did Anna", "did Dora").replace("Ben", "Emil")
    rows = [(1, same), (2, other), (3, mixed), (4, words(5, 300)), (None, same), (5, None), (6, ""), (7, "a short one here"), (8, " ".join([same] * 3)), (9, other), (9, other)]
    got = decontaminate.contaminated(spark, frame(spark, rows, extra=True), spark.createDataFrame(ITEMS, "item_id long, text string"), broadcast)
    found = sorted((r["doc_id"] or -1, r["item_id"]) for r in got.collect())
    assert found == [(-1, 0), (1, 0), (2, 0), (3, 0), (8, 0), (9, 0), (9, 0)]
    cover = {r["doc_id"]: r["coverage"] for r in got.collect() if r["item_id"] == 0}
    assert cover[2] == cover[1] > cover[3]  # the inconsistent name costs its windows
    none = decontaminate.contaminated(spark, frame(spark, rows), spark.createDataFrame([], "item_id long, text string"), broadcast)
    assert none.count() == 0 and decontaminate.contaminated(spark, frame(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string"), broadcast).count() == 0


def variants(n):
    """The first item with other names and numbers."""
    people = ["Zoe", "Abe", "Mia", "Leo", "Eva", "Max", "Ida", "Tim", "Una", "Kai", "Lea", "Jon"]
    out = []
    for k in range(n):
        swap = {"Anna": people[k], "Ben": people[k + 1], "12": str(30 + k), "3": str(9 - k % 9), "4": str(50 + k)}
        out.append(re.sub(r"\b(Anna|Ben|12|3|4)\b", lambda m: swap[m[0]], ITEMS[0][1]))
    return out


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, -1])
def test_variants_of_an_item_in_one_text_dont_hide_it(spark, broadcast):
    exact, ten = ITEMS[0][1], variants(10)
    spaced = exact.replace("each and", "each and then also")
    rows = [(1, exact + " " + ten[0]), (2, " ".join([exact, *ten])), (3, " ".join(ten)), (4, exact), (5, " ".join([*ten, spaced])), (6, spaced)]
    got = decontaminate.contaminated(spark, frame(spark, rows), spark.createDataFrame(ITEMS[:1], "item_id long, text string"), broadcast)
    cover = {r["doc_id"]: r["coverage"] for r in got.collect()}
    assert set(cover) == {1, 2, 3, 4, 5, 6}
    assert cover[1] == cover[2] == cover[3] == cover[4] == 1.0 > cover[6]  # words put in cost their windows


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, -1])
def test_names_at_starts_number_words_and_short_units_are_slots(spark, broadcast):
    items = [
        (0, "Anna has 3 apples. Ben has 5 apples. Tom has 2 pears. How many fruits do they have together?"),
        (1, "Somebody cuts three pieces of 4 m each from a rope, then five more of 6 g and seven at the far end."),
    ]
    rows = [
        (0, items[0][1]),
        (1, "Zoe has 8 apples. Abe has 9 apples. Mia has 6 pears. How many fruits do they have together?"),
        (2, "Zoe has 8 apples. Abe has 9 apples. Mia has 6 pears, how many fruits do they have together?"),
        (3, "Anna has three apples. Ben has five apples. Tom has two pears. How many fruits do they have together?"),
        (4, items[1][1]),
        (5, "Somebody cuts eight pieces of 9 km each from a rope, then two more of 11 kg and six at the far end."),
        (6, "Somebody cuts 8 pieces of 9 t each from a rope, then 2 more of 11 l and 6 at the far end."),
    ]
    got = decontaminate.contaminated(spark, frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast)
    cover = {(r["doc_id"], r["item_id"]): r["coverage"] for r in got.collect()}
    assert set(cover) == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1)}
    assert all(c == 1.0 for c in cover.values())


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, -1])
def test_a_run_of_a_long_item_is_enough(spark, broadcast):
    letters = [w + c for c in "abc" for w in WORDS]
    item = letters[:57]
    named = [*letters[:20], "Anna", "5", *letters[20:55]]
    other = ["Zoe" if w == "Anna" else "9" if w == "5" else w for w in named]
    items = [(0, " ".join(item)), (1, " ".join(w[::-1] if w != "Anna" else w for w in named))]
    back = [w[::-1] if w != "Zoe" else w for w in other]
    rows = [
        (0, "xx yy " + " ".join(item[10:35]) + " zz"),
        (1, "xx yy " + " ".join(item[10:23]) + " zz"),
        (2, "xx yy " + " ".join(item[10:22]) + " zz"),
        (3, " ".join(item[:10]) + " xx " + " ".join(item[20:30])),
        (4, "xx yy " + " ".join(back[12:30]) + " zz"),
    ]
    got = decontaminate.contaminated(spark, frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast)
    found = {(r["doc_id"], r["item_id"]): r["matched_windows"] for r in got.collect()}
    assert found == {(0, 0): 18, (1, 0): 6, (4, 1): 11}


# 9
def brute_components(rows):
    """(number of shingles, component) of each row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                parent[find(a)] = find(b)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return [(len(sets[k]), names.get(find(k))) for k in range(len(rows))]


def check_join(spark, rows):
    got = near_join.near_join(spark, frame(spark, rows, extra=True)).collect()
    want = brute_components(rows)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(key((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == sorted(key((i, *w)) for (i, _), w in zip(rows, want, strict=True))


def edited(seed, text, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{seed}x{r.randrange(10**6)}"
    return " ".join(w)


def test_join_equals_all_pairs(spark):
    rows = list(ODD)
    rows += [(1000 + k, edited(k, words(7, 150), k % 9)) for k in range(120)]  # a dense group
    rows += [(2000 + k, words(k, 30) + " " + words(8, 60)) for k in range(60)]  # a shared passage
    rows += [(3000 + k, " ".join(words(9, 14).split()[: 9 + k % 6])) for k in range(30)]  # small sets
    rows += [(4000 + k, edited(k, words(10, 14), k % 2)) for k in range(40)]
    rows += [(5000 + k, " ".join(WORDS[: 5 + k % 4])) for k in range(8)]
    rows += [(6000 + k, " ".join([words(11, 12), *WORDS[k % 3 :: 3]])) for k in range(12)]
    check_join(spark, rows)
    check_join(spark, [])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_equals_all_pairs_at_random(spark, seed):
    r = random.Random(seed)
    base = [words(100 * seed + k, r.choice([6, 8, 12, 25, 70])) for k in range(8)]
    rows = [(k, edited(k, r.choice(base), r.choice([0, 0, 1, 1, 2, 3]))) for k in range(150)]
    rows = [(i, t if r.random() < 0.7 else " ".join(t.split()[r.randrange(3) :])) for i, t in rows]
    check_join(spark, rows)


def test_subsets_cover_every_link():
    for s in range(1, 13):
        for t in range(s, 2 * s + 1):
            links = 5 * s >= 4 * t
            assert ((s, t) in near_join.partners(s)) == links == ((s, t) in near_join.partners(t))
            assert all((100 * i >= 80 * (s + t - i)) == (i >= near_join.overlap(s, t)) for i in range(s + 1))


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_tables_take_few_files(spark):
    """However many partitions a shuffle has."""
    docs = [(k, " ".join(f"w{(k // 2 * 7 + j)}" for j in range(20 + k % 2))) for k in range(400)] + [(k, "one text") for k in range(400, 420)]
    folder = Path(shared_dir(spark, "x").removeprefix("file:")).parent
    before = set(folder.iterdir())
    confs = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        near = {r["doc_id"]: r["component_id"] for r in near_join.near_join(spark, frame(spark, docs)).collect()}
        exact = exact_dedup.exact_dedup(spark, frame(spark, docs)).filter("kept").count()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert near == {k: k // 2 * 2 if k < 400 else 400 for k in range(420)} and exact == 401
    files = defaultdict(list)
    for f in set(folder.iterdir()) - before:
        files[f.name[:-33]].append(len(list(f.glob("part-*"))))
    few = spark.sparkContext.defaultParallelism
    for name in ("classes", "candidates", "frequencies", "postings", "hubs", "hub-links", "edges", "placed-postings", "grouped-classes", "dedup-groups"):
        assert files[name] and max(files[name]) <= few, name


# 10
def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(spark, frame(spark, ODD, extra=True)).collect()
    by = defaultdict(list)
    for i, t in ODD:
        by[t or ""].append(i)
    assert len(got) == len(ODD)
    digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in by.items()}
    for r in got:
        ids = digest[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(digest)
    assert exact_dedup.exact_dedup(spark, frame(spark, [])).count() == 0


def test_colliding_digests_are_told_apart_by_their_bytes(spark):
    rows = [(k, f"text {k % 5}") for k in range(30)]
    got = exact_dedup.exact_dedup(spark, frame(spark, rows), digest=lambda t: F.unhex(F.lit("00"))).collect()
    assert all((r["group_size"], r["keep_id"]) == (6, 25 + r["doc_id"] % 5) and r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_state_grows_with_later_arrivals(spark, tmp_path):
    state, folder = str(tmp_path / "state"), tmp_path / "in"
    for n in range(2):
        batch = spark.createDataFrame([(10 * n + k, f"f:{n}:{k}", bytearray([k % 3])) for k in range(6)], "doc_id long, loc string, digest binary")
        batch.write.mode("append").parquet(str(folder))
        found = exact_dedup.run_stream(spark, str(folder), batch.schema, state)
    assert sorted((bytes(r["digest"]), r["keep_id"], r["n"]) for r in found.collect()) == [(b"\0", 13, 4), (b"\1", 14, 4), (b"\2", 15, 4)]


# the queries and the pipeline
def test_operators_take_odd_rows_and_empty_tables(spark):
    odd, none = frame(spark, ODD, extra=True), frame(spark, [])
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for df, n in ((odd, len(ODD)), (none, 0)):
        assert token_count.count_tokens(df).count() == n
        assert toxicity.toxicity(spark, df, labels).count() == n
        assert toxicity.toxicity(spark, df, labels.limit(0)).count() == n
        assert quality.quality(spark, df).count() == n


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:4]], ids=[n for n, _ in corpus_pipeline.STAGES[:4]])
def test_stages_take_odd_rows_and_keep_columns(spark, stage):
    odd = frame(spark, ODD, extra=True)
    got = stage(spark, odd, SF)
    assert got.columns == odd.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert (5, words(1, 60)) in kept or (6, words(1, 60)) in kept
    assert stage(spark, frame(spark, []), SF).count() == 0


def test_pipeline_equals_its_stages_by_hand(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    scorer_kept = {r["doc_id"] for r in quality.quality(spark, spark.read.parquet(f"{SF}/documents.parquet")).collect() if r["keep"]}
    last = {}
    for i in sorted(scorer_kept):
        last[rows[i]] = i
    left = sorted(last.values())
    components = [c for _, c in brute_components([(i, rows[i]) for i in left])]
    left = [i for i, c in zip(left, components, strict=True) if c in (i, None)]
    base = spark.createDataFrame([(i, rows[i]) for i in left], "doc_id long, text string")
    bad = {r["doc_id"] for r in decontaminate.contaminated(spark, base, spark.read.parquet(f"{SF}/benchmark.parquet"), 0).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(left) - bad
    e = tokens.Encoder(tokens.default_path())
    for i in left[:40]:
        if i not in bad:
            assert sum(r["length"] for r in got if r["doc_id"] == i) == len(e.whole([rows[i]])[0]) // 4 + 1


def test_every_query_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.QUERIES} <= names and set(__spark_entry__.oracle_sql()) <= names
    assert sorted(int(m[1]) for n in queries.QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
