"""The training-data operators against plain loops that share none of their code paths."""

import functools
import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import psutil
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from evigraph.llm import chat_format, common, decontaminate, near_join, packing, quality, queries, shards, tokens, toxicity
from tests.llm.test_operators import DOC, ODD, SF, WORDS, check_join, frame, words


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# 2
def read_clauses(text, units, listed):
    """Targeted insults, threats and other insults, by looking at each word's neighbours; no automaton."""
    aimed = threats = plain = 0

    def known(word):
        if word in listed:
            return listed[word]
        return "i" if word in units else "s" if any(u[-1] == "*" and word.startswith(u[:-1]) and word != u[:-1] for u in units) else "o"

    for clause in re.split(r"[.!?;\n]", text.lower()):
        classes = [known(w) for w in re.findall(r"[^\W\d_]+(?:'[a-z]+)?", clause)]
        for k, c in enumerate(classes):
            if c not in "isv" or "N" in classes[max(0, k - 3) : k] or "R" in classes[:k]:
                continue
            if c == "v":
                threats += "T" in classes[k + 1 : k + 4]
            elif c == "i" and "T" in classes[max(0, k - 4) : k] + classes[k + 1 : k + 5]:
                aimed += 1
            else:
                plain += 1
    return aimed, threats, plain


def test_toxicity_equals_a_plain_reader_of_clauses(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    marks = labels.filter(toxicity.in_training(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    grammar = toxicity.train(spark, common.narrow(d), marks)
    listed = {w: k for k, ws in (("v", toxicity.THREATS), ("T", toxicity.TARGETS), ("N", toxicity.NEGATIONS), ("R", toxicity.REPORTS)) for w in ws}
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(d, grammar).collect()}
    w = np.array(grammar.model)
    seen = 0
    for r in d.collect():
        aimed, threats, plain = read_clauses(r["text"] or "", set(grammar.insults), listed)
        support = max(0, aimed + threats + plain - 1)
        x = [math.log1p(aimed), math.log1p(threats), math.log1p(support), math.log1p(100 * support / max(1, len((r["text"] or "").split())))]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, float(np.dot(w[1:], x) + w[0]))))), abs=1e-9), r["doc_id"]
        seen += support > 0
    assert seen > 50


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("isvTNRo"), max_size=25))
def test_one_automaton_does_what_the_transducers_do_in_turn(classes):
    one = toxicity.INSULT(toxicity.REPORTED(toxicity.NEGATION(classes)))
    assert toxicity.FORWARDS(classes) == one
    assert toxicity.kinds(classes) == toxicity.THREAT(toxicity.INSULT(one[::-1]))[::-1]


TOXIC = ["you pathetic loser", "He is such a loser!", "We will kill you.", "They said nothing. You stupid clown", "What an idiot, you moron"]
CLEAN = [
    "pathetic",
    "kill",
    "The word loser appears here in a long plain sentence about a dictionary of words",
    "he is not a loser",
    "he said you are a loser",
    "She never called him an idiot",
    "They plan to destroy the old bridge",
    "They wrote: you are a clown",
    "More trade across the world takes a new path close to the morning market",
    "No one will hurt you",
    "",
]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_the_grammar_decides(spark, sf):
    """On weights trained on the tables, clauses make a text toxic and single words don't."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    marks = labels.filter(toxicity.in_training(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    grammar = toxicity.train(spark, common.narrow(d), marks)
    score = lambda t: float(grammar.score(np.array([grammar.features(t, {})]))[0])
    assert all(score(t) >= 0.5 for t in TOXIC), [(t, score(t)) for t in TOXIC]
    assert all(score(t) < 0.5 for t in CLEAN), [(t, score(t)) for t in CLEAN]
    assert grammar.model[0] < 0 and min(grammar.model[1:]) >= 0
    # what is learned of words that are known anyway brings in no beginnings of other words
    assert not [u for u in grammar.insults if u[-1] == "*" and any(w.startswith(u[:-1]) for w in toxicity.INSULTS)]


def test_conflicting_labels_and_repeated_ids_are_settled(spark):
    rows = [(i, f"you worthless snark{i % 3} fool" if i % 2 else f"a calm day {i}") for i in range(60)] + [(1, "another text of one id")] * 3
    labels = [(i, 1, i % 2) for i in range(60)] + [(3, 1, 0), (4, 1, 1), (5, 1, 1)]
    d = frame(spark, rows, extra=True)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = {(r["doc_id"], r["score"]) for r in toxicity.toxicity(spark, d, lab).collect()}
    two = {(r["doc_id"], r["score"]) for r in toxicity.toxicity(spark, d.repartition(5), lab.orderBy(F.desc("toxic"))).collect()}
    assert one == two
    without = lab.filter("doc_id not in (3, 4)")  # the two with labels of both kinds
    assert {(r["doc_id"], r["score"]) for r in toxicity.toxicity(spark, d, without).collect()} == one


# 3
CHATS = "conv_id long, turn long, role string, parts " + chat_format.PARTS
PIECES = ["<|im_", "end|>", "\n<|im_end|>\n", "\\", "[IN", "ST]", "</", "s>", "x", "", "", "1", "1", "<|image|>", "<|", "im_sep|>", "é\n"]
part = st.one_of(st.sampled_from(PIECES).map(lambda t: ("text", t, None, None)), st.sampled_from([("image", None, "a.png", 7), ("audio", "ignored", "b.wav", None), ("document", None, None, 3), (None, "t", None, None)]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.lists(part, max_size=6)), min_size=1, max_size=5))
def test_parts_come_back_however_texts_are_split(spark, turns):
    df = spark.createDataFrame([(1, k, role, parts) for k, (role, parts) in enumerate(turns)], CHATS)
    chats = chat_format.format_chats(df)
    r, back = chats.first(), chat_format.read_back(chats).first()
    assert back["n_turns"] == len(turns)
    shown = ["".join(f"<|{p[0]}|>" if p[0] in chat_format.ATTACHED else p[1] or "" for p in parts) for _, parts in turns]
    assert back["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for (role, _), t in zip(turns, shown, strict=True)).encode()).hexdigest()
    learned = "".join(t for (role, _), t in zip(turns, shown, strict=True) if role == "assistant")
    assert back["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    files = [p for _, parts in turns for p in parts if p[0] in chat_format.ATTACHED]
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(p[0], p[2], p[3] or 0) for p in files]
    assert r["expanded_tokens"] == sum(p[3] or 0 for p in files)
    # placeholders that nobody attached are escaped: a live one is not behind an odd run of backslashes
    live = len(re.findall(r"(?<!\\)(?:\\\\)*<\|(?:image|audio|document)\|>", r["formatted"]))
    assert live == len(files)


def test_chats_ignore_other_columns_and_keep_long_texts(spark):
    long = "word \\ <s> " * 200_000
    rows = [(1, 0, "user", [("text", long, None, None)]), (1, 0, "user", [("text", long, None, None)]), (1, None, None, None)]
    df = spark.createDataFrame(rows, CHATS)
    for c in ("text", "content", "formatted", "chunk", "p", "k", "before", "n_turns", "loss_mask"):
        df = df.withColumn(c, F.lit("x"))
    got = chat_format.read_back(chat_format.format_chats(df)).first()
    assert got["n_turns"] == 3 and got["turns_sha256"] == hashlib.sha256(f"\n\nuser\n{long}\nuser\n{long}\n".encode()).hexdigest()
    many = spark.range(5000).selectExpr("1 as conv_id", "cast(null as long) as turn", "'user' as role", "id").withColumn("parts", chat_format.text_parts(F.concat(F.lit("t"), F.lpad("id", 5, "0"))))
    assert chat_format.format_chats(many).first()["n_turns"] == 5000


# 4
def test_accuracies_equal_em_over_documents_one_by_one(spark, texts):
    """EM over rows instead of pattern counts, with plain loops."""
    votes = [quality.votes(t, t.split()) for t in texts.values()]
    post = [[0.95, 0.4, 0.05][min(2, v.count(-1))] for v in votes]
    k = len(quality.LABELLERS)
    for _ in range(100):
        n = {1: sum(post), 0: sum(1 - p for p in post)}
        rate = {c: [{x: (sum((p if c else 1 - p) for p, v in zip(post, votes, strict=True) if v[j] == x) + 1) / (n[c] + 3) for x in (-1, 0, 1)} for j in range(k)] for c in (0, 1)}
        spoken = {c: [{x: math.log(r[x] / (r[-1] + r[1])) for x in (-1, 1)} for r in rate[c]] for c in (0, 1)}
        odds = math.log((n[1] + 1) / (n[0] + 1))
        new = []
        for v in votes:
            z = odds + sum(spoken[1][j][x] - spoken[0][j][x] for j, x in enumerate(v) if x)
            new.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        moved = max(abs(a - b) for a, b in zip(post, new, strict=True))
        if moved < 1e-9:
            break
        post = new
    got = {r["doc_id"]: r for r in quality.quality(spark, spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for (i, _), p in zip(texts.items(), post, strict=True):
        assert got[i]["posterior"] == pytest.approx(p, abs=1e-6)


def test_scores_equal_the_weights_one_by_one(spark, texts):
    scorer = quality.fit(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.read.parquet(f"{SF}/documents.parquet"), scorer).collect()}
    for i, t in texts.items():
        if not t.split():
            assert got[i] == 0
            continue
        at, v = quality.features(t.split(), quality._votes(t, t.split()))
        z = sum(scorer.weights[a] * x for a, x in zip(at, v, strict=True)) + scorer.weights[-1]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


# 5, 6
def test_encoding_long_texts_with_runs_of_spaces_takes_little_memory():
    r = random.Random(3)
    make = lambda: "  ".join([" ".join(r.choice(WORDS) + str(r.randrange(90)) for _ in range(10_000)) for _ in range(2)])
    some = [make() for _ in range(64)]
    odd = [t.replace("alpha", "альфа") for t in some]
    e = tokens.Encoder(tokens.default_path())
    e.encode(some[:1])
    before = psutil.Process().memory_info().rss
    for k in range(0, 64, 8):
        assert all(e.encode(some[k : k + 8])) and all(e.encode(odd[k : k + 8]))
    assert psutil.Process().memory_info().rss - before < 120 << 20


@functools.cache
def library():
    """A tokenizer of the library's own, with nothing set on it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def library_ids(texts):
    return [np.asarray(library().encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "Word", "é", " ", "  ", "   ", "\n", "\t", "\xa0", "\r\n", "12", ".", ",", "'s", "$$", "_", "²", "\x0b", "\x85", "日", "　", "\x1c", "😀", "<|endoftext|>", "<|endoftext", "|>"]), max_size=40).map("".join))
def test_cutting_changes_no_id(text):
    e = common.sole("test-encoder", lambda: tokens.Encoder(tokens.default_path()))
    want = library_ids([text])[0]
    part, call = tokens.PART, tokens.CALL
    tokens.PART, tokens.CALL = 5, 12
    try:
        assert e.encode([text]) == [want] == e.whole([text])
    finally:
        tokens.PART, tokens.CALL = part, call


def test_a_worker_gives_back_what_it_freed():
    code = """
import re
from pathlib import Path
import pyarrow as pa
from evigraph.llm.common import sliced
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) // 1024
before = held()
for b in sliced(iter([pa.RecordBatch.from_pydict({"text": ["x"]})])):
    made = [bytes(1000) for _ in range(200_000)]
    last = made[-1]
    del made
assert held() - before < 60, held() - before
"""
    subprocess.run([sys.executable, "-c", code], check=True)


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    sizes = [10, 3_000_000, 5, 5, 900_000, 200_000, *[1] * 1200]
    b = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in sizes])], names=["text"])
    cut = [[len(t) for t in s.column(0).to_pylist()] for s in common.sliced(iter([b]))]
    assert [n for c in cut for n in c] == sizes
    assert all(len(c) <= 512 and (sum(c) <= 1 << 20 or len(c) == 1) for c in cut)


def test_packing_ignores_other_columns_of_the_same_names(spark):
    got = packing.pack(spark, frame(spark, ODD, extra=True)).collect()
    want = Counter((i, len(x) // 4 + 1, zlib.crc32(x + b"\1\0\0\0") if len(x) < 4 * 2048 else None) for (i, _), x in zip(ODD, library_ids([t or "" for _, t in ODD]), strict=True))
    assert Counter((r["doc_id"], r["doc_tokens"], r["ids_crc32"] if r["doc_tokens"] <= 2048 else None) for r in got if r["start"] == 0) == want


# 7
def jump(key: int, buckets: int) -> int:
    """The published hash, on Python's integers."""
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards_equal_the_scalar_hash(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    keys = {r["doc_id"]: r["k"] % 2**64 for r in d.select("doc_id", F.xxhash64(F.col("doc_id").cast("long")).alias("k")).collect()}
    for r in shards.shard_documents(d, 8).collect():
        assert (r["shard"], r["grown_shard"]) == (jump(keys[r["doc_id"]], 8), jump(keys[r["doc_id"]], 9))
    r = random.Random(8)
    some = [r.randrange(2**64) for _ in range(2000)] + [0, 1, 2**64 - 1]
    for n in (1, 2, 9, 1000):
        assert shards.jump_hash(np.array(some, np.uint64), n).tolist() == [jump(k, n) for k in some]


# 8
def all_against_all(texts, items):
    """Coverage of each item by each document from dictionaries of windows; slots are checked by occurrence as the
    operator's docstring says, for texts without names at a sentence's start and items of a window or more."""
    number = re.compile(r"\d+")

    def template(text):
        return [("#", w) if number.fullmatch(w) else (w, None) for w in re.findall(r"[a-z]+|\d+", text.lower())]

    found = set()
    for d, text in texts.items():
        t = template(text)
        where = defaultdict(list)
        for p in range(len(t) - 7):
            where[tuple(w for w, _ in t[p : p + 8])].append(p)
        for i, item in items.items():
            q = template(item)
            windows = [p for p in range(len(q) - 7) if sum(v is None for _, v in q[p : p + 8]) >= 3]
            by = defaultdict(list)
            for p in windows:
                for at in where.get(tuple(w for w, _ in q[p : p + 8]), ()):
                    by[at - p].append(p)
            for offset, hits in by.items():
                readings = Counter()
                for p in hits:
                    readings.update({(q[k][1], t[offset + k][1]) for k in range(p, p + 8) if q[k][1]})
                to, fro = {}, {}
                for (x, y), _ in sorted(readings.items(), key=lambda z: (-z[1], z[0])):
                    to.setdefault(x, y)
                    fro.setdefault(y, x)
                good = [p for p in hits if all(to[q[k][1]] == t[offset + k][1] and fro[t[offset + k][1]] == q[k][1] for k in range(p, p + 8) if q[k][1])]
                if len(good) >= 0.5 * len(windows):
                    found.add((d, i))
    return found


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, -1])
def test_decontamination_equals_all_documents_against_all_items(spark, broadcast):
    r = random.Random(11)
    vocabulary = [w + c for c in "abc" for w in WORDS]
    items = {i: " ".join(r.choice(vocabulary) if r.random() < 0.8 else str(r.randrange(10, 99)) for _ in range(r.randrange(12, 30))) for i in range(25)}
    texts = {}
    for d in range(150):
        around = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randrange(40)))
        inside = items[r.randrange(25)].split()
        change = {x: str(r.randrange(100, 999)) for x in set(inside) if x.isdigit()} if r.random() < 0.5 else {}
        inside = [change.get(w, w) if r.random() < 0.97 else r.choice(vocabulary) for w in inside]
        cut = inside[: r.randrange(4, len(inside) + 1)] if r.random() < 0.5 else inside
        texts[d] = " ".join([around(), *cut, around()])
    want = all_against_all(texts, items)
    got = decontaminate.contaminated(spark, frame(spark, list(texts.items())), spark.createDataFrame(list(items.items()), "item_id long, text string"), broadcast)
    rows = {(x["doc_id"], x["item_id"]): x for x in got.collect()}
    covered = {k for k, x in rows.items() if x["coverage"] >= 0.5}
    assert want <= covered and len(want) > 40
    # what more is covered needs windows of other offsets or a run
    assert all(rows[k]["matched_windows"] >= 5 for k in set(rows) - want)


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, -1])
def test_short_items_contaminate_only_whole_texts(spark, broadcast):
    items = [(0, "short one"), (1, "7"), (2, "add 3 and 4"), (3, "!"), (4, "seven words are less than a window")]
    rows = [(0, "a short one here"), (1, "Short one."), (2, "8"), (3, "7"), (4, "add 3 and 5"), (5, "Add 3, and 4"), (6, "?"), (7, items[4][1]), (8, items[4][1] + " now"), (9, "tall " * 100_000 + "short one")]
    got = decontaminate.contaminated(spark, frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, 0), (3, 1), (5, 2), (7, 4)]


# 9
@pytest.mark.parametrize("seed", [4, 5])
def test_join_without_any_broadcast_equals_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(common, "BROADCAST", -1)
    monkeypatch.setattr(near_join, "BITS", 1 << 10)  # some rows pass the bitmap that aren't wanted
    r = random.Random(seed)
    base = [words(100 * seed + k, r.choice([7, 12, 25, 70])) for k in range(7)]
    rows = []
    for k in range(120):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    check_join(spark, rows + ODD)


def test_a_passage_in_texts_that_dont_link_gives_few_candidates(spark, monkeypatch):
    passage, n, looked = words(8, 64), 600, []
    verified = near_join._verified

    def counted(pairs, sets):
        looked.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(near_join, "_verified", counted)
    rows = [(k, words(k + 50, 6 + k % 30) + " " + passage + " " + words(k + 5000, 6 + k % 20)) for k in range(n)]
    rows += [(n + k, passage) for k in range(20)] + [(n + 100 + k, f"x{k} {passage}") for k in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in near_join.near_join(spark, frame(spark, rows)).collect()}
    assert sum(looked) < 10 * n
    assert len({got[n + k] for k in range(20)} | {got[n + 100 + k] for k in range(40)}) == 1


# the pipeline
ONE = words(77, 80)


def _corpus(spark, tmp_path, rows):
    path = tmp_path / "sf"
    frame(spark, rows, extra=True).coalesce(2).write.parquet(str(path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_pipeline_takes_odd_and_repeated_rows(spark, tmp_path):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = ODD + [(50, ONE)] * 3 + [(51, ONE), (52, ONE + " more"), (53, f"{words(5, 30)} {item} {words(6, 30)}"), (None, words(78, 60))]
    got = corpus_pipeline.run(spark, _corpus(spark, tmp_path, rows)).collect()
    ids = Counter(r["doc_id"] for r in got if r["start"] == 0)
    assert ids[51] + ids[52] + ids[50] == 1 and ids[53] == 0 and ids[5] + ids[6] == 1 and ids[None] >= 1 and ids[7] == 1
    assert sum(r["length"] for r in got if r["doc_id"] == 7) == next(r["doc_tokens"] for r in got if r["doc_id"] == 7)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, _corpus(spark, tmp_path, [])).count() == 0


def test_packing_is_the_last_stage(spark):
    name, stage = corpus_pipeline.STAGES[-1]
    assert name == "packing" and stage(spark, frame(spark, ODD, extra=True), SF).filter("start = 0").count() == len(ODD)


def test_typed_parts_query_equals_plain_python(spark):
    turns = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((t, role, text))

    def esc(s):
        s = s.replace("\\", "\\\\")
        for c in chat_format.CONTROL:
            s = s.replace(c, "\\" + c)
        return s

    got = {r["conv_id"]: r for r in queries.chat_parts(spark, SF).collect()}
    assert set(got) == set(by)
    for c, rows in by.items():
        whole, files = "", 0
        for _, role, text in sorted(rows):
            whole += f"<|im_start|>{esc(role)}\n<|im_sep|>{esc(text).replace('?', '?<|image|>')}\n<|im_end|>\n"
            files += text.count("?")
        assert (got[c]["formatted_sha256"], got[c]["n_attachments"], got[c]["expanded_tokens"]) == (hashlib.sha256(whole.encode()).hexdigest(), files, 64 * files)


assert DOC
