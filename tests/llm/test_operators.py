"""The operators on Spark: beside brute force on the smallest tables, and on what tables may hold in every column."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtrail.llm import chat, licenses, tokens
from rowtrail.llm.decontaminate import Index, decontaminate, longest_stretch, overlaps
from rowtrail.llm.fingerprints import edited_fingerprints
from rowtrail.llm.graph import components
from rowtrail.llm.lines import line_duplicates
from rowtrail.llm.minhash import near_duplicates
from rowtrail.llm.packing import pack
from rowtrail.llm.quality import classify
from rowtrail.llm.rlz import substring_duplicates
from rowtrail.llm.shared import Scratch
from rowtrail.llm.words import SEPARATOR, words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def made(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def invented(rng, n, words=6):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, words))) for _ in range(n))


@pytest.fixture(scope="module")
def families():
    """Groups whose members differ by a few words, chains of small edits, exact copies, short and empty texts."""
    rng = random.Random(11)
    rows, i = [], 0
    for _ in range(4):
        base = invented(rng, 90).split()
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = invented(rng, 1)
            rows.append((i, " ".join(w)))
            i += 1
    chain = invented(rng, 60).split()
    for _ in range(12):
        chain[rng.randrange(60)] = invented(rng, 1)
        rows.append((i, " ".join(chain)))
        i += 1
    long_one = invented(rng, 20000)
    rows += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "one two"), (i + 6, long_one), (i + 7, long_one)]
    rng.shuffle(rows)
    return rows


def check_near(df, rows, **how):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}
    assert got == brute.near(rows, **how)
    assert {r["doc_id"] for r in df.filter("kept").collect()} == {c for _, c in got.values()}


def test_near_duplicates(spark, given, families):
    check_near(near_duplicates(given), rows_of(given))
    check_near(near_duplicates(made(spark, families)), families)
    check_near(near_duplicates(made(spark, families), shingle_words=5), families, k=5)


def test_near_duplicates_of_odd_rows(spark):
    odd = made(spark, [(1, "a b c", 9), (1, "a b c", 9), (None, "a b c", 9), (None, None, 9), (3, "A b\tc", 9)], "doc_id long, text string, kept int")
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(odd).collect())
    assert found == {(1, 2, 1, True): 2, (3, 2, 1, False): 1, (None, 2, None, True): 1, (None, 0, None, True): 1}
    assert near_duplicates(odd.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(200, 201), (201, 200), (7, 7)]
    random.Random(1).shuffle(edges)
    scratch = Scratch(spark, "test")
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {j: 100 for j in range(101, 140)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


@pytest.fixture(scope="module")
def passages():
    """Documents that share passages of 30 to 120 words at any place, cut short, overlapping, and whole copies."""
    rng = random.Random(12)
    shared = [invented(rng, rng.randrange(30, 120), 4).split() for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(shared)
            lo = rng.randrange(0, 20)
            parts += invented(rng, rng.randrange(0, 40), 4).split() + p[lo : rng.randrange(max(lo, len(p) - 20), len(p) + 1)]
        rows.append((1000 - 7 * i, " ".join(parts)))
    rows += [(5000, rows[3][1]), (5001, rows[3][1]), (5002, "a " * 300), (5003, "a " * 55), (5004, None), (5005, "  "), (5006, "a b " * 40)]
    return rows


def test_substring_duplicates(spark, given, passages):
    for df, rows in ((given, rows_of(given)), (made(spark, passages).repartition(7), passages)):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_duplicates(df).collect()}
        assert got == brute.substrings(rows)


def test_substring_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    odd = made(spark, [(1, text), (1, text), (None, text), (2, text + " more"), (2, "other")])
    found = substring_duplicates(odd, with_text=True).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in found) == [
        ("1", 60, 0, None), ("1", 60, 0, None), ("2", 1, 0, None), ("2", 61, 60, "more"), ("None", 60, 0, None),
    ]
    assert substring_duplicates(odd.limit(0)).count() == 0


def test_line_duplicates(spark, given):
    rng = random.Random(13)
    pool = [invented(rng, rng.randrange(0, 6)) for _ in range(30)] + ["", "x", "a line that is long enough to count"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(40)] + [(90, None), (91, ""), (92, "\n\n")]
    for df, own in ((given, rows_of(given)), (made(spark, rows), rows)):
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_duplicates(df).collect()}
        assert got == brute.lines(own)


def test_line_duplicates_of_odd_rows(spark):
    text = "a line that is long enough to count\nshort"
    odd = made(spark, [(1, text, "x"), (1, text, "x"), (None, text, "x"), (2, text, "x")], "doc_id long, text string, N_LINES string")
    found = sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in line_duplicates(odd).collect())
    assert found == [("1", text, 0), ("1", text, 0), ("2", "", 2), ("None", text, 0)] or found[2] == ("2", "short", 1)
    assert line_duplicates(odd).columns == ["doc_id", "text", "n_lines", "n_removed", "kept_sha256"]
    assert line_duplicates(odd.limit(0)).count() == 0


def test_edited_fingerprints(spark, given):
    rows = sorted(rows_of(given)) + [(900, None), (901, ""), (902, "é"), (903, "日本語 " * 4000)]
    found = {r["doc_id"]: r for r in edited_fingerprints(made(spark, rows).repartition(5)).collect()}
    assert len(found) == len(rows)
    prints = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long = [r for r in found.values() if r["n_chars"] > 400]
    assert np.median([r["near_edited"] for r in long]) > 0.35 and np.mean([r["near_next"] for r in long]) < 0.15
    assert [r["edited_sha256"] for r in edited_fingerprints(made(spark, [(1, "ab")])).collect()] == [hashlib.sha256(b"aa").hexdigest()]
    assert edited_fingerprints(made(spark, [])).count() == 0
    twice = edited_fingerprints(made(spark, [(1, "b c"), (1, "a b"), (None, "x")])).collect()
    assert sorted(str(r["doc_id"]) for r in twice) == ["1", "1", "None"]


def test_token_counts(spark, given):
    library = tokens.encoder(tokens.vocabulary(None)).library
    rows = rows_of(given) + [(900, None), (901, ""), (None, "a <|endoftext|> b"), (902, "x y " * 30000), (902, "x y " * 30000)]
    found = Counter(tuple(r) for r in tokens.token_counts(made(spark, rows)).collect())
    expected = Counter()
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected[i, len((t or "").encode()), n, n > 512] += 1
    assert found == expected
    assert tokens.token_counts(made(spark, [])).count() == 0


def test_packing(spark, given):
    library = tokens.encoder(tokens.vocabulary(None)).library
    rows = rows_of(given) + [(900, None), (901, ""), (902, "x y " * 5000), (903, "tie"), (903, "tie"), (None, "tie")]
    found = pack(made(spark, rows).repartition(6), capacity=512).collect()
    shuffled = pack(made(spark, rows).repartition(6), capacity=512, small_offsets=0)
    assert "Broadcast" not in shuffled._jdf.queryExecution().executedPlan().toString()
    assert (shuffled.count(), shuffled.agg(F.max("sequence_id")).first()[0]) == (len(found), max(r["sequence_id"] for r in found))
    pieces = defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    expected = defaultdict(list)
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 512 or min(len(ids), 512)
        edges = [0, *range(first, len(ids) + 1, 512)]
        for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
            expected[i].append((k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    held = defaultdict(list)
    for r in found:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 512
    total = sum(r["length"] for r in found)
    assert len(held) <= 1.05 * -(-total // 512) + 1
    assert pack(made(spark, [])).count() == 0


def test_decontamination(spark):
    rng = random.Random(14)
    items = [(i, invented(rng, 30)) for i in range(8)] + [(8, "too short to tell"), (9, None), (None, "no id but long enough to count as one")]
    benchmark = made(spark, items, "item_id long, text string")
    rows, truth = [], {}
    for i in range(40):
        body = invented(rng, 80).split()
        if i % 2:
            words = items[i % 8][1].split()
            for _ in range(i % 5):
                words[rng.randrange(30)] = "changed"
            at = rng.randrange(80)
            body[at:at] = [w.upper() + "," for w in words] if i % 4 == 1 else words
        rows.append((i, " ".join(body), True))
        truth[i] = i % 2 == 0
    rows += [(50, None, True), (51, "", True), (51, "", True), (52, "too short to tell", True), (None, items[0][1], True)]
    found = decontaminate(made(spark, rows, "doc_id long, text string, Kept boolean"), benchmark).collect()
    assert {r["doc_id"]: r["kept"] for r in found if r["doc_id"] in truth} == truth
    assert all(r["item_id"] == d["doc_id"] % 8 for d in found if d["doc_id"] in truth for r in d["hits"])
    assert sorted((str(r["doc_id"]), r["kept"]) for r in found if r["doc_id"] not in truth) == [
        ("50", True), ("51", True), ("51", True), ("52", True), ("None", False),
    ]
    assert decontaminate(made(spark, rows[:3], "doc_id long, text string, k boolean"), benchmark.limit(0)).filter("kept").count() == 3
    assert decontaminate(made(spark, []), benchmark).count() == 0


def qualifies(same, item_words):
    """Whether any stretch has enough equal words, and four in five of them equal."""
    need = min(13, -(-4 * item_words // 5))
    upto = np.concatenate([[0], np.cumsum(same)])
    spans = [(upto[j] - upto[i], j - i) for i in range(len(same)) for j in range(i + 1, len(same) + 1)]
    return any(m >= need and 5 * m >= 4 * n for m, n in spans)


@pytest.mark.parametrize("size", [8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 20, 25])
def test_overlaps_wherever_words_are_replaced(size):
    """All places for as many replaced words as the rule allows: seeds and verification together."""
    index = Index([(0, " ".join(f"w{i}" for i in range(size)))])
    texts = []
    for gone in itertools.combinations(range(size), size // 5):
        words = [f"x{i}" if i in gone else f"w{i}" for i in range(size)]
        texts.append(" ".join(["before", *words, "after"]).encode())
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = overlaps(words_of(np.frombuffer(b"".join(texts), np.uint8), offsets, lower=True, blank=SEPARATOR), index)
    assert [f[0] for f in found] == list(range(len(texts)))


def test_overlaps_beside_brute_force():
    rng = random.Random(16)
    for _ in range(600):
        size = rng.randrange(8, 45)
        same = np.array([rng.random() < rng.choice((0.7, 0.8, 0.9)) for _ in range(size)])
        first, length, matched = longest_stretch(same)
        assert matched == same[first : first + length].sum() and 5 * matched >= 4 * length
        item, text = " ".join(f"w{i}" for i in range(size)), " ".join(f"w{i}" if s else "x" for i, s in enumerate(same)).encode()
        words = words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), lower=True, blank=SEPARATOR)
        assert bool(overlaps(words, Index([(0, item)]))) == qualifies(same, size)


def test_decontamination_in_several_passes(spark, monkeypatch):
    from rowtrail.llm import decontaminate as module

    rng = random.Random(15)
    items = [(i, invented(rng, 20)) for i in range(9)]
    docs = made(spark, [(0, items[0][1] + " x " + items[8][1]), (1, "nothing here")])
    monkeypatch.setattr(module, "BLOCK_BYTES", 150)
    found = {r["doc_id"]: sorted(h["item_id"] for h in r["hits"]) for r in decontaminate(docs, made(spark, items, "item_id long, text string")).collect()}
    assert found == {0: [0, 8], 1: []}


def test_chats(spark, monkeypatch):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [
        (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"),
        (-2, 0, None, None), (-2, None, "assistant", "\n\n <|endoftext|>é"), (None, 1, "assistant", ""), (-3, 1, "assistant", "tie"),
        (-3, 1, "assistant", "tie"), (-3, 1, "assistant", "a tie"),
    ] + [(-4, i, ("user", "assistant")[i % 2], f"{i} <|" + "long text " * 300) for i in range(60)]
    turns = turns.unionByName(made(spark, odd, turns.schema))
    expected = defaultdict(list)
    for r in turns.collect():
        turn = r["turn"] if r["turn"] is not None else -(10**9)
        expected[r["conv_id"]].append((turn, r["role"] or "", r["text"] or ""))
    want = {}
    for conv, own in expected.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        text = "".join(f"{role}\n{t}\n" for _, role, t in own)
        want[conv] = (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for part in (1 << 20, 5000):
        monkeypatch.setattr(chat, "PART_CHARS", part)
        found = chat.digests(chat.format_chats(turns)).collect()
        assert {r["conv_id"]: tuple(r)[1:5] for r in found} == want
    assert chat.digests(chat.format_chats(turns.limit(0))).count() == 0


def test_masked_tokens_decode_to_what_was_said(spark):
    library = tokens.encoder(tokens.vocabulary(None)).library
    rows = [(1, 0, "user", "Hi there"), (1, 1, "assistant", " Sure, 12 things:\n\n- one\n"), (1, 2, "user", "ok")]
    row = chat.format_chats(made(spark, rows, "conv_id long, turn long, role string, text string")).first()
    on = [i for i, m in zip(row["input_ids"], row["loss_mask"]) if m]
    assert " Sure, 12 things:\n\n- one" in library.decode(on) and "Hi" not in library.decode(on)
    assert len(row["input_ids"]) == len(row["loss_mask"])


def test_licenses(spark):
    rows = [
        (1, "Some text. Released under the MIT License. And more text about nothing at all."), (2, "licensed UNDER the apache license, version 2.0"),
        (3, "Licensed under the"), (4, None), (5, ""), (6, "word " * 3000 + licenses.TEMPLATES["MIT"][2] + " word" * 500),
        (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (7, "This work is licensed under the GNU General Public License, version 3."),
        (None, "Released under the MIT License."),
    ]
    found = {(r["doc_id"], r["license"]): (r["containment"], r["first_word"]) for r in licenses.license_notices(made(spark, rows)).collect()}
    assert found[1, "MIT"] == (1.0, 2) and found[2, "Apache-2.0"][0] == 1.0 and found[6, "MIT"][1] >= 2900
    assert {k for k in found if k[0] == 7} >= {(7, "CC-BY-NC-4.0"), (7, "MIT"), (7, "GPL-3.0")} and (None, "MIT") in found
    assert not {k for k in found if k[0] in (3, 4, 5)}
    assert licenses.license_notices(made(spark, [])).count() == 0
    plan = licenses.license_notices(made(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_halves_in_two_rows(spark):
    text = licenses.TEMPLATES["MIT"][2].split()
    halves = [" ".join(text[:35]), "... " * 35 + " ".join(text[35:])]
    whole = "before it " * 40 + " ".join(text)
    rows = [(7, halves[0]), (7, halves[1]), (None, halves[0]), (None, halves[1]), (8, halves[0]), (8, whole), (8, whole), (9, "no notice here at all")]
    found = licenses.license_notices(made(spark, rows)).collect()
    assert [(r["doc_id"], r["license"], r["containment"], r["first_word"]) for r in found] == [(8, "MIT", 1.0, 80)]


def test_quality_on_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("toxic", "is_toxic")
    scored = classify(docs, labels.withColumnRenamed("is_toxic", "toxic")).join(labels, "doc_id").collect()
    rate = lambda rows: np.mean([r["kept"] for r in rows])
    assert rate([r for r in scored if r["quality"] == 1 and r["is_toxic"] == 0]) > 0.97
    assert rate([r for r in scored if r["quality"] == 0]) < 0.1
    assert rate([r for r in scored if r["is_toxic"] == 1]) < 0.5


def test_quality_of_odd_rows(spark):
    good = "The sum of the parts is the whole, and it was not for us to say which of them came first."
    rows = [(1, good, 0.5), (1, good, 0.5), (2, None, 0.5), (3, "", 0.5), (None, good, 0.5), (4, "BUY!!! NOW!!! $$$ ### " * 50, 0.5), (5, "w " * 200000, 0.5)]
    found = classify(made(spark, rows, "doc_id long, text string, GOOD double"))
    assert [c for c in found.columns if c.lower() == "good"] == ["good"]
    kept = {(r["doc_id"], r["text"] and r["text"][:3]): r["kept"] for r in found.collect()}
    assert not kept[2, None] and not kept[3, ""] and kept[1, "The"] == kept[None, "The"] and not kept[4, "BUY"]
    assert classify(made(spark, [])).count() == 0
