"""Phrase collocations, repeated substrings and spelling variants, beside plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from rowtrail.llm import phrases, runindex, spelling
from rowtrail.llm.shared import Scratch

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- 11 phrases ------------------------------------------------------------------------------------------


def brute_phrases(rows, least=100, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = set()
        for q, b in cand.items():
            for m in range(2, len(q)):
                inside |= {q[i : i + m] for i in range(len(q) - m + 1) if 100 * b >= 100 * cand[q[i : i + m]]}
        found = []
        for p, a in cand.items():
            if p not in inside:
                cuts = [(int(Fraction(1000 * a * totals[lang], f[p[:k]] * f[p[k:]]) // 1), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def got_phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def spoken(seed=3):
    """Few words, so that phrases repeat, overlap and tie, in pieces cut by all separators."""
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        words = [rng.choice(["Alpha", "beta", "GAMMA", "delta", "ß", "été", "x", "y z", "to be", "to be or not"]) for _ in range(60)]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!?", "; "]) for w in words)
        rows.append((rng.choice(["en", "de", None]), text))
    return rows + [("en", None), (None, ""), ("xx", " \t. "), ("yy", "a b"), ("en", "la " * 30_000), ("en", "la " * 30_000)]


def test_phrases(spark, given, monkeypatch):
    rows = spoken()
    df = spark.createDataFrame(rows, "lang string, text string")
    assert got_phrases(phrases.collocations(df)) == brute_phrases(rows)
    want = brute_phrases(rows, least=8)
    assert got_phrases(phrases.collocations(df, least=8)) == want and len(want) > 50
    assert got_phrases(phrases.collocations(df, least=8, top=7)) == brute_phrases(rows, least=8, top=7)
    # without numbers for words, and in many groups whose prefixes are long
    assert got_phrases(phrases.collocations(df, least=8, small=3)) == want
    monkeypatch.setattr(phrases, "BUDGET", 40)
    assert got_phrases(phrases.collocations(df, least=8)) == want
    assert got_phrases(phrases.collocations(df.repartition(7), least=8, small=3)) == want
    some = [(r["lang"], r["text"]) for r in given.select("lang", "text").collect()]
    assert got_phrases(phrases.collocations(given, least=20)) == brute_phrases(some, least=20)


def test_phrase_scores_are_exact(spark):
    """Products beyond 64 bits."""
    big = 2_000_000_000_000
    q = spark.sql(f"SELECT (CAST({big} AS DECIMAL(19,0)) * CAST(1000 * {3 * big} AS DECIMAL(19,0))) div (CAST({big} AS DECIMAL(19,0)) * CAST(7 AS DECIMAL(19,0))) AS q")
    assert q.first()["q"] == big * 1000 * 3 * big // (big * 7)


def test_phrases_of_odd_tables(spark):
    schema = "lang string, text string, phrase long, n string, h int, score int"
    rows = [("en", "a b " * 60, 1, "x", 2, 3)] * 2 + [(None, None, None, None, None, None)]
    got = got_phrases(phrases.collocations(spark.createDataFrame(rows, schema)))
    assert got == brute_phrases([r[:2] for r in rows])
    assert phrases.collocations(spark.createDataFrame([], schema)).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", "rare words here")], "lang string, text string")).collect() == []


def test_suffixes_in_keys():
    rng = np.random.default_rng(5)
    for codes in (phrases.Codes(np.arange(9).astype(np.uint64), None, None, [], 3), phrases.Codes(None, None, None, [], 3)):
        columns = [rng.integers(0, 9, 50).astype(np.uint64) for _ in range(phrases.DEPTH)]
        back = codes.unpack(codes.pack(columns))
        assert all((x == y).all() for x, y in zip(columns, back, strict=True))


# -- 12 repeated substrings -----------------------------------------------------------------------------------


def brute_repeats(rows, window=200):
    seen = defaultdict(list)
    for r, (_, text) in enumerate(rows):
        b = (text or "").encode()
        for i in range(len(b) - window + 1):
            seen[b[i : i + window]].append((r, i))
    starts = defaultdict(list)
    for places in seen.values():
        if len(places) > 1:
            for r, i in places:
                starts[r].append(i)
    out = []
    for r, (doc, text) in enumerate(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in starts[r]:
            gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got_repeats(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def repeated_rows(seed=9):
    """Passages in ever new surroundings, exact copies, copies with edits, periodic texts, and bytes that break characters."""
    rng = random.Random(seed)

    def prose(n):
        return "".join(rng.choice("abcdefghij  éß€😀\0") for _ in range(n))

    passage, second = prose(260), prose(700)
    rows = [(i, prose(rng.randrange(0, 150)) + passage + prose(rng.randrange(0, 150))) for i in range(40)]
    rows += [(100 + i, prose(90) + second[: 150 + 40 * i] + prose(90)) for i in range(12)]
    base = prose(2000)
    for i in range(10):
        t = list(base)
        for _ in range(i):
            t[rng.randrange(len(t))] = "#"
        rows.append((200 + i, "".join(t)))
    rows += [(300, "ab" * 105), (301, "z" * 199), (302, "y" * 200), (303, "x" * 201), (304, "w" * 5000), (305, prose(400) * 2)]
    rows += [(306, passage[:30] + "q" * 700 + prose(20)), (307, "q" * 650)]
    rows += [(400, "same text " * 40), (401, "same text " * 40), (402, "short"), (403, "short"), (404, None), (405, "")]
    rows += [(None, second), (None, second), (406, second), (406, second), (None, "short"), (407, prose(300_000))]
    return rows


@pytest.mark.parametrize("versions", [1024, 3, 0])
def test_repeated_substrings(spark, versions):
    rows = repeated_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_repeats(runindex.repeated_substrings(df, versions=versions)) == brute_repeats(rows)


def test_repeated_substrings_of_given(spark, given):
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    assert got_repeats(runindex.repeated_substrings(given)) == brute_repeats(rows)


def test_repeated_substrings_in_parts(spark, monkeypatch):
    """Long texts in parts (in this process: workers have the usual size)."""
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd") for _ in range(9000))
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = runindex.blocks_of(data, offsets)
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(whole[1], whole[2], strict=True)])
    assert (covered == np.arange(len(text) - 199)).all()
    monkeypatch.setattr(runindex, "PART", 1000)
    parts = list(runindex._parts(data, offsets))
    assert len(parts) == 9
    seen, anchors = [], {}
    for _, _, some, at, before in parts:
        _, begin, size, anchor, _, _ = runindex.blocks_of(some, at)
        for b, n, a in zip(begin + before, size, anchor, strict=True):
            seen += range(b, b + n)
            anchors |= dict.fromkeys(range(b, b + n), a)
    assert seen == list(range(len(text) - 199))
    assert all(anchors[i] == a for b, n, a in zip(whole[1], whole[2], whole[3], strict=True) for i in range(b, b + n))


def test_repeated_substrings_of_odd_tables(spark):
    schema = "doc_id long, text string, sha string, row long, n_bytes string, anchor int"
    rows = [(1, "k" * 300, "a", 1, "b", 2), (2, "k" * 250, "a", 1, "b", 2), (None, None, None, None, None, None)]
    got = got_repeats(runindex.repeated_substrings(spark.createDataFrame(rows, schema)))
    assert got == brute_repeats([r[:2] for r in rows])
    assert runindex.repeated_substrings(spark.createDataFrame([], schema)).collect() == []
    alone = runindex.repeated_substrings(spark.createDataFrame([(5, "alone")], "doc_id long, text string")).collect()
    assert [tuple(r)[:4] for r in alone] == [(5, 5, 0, 0)]


def test_suffix_array_and_matches():
    rng = random.Random(4)
    for _ in range(60):
        s = np.array([rng.randrange(0, rng.choice([1, 2, 4, 257])) for _ in range(rng.randrange(1, 300))], np.uint16)
        listed = [int(x) for x in s]
        assert list(runindex.suffix_array(s)) == sorted(range(len(s)), key=lambda i: listed[i:])
        match = runindex.RunIndex(s).matching_statistics()
        for i in range(len(s)):
            best = 0
            for j in range(len(s)):
                n = 0
                while j != i and max(i, j) + n < len(s) and listed[i + n] == listed[j + n]:
                    n += 1
                best = max(best, n)
            assert match[i] == best
    repeated = np.array([1, 2, 3, 4, 5] * 200, np.uint16)
    assert runindex.RunIndex(repeated).runs < 12


# -- 13 spelling ---------------------------------------------------------------------------------------------------


def brute_words(rows, least_length=7, least=2):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least}


def brute_forms(words, factor=10):
    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        a, b = sorted((a, b), key=len)
        i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[i + (len(a) == len(b)) :] == b[i + 1 :]

    all_near = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(all_near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(all_near[w]), words[form[w]] if form[w] is not None else None))
    return sorted(out)


def got_forms(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def lexicon(seed=6, size=900):
    """Words of few letters, many of them with one edit between them, in crowds that share their halves; chains of forms and ties."""
    rng = random.Random(seed)
    words = set()
    while len(words) < size:
        w = "".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 7, 7, 8, 8, 9, 12])))
        words |= {w, "internat" + w, w + "ization"}
    words |= {"prefixed" + a + b for a in "abcdefghijklmnopqrst" for b in "abcdefghij"} | {"q" * 400, "q" * 401, "q" * 402, "😀" * 8, "😀" * 7}
    counts = {w: rng.choice([2, 2, 2, 3, 20, 25, 200, 2000]) for w in sorted(words)}
    return counts | {"chainaaa": 2, "chainaab": 20, "chainabb": 200, "chainbbb": 2000}


@pytest.mark.parametrize("group", [64, 4])
def test_spelling_variants(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    words = lexicon()
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(6)
    want = brute_forms(words)
    assert got_forms(spelling.spelling_variants(df)) == want
    assert any(root != form and form for _, form, root, *_ in want)


def test_spelling_of_given(spark, given):
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    words = brute_words(rows)
    counted = spelling.noisy_words(given).groupBy("word").count().filter("count > 1")
    assert {r["word"]: r["count"] for r in counted.collect()} == words
    assert {(w, n) for w, _, _, n, *_ in got_forms(spelling.corpus_spellings(given))} == set(words.items())


def test_spelling_of_odd_tables(spark):
    schema = "doc_id long, text string, word int, n string, run string, h int"
    said = "Reading reading, reaDings READING readinég " * 12
    rows = [(1, said, 1, "x", "r", 1), (1, said, 2, "x", "r", 1), (None, "reading reading", None, None, None, None), (2, None, None, None, None, None)]
    rows.append((3, "tooshort tiny " + "l" * 100_000, 0, "", "", 0))
    rows.append((4, "l" * 100_000, 0, "", "", 0))
    df = spark.createDataFrame(rows, schema)
    assert got_forms(spelling.corpus_spellings(df)) == brute_forms(brute_words([r[:2] for r in rows]))
    assert spelling.corpus_spellings(spark.createDataFrame([], schema)).collect() == []
    twice = spark.createDataFrame([("reading", 2), ("reading", 3), ("readings", 50), (None, 4), ("", 2)], "word string, n long")
    assert got_forms(spelling.spelling_variants(twice)) == brute_forms({"reading": 5, "readings": 50})


def test_near_words_are_met_once(spark):
    words = spark.createDataFrame([("aaaaaaa", 2), ("aaaaaaaa", 2)], "word string, n long")
    met = spelling.near_words(words, Scratch(spark, "near")).collect()
    assert sorted((r["word"], r["n_near"]) for r in met) == [("aaaaaaa", 1), ("aaaaaaaa", 1)]
