"""Language profiles, ranked search and periodic runs, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import periodic_runs, rank_profiles, wand_search
from graphloom.llm.shared import word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, score double, rank int, item long"
ODD = [(1, None), (2, ""), (3, " \n "), (None, "a null id here with words"), (4, "same row twice"), (4, "same row twice"), (5, "Über \U0001f642 x"), (6, "long " * 60000)]


def frame(spark, rows):
    """Documents with further columns, some of them named like results."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0.5, 3, 9) for r in rows], SCHEMA)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# --- 11


def plain_list(text):
    """A text's n-grams of one to three letters by falling count, ties by code points; a blank around each word."""
    words = re.findall(r"[^\W\d_]+", "".join(c.lower() if len(c.lower()) == 1 else c for c in text))
    counts = Counter()
    for w in words:
        counts.update(w)
        w = f" {w} "
        counts.update(w[i : i + 2] for i in range(len(w) - 1))
        counts.update(w[i : i + 3] for i in range(len(w) - 2))
    order = sorted(counts, key=lambda g: (-counts[g], [1 if c == " " else ord(c) for c in g]))
    return counts, order


def speech(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


TONGUES = {"aa": "abcdefgäö", "bb": "efghijkßÉ", "zz": "аbcБвгДж"}


def test_profiles_and_distances_against_plain_lists(monkeypatch):
    monkeypatch.setattr(rank_profiles, "PROFILE", 30)
    rng = random.Random(1)
    texts = [speech(rng, TONGUES[k], rng.randint(0, 60)) for k in TONGUES for _ in range(15)] + ["", "12 ?!", "x", "I'm (k)eeping-it", "한국어 텍스트 한국어"]
    profile = {k: plain_list(" ".join(t for i, t in enumerate(texts[:45]) if i // 15 == n))[1][:30] for n, k in enumerate(TONGUES)}
    packed = lambda g: int.from_bytes(b"".join((1 if c == " " else ord(c)).to_bytes(2, "big") for c in g).ljust(6, b"\0"), "big")
    model = rank_profiles.Profiles([(k, packed(g), r) for k, p in profile.items() for r, g in enumerate(p)])
    for part in (rank_profiles.PART, 7):  # also counted in small parts
        monkeypatch.setattr(rank_profiles, "PART", part)
        got, n = model.distances(texts)
        for i, t in enumerate(texts):
            own = plain_list(t)[1][:30]
            assert n[i] == len(own)
            assert got[i].tolist() == [sum(abs(r - p.index(g)) if g in p else 30 for r, g in enumerate(own)) for p in profile.values()]


def test_languages(spark):
    rng = random.Random(2)
    rows = [(2000 + i, speech(rng, TONGUES[k], 40), k) for i, k in enumerate(rng.choice(list(TONGUES)) for _ in range(120))]
    rows += [*ODD[:4], (700, "11 22 ?", "aa"), (701, rows[0][1], None), (None, rows[1][1], rows[1][2])]
    got = {r["doc_id"]: r for r in rank_profiles.languages(frame(spark, rows)).collect() if r["doc_id"] is not None}
    assert [got[i]["lang_pred"] for i, _, _ in rows[:120]] == [k for _, _, k in rows[:120]]
    assert all(got[i]["held_out"] == (crc(i) % 4 == 2) for i, _, _ in rows[:120])
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1, 2, 3, 700)] == [("und", 0.0)] * 4
    assert got[701]["lang_pred"] == rows[0][2] and 0 < got[701]["score"] <= 1
    assert rank_profiles.languages(frame(spark, rows)).count() == len(rows)
    assert rank_profiles.languages(frame(spark, [])).collect() == []
    # labels of held-out rows and the row's own label are no inputs
    other = [(i, t, "xx") if crc(i) % 4 == 2 else (i, t, *k) for i, t, *k in rows]
    assert {r["doc_id"]: r["lang_pred"] for r in rank_profiles.languages(frame(spark, other)).collect() if r["doc_id"] is not None} == {i: r["lang_pred"] for i, r in got.items()}
    # nothing to learn from: all rows held out, or no language named
    assert {r["lang_pred"] for r in rank_profiles.languages(frame(spark, [(i, "abc", None) for i in range(9)])).collect()} == {"und"}


def test_equal_distances_take_the_first_language(spark):
    ids = [i for i in range(40) if crc(i) % 4 != 2][:6]
    rows = [(i, "abc abd", k) for i, k in zip(ids, ["zz", "bb", "bb", "zz", "mm", "mm"], strict=True)]
    assert {r["lang_pred"] for r in rank_profiles.languages(frame(spark, rows)).collect()} == {"bb"}


# --- 12

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_search(docs, items, k):
    words = [(i, terms(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n, size = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for i, w in words:
            tf = Counter(w)
            m = 25 + 75 * len(w) * n // size
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if t in tf)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("shard", [300, 1 << 24])
def test_search_against_brute_force(spark, shard):
    rng = random.Random(shard)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))
    docs = [*ODD, *((100 + i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(150))]
    docs += [(300 + i, docs[20][1]) for i in range(15)] + [(300, docs[20][1])]  # ties, and a repeated row
    items = [(i, " ".join(rng.choice([word(), docs[20][1][:9], "b-B b"]) for _ in range(rng.randint(1, 12)))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "nowhere else"), (None, "null id of an item"), (3, items[3][1]), (60, docs[20][1])]
    table = spark.createDataFrame([(i, t, 7, 1, 0) for i, t in items], "item_id long, text string, doc_id int, score int, rank int")
    got = wand_search.search(frame(spark, docs), table, 10, shard)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_search(docs, items, 10)


def test_search_of_items_in_parts_and_of_empty_tables(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(9))) for i in range(60)]
    items = [(i, " ".join(rng.choice("abcdefghxyz") for _ in range(4))) for i in range(30)]
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(wand_search, "ITEM_BYTES", 200)
    assert sorted(str(tuple(r)) for r in wand_search.search(frame(spark, docs), table, 3).collect()) == brute_search(docs, items, 3)
    assert wand_search.search(frame(spark, []), table).collect() == []
    assert wand_search.search(frame(spark, docs), table.limit(0)).collect() == []
    assert wand_search.search(frame(spark, [(1, None), (2, "")]), table).collect() == []


def test_wand_skips_documents():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "a", "of", f"w{rng.randint(0, 400)}"]) for _ in range(30)) for _ in range(3000)]
    hashes = [np.unique(word_hashes([t.encode()], True)[0]) for t in texts]
    query = "the of w17 w18 w19 w20".split()
    lists, brute = [], Counter()
    for w, t in zip([1, 1, 50, 50, 50, 50], query, strict=True):
        h = word_hashes([t.encode()], True)[0][0]
        at = [d for d, have in enumerate(hashes) if h in have]
        value = [100 + d % 7 for d in at]
        lists.append((w, wand_search.array("i", at), wand_search.array("i", value)))
        for d, v in zip(at, value, strict=True):
            brute[d] += w * v
    heap = []
    scored = wand_search.best_of_shard(lists, list(range(3000)), 10, heap)
    assert sorted(heap, reverse=True) == sorted(((s, -d) for d, s in brute.items()), reverse=True)[:10]
    assert scored < len(brute) / 3


# --- 13


def brute_runs(w, least=6, times=4):
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                best.setdefault((s, i + q - s), q)
            i = max(i, s + 1)
    return sorted((s, z, q) for (s, z), q in best.items())


def collapsed(w, runs):
    drop = {i for s, z, q in runs for i in range(s + q, s + z)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def looping(rng):
    w = []
    while len(w) < rng.randint(0, 90):
        block = [rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.2:
            block = block * rng.randint(1, 7) + ["z"]
        w += (block * rng.randint(1, 7))[: rng.randint(1, 70)]
    return w


@pytest.mark.parametrize(("least", "times"), [(6, 4), (8, 5), (2, 2), (5, 3), (12, 2)])
def test_runs_against_brute_force(least, times):
    rng = random.Random(least * times)
    for _ in range(400):
        texts = [looping(rng) for _ in range(rng.randint(1, 4))]
        for w, (runs, text) in zip(texts, periodic_runs.runs_of([" ".join(w).encode() for w in texts], least, times), strict=True):
            assert runs == brute_runs(w, least, times)
            assert text.decode() == collapsed(w, runs)


def test_gram_length_is_safe_and_masks_words():
    assert periodic_runs.gram_length(6, 4) == 5
    words = np.array([*range(50), 1, 2, 3, 4, 5, *range(60, 90)])
    covered = periodic_runs.repeated(words, np.zeros(len(words), np.int64), 5)
    assert np.flatnonzero(covered).tolist() == [1, 2, 3, 4, 5, 50, 51, 52, 53, 54]


def test_equal_hashes_are_found_out(monkeypatch):
    # both hashes made blind: only the comparison of words is left
    monkeypatch.setattr(periodic_runs, "mix", lambda h: h * np.uint64(0))
    w = "a b c d a b c d a b c d a b c d x y a a a a a a".split()
    assert [r for r, _ in periodic_runs.runs_of([" ".join(w).encode()])] == [brute_runs(w)]


def test_runs_of_patterns_that_cancel_in_one_hash():
    thue = [str(bin(i).count("1") & 1) for i in range(1 << 12)]
    (runs, _), (long, _) = periodic_runs.runs_of([" ".join(thue * 4).encode(), b"x " * 300_000])
    assert runs == [(0, 4 << 12, 1 << 12)] and long == [(0, 300_000, 1)]


def test_run_query_against_brute_force(spark):
    rng = random.Random(8)
    rows = [*ODD, *((100 + i, "  ".join(looping(rng)) + "  Ä　b") for i in range(150)), *((400 + i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 80)))) for i in range(150))]
    docs = frame(spark, rows)
    text = periodic_runs.with_period(docs["text"], docs["doc_id"])
    got = periodic_runs.digests(periodic_runs.periodic_runs(docs.withColumn("text", text))).collect()
    want = []
    changed = 0
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = crc(i), len(w)
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
            changed += 1
        runs = brute_runs(w) if len(set(w)) > 1 else [(0, n, 1)] if n >= 6 else []
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{z},{q}\n" for s, z, q in runs)), sha(collapsed(w, runs))))
    assert changed > 10
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    assert periodic_runs.periodic_runs(frame(spark, [])).collect() == []
