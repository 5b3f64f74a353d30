"""The operators with Python on the executors, against brute force."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from graphloom.llm import bm25_decontam, bottomk_dedup, dac_tokens, mil_quality, ngram_trie, shared, toxicity_lexicon

SCHEMA = "doc_id long, text string, lang string, source string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0.5) for i, t in rows], SCHEMA)


def prose(rng, n, letters="etaoinshrdlu"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n "), (None, "a null id here with words"), (4, "same row twice"), (4, "same row twice"), (5, "Über \U0001f642 x"), (6, "long " * 60000)]


# --- 7


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    up = list(range(len(sets)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            up[root(a)] = root(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return [(i, len(s), least.get(root(a)) if s else i) for a, (i, s) in enumerate(sets)]


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else "z" + w for w in words)


def test_dedup_against_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    # small limits, so that long lists, pivots and groups of several blocks all occur
    monkeypatch.setattr(bottomk_dedup, "LIGHT", 6)
    monkeypatch.setattr(bottomk_dedup, "BLOCK", 16)
    base = prose(rng, 120).split()
    common = prose(rng, 60)
    rows = [*ODD, *((100 + i, edited(rng, base, rng.choice([0.01, 0.02, 0.04, 0.06]))) for i in range(90))]
    rows += [(300 + i, prose(rng, 60) + " " + common) for i in range(40)]
    rows += [(400 + i, " ".join(base)) for i in range(30)] + [(500 + i, prose(rng, rng.randint(1, 9))) for i in range(20)]
    rows += [(600 + i, "four words stand here") for i in range(3)] + [(700, "FOUR words stand here")]
    got = bottomk_dedup.dedup(frame(spark, rows)).collect()
    want = brute_components(rows)
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(str, want))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    stay = bottomk_dedup.one_of_each(frame(spark, rows))
    assert stay.columns == frame(spark, rows).columns
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == sorted({str(i) for i, _, c in want if i == c})


def test_one_of_each_with_repeated_ids_and_clashing_names(spark):
    rng = random.Random(5)
    x, y, z = (prose(rng, 40) for _ in range(3))
    rows = [(3, x), (5, x), (5, y), (5, y.upper()), (6, z), (6, z + " end"), (7, y), (8, None), (8, ""), (None, x), (None, None)]
    docs = spark.createDataFrame([(i, t, b"k", 1, "c") for i, t in rows], "doc_id long, text string, set_key binary, n_shingles int, component string")
    got = {(r["doc_id"], r["component_id"]) for r in bottomk_dedup.dedup(docs).collect()}
    assert got == {(3, 3), (5, 3), (5, 5), (6, 6), (7, 5), (8, 8), (None, 3), (None, None)}
    stay = bottomk_dedup.one_of_each(docs)
    assert stay.columns == docs.columns
    # 5 loses its copy of 3's text and keeps the smaller of its two spellings; rows without an id stay
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in stay.collect()))) == sorted(map(str, [(3, x), (5, y.upper()), (6, z), (8, None), (None, x), (None, None)]))


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    assert {r["node"]: r["label"] for r in shared.components(e).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- 8


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")


def test_token_shards_round_trip(spark, tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer)
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "It's", "é", "ß", "Ж", "12", "½", "'ll", "...", "$$", "\x1c", "<|endoftext|>", "日本", "\U0001f642", "word", " we're"]
    rows = [*ODD, *((1000 - i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(120))]
    got = sorted(dac_tokens.encode_documents(frame(spark, rows), tokenizer, 2).collect(), key=lambda r: r["start"])
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids[len(ids) // 2]))
        at += len(ids)
    assert [tuple(r) for r in got] == want


def test_small_shards_and_one_partition(spark, tokenizer, monkeypatch):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(60)]
    whole = sorted(map(tuple, dac_tokens.encode_documents(frame(spark, rows), tokenizer, 2).collect()))
    # several shards in a partition, documents larger than a shard among them
    shards = dac_tokens.write_shards(frame(spark, rows).repartition(2), tokenizer, 2, 150)
    assert shards.groupBy("part").count().agg({"count": "max"}).first()[0] > 3
    assert sorted(map(tuple, dac_tokens.read_shards(shards).collect())) == whole
    # on disk a shard is a row group of its own, as it is
    import pyarrow.parquet as pq

    seen = 0
    for f in shards.inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        for g in range(meta.num_row_groups):
            assert meta.row_group(g).num_rows == 1
            assert {meta.row_group(g).column(c).compression for c in range(meta.num_columns)} == {"UNCOMPRESSED"}
        seen += meta.num_row_groups
    assert seen == shards.count()
    # any id of the corpus by its place
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer)
    every = [x for _, t in rows for x in [*lib.encode(t, add_special_tokens=False).ids, 2]]
    monkeypatch.setattr(dac_tokens, "STRETCH", 100)
    asked = [*range(0, len(every), 13), 0, len(every) - 1, len(every), -1, None]
    got = dac_tokens.tokens_at(shards, spark.createDataFrame([(i,) for i in asked], "place long"))
    assert sorted(map(tuple, got.collect())) == sorted({(i, every[i]) for i in asked if i is not None and 0 <= i < len(every)})


def test_pieces_forgotten_and_learned_again(tokenizer, monkeypatch):
    monkeypatch.setattr(dac_tokens, "REMEMBERED", 50)
    rng = random.Random(5)
    e = dac_tokens.Encoder(tokenizer)
    for _ in range(6):
        texts = [prose(rng, 30) + rng.choice(["", "\x1c", " don't", "\n\n Über1"]) for _ in range(5)]
        assert [x.tolist() for x in e.encode(texts)] == [e.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_codes_reach_any_token():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 2**b, 400) for b in (3, 8, 9, 16, 17, 24, 25, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    first = np.array([0, 0, 5, 700, 700, len(ids)])
    s = dac_tokens.Shard(dac_tokens.pack(ids, first))
    assert [s.token(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
    for k in range(5):
        assert (s.document(k) == ids[first[k] : first[k + 1]]).all()
    for a, b in ((0, 1), (63, 65), (64, 128), (1, 3200), (3199, 3200)):
        assert (s.slice(a, b) == ids[a:b]).all()
    assert dac_tokens.Shard(dac_tokens.pack(np.zeros(0, np.uint32), np.array([0]))).tokens == 0


# --- 10


def test_wand_returns_all_above(spark):
    rng = random.Random(4)
    vocabulary = prose(rng, 120).split()
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40)))) for i in range(90)]
    index = bm25_decontam.Index(items)
    for _ in range(150):
        t = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 60)))
        score = np.zeros(len(index.ids))
        for k in t:
            score[index.postings[k][0]] += index.postings[k][1]
        for least in (0.1, 0.3, 0.5):
            assert sorted(i for i, _ in index.wand(t, least)) == np.flatnonzero(score >= least - 1e-9).tolist()


def test_leaks(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 25).capitalize() + ".\n" + prose(rng, 8) + ".") for i in range(12)] + [(90, None), (91, ""), (92, "word"), (93, "???\nonly an answer"), (94, "only a question\n!")]
    clean = [(i, prose(rng, rng.randint(0, 400))) for i in range(100, 130)] + [(130, "a word in some other text entirely, only an answer and only a question")]
    planted = [(200 + k, prose(rng, 37 * k) + " " + items[k][1].upper() + " " + prose(rng, 50)) for k in range(12)]
    got = bm25_decontam.leaks(frame(spark, [*ODD, *clean, *planted]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(200 + k, k) for k in range(12)}
    # items with further columns, some of them named like those of documents and results
    wide = spark.createDataFrame([(i, t, 5, "x", 0.5) for i, t in items], "item_id long, text string, doc_id int, source string, score double")
    rest = bm25_decontam.without_leaks(frame(spark, [*clean, *planted]), wide)
    assert sorted(r["doc_id"] for r in rest.collect()) == [i for i, _ in clean]


def test_leaks_of_short_items(spark):
    items = spark.createDataFrame([(1, "red fox"), (2, "who? me."), (3, "what is the tallest hill of all? rainhill"), (4, "fox fox")], "item_id long, text string")
    docs = [(10, "a red fox runs"), (11, "fox, red"), (12, "who is it? not me"), (13, "Who, ME"), (14, "what is the tallest hill of all: a) tarn b) rainhill"), (15, "rainhill is a hill"), (16, "the fox " * 40)]
    got = bm25_decontam.leaks(frame(spark, docs), items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(10, 1), (13, 2), (14, 3)]


def test_leaks_of_long_items(spark):
    rng = random.Random(10)
    items = [(k, prose(rng, n).capitalize() + ".\n" + prose(rng, 10) + ".") for k, n in enumerate((30, 55, 118, 246, 390, 590, 1500))]
    clean = [(i, prose(rng, 700)) for i in range(100, 110)]
    planted = [(200 + k, prose(rng, 37 * k + 11) + " " + items[k][1] + " " + prose(rng, 50)) for k in range(7)]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = bm25_decontam.leaks(frame(spark, [*clean, *planted]), items_df).collect()
    assert sorted((r["doc_id"], r["item_id"], r["question_overlap"], r["answer_overlap"]) for r in got) == [(200 + k, k, 1.0, 1.0) for k in range(7)]
    assert sorted(r["doc_id"] for r in bm25_decontam.without_leaks(frame(spark, [*clean, *planted]), items_df).collect()) == [i for i, _ in clean]


def brute_leaks(docs, items):
    """Every passage of two segments against every piece, by the formula; then the overlaps of the whole item."""
    B = bm25_decontam
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    cut = {i: words(t) for i, t in items if words(t)}
    pieces = [(i, [p.tolist() for p in np.array_split(np.array(w, object), -(-len(w) // B.SEGMENT))]) for i, w in cut.items()]
    df = Counter(t for w in cut.values() for t in set(w))
    mean = max(1.0, sum(map(len, cut.values())) / sum(len(p) for _, p in pieces))
    grams = lambda w, n: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
    found = {}
    for d, t in docs:
        w = words(t)
        for s in range(0, max(1, len(w)), B.SEGMENT):
            here = set(w[s : s + 2 * B.SEGMENT])
            for i, ps in pieces:
                best = 0.0
                for p in ps:
                    weight = {x: math.log(1 + (len(cut) - df[x] + 0.5) / (df[x] + 0.5)) * f * (B.K1 + 1) / (f + B.K1 * (1 - B.B + B.B * len(p) / mean)) for x, f in Counter(p).items()}
                    best = max(best, sum(v for x, v in weight.items() if x in here) / (sum(weight.values()) or 1.0))
                if best >= B.THRESHOLD:
                    reach = max(B.SEGMENT, len(cut[i]))
                    near = w[max(0, s - reach) : s + 2 * B.SEGMENT + reach]
                    parts = [words(x) for x in B.split_item(dict(items)[i])]
                    if not all(parts) or (max(map(len, parts)) < 3 and tuple(cut[i]) not in grams(near, len(cut[i]))):
                        continue
                    over = [len(grams(x, min(3, len(x))) & grams(near, min(3, len(x)))) / len(grams(x, min(3, len(x)))) for x in parts]
                    if over[0] >= B.QUESTION and over[1] >= B.ANSWER:
                        found.setdefault((d, i), {})[s] = best
    return found


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(21)
    vocabulary = prose(rng, 150).split()
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(n)).capitalize() + ".\n" + " ".join(some(max(3, n // 8))) + ".") for k, n in enumerate([15, 20, 30, 40, 55, 64, 65, 90, 130, 260, 400, 700, 1900])]
    items += [(20, vocabulary[0]), (21, " ".join(vocabulary[1:3])), (22, " ".join(vocabulary[3:5]) + "\n" + vocabulary[5])]
    docs = [(1, None), (2, ""), (None, "no id " + items[3][1]), (900, items[12][1]), (901, items[21 - 7][1]), (902, items[22 - 7][1])]
    for d in range(100, 240):
        k = rng.randrange(len(items))
        w = items[k][1].split()
        a = rng.randrange(max(1, len(w) // 2))
        part = w[a // 3 : a // 3 + rng.randint(len(w) // 2, len(w))]
        docs.append((d, " ".join(some(rng.randint(0, 150)) + [x if rng.random() > 0.06 else "zz" for x in part] + some(rng.randint(0, 150)))))
    want = brute_leaks(docs, items)
    table = spark.createDataFrame([*items, items[0], (90, None), (91, "")], "item_id long, text string")
    for limit in (bm25_decontam.INDEX_BYTES, 4000):
        monkeypatch.setattr(bm25_decontam, "INDEX_BYTES", limit)
        got = {(r["doc_id"], r["item_id"]): (r["score"], r["passage_start"]) for r in bm25_decontam.leaks(frame(spark, docs), table).collect()}
        assert got.keys() == want.keys() and len(want) > 20
        for k, (score, start) in got.items():
            assert abs(score - max(want[k].values())) < 1e-9 and abs(want[k][start] - score) < 1e-9


# --- 2


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 2**63), (300, 500), (1000, 2**64 - 1), (5000, 2**40)):
        x = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e, _ = ngram_trie.EliasFano.read(ngram_trie.EliasFano.pack(x), 0)
        assert (e.get(np.arange(n)) == x).all()
        q = np.concatenate([x, x + np.uint64(1)])
        assert (e.successor(q, np.zeros(len(q), np.int64), np.full(len(q), n)) == np.searchsorted(x, q)).all()


def test_scores_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(ngram_trie, "SHARD_TRIPLES", 700)
    rng = random.Random(3)
    vocabulary = prose(rng, 60).split()
    rows = [*ODD, *((i, " ".join("the" if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(10, 160)), (170, "unseen-" + prose(rng, 5))]
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c, pairs, begins = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            c.update(tok(t))
            pairs.update(zip([0, *tok(t)[:-1]], tok(t), strict=True))
            begins += 1
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in rows:
        base, model, before = 0.0, 0.0, 0
        for w in tok(t):
            base += math.log10((c[w] + 1) / (n + v + 1))
            p1 = ngram_trie.KNOWN * c[w] / n if c[w] else (1 - ngram_trie.KNOWN) / n
            model += math.log10((pairs[before, w] + ngram_trie.MU * p1) / ((begins if before == 0 else c[before]) + ngram_trie.MU))
            before = w
        want.setdefault(str(i), []).append((held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, base, model))
    got = ngram_trie.score(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[str(r["doc_id"])][0]
        assert tuple(r)[1:5] == w[:4] and r["base_score"] == pytest.approx(w[4], rel=1e-11, abs=1e-9)
        assert abs(r["score"] - w[5]) <= 0.03 * w[1]


def test_hot_token_is_known_after_new_predecessors(spark, monkeypatch):
    monkeypatch.setattr(ngram_trie, "SHARD_TRIPLES", 300)
    rng = random.Random(8)
    vocabulary = sorted(set(prose(rng, 40).split()) - {"hot", "pre"})
    is_held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    # in training texts "hot" stands only after "pre", in the others after every word
    rows = [(i, " ".join(f"{w} hot" for w in vocabulary) if is_held(i) else "pre hot " * 10 + " ".join(vocabulary)) for i in range(150)]
    c, pairs, begins = Counter(), Counter(), 0
    for i, t in rows:
        if not is_held(i):
            c.update([*t.split(), None])
            pairs.update(zip([0, *t.split()], [*t.split(), None], strict=True))
            begins += 1
    n, v, mu = sum(c.values()), len(c), ngram_trie.MU
    got = {r["doc_id"]: r for r in ngram_trie.score(frame(spark, rows)).collect()}
    assert any(is_held(i) for i, _ in rows)
    for i, t in rows:
        words, r = [*t.split(), None], got[i]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)
        model = sum(math.log10((pairs[p, w] + mu * ngram_trie.KNOWN * c[w] / n) / ((c[p] if p else begins) + mu)) for p, w in zip([0, *words], words, strict=False))
        assert r["n_known"] == r["n_tokens"] == len(words)
        assert r["base_score"] == pytest.approx(base, abs=1e-9)
        assert abs(r["score"] - model) <= 0.03 * len(words)


# --- 4 and 5


def labelled(spark, rows, column):
    return spark.createDataFrame([(i, y) for i, y in rows], f"doc_id long, {column} int")


def held_out_accuracy(got, truth):
    hits = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    return sum(hits) / len(hits)


def test_toxicity(spark):
    rng = random.Random(6)
    rows, truth = [], {}
    for i in range(100, 420):
        w = prose(rng, rng.randint(15, 80)).split()
        truth[i] = int(rng.random() < 0.3)
        for _ in range(4 if truth[i] else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "Stуpid", "m0ron", "zorgliax", "zorglien"]))
        if not truth[i] and rng.random() < 0.3:
            w.append("trash can")
        rows.append((i, " ".join(w)))
    labels = labelled(spark, [*truth.items(), (None, 1), (5, None), (9999, 1)], "toxic")
    got = toxicity_lexicon.toxicity(frame(spark, [*ODD, *rows]), labels).collect()
    assert len(got) == len(ODD) + len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert held_out_accuracy(got, truth) > 0.95
    kept = toxicity_lexicon.without_toxic(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and 0.6 < kept.count() / len(rows) < 0.8


def test_ids_of_several_texts_teach_one(spark):
    rng = random.Random(16)
    rows = [(i, prose(rng, 30) + (" zorgliax" if i % 3 == 0 else "")) for i in range(90)]
    rows += [(i, "~ " + prose(rng, 5)) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int, quality int")
    for f in (toxicity_lexicon.toxicity, mil_quality.quality):
        once, again = (sorted((r["doc_id"], r["score"]) for r in f(frame(spark, x).repartition(n), labels).collect()) for x, n in ((rows, 2), (rows[::-1], 5)))
        assert [i for i, _ in once] == [i for i, _ in again] and len(once) == 180
        assert [x for _, x in once] == pytest.approx([x for _, x in again])


def test_lexicon_matches():
    x = toxicity_lexicon.Lexicon({"trash": 1.0, "moron": 2.0, "réeux": 3.0}, {"trash", "moron"})
    found = lambda t: [t[a:b] for a, b, *_ in x.matches(t)]
    assert found("Trash! a trash can, trashy m0r0n### réeuxpa anréeux MORON") == ["Trash", "m0r0n", "réeux", "MORON"]
    fixed = toxicity_lexicon.Lexicon({w: 3.0 for w in toxicity_lexicon.INSULTS}, set(toxicity_lexicon.INSULTS))
    signs = "a55hole l00ser $tupid 1diot 0rdure id10t stop!idiot f00l c1own dumb3 b!tch @sshole Stуpid"
    assert len(fixed.matches(signs)) == len(signs.split())
    assert fixed.matches("a looser grip, 5kg on the 3rd of 2024, mp3 files, class5 and user@host") == []
    assert found(None) == [] and found("") == []


def test_quality(spark):
    rng = random.Random(8)
    rows, truth = [], {}
    for i in range(100, 400):
        truth[i] = int(rng.random() < 0.6)
        t = prose(rng, rng.randint(60, 400))
        rows.append((i, t if truth[i] else t[: len(t) // 2] + " " + " ".join(w + "%%%" for w in t[len(t) // 2 :].split())))
    got = mil_quality.quality(frame(spark, [*ODD, *rows]), labelled(spark, truth.items(), "quality")).collect()
    assert len(got) == len(ODD) + len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert held_out_accuracy(got, truth) > 0.95


def test_attention_gradients():
    rng = np.random.default_rng(1)
    m = mil_quality.Model()
    parts, y, w = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    x = rng.normal(size=(8, mil_quality.FEATURES))
    loss = lambda: -(w * (y * np.log(m.forward(x, parts)["y"]) + (1 - y) * np.log(1 - m.forward(x, parts)["y"]))).sum() / w.sum()
    g = m.gradients(m.forward(x, parts), parts, y, w)
    for k in m.names:
        at = tuple(0 for _ in m.p[k].shape)
        m.p[k][at] += 1e-5
        up = loss()
        m.p[k][at] -= 2e-5
        assert g[k][at] == pytest.approx((up - loss()) / 2e-5, abs=1e-6)
        m.p[k][at] += 1e-5


def test_empty_tables(spark, tokenizer):
    none = spark.createDataFrame([], SCHEMA)
    nothing = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert bottomk_dedup.dedup(none).count() == 0 and dac_tokens.encode_documents(none, tokenizer).count() == 0
    assert ngram_trie.score(none).count() == 0 and toxicity_lexicon.toxicity(none, nothing).count() == 0
    assert mil_quality.quality(none, nothing).count() == 0
    assert bm25_decontam.leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
