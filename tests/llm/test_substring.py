"""Passages that share few keys, or keys with many documents."""

import random

import numpy as np

import corpus_pipeline
from corrolla.llm import substring_dedup as S
from corrolla.llm.shingles import mix, shingle_values, word_values


def prose(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def shingles(words):
    return shingle_values(word_values(" ".join(words)), 5)


def keys(words):
    x = shingles(words)
    return set(S.compact_windows(x, np.array([0, len(x)]), 4, 46)[1].tolist())


def found(spark, texts):
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in (texts.items() if isinstance(texts, dict) else texts)], "doc_id long, text string")
    return {tuple(r)[:4] for r in S.substring_duplicates(rows).collect()}


def test_compact_windows_hold_every_sequence_once():
    """Every sequence of 5 or more lies in exactly one window whose key is its least value, also where values repeat, and
    holds a place of it that is at most 4 from a place listed."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, most, n).astype(np.uint64) for most, n in ((1 << 60, 40), (6, 60), (1, 30), (9, 4), (9, 0), (3, 5))]
    starts = np.cumsum([0, *map(len, texts)])
    text, key, place, first, last = S.compact_windows(np.concatenate(texts), starts, 2, 5)
    for t, x in enumerate(texts):
        for k in range(2):
            value = mix(x ^ np.uint64(0xA0761D6478BD642F * (k + 1) & (1 << 64) - 1)) & ~np.uint64(7) | np.uint64(k)
            mine = (text == t) & ((key & 7) == k)
            rows = list(zip(key[mine].view(np.uint64).tolist(), place[mine].tolist(), first[mine].tolist(), last[mine].tolist()))
            for v, p, a, b in rows:
                assert a <= p <= b and b - a >= 4 and value[p] == v == value[a : b + 1].min()
            assert len(rows) <= len(x)
            for a in range(len(x)):
                for b in range(a + 4, len(x)):
                    least = int(value[a : b + 1].min())
                    assert len({(v, f, u) for v, _, f, u in rows if v == least and f <= a and b <= u}) == 1
                    assert any(v == least and a - 4 <= p <= b + 4 and f <= a and b <= u for v, p, f, u in rows)


def test_a_text_of_one_word_gives_few_windows(spark):
    x = shingles(["same"] * 100_000)
    text, key, place, first, last = S.compact_windows(x, np.array([0, len(x)]), 4, 46)
    assert len(set(key.tolist())) == 4 and len(key) <= 4 * (len(x) // 46 + 1) and set(first.tolist()) == {0} and set(last.tolist()) == {len(x) - 1}
    assert found(spark, {1: ["same"] * 100_000, 2: ["same"] * 70_000, 3: ["other"]}) == {(2, 0, 70_000, 1)}


def covered(rows, spans):
    """Words that brute force over all pairs of texts finds to repeat an earlier one, and the longest run of them left uncovered."""
    texts = sorted({(i, S.text_hash(word_values(" ".join(w)))): w for i, w in rows if i is not None}.items())
    of, most, true, first = {}, 0, 0, {}
    for i, a, b, _, t in spans:
        of.setdefault((i, t), []).append((a, b))
    for n, (unit, w) in enumerate(texts):
        if len(w) < 50:
            assert unit not in of
            continue
        if unit[1] in first:
            if unit[0] != first[unit[1]]:
                assert of[unit] == [(0, len(w))]
            continue
        first[unit[1]] = unit[0]
        cover = np.zeros(len(w), bool)
        for a, b in of.get(unit, []):
            cover[a:b] = True
        for earlier, v in texts[:n]:
            for _, _, f, u in S.shared_passages(shingles(v), shingles(w), 5, 80, 50):
                true += u + 5 - f
                run = 0
                for c in cover[f : u + 5]:
                    run = 0 if c else run + 1
                    most = max(most, run)
    return true, most


def test_substring_duplicates_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    passages = [prose(rng, rng.randrange(50, 120)) for _ in range(12)]
    line = prose(rng, 20)
    rows = []
    for n in range(200):
        w = prose(rng, rng.randrange(0, 60))
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(passages))
            for _ in range(rng.randrange(3)):
                p[rng.randrange(len(p))] = f"x{rng.randrange(10**6)}"
            w += p + prose(rng, rng.randrange(0, 40)) + (line if rng.random() < 0.5 else [])
        rows.append((rng.randrange(150), w))  # ids repeat with other texts
    rows += rows[:10] + [(500 + i, w) for i, w in rows[20:30]] + [(None, rows[0][1])]
    df = spark.createDataFrame([(i, " ".join(w), 1) for i, w in rows], "doc_id long, text string, key int")
    spans = [tuple(r) for r in S.substring_duplicates(df).collect()]
    true, most = covered(rows, spans)
    assert true > 5000 and most < 50
    monkeypatch.setattr(S, "BLOCK", 6)  # keys in many windows are thinned and dealt
    again = [tuple(r) for r in S.substring_duplicates(df).collect()]
    assert sorted(spans) == sorted(again)


def test_the_other_text_of_a_repeated_id_stays(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(prose(rng, 70)) for _ in range(3))
    df = spark.createDataFrame([(1, a), (1, a), (5, a), (5, b), (7, c)], "doc_id long, text string")
    got = sorted(tuple(r) for r in S.cut_passages(df, S.substring_duplicates(df)).collect())
    assert got == sorted([(1, a), (1, a), (5, ""), (5, b), (7, c)])


def test_one_agreeing_hash_is_enough(spark):
    texts, pairs = {}, []
    for seed in range(3000):
        rng = random.Random(seed)
        a = prose(rng, 60)
        b = [*a]
        b[rng.randrange(10, 50)] = "changed"
        if len(keys(a) & keys(b)) == 1 and S.shared_passages(shingles(a), shingles(b), 5, 80, 50):
            pairs.append((2 * seed, 2 * seed + 1))
            texts |= {2 * seed: a, 2 * seed + 1: b}
        if len(pairs) == 3:
            break
    assert len(pairs) == 3
    assert {(b, a) for b, _, _, a in found(spark, texts)} == {(b, a) for a, b in pairs}


def test_a_source_after_many_first_documents_of_its_keys(spark):
    rng = random.Random(5)
    passage = prose(rng, 60)
    source, target = prose(rng, 80) + passage + prose(rng, 80), prose(rng, 90) + passage + prose(rng, 70)
    values, texts = shingles(source), {1000: source, 1001: target}
    for key in keys(source) & keys(target):
        hashed = mix(values ^ np.uint64(0xA0761D6478BD642F * ((key & 7) + 1) & (1 << 64) - 1))
        place = (hashed & ~np.uint64(7) | np.uint64(key & 7)).view(np.int64).tolist().index(key)
        for _ in range(6):  # unrelated documents with the key
            other = []
            while key not in keys(other):
                other = prose(rng, 25) + source[place : place + 5] + prose(rng, 25)
            texts[len(texts)] = other
    [(doc, start, end, by)] = found(spark, texts)
    assert (doc, start, end, by) == (1001, 90, 150, 1000)


def test_windows_without_enough_in_common_alone_are_left_out():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60):
        x = rng.integers(0, 20, n).astype(np.uint64)
        for size in (1, 7, 46):
            k = min(size, n)
            assert S._distinct(x, size).tolist() == [len(set(x[i : i + k].tolist())) for i in range(n - k + 1)]


def test_stock_phrases_do_not_cut_a_passage():
    rng = random.Random(1)
    passage = prose(rng, 60)
    changed = [*passage]
    changed[29] = "changed"
    source = prose(rng, 30) + passage[30:35] + prose(rng, 100) + passage + prose(rng, 30)  # what follows the edit stands earlier, too
    [(_, _, first, last)] = S.shared_passages(shingles(source), shingles(changed), 5, 80, 50)
    assert (first, last) == (0, 55)
    stock = prose(rng, 6)  # words put in that stand elsewhere
    source = stock + prose(rng, 100) + passage + prose(rng, 30)
    got = S.shared_passages(shingles(source), shingles(passage[:30] + stock + passage[30:]), 5, 75, 50)
    assert (0, 61) in [x[2:] for x in got]


def among_many(seed, n):
    """Texts 1000 and 1001, alike, that share one key, and n unrelated ones with that key before them."""
    rng = random.Random(seed)
    a = prose(rng, 60)
    b = [*a]
    b[rng.randrange(10, 50)] = "changed"
    [key] = keys(a) & keys(b)
    hashed = mix(shingles(a) ^ np.uint64(0xA0761D6478BD642F * ((key & 7) + 1) & (1 << 64) - 1))
    place = (hashed & ~np.uint64(7) | np.uint64(key & 7)).view(np.int64).tolist().index(key)
    texts = {1000: a, 1001: b}
    for i in range(n):
        texts[i] = []
        while key not in keys(texts[i]):
            texts[i] = prose(rng, 25) + a[place : place + 5] + prose(rng, 25)
    return texts


def test_a_pair_is_found_among_any_number_of_texts_with_its_key(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 6)
    for seed in (2979, 3359):
        few, many = found(spark, among_many(seed, 2)), found(spark, among_many(seed, 20))
        assert few == many and [(b, a) for b, _, _, a in many] == [(1001, 1000)]


def test_the_stage_cuts_a_passage_among_any_number_of_texts_with_its_key(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 6)
    for n in (2, 20):
        texts = among_many(6655, n)
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
        left = {r["doc_id"]: r["text"].split() for r in corpus_pipeline.repeated_passages(spark, df, "").collect()}
        assert left.pop(1001, []) != texts.pop(1001) and left == texts


def test_blocks_and_tiles_give_what_holding_all_at_once_gives(monkeypatch):
    """The best earlier window of each open one is the same, however many are held against each other at once."""
    rng = np.random.default_rng(8)
    stock, base, rows = rng.integers(0, 1 << 16, 16), rng.integers(0, 1 << 16, 91), []
    for n in range(60):
        x = rng.integers(0, 1 << 16, 91)
        x[38:54] = stock
        if n % 3 == 0:
            x = base.copy()
            x[rng.integers(46, 80) :][:6] = rng.integers(0, 1 << 16, 6)
        rows.append((n - 60, 7, int(rng.integers(0, 40)), n, 45, n % 5 > 0, x.astype(np.uint16).tobytes()))
    held = {c: list(v) for c, v in zip(("part", "key", "_u", "place", "left", "open", "prints"), zip(*rows))}
    whole = S._earliest_alike(held, 5, 80, 50)
    monkeypatch.setattr(S, "TILE", 7)
    monkeypatch.setattr(S, "CLOSEST", 2)
    assert len(whole) > 5 and S._earliest_alike(held, 5, 80, 50) == whole
