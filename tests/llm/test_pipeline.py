import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from corrolla.llm import secrets, substring_dedup as S
from corrolla.llm.shingles import shingle_values, word_values

SF = "/root/testdata/sf0.001"
EXTRA = "_id _t _u key label node n score spans words keys digest text_hash source_id rank".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**5)}" for _ in range(n)) + "."


def plain_sets(texts):
    return [set(np.unique(shingle_values(word_values(t or ""), 5)).tolist()) for t in texts]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage over the table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append((docs, after))
        docs = after
    return out


def test_stages_in_order_keep_the_columns(stages):
    ids = {r[0] for r in stages[0][0].select("doc_id").collect()}
    for before, after in stages[:-1]:
        assert after.columns == before.columns
        now = {r[0] for r in after.select("doc_id").collect()}
        assert now <= ids and now
        ids = now
    assert {r[0] for r in stages[-1][1].select("doc_id").distinct().collect()} == ids


def test_near_duplicates_stage_brute_force(stages):
    before, after = ([(r["doc_id"], r["text"]) for r in x.collect()] for x in stages[1])
    before.sort()
    sets, gone = plain_sets([t for _, t in before]), list(range(len(before)))

    def root(x):
        while gone[x] != x:
            x = gone[x]
        return x

    for j in range(len(before)):
        for i in range(j):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                gone[b] = a
    assert sorted(after) == [d for k, d in enumerate(before) if root(k) == k]


def test_repeated_passages_stage_brute_force(stages):
    """Where all pairs of texts share no passage nothing is cut; what is left shares none, and no word comes from elsewhere."""
    before, after = (sorted((r["doc_id"], r["text"]) for r in x.collect()) for x in stages[2])
    left = dict(after)
    values = [(i, t, shingle_values(word_values(t or ""), 5)) for i, t in before]
    for n, (i, t, v) in enumerate(values):
        repeats = [p for _, _, w in values[:n] for p in S.shared_passages(w, v, 5, 80, 50)]
        if not repeats:
            assert left.get(i, "") == (t or "") or not (t or "").split()
        else:
            assert not Counter(left.get(i, "").split()) - Counter(t.split())
            covered = set().union(*(range(f, u + 5) for _, _, f, u in repeats))
            assert len(t.split()) - len(left.get(i, "").split()) <= len(covered) + 50
    for n, (_, t) in enumerate(after):
        for _, s in after[:n]:
            assert not S.shared_passages(shingle_values(word_values(s or ""), 5), shingle_values(word_values(t or ""), 5), 5, 80, 50)


def test_secret_stage_brute_force(stages):
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in stages[3])
    for i, t in before.items():
        found = sorted((m.start(), k, m.end(), r.kind) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.compiled, t or "") if m.end(r.group) - m.start(r.group) >= r.least)
        out, at = "", 0
        for a, _, b, kind in found:
            if a >= at:
                out += t[at:a] + f"[{kind}]"
            at = max(at, b)
        assert after[i] == (out + t[at:] if t is not None else None)


def test_packing_stage_holds_every_token_once(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] or "" for r in stages[4][0].collect()}
    pieces, used = {}, {}
    for r in stages[4][1].collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in texts.items():
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(tok.encode(t, add_special_tokens=False).ids) + 1
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= corpus_pipeline.WINDOW


def test_stages_on_awkward_rows(spark):
    rng = random.Random(12)
    a, b, c = prose(rng, 90), prose(rng, 90), prose(rng, 90) + " password = hunter2hunter2"
    texts = [(1, a), (1, a), (5, a), (5, b), (7, c), (None, c), (None, "no id"), (6, None), (8, ""), (9, " \n\t"), (10, prose(rng, 20_000)), (11, "x" * 30_000), (12, "same " * 5000)]
    rows = [(i, t, None, None, len(t or ""), *["x"] * len(EXTRA)) for i, t in texts]
    docs, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
    got = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES}
    for name, df in list(got.items())[:-1]:
        assert df.schema.simpleString() == docs.schema.simpleString(), name
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    quality = Counter(key(got["quality classifier"]))
    assert all(n == Counter(texts)[x] for x, n in quality.items())  # whole rows go or stay, each as often as it comes
    near = key(got["near-duplicates"])
    assert Counter(i for i, _ in near) == Counter({1: 1, 5: 1, 7: 1, None: 1, 6: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1}) and (5, b) in near and (None, "no id") in near
    cut = key(got["repeated passages"])
    assert (5, b) in cut and cut.count((1, a)) == 2 and (5, a) not in cut and (6, None) in cut and (None, c) in cut and 8 not in dict(cut)
    kept = {(r["doc_id"], r["n_chars"]) for r in got["repeated passages"].collect()}
    assert all(n is None or n == len(t) for i, t in cut if t is not None for j, n in kept if (i, t) == (10, t) and j == 10)
    clean = key(got["secret spans"])
    assert len(clean) == len(texts) and (6, None) in clean and sum("[assign]" in (t or "") for _, t in clean) == 2
    pieces = got["packing"].groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in pieces} == {i for i, _ in texts} and dict((r[0], r[1]) for r in pieces)[6] == 1
