import random

import corpus_pipeline
import numpy as np
import pytest
from data import documents, frame

from tablewright.llm import minhash, simhash
from tablewright.llm.minhash import (
    BATCH,
    HASHES,
    drop_near_duplicates,
    near_duplicates,
    needed_matches,
    shingle_set,
    signature,
    survivors,
)


def shingles(text, width):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def components(rows, width, least=80):
    """doc_id: (size of its set, least id reachable), by comparing all pairs."""
    sets, root = [shingles(r[1], width) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= least * len(a | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        first[find(i)] = min(first.get(find(i), r[0]), r[0])
    return {r[0]: (len(sets[i]), first[find(i)]) for i, r in enumerate(rows)}


def planted(seed=4):
    """Edits of a few words in a hundred, a chain of edits, boilerplate in a third of the rows, copies."""
    rng = random.Random(seed)
    texts = []
    for n in (8, 60, 150, 400):
        for edits in (1, 2, n // 100 + 1, n // 50 + 1, n // 30, n // 12):
            words = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(words))
            for at in rng.sample(range(n), edits):
                words[at] = "edited"
            texts.append(" ".join(words).upper())
    chain = [f"c{i}" for i in range(300)]
    for at in range(0, 120, 6):
        chain[at : at + 6] = [f"n{at}"] * 6
        texts.append(" ".join(chain))
    license_ = " ".join(f"l{i}" for i in range(150))
    for i in range(60):  # all share slots, few are similar enough
        texts.append(license_ + " " + " ".join(f"o{i}x{k}" for k in range(rng.randint(10, 70))))
    base = [f"b{i}" for i in range(200)]
    for i in range(60):  # a group of near copies, all different
        words = [*base]
        for at in rng.sample(range(200), rng.randint(1, 14)):
            words[at] = f"e{i}"
        texts.append(" ".join(words))
    texts += [None, "", " \n", "one two", "ONE  two", "one", *[texts[3]] * 20]
    rng.shuffle(texts)
    return [(i * 3, t, None, "s", 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("part,width", [(256, 4), (4, 4), (16, 5)])
def test_near_duplicates(spark, monkeypatch, part, width):
    monkeypatch.setattr(minhash, "PART", part)
    monkeypatch.setattr(minhash, "QUERIES", part)
    monkeypatch.setattr(minhash, "STREAM", 16 * part)
    rows = planted()
    got = near_duplicates(frame(spark, rows), width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_without_rounds_the_rest_is_exact(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GAIN", 0)  # one round, then all that is left
    monkeypatch.setattr(minhash, "PART", 8)
    monkeypatch.setattr(minhash, "QUERIES", 8)
    monkeypatch.setattr(minhash, "HELD", 2000)
    monkeypatch.setattr(minhash, "STREAM", 20)
    rows = planted(7)
    got = near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, 4)


def test_odd_rows(spark):
    rows = documents()
    got = near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, 4)
    kept = drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    want = {c for _, c in components(rows, 5).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    text = {r[0]: r[1] for r in rows}
    assert all(r.text == text[r.doc_id] and r.row == "y" for r in kept.collect())


def test_null_and_repeated_ids(spark):
    rows = [(None, "q w e r t", None, None, 1), (None, "r t z u i", None, None, 1), (None, "r t z u i", None, None, 1),
            (3, "q w e r t", None, None, 1), (3, "q w e r t", None, None, 1), (None, None, None, None, 0)]
    got = sorted(
        ((r.doc_id or 0, r.component_id or 0, r.n_shingles, r.kept) for r in near_duplicates(frame(spark, rows)).collect())
    )
    assert got == [(0, 0, 0, True), (0, 0, 2, True), (0, 0, 2, True), (0, 3, 2, False), (3, 3, 2, True), (3, 3, 2, True)]
    left = drop_near_duplicates(frame(spark, rows), width=4).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, ""), (0, "r t z u i"), (3, "q w e r t")]
    assert near_duplicates(frame(spark, [])).count() == 0 == drop_near_duplicates(frame(spark, [])).count()


def test_bayes_gives_up_few_true_pairs():
    """Recall, measured on 20,000 pairs of sets at 0.8, and pruning of those far below."""
    needed = needed_matches(0.8, 1e-6)
    assert len(needed) == HASHES // BATCH and sorted(needed) == needed
    rng = np.random.default_rng(3)
    counts = {}
    for similarity in (0.8, 0.5, 0.2):
        agree = rng.random((20_000, HASHES)) < similarity
        a = np.zeros((20_000, HASHES), np.uint32)
        counts[similarity] = len(survivors(a, (~agree).astype(np.uint32), needed))
    assert counts[0.8] >= 19_999
    assert counts[0.5] < 200 and counts[0.2] == 0


def test_recall_of_bands():
    """Of 2,000 pairs of sets at 0.8 all share a band."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(2000):
        both = np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))
        a, b = signature(both[:90]), signature(both[10:])
        missed += not (a == b).reshape(minhash.BANDS, minhash.ROWS).all(axis=1).any()
    assert missed == 0


def test_shingle_set():
    assert len(shingle_set(b"a b  C\nd e a B c d", 4)) == 5
    assert (shingle_set(b"A b", 4) == shingle_set(b"a\tb ", 4)).all() and len(shingle_set(b" \x0b", 4)) == 0


def test_fingerprints_propose_links_that_are_verified(spark, monkeypatch):
    """In the pipeline's stage: one word of 600 changed is within three bits; texts that one repeated shingle
    dominates have one fingerprint, and are below the least similarity."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in rng.integers(0, 10_000, 600)]
    close = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in (0, 599)]
    apart = [" ".join(["a"] * 500 + [f"{x}{i}" for i in range(40)]) for x in "xyz"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([" ".join(words), *close, *apart])]
    monkeypatch.setattr(minhash, "similar_links", lambda *args: args[-1])
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    assert got == {0, 3, 4, 5}
    print_of = {d: simhash.fingerprint(t.encode(), 5) for d, t, *_ in rows}
    assert all(bin((print_of[0] ^ print_of[d]) & (1 << 64) - 1).count("1") <= 3 for d in (1, 2))
    assert print_of[3] == print_of[4] == print_of[5]
