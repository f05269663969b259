import hashlib
import re

import brute
import pytest
from data import documents, frame

from tablewright.llm.components import connected
from tablewright.llm.exact import drop_copies, exact_groups
from tablewright.llm.repeats import _blind_trie, remove_repeats
from tablewright.llm.simhash import _slots, drop_near_copies, near_groups, tile_links

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _norm(text):
    return SPACE.sub(" ", text or "")


@pytest.mark.parametrize("hot", [20_000, 4])
def test_exact_groups(spark, hot):
    rows = documents()
    groups = {}
    for d, text, *_ in rows:
        groups.setdefault(_norm(text), []).append(d)
    got = {r.doc_id: r for r in exact_groups(frame(spark, rows), hot=hot).collect()}
    assert len(got) == len(rows)
    for d, text, *_ in rows:
        group, r = groups[_norm(text)], got[d]
        assert (r.keep_id, r.group_size, r.kept) == (min(group), len(group), d == min(group))
        assert r.text_sha256 == hashlib.sha256(_norm(text).encode()).hexdigest()
    kept = drop_copies(frame(spark, rows), hot=hot)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_exact_without_ids(spark):
    rows = [(None, "a", None, None, 1), (None, "a", None, None, 1), (4, "a ", None, None, 2), (4, "a ", None, None, 2)]
    got = [(r.keep_id, r.group_size, r.kept) for r in exact_groups(frame(spark, rows)).collect()]
    want = [(4, 2, False), (4, 2, True), (None, 2, False), (None, 2, True)]
    assert sorted(got, key=str) == want
    assert drop_copies(frame(spark, rows)).count() == 2
    assert drop_copies(frame(spark, [])).count() == 0 == exact_groups(frame(spark, [])).count()


def test_near_groups(spark):
    rows = documents()
    fps = [brute.fingerprint(r[1]) for r in rows]
    want = dict(zip([r[0] for r in rows], brute.components([r[0] for r in rows], fps), strict=True))
    got = near_groups(frame(spark, rows)).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == dict(zip([r[0] for r in rows], fps, strict=True))
    assert {r.doc_id: r.component_id for r in got} == want
    kept = drop_near_copies(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_near_groups_without_ids(spark):
    rows = [(None, "q w e", None, None, 1), (None, "r t z", None, None, 1), (3, "q w e", None, None, 1)]
    got = sorted((r.component_id is None, r.component_id) for r in near_groups(frame(spark, rows)).collect())
    assert got == [(False, 3), (False, 3), (True, None)]
    assert sorted(r.text for r in drop_near_copies(frame(spark, rows)).collect()) == ["q w e", "r t z"]
    assert near_groups(frame(spark, [])).count() == 0 == drop_near_copies(frame(spark, [])).count()


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_slots_meet_and_links_hold(spark, radius):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.int64) * 2 + 1
    near = base.copy()
    for _ in range(radius):  # at most `radius` differing bits
        near ^= np.int64(1) << rng.integers(0, 63, 40)
    fps = np.concatenate((base, near))
    frame_ = spark.createDataFrame([(int(f),) for f in fps], "fp long").select(_slots(F.col("fp"), radius).alias("s"))
    slots = [set(r.s) for r in frame_.collect()]
    assert all(slots[i] & slots[i + 40] for i in range(40))
    side = np.zeros(80, np.int64)
    a, b = tile_links(side, side, fps, radius)
    where = {int(f): i for i, f in enumerate(fps)}
    linked = {frozenset((where[int(x)] % 40, where[int(y)] % 40)) for x, y in zip(a, b, strict=True)}
    assert {frozenset((i,)) for i in range(40) if base[i] != near[i]} <= linked


def test_a_crowded_slot_is_tiled(spark, monkeypatch):
    monkeypatch.setattr("tablewright.llm.simhash.TILE", 8)
    rows = documents()
    want = brute.components([r[0] for r in rows], [brute.fingerprint(r[1]) for r in rows])
    got = {r.doc_id: r.component_id for r in near_groups(frame(spark, rows)).collect()}
    assert got == dict(zip([r[0] for r in rows], want, strict=True))


def test_connected(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (7, 3), (60, 50), (50, 70)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 60: 50, 70: 50}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [50_000, 3])
def test_repeats(spark, hot):
    rows = documents()
    want = brute.repeats([r[:2] for r in rows])
    got = remove_repeats(frame(spark, rows), hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    assert sum(w[1] for w in want.values()) > 10_000


def test_repeats_in_pieces(spark, monkeypatch):
    import importlib

    module = importlib.import_module("tablewright.llm.repeats")
    monkeypatch.setattr(module, "PIECE", 700)
    monkeypatch.setattr(module, "BUFFER", 1500)
    texts = [r[:2] for r in documents()]
    batch = _batches(texts)
    rows = [r for b in module._runs(100)(iter([batch])) for r in b.to_pylist()]
    covered = {}
    for r in rows:
        if r["stop"] < 0:
            place, count = r["at"] >> 16, r["at"] >> 8 & 255
            covered.setdefault(r["id"], set()).update(range(place, place + count))
        else:
            covered.setdefault(r["id"], set()).update(range(r["at"], r["stop"] - 99))
    for d, text in texts:
        n = len((text or "").encode())
        assert covered.get(d, set()) == set(range(max(0, n - 99)))


def _batches(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in texts], pa.int64()), pa.array([0] * len(texts), pa.int64()),
         pa.array([None if t is None else t.encode() for _, t in texts], pa.binary())],
        names=["id", "twin", "body"],
    )


def test_repeats_of_equal_and_null_ids(spark):
    text = "word " * 40
    rows = [(1, text, None, None, 0), (1, text, None, None, 0), (None, text, None, None, 0), (None, None, None, None, 0)]
    got = sorted((r.doc_id or 9, r.n_bytes, r.n_removed) for r in remove_repeats(frame(spark, rows)).collect())
    first = brute.repeats([(1, text)])[1][1]  # a text that repeats itself
    assert got == [(1, 200, first), (1, 200, 200), (9, 0, 0), (9, 200, 200)]
    assert remove_repeats(frame(spark, [])).count() == 0


def test_repeats_with_a_null_id_in_a_third_of_the_rows(spark):
    rows = documents()
    several = [(None if i % 3 == 0 else r[0], *r[1:]) for i, r in enumerate(rows)]
    got = remove_repeats(frame(spark, several)).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == -(-len(rows) // 3)
    # Rows without an id come last: the others are as they would be by themselves.
    want = brute.repeats([r[:2] for r in several if r[0] is not None])
    known = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None}
    assert known == want


def test_repeats_with_one_anchor_in_every_row(spark):
    phrase = "the very same words stand in each of all these documents here and there, " * 2
    rows = [(i, f"{i * 7919:07d} {phrase}{i:05d}" + "x" * (i % 7), None, None, 0) for i in range(90)]
    for hot in (50_000, 5):
        got = remove_repeats(frame(spark, rows), hot=hot).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeats([r[:2] for r in rows])


def test_blind_trie_orders_like_sorting():
    import random

    rng = random.Random(1)
    for _ in range(500):
        strings = list({bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 9))) for _ in range(12)})
        assert [strings[i] for i in _blind_trie(strings)] == sorted(strings)
