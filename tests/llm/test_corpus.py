import json
import random
import zlib
from collections import defaultdict
from math import isclose

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from data import SCHEMA, documents, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import grammar, tokens
from tablewright.llm.codes import code_of, top_k
from tablewright.llm.language import held_out, identify
from tablewright.llm.mixing import mix, mixed_documents
from tablewright.llm.packing import pack_documents, plan_sequences
from tablewright.llm.quality import isotonic, quality_scores
from tablewright.llm.scoring import backoff_scores
from tablewright.llm.stages import settle

FILE = public_tokenizers.path("byte_bpe_50k.json")


def library():
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def targets(sizes: dict, weights=(5, 2, 1), share=1.5):
    """Shares given out again and again until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: dict = {}
    while True:
        left = share * sum(sizes.values()) - sum(full.values())
        open_ = [s for s in order if s not in full]
        given = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = [s for s in open_ if given[s] > 2 * sizes[s]]
        if not above:
            return full | given
        full |= {s: 2 * sizes[s] for s in above}


def test_mix(spark):
    rows = documents()
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = defaultdict(int)
    for d, s in source.items():
        sizes[s] += size[d]
    want = targets(sizes)
    mixed = mix(frame(spark, rows))
    got = mixed.drop("row").collect()
    taken = defaultdict(int)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source[r.doc_id]])
        assert isclose(r.target, want[source[r.doc_id]], rel_tol=1e-12)
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = {r.doc_id: r.taken for r in mix(frame(spark, rows, parts=7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    out = mixed_documents(mixed, frame(spark, rows).columns).collect()
    words = defaultdict(int)
    text = {r[0]: r[1] for r in rows}
    for r in out:
        assert text[r.doc_id].startswith(r.text)
        words[r.doc_id] += len(r.text.encode().split())
    assert words == {d: n for d, n in again.items() if n}


def test_mix_of_nothing(spark):
    assert mix(frame(spark, [])).count() == 0
    got = mix(frame(spark, [(1, None, None, None, 0), (None, "", "x", "s", 0)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_tokens_are_the_library_s():
    rng = random.Random(5)
    texts = ["", " ", "  a  b", "a\n b \n\n c", "x y   z", "don't we'll !'s 'tis 3's", "\x1c a\x1cb", "a" * 300]
    texts += ["".join(rng.choice(" \n\t  ab'sé1.!\x1c") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += [r[1] or "" for r in documents()]
    encode = library()
    got = list(tokens.encode(pa.array([t.encode() for t in texts], pa.binary()), FILE))
    assert [g.tolist() for g in got] == [encode(t) for t in texts]


def _with_added_tokens():
    end, rng = "<|endoftext|>", random.Random(6)
    texts = [f"a{end}b", end, f"{end}{end}", f"{end[:-1]}{end}", f"a  {end}  b\n", f" {end}\n\n c", f"é{end}é"]
    texts += [f"<|{end}|>", "<|endoftext|", "no token", "", f"it{end}'s", f"12{end}34", end.upper()]
    return texts + ["".join(rng.choice([end, " ", "\n", "ab", "'s", "é", "1", "<|"]) for _ in range(rng.randint(0, 20))) for _ in range(300)]


def test_added_tokens_are_the_library_s():
    untouched, texts = Tokenizer.from_file(FILE), _with_added_tokens()
    got = list(tokens.encode(pa.array([t.encode() for t in texts], pa.binary()), FILE))
    assert got[0].tolist() == [64, 50256, 65]
    assert [g.tolist() for g in got] == [untouched.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("flag", ["lstrip", "rstrip", "single_word"])
def test_added_tokens_with_rules_are_the_library_s(tmp_path, flag):
    from tokenizers import AddedToken

    untouched, texts = Tokenizer.from_file(FILE), _with_added_tokens()
    untouched.add_tokens([AddedToken("ab", normalized=False, **{flag: True})])
    untouched.save(str(tmp_path / "more.json"))
    got = list(tokens.encode(pa.array([t.encode() for t in texts], pa.binary()), str(tmp_path / "more.json")))
    assert [g.tolist() for g in got] == [untouched.encode(t, add_special_tokens=False).ids for t in texts]


def _changed(tmp_path, change):
    import json

    with open(FILE) as file:
        content = json.load(file)
    change(content)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(content))
    return str(path)


@pytest.mark.parametrize("change", [
    lambda f: f.update(normalizer={"type": "Lowercase"}),
    lambda f: f["pre_tokenizer"].update(add_prefix_space=True),
    lambda f: f["pre_tokenizer"].update(use_regex=False),
    lambda f: f["model"].update(ignore_merges=True),
])
def test_other_tokenizers_get_whole_texts(tmp_path, change):
    path, texts = _changed(tmp_path, change), ["Ab  c'S \n d", "", "x 12 é", "Ünïcode  Straße <|endoftext|>!"]
    untouched = Tokenizer.from_file(path)
    got = list(tokens.encode(pa.array([t.encode() for t in texts], pa.binary()), path))
    assert [g.tolist() for g in got] == [untouched.encode(t, add_special_tokens=False).ids for t in texts]
    words = public_tokenizers.path("word_bpe_49k.json")
    got = list(tokens.encode(pa.array([t.encode() for t in texts], pa.binary()), words))
    untouched = Tokenizer.from_file(words)
    assert [g.tolist() for g in got] == [untouched.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("capacity", [1024, 64])
def test_packing(spark, capacity):
    rows = documents()
    got = pack_documents(frame(spark, rows), FILE, capacity).collect()
    by, sequences, encode = defaultdict(list), defaultdict(list), library()
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for d, text, *_ in rows:
        ids, at = [*encode(text), 2], 0
        for i, r in enumerate(sorted(by[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at)
            assert r.length == capacity or i == 0
            assert brute.crc(ids[at : at + r.length]) == r.ids_crc32
            at += r.length
        assert at == len(ids)
        total += at
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= total / capacity * 1.08 + 2
    assert pack_documents(frame(spark, []), FILE, capacity).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.lognormal(4, 1, 5000).astype(int) + 1, 256)
    histogram = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True)), strict=True))
    plan = plan_sequences(histogram, 256)
    used = defaultdict(int)
    for pattern, times in plan:
        assert sum(pattern) <= 256 and times > 0
        for v in pattern:
            used[v] += times
    assert used == histogram
    assert sum(t for _, t in plan) <= lengths.sum() / 256 * 1.01 + 1
    assert plan_sequences({}, 256) == []


def test_language_scores_are_plain_out_of_place_distances(spark):
    rows = [r for r in documents() if len(r[1] or "") < 30_000]
    rows += [(500 + i, t, lang, None, 0) for i, (t, lang) in enumerate(
        [("Das ist ein Haus, die Straße", "de"), ("the house and the street", "en"), ("ÀÉ x", None), ("Ωμέγα", "el")] * 9
    )]
    train = [(t, lang) for d, t, lang, *_ in rows if zlib.crc32(str(d).encode()) % 3 != 1 and t and lang]
    profiles = brute.language_profiles(train)
    got = {r.doc_id: r for r in identify(frame(spark, rows))[0].collect()}
    for d, text, *_ in rows:
        lang, score = brute.language(text, profiles)
        assert got[d].lang_pred == lang and isclose(got[d].score, score, abs_tol=1e-12)
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)


@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_grams_of_texts_in_pieces(monkeypatch, piece):
    from tablewright.llm import language

    monkeypatch.setattr(language, "PIECE", piece)
    rng = random.Random(3)
    texts = ["", " ", "a", " a", "ab", "  ab  c", "É1é"]
    texts += ["".join(rng.choice("abÉ .1") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for text in texts:
        key, n = language.gram_counts(text)
        assert dict(zip(key.tolist(), n.tolist(), strict=True)) == dict(brute.language_grams(text))


def test_language(spark):
    rng = random.Random(1)
    letters = {"one": "abcdeo", "two": "xyzuvi", "ру": "абвгдя"}
    rows = []
    for i in range(240):
        lang = [*letters][i % 3]
        text = " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(4, 40)))
        rows.append((i, text, lang, None, 0))
    rows += [(300, None, "one", None, 0), (301, "12 ...", "two", None, 0), (302, "", None, None, 0), (None, "abc bca", None, None, 0)]
    got, _ = identify(frame(spark, rows))
    got = {r.doc_id: r for r in got.collect()}
    assert len(got) == len(rows)
    import zlib

    for d, _, lang, *_ in rows[:240]:
        assert got[d].lang_pred == lang and 0 < got[d].score <= 1
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
    assert [got[d].lang_pred for d in (300, 301, 302, None)] == ["und", "und", "und", "one"]
    empty, _ = identify(frame(spark, []))
    assert empty.count() == 0
    untaught, _ = identify(frame(spark, [(1, "abc", None, None, 0)]))
    assert [tuple(r) for r in untaught.select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        words = ["".join(rng.choice("abcdeflmn") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(words) if good else "!! ".join(words).upper(), None, None, 0))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(900, None, None, None, 0), (901, "", None, None, 0), (None, "abc", None, None, 0)]
    labels += [(None, 1, 0), (901, None, 0), (5000, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_scores(frame(spark, rows), marks).collect()}
    assert len(got) == len(rows)
    held = [r for d, r in got.items() if d is not None and d < 600 and r.held_out]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    none = quality_scores(frame(spark, rows[:5]), marks.limit(0)).collect()
    assert [(r.score, r.predicted) for r in none] == [(0.5, 0)] * 5
    assert quality_scores(frame(spark, []), marks).count() == 0
    one = quality_scores(frame(spark, rows[:20]), marks.withColumn("quality", marks.quality * 0 + 1)).collect()
    assert all(isclose(r.score, 1) for r in one)


def test_quality_is_plain_ridge_on_the_same_kernel(spark):
    """The scores against the ridge solution in one matrix, and the pool-adjacent-violators fit of its bins."""
    rows, rng = documents(), random.Random(8)
    labels = [(r[0], int(rng.random() < (0.8 if len(r[1] or "") > 200 else 0.3)), 0) for r in rows]
    got = {r.doc_id: r for r in quality_scores(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    want = brute.quality(rows, labels)
    assert set(got) == set(want)
    assert max(abs(got[d].score - want[d]) for d in want) < 1e-6
    assert all(got[d].predicted == int(got[d].score >= 0.7) for d in want)


def test_isotonic():
    n, t = np.array([1, 2, 1, 4]), np.array([1.0, 0.0, 1.0, 2.0])
    assert np.allclose(isotonic(n, t), [1 / 3, 1 / 3, 3 / 5, 3 / 5]) or np.allclose(isotonic(n, t), [1 / 3] * 2 + [3 / 5] * 2)


def _vectors(n: int, dims: int, seed: int = 0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dims)], 0) for i in range(n)]
    rows[40:60] = [(i, rows[0][1], 0) for i in range(40, 60)]
    rows += [(n, None, None), (n + 20, [None, 1.0, float("nan")], 1), (None, rows[3][1], 2), (n + 40, [], 0)]
    return rows


@pytest.mark.parametrize("job,crowd", [(2500, 1 << 16), (20, 8), (100_000, 3)])
def test_nearest(spark, monkeypatch, job, crowd):
    """Also where few lookups are made before all codes are compared, and where every slot is crowded."""
    from tablewright.llm import codes as module

    monkeypatch.setattr(module, "JOB", job)
    monkeypatch.setattr(module, "CROWD", crowd)
    monkeypatch.setattr(module, "BLOCK", 4)
    rows = _vectors(300, 64)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    codes = {r.vec_id: r.c for r in vectors.select("vec_id", code_of(vectors.embedding).alias("c")).collect()}
    want = brute.nearest([r[0] for r in rows], [None if codes[r[0]] is None else codes[r[0]] & (1 << 64) - 1 for r in rows], 10, 20)
    got = defaultdict(list)
    for r in top_k(vectors).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.distance, r.vec_id))
    assert got == want
    assert top_k(vectors.limit(0)).count() == 0
    few = top_k(vectors.where("vec_id in (20, 21, 40)"), k=5).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(20, 1), (20, 2), (40, 1), (40, 2)]


def test_nearest_takes_tied_codes_by_id(spark):
    """Many copies of one code tie with single codes and with copies of another, in front and behind."""
    def vector(*flipped):
        return [-1.0 if i in flipped else 1.0 for i in range(64)]

    rows = [(0, vector(), 0), (20, vector(0, 1, 2, 3, 4), 0), (40, vector(60, 61), 0)]
    rows += [(i, vector(1, 2, 3), 0) for i in [5, *range(901, 914)]]
    rows += [(10, vector(4, 5, 6), 0), (11, vector(7, 8, 9), 0)]
    rows += [(i, vector(40, 41, 42), 0) for i in (903_000, 7, 30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    codes = [sum(1 << i for i, x in enumerate(v) if x > 0) for _, v, _ in rows]
    for k in (1, 4, 10):
        got = defaultdict(list)
        for r in top_k(vectors, k=k).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.distance, r.vec_id))
        assert got == brute.nearest([r[0] for r in rows], codes, k, 20)


def test_codes_of_longer_embeddings(spark):
    vectors = spark.createDataFrame(_vectors(120, 100, 3), "vec_id long, embedding array<double>, label int")
    found = top_k(vectors, k=3).where("query_id = 0").orderBy("rank").collect()
    assert [(r.distance, r.vec_id) for r in found] == [(0, 40), (0, 41), (0, 42)]


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_token_files(spark, monkeypatch, block):
    rows = documents() + [(None, "zz yy", None, None, 0)]
    files = settle(grammar.token_files(frame(spark, rows), FILE))
    got, at, encode = {r.doc_id: r for r in grammar.token_index(files).collect()}, 0, library()
    for d, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*encode(text), 0]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert grammar.token_index(settle(grammar.token_files(frame(spark, []), FILE))).count() == 0


class Counted:
    """A library object that notes the calls of its methods, and of its model's."""

    def __init__(self, inner, calls):
        self.inner, self.calls = inner, calls

    def __getattr__(self, name):
        value = getattr(self.inner, name)
        if name == "model":
            return Counted(value, self.calls)

        def call(*args, **kwargs):
            self.calls.append(name)
            return value(*args, **kwargs)

        return call if callable(value) else value


def test_new_words_are_asked_for_together():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéñöÇſ\u024f", k=rng.randint(1, 30))) for _ in range(4000)]
    text = "".join(rng.choice((" ", " ", " ", " ", " ", "  ", "\n", "\u00a0 ")) + w for w in words)
    text += "".join(" " + "".join(rng.choices("etaoinshr", k=7)) for _ in range(6000)) + " x." + " nu,"
    pieces, calls = tokens.Pieces(FILE), []
    for part in ("tokenizer", "model"):
        if hasattr(pieces, part):
            setattr(pieces, part, Counted(getattr(pieces, part), calls))
    assert pieces.ids_of([text.encode()])[0].tolist() == library()(text)
    assert len(calls) < 2500  # some 2,000 of the pieces begin without a space or are no plain words


def test_words_are_asked_for_alone_if_merges_reach_into_the_next(tmp_path):
    file = json.loads(Tokenizer.from_file(FILE).to_str())
    letters, body = tokens._byte_letters(), file["model"]
    assert tokens._separable(file, "".join(letters))
    for merges in ([["a", "Ġ"], ["aĠ", "b"]], [["Ġ", "b"], ["a", "Ġb"], ["Ġ", "a"]]):
        body["vocab"] = {t: i for i, t in enumerate([*letters, *("".join(m) for m in merges)])}
        body["merges"], file["added_tokens"] = merges, []
        path, text = str(tmp_path / f"{len(merges)}.json"), "a b ba a b aba a\n a b"
        with open(path, "w") as out:
            json.dump(file, out)
        pieces = tokens.Pieces(path)
        assert pieces.cuttable and not pieces.separable
        assert pieces.ids_of([text.encode()])[0].tolist() == pieces.tokenizer.encode(text).ids
    del body["vocab"]["Ġ"], body["merges"][:]
    assert not tokens._separable(file, "".join(letters))


def test_long_rules_are_read_whole():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 50_000, 3 * grammar.SHORT + 5)
    ids = [np.concatenate((passage, rng.integers(0, 50_000, n), passage[n:])).astype(np.uint32) for n in range(40)]
    for docs in (ids, [np.zeros(5000, np.uint32), *ids[:3]], ids[:1], []):
        block = grammar.Block(grammar.compress(docs))
        assert [d.tolist() for d in block.documents()] == [d.tolist() for d in docs]
        assert block.whole().tolist() == block.expand(block.seq).tolist()
    assert grammar.Block(grammar.compress(ids)).lengths.max() > grammar.SHORT


def test_blocks_decode_at_any_place():
    rng = np.random.default_rng(0)
    for n, high, longest in ((0, 5, 1), (1, 2, 1), (40, 3, 300), (300, 6, 40), (50, 60_000, 400)):
        ids = [rng.integers(0, high, rng.integers(1, longest + 1)).astype(np.uint32) for _ in range(n)]
        block = grammar.Block(grammar.compress(ids))
        assert len(block) == n
        assert all((a == b).all() for a, b in zip(ids, block.documents(), strict=True))
        for i in range(n):
            a, b = sorted(rng.integers(0, len(ids[i]) + 1, 2))
            assert block.document(i, a, b).tolist() == ids[i][a:b].tolist()
    repeated = [np.tile(np.arange(8, dtype=np.uint32), 2000)]
    assert len(grammar.compress(repeated)) < 16_000 * 4 / 8
    with pytest.raises(ValueError):
        grammar.Block(bytes(64))


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 50_000, 1000)
    often = [np.concatenate((passage, rng.integers(0, 50_000, 20))).astype(np.uint32) for _ in range(40)]
    rising = [np.arange(1000, dtype=np.uint32)] * 10
    few = [np.array([1, 2, 3, 1, 1, 1], np.uint32)] * grammar.LEAST
    natural = [np.minimum(rng.zipf(1.3, 3000), 5000).astype(np.uint32) for _ in range(20)]
    wide = [rng.integers(0, 700, 400_000).astype(np.uint32)]
    for ids in (often, rising, few, natural, wide, [np.zeros(5000, np.uint32)]):
        block = grammar.Block(grammar.compress(ids))
        assert all((a == b).all() for a, b in zip(ids, block.documents(), strict=True))
        places = defaultdict(int)
        for i in range(len(block)):
            seq, taken = block.seq[block.symbols[i] : block.symbols[i + 1]].tolist(), {}
            for at, pair in enumerate(zip(seq, seq[1:], strict=False)):
                if taken.get(pair) != at - 1:
                    taken[pair] = at
                    places[pair] += 1
        assert max(places.values(), default=0) < grammar.LEAST
    block = grammar.Block(grammar.compress(often))
    assert np.diff(block.symbols).max() <= 25


@pytest.mark.parametrize("seed", [3, 8])
def test_backoff(spark, seed):
    rows = documents(seed) + [(None, "a b a b", None, None, 0)] * 2
    want = sorted(brute.backoff([r[:2] for r in rows]), key=lambda r: (r[0] is None, r[0] or 0))
    got = backoff_scores(frame(spark, rows)).collect()
    got.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.words, r.pairs_found) for r in got] == [w[:3] for w in want]
    for r, w in zip(got, want, strict=True):
        assert isclose(r.log_score, w[3], rel_tol=1e-9, abs_tol=1e-9)
        assert r.score is None if not w[1] else isclose(r.score, w[3] / w[1], rel_tol=1e-9)
    assert backoff_scores(frame(spark, [])).count() == 0


def test_gains_grow_with_the_pairs_and_not_with_parts_times_documents(spark, monkeypatch):
    """Twice the documents at a fixed size of a part: twice the bytes that parts send back."""
    from tablewright.llm import scoring

    monkeypatch.setattr(scoring, "PART", 40)
    monkeypatch.setattr(scoring, "BUFFER", 3000)
    written, settle_ = [], scoring.settle

    def measured(df, label):
        out = settle_(df, label)
        if label == "gains":
            written.append(out.agg(F.sum(F.octet_length("base") + F.octet_length("words"))).first()[0])
        return out

    monkeypatch.setattr(scoring, "settle", measured)
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(30)) for _ in range(160)]
    rows = [(i, texts[i // 2], None, None, 0) for i in range(320)]  # all pairs are found
    for n in (80, 160, 320):
        backoff_scores(frame(spark, rows[:n])).count()
    assert written[1] < 2.3 * written[0] and written[2] < 2.3 * written[1]


def test_backoff_cuts_long_texts_between_words(monkeypatch):
    from tablewright.llm import scoring

    monkeypatch.setattr(scoring, "BUFFER", 50)
    text = ("word and more " * 40).encode()
    assert b"".join(scoring._cuts(text)) == text
    assert all(p[-1:].isspace() or q[:1].isspace() for p, q in zip([*scoring._cuts(text)], [*scoring._cuts(text)][1:], strict=False))


def test_held_out_is_by_id_as_text(spark):
    import zlib

    ids = spark.range(50)
    got = {r.id: r.h for r in ids.select("id", held_out(ids.id, 4, 2).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


def test_schema_has_every_clash():
    assert len(SCHEMA.split(",")) > 40
