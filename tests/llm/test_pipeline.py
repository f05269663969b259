import zlib

import brute
import corpus_pipeline
import duckdb
import pytest
from compare import compare, connect
from data import frame
from test_minhash import components, planted

from tablewright.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, con, name):
    assert compare(spark, con, FOLDER, queries.QUERIES[name], queries.SQL[name]) == []


def test_stages(spark, tmp_path):
    """Each stage on its predecessor's rows, against plain versions where they exist."""
    rows = duckdb.sql(f"SELECT * FROM '{FOLDER}/documents.parquet'").fetchall()
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    docs, left = spark.read.parquet(f"{FOLDER}/documents.parquet"), {r[0]: r[1] for r in rows}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name == "language ID":
            train = [(r[1], r[2]) for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[1] and r[2]]
            profiles = brute.language_profiles(train)
            left = {d: t for d, t in left.items() if brute.language(t, profiles)[1] >= corpus_pipeline.LEAST_SCORE}
        elif name == "exact dedup":
            first = {}
            for d in sorted(left):
                first.setdefault(b" ".join(left[d].encode().split()), d)
            left = {d: left[d] for d in first.values()}
        elif name == "near dedup":
            pairs = components([(d, left[d]) for d in sorted(left)], 5)
            left = {d: left[d] for d in {first for _, first in pairs.values()}}
        if name in ("language ID", "exact dedup", "near dedup"):
            assert {r.doc_id: r.text for r in docs.collect()} == left
            assert docs.columns == columns and docs.count() == len(left)
        elif name == "mixing":
            assert docs.columns == columns
            words = sum(len(r.text.encode().split()) for r in docs.collect())
            total = sum(len(t.encode().split()) for t in left.values())
            assert abs(words - 1.5 * total) <= 20
            mixed = docs.count()
        else:
            assert docs.where("piece = 0").count() == mixed
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_language_stage_rejects_what_is_in_no_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    noise = ["Жщфю ыэъё", "kqxzj wqxjk zzqxv", "漢字漢字漢字", "0123 4567 !!", "", None]
    more = frame(spark, [(10_000 + i, t, "en", "s", 0) for i, t in enumerate(noise)], docs.schema.simpleString()[7:-1].replace(":", " "))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(more), FOLDER).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_near_stage_keeps_one_of_each_group(spark):
    rows = planted(9)
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()
    text = {r[0]: r[1] for r in rows}
    assert sorted(r.doc_id for r in got) == sorted({first for _, first in components(rows, 5).values()})
    assert all(r.text == text[r.doc_id] for r in got)
