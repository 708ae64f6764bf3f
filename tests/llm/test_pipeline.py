"""The pipeline's stages in order, each on what the one before kept, and the registry."""

import collections
import random

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from veldt.llm.base_queries import BASE_ORACLES, BASE_QUERIES
from veldt.llm.queries import ORACLES, QUERIES


def test_registry():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(BASE_ORACLES))
def test_counted_columns_are_those_of_sql(spark, name):
    db, folder = duckdb.connect(), "/root/testdata/sf0.001"
    db.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    frame, found = BASE_QUERIES[name](spark, folder), db.sql(BASE_ORACLES[name])
    plain = lambda rows, names: sorted(str([round(r[names.index(c)], 4) if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in sorted(names)]) for r in rows)
    assert plain([tuple(r) for r in frame.collect()], frame.columns) == plain(found.fetchall(), found.columns)


def odd_tables(spark, folder, empty=False):
    """Documents with nulls, empties, repeats, copies, long words and columns whose names operators use, and a benchmark."""
    rng = random.Random(6)
    words = "the and of to in is that for it with as was be at by this are from other some more time people water".split()
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ly"]) + ("." if k % 9 == 8 else "") for k in range(n))
    texts = [prose(rng.choice([60, 90, 200])) for _ in range(30)]
    passage = prose(14)
    texts += [texts[0], texts[0], texts[1] + " more", None, "", " \n", "x" * 5000, prose(40) + " " + passage + " " + prose(40), "@@ ## $$ %%"]
    rows = [(k, t, None if k % 5 == 4 else "en", None if k % 4 == 3 else f"s{k % 4}", k, "row", 1.5, "text_key", [k]) for k, t in enumerate(texts)]
    rows += [rows[3], (None, prose(70), "en", "s0", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, size string, rate double, text_key string, row array<long>"
    spark.createDataFrame([] if empty else rows, kind).repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([] if empty else [(1, passage), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [] if empty else rows, passage


def test_pipeline_on_odd_tables(spark, tmp_path):
    rows, passage = odd_tables(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append([r.text for r in docs.collect()])
    whole = collections.Counter(r[1] for r in rows)
    assert all(whole[t] for t in kept[0]) and not {None, "", " \n", "x" * 5000} & set(kept[0])
    assert max(collections.Counter(kept[1]).values()) == 1 and set(kept[1]) <= set(kept[0]) and rows[0][1] in kept[1]
    assert kept[2] and sorted(kept[2]) == sorted(t for t in kept[1] if passage not in t) and len(kept[2]) < len(kept[1])
    assert set(kept[3]) <= set(kept[2]) and max(collections.Counter(kept[3]).values()) <= 2
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len(kept[3]) and sorted(r.start for r in out) == [sum(x.n_tokens for x in sorted(out, key=lambda r: r.start)[:k]) for k in range(len(out))]


def test_pipeline_on_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path, empty=True)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_in_order(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:4]:
        docs = step(spark, docs, folder)
        from veldt.llm.common import Stage

        docs = Stage(spark, "test").put("stage", docs)
        assert docs.columns == columns, name
        after = docs.count()
        assert (after < before) if name != "mixing sources to target weights" else after > 0
        before = after
    rows = corpus_pipeline.STAGES[4][1](spark, docs, folder)
    assert rows.count() == before and rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
