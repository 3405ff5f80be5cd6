"""Tables that the findings of round 4 name: titles with cut references, texts that move once, a time of each schedule."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.providers import HashEmbedding, embedding_udf
from millrace.operators import chunk

from .test_round3 import both


def test_titles_and_languages_of_odd_pages(spark, tmp_path):
    titles = ["a &quot", "a &quot;b&quot; &lt c&lt; &gt;&g &am &amp &amp; &amp;lt; &amp;amp;", "&copy; &#39; &nbsp;|", "\u00a0x\u000b\ty \n z\u2003", "e\u0301 \u00e9", "", " ", "a<b>c</b>", "x" * 90_000]
    html = [f"<!DOCTYPE html><HTML class='a'\n Lang=\"e{i}\"><head><Title>{t}</tITLE><title>two</title></head><body><h1>head</h1>" for i, t in enumerate(titles)]
    html += ['<html lang="">', "<html lang='de'><title lang=\"x\">no</title><h1>a head</h1>", '<html xlang="a" lang="b"><title>open', '<html\u000blang="v">', '<html><html lang="c"><svg><title>of a picture</title></svg>', "", None]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").selectExpr("page_id", "'http://e.example/' url", "html")
    got, sql = both(spark, tmp_path, "html_title_lang", pages=pages)
    assert got == sql and len(got) == len(html)


@pytest.fixture(scope="module")
def blocks(spark):
    rng = random.Random(8)
    rows = [(99, 0, None, "prose", "Alone.", ""), (98, 0, "", "code", "x = 1", "py"), (97, 0, "", "prose", "\u00a0", ""), (96, 0, "", "prose", "w" * 700 + " " + "One two. " * 40, "")]
    for doc in range(40):
        for o in range(rng.randrange(0, 14)):
            kind = rng.choice(["prose", "prose", "prose", "code", "table"])
            text = " ".join(rng.choice(["Abc", "Def", "Ghi", "Jkl"]) + f" says number {rng.randrange(9)}." for _ in range(rng.randrange(1, 6)))
            rows.append((doc, o, f"h{o // 4 % 2}", kind, rng.choice(["", " ", "\u00a0", None]) if rng.random() < 0.1 else text, "py" if kind == "code" else ""))
    return spark.createDataFrame(rows, "doc long, ordinal int, heading string, kind string, text string, language string").repartition(3).cache()


@pytest.mark.parametrize("method, value", [("percentile", 60.0), ("percentile", 95.0), ("stddev", 1.0), ("iqr", 0.5)])
def test_chunks_of_texts_that_move_once_are_the_same(spark, blocks, monkeypatch, method, value):
    monkeypatch.setattr(chunk, "MOST_SENTENCES", 25)
    monkeypatch.setattr(chunk, "EMBEDDED", 7)
    monkeypatch.setattr(chunk, "FOLDED", 3)
    options = chunk.ChunkOptions(120, 0)
    said = chunk.semantic_runs(blocks, "doc", 120).withColumn("vector", embedding_udf(HashEmbedding())(F.col("sentence")).cast("array<double>"))
    planned, stats = chunk.semantic_plan(said, "doc", method, value)
    assert {r.fallback for r in stats.collect()} == {None, "too_short", "too_many_sentences"}
    want = chunk.semantic_pack(blocks, planned, stats, "doc", options, 40)
    got = chunk.semantic_chunked(blocks, "doc", HashEmbedding(), options, 40, method, value)
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert got.schema == want.schema and rows == sorted(map(tuple, want.collect()), key=repr) and len(rows) > 150


def test_semantic_pack_shuffles_texts_once(spark):
    from millrace.plans.registry import QUERIES

    plan = QUERIES["semantic_pack"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("FileScan") == 1 and "documents.parquet" in plan


@pytest.mark.parametrize("method, value", [("percentile", 95.0), ("percentile", 50.0), ("stddev", 1.5), ("iqr", 1.5)])
def test_thresholds_of_arrays_are_those_of_rows(spark, method, value):
    rng = random.Random(9)
    rows = [(i, [rng.random() for _ in range(i)]) for i in range(1, 40)]
    df = spark.createDataFrame([*rows, (0, [])], "id int, d array<double>")
    want = dict(map(tuple, df.select("id", F.explode("d").alias("x")).groupBy("id").agg(chunk.breakpoint_threshold(F.col("x"), method, value)).collect()))
    got = dict(map(tuple, df.select("id", chunk.listed_threshold(F.col("d"), method, value)).collect()))
    assert got.pop(0) is None and got.keys() == want.keys() and all(abs(got[k] - want[k]) < (1e-12 if method == "stddev" else 1e-300) for k in want)


def test_schedules_are_due_by_their_own_interval(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 20) - dt.timedelta(hours=h), 1, "click", 1.0, "{}") for i, h in enumerate([12, 24, 35, 60, 100, 167, 168, 200] * 60)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    got, sql = both(spark, tmp_path, "claim_due", events=events)
    want = {i: i % 3 == 0 or dt.datetime(2024, 1, 20) - ts >= dt.timedelta(hours=12 * (1 + i % 28)) for i, ts, *_ in rows}
    assert got == sql and {r[1]: r[0] for r in got} == want
    alike = {want[i] for i, ts, *_ in rows if i % 3 and ts == dt.datetime(2024, 1, 13)}
    assert alike == {True, False}  # last run at one time, due or not by their interval
