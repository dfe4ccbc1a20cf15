from __future__ import annotations

import os
import random
from collections import Counter

from common import SCHEMA, sentence
from test_lines_urls_mix import brute_lines
from test_near_dedup import brute

import corpus_pipeline
from pyspark.sql import functions as F
from rooftide.llm import _common, queries


def tables(spark, folder):
    rng = random.Random(3)
    made = lambda n: " ".join("".join(rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    items = [(i, made(25) + ".") for i in range(4)]
    rows = [(i, sentence(rng, "en", 40) + "\nfooter line of the site", "en", "ab"[i % 2], 0) for i in range(80)]
    rows += [(100 + i, rows[i][1].replace("the", "THE"), "en", "a", 0) for i in range(10)]
    rows += [(200, "12 !!", "en", "a", 0), (201, None, "en", None, 0), (202, sentence(rng, "en", 150) + " " + items[2][1], "en", "b", 0)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_pipeline_stage_by_stage(spark, tmp_path):
    rows = tables(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "source_mix"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {r[0]: r[1] for r in rows}
    columns, after = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ([*columns, "copy"] if name == "source_mix" else columns)
        after.append(docs.collect())
        docs = spark.createDataFrame(after[-1], docs.schema)
    named, lines, near, clean, mixed = after
    kept = {k: v for k, v in want.items() if k not in (200, 201)}
    assert {r.doc_id: r.text for r in named} == kept
    expected = {i: t for i, t, *_ in brute_lines(list(kept.items()))}
    assert {r.doc_id: r.text for r in lines} == expected and all(r.n_chars == len(r.text) for r in lines)
    roots = brute(list(expected.items()), 5)
    assert {r.doc_id for r in near} == {i for i in expected if roots[i] == i}
    assert {r.doc_id for r in near} - {r.doc_id for r in clean} == {202}
    copies = Counter((r.doc_id, r.copy) for r in mixed)
    assert set(copies.values()) == {1} and max(c for _, c in copies) <= 2 and {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(str, run.collect())) == Counter(map(str, mixed))


CLASH = ["rejected", "score", "lang_pred", "kept_text", "n_lines", "n_dropped", "vertex", "kept", "contaminated", "item_ids", "size", "src", "copies"]


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, texts, languages and sources, repeated rows, repeated ids, ties, a very long text, clashing columns."""
    tables(spark, tmp_path)
    rng = random.Random(11)
    long = sentence(rng, "en", 60_000)
    rows = [(i, sentence(rng, "en", 30), "en", "ab"[i % 2]) for i in range(60)]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None), (None, sentence(rng, "en", 30), None, None), (None, sentence(rng, "en", 30), None, "a"), (None, rows[2][1] + " more", "en", "a")]
    rows += [rows[63], (70, None, "en", "a"), (70, None, "en", "a"), (71, "", None, None), (72, "12 34", "en", "b"), (73, long, "en", "b"), (74, long, "en", "b"), (5, sentence(rng, "en", 30), "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *(f"'own {c}' AS {c}" for c in CLASH))
    stages = dict(corpus_pipeline.STAGES)

    def run(name, docs=df):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == [*docs.columns, *(["copy"] if name == "source_mix" else [])]
        got = out.collect()
        assert all(r[c] == f"own {c}" for r in got for c in CLASH if c in docs.columns)
        return Counter((r.doc_id, r.text) for r in got)

    every = Counter((i, t) for i, t, *_ in rows)
    named = run("language_id")
    assert named == Counter({k: n for k, n in every.items() if k[1] and k[1] != "12 34"})
    lines = brute_lines([(i, t) for i, t, *_ in rows])
    assert run("line_dedup") == Counter({(i, t): 0 for i, t, *_ in lines}) + Counter((i, t) for (i, t, *_), n in lines.items() for _ in range(n))
    near = run("near_dedup")
    dropped = {(None, rows[1][1]), (None, rows[2][1] + " more"), (74, long)}
    assert near == Counter({k: 1 for k in every if k not in dropped})  # one of repeated rows; both texts of id 5; both rows without an id
    assert run("decontaminate") == every
    mixed = run("source_mix")
    assert set(mixed) <= set(every) and all(mixed[k] <= 2 * every[k] for k in mixed)
    for name in stages:
        assert not run(name, df.limit(0))
    own = stages["source_mix"](spark, df.withColumn("copy", F.lit("x")), str(tmp_path))
    assert own.columns == [*df.columns, "copy"] and own.schema["copy"].dataType.typeName() == "integer"


def test_intermediate_tables_can_be_dropped(spark, tmp_path):
    tables(spark, tmp_path)
    rows = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert rows > 0 and _common._WRITTEN
    paths = list(_common._WRITTEN)
    _common.drop_tables(spark)
    assert not _common._WRITTEN and not any(os.path.exists(p) for p in paths)


def test_queries_are_named_by_contract():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
