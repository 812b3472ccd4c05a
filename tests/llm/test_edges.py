"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenizers import Tokenizer

import corpus_pipeline
from parlance.llm import fingerprints, licenses, mixing, neighbours, packing, sharding, simhash, suffix, tokens, toxicity
from parlance.llm.queries import tokenizer_path

LONG = "word " * 60_000
SAME = " ".join(f"token{i}" for i in range(120))
ROWS = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \n\t", "en", "a", 3), (4, LONG, "en", "b", 300_000), (5, SAME, "en", "a", 1), (5, SAME, "en", "a", 1),
    (6, SAME + " x", "en", "b", None), (7, "Released under the MIT License.", "en", None, 31), (None, "no id here", "en", "a", 10), (None, None, None, None, None),
    (8, "a\u0000b <|endoftext|> \U0001f600 éé Licensed under CC BY-NC 4.0.", "de", "c", 5), (9, "x" * 50_000, "de", "c", 5), (10, SAME, "fr", "a", 9),
]
CLASH = [
    "k1", "k2", "key", "fp", "v", "n", "text_key", "part", "size", "order", "b", "rn", "ghost", "bucket", "spans", "copies", "draw", "label", "f0", "root", "row", "score", "same",
    "place", "time", "kept", "blank", "__key", "__row", "__score", "__k1", "__k2", "__kept", "__copies", "__same", "__time", "ids", "shard",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (4, 0), (5, 1), (7, 0), (8, 1), (None, 1), (9, None)], "doc_id long, toxic int")


def per_row(labels):
    path = tokenizer_path()
    return {
        "op2": suffix.remove_repeats,
        "op3": sharding.shard_by_bytes,
        "op4": lambda d: tokens.count_tokens(d, path),
        "op6": lambda d: toxicity.score_documents(d, labels),
        "op8": mixing.cube_mix,
        "op9": fingerprints.fingerprint_edits,
        "op10": simhash.simhash_components,
    }


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op6", "op8", "op9", "op10"])
def test_one_row_for_each_row(docs, none, labels, name):
    run = per_row(labels)[name]
    got = run(docs).toPandas()
    assert len(got) == len(ROWS)
    assert sorted(got["doc_id"].dropna().astype(int)) == sorted(r[0] for r in ROWS if r[0] is not None)
    assert run(none).count() == 0


BIG = [(1 << 53) + 1, None, (1 << 53) + 3, -(1 << 60) - 1, 7]


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10"])
def test_large_ids_next_to_a_null_stay_as_they_are(spark, labels, name):
    rows = spark.createDataFrame([(d, f"text number {i} of some words", "en", f"s{i % 2}", 1) for i, d in enumerate(BIG)], SCHEMA).coalesce(1)
    run = per_row(labels).get(name, lambda d: packing.pack(d, tokenizer_path()))
    assert {r["doc_id"] for r in run(rows).collect()} == set(BIG)


def test_counts_on_odd_texts_are_the_librarys(docs):
    library = Tokenizer.from_file(tokenizer_path())
    want = sorted((r[0] is None, r[0] or 0, len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in tokens.count_tokens(docs, tokenizer_path()).collect()) == want


def test_mixing_shares_copies_among_repeated_rows(spark):
    same = [(1, "a b c", "en", "x", i % 3) for i in range(10)]
    rows = spark.createDataFrame([*same, (2, "d e f g", "en", "y", 0), (3, "h " * 40, "en", "y", 1)], SCHEMA)
    drawn = {r["doc_id"]: r["n"] for r in mixing.cube_mix(rows).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    got, again = (sorted(map(tuple, mixing.take(rows.repartition(n)).collect())) for n in (2, 5))
    assert got == again and sum(r[0] == 1 for r in got) == drawn[1]
    per = [sum(r[0] == 1 and r[4] == k for r in got) / sum(r[4] == k for r in same) for k in range(3)]
    assert max(per) - min(per) <= 1


def test_packing_holds_every_row(docs, none):
    got = packing.pack(docs, tokenizer_path()).toPandas()
    want = packing.token_table(docs, tokenizer_path()).agg(F.sum("n")).first()[0]
    assert got["length"].sum() == want
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_repeats_of_equal_rows_and_long_runs(docs):
    got = {(r["doc_id"], r["n_bytes"]): r for r in suffix.remove_repeats(docs).collect()}
    assert got[5, len(SAME)]["n_removed"] == len(SAME)
    assert got[4, len(LONG)]["n_removed"] == len(LONG) and got[9, 50_000]["n_spans"] == 1
    assert got[1, 0]["n_removed"] == 0


def test_licences(docs, none):
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()}
    assert {(7, "mit-notice")} <= got
    assert licenses.scan_licenses(none).count() == 0


def test_keep_one_of_repeated_rows(docs, none):
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(5) == 1 and 10 not in ids and simhash.keep_one(none).count() == 0


def test_vectors(spark):
    good = [(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(60)]
    odd = [(100, None), (120, [0.0] * 4), (140, [1.0, None, 0.0, 0.0]), (160, [float("nan")] * 4), (180, [float("inf"), 0.0, 0.0, 0.0]), (200, [1.0]), (None, [1.0] * 4), (20, good[20][1]), (300, good[20][1])]
    table = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumn("part", F.lit("x"))
    got = neighbours.search(table).toPandas()
    assert set(got["query_id"]) == {0, 20, 40, 300} and (got.groupby("query_id").size() == 20).all()
    x = {i: np.array(v) for i, v in [*good, (300, good[20][1])]}
    for q, rows in got.groupby("query_id"):
        want = sorted(((-float((x[i] * x[q]).sum()), i) for i in x if i != q))[:20]
        assert [i for _, i in want] == rows.sort_values("rank")["vec_id"].tolist()
    assert neighbours.search(table.where("vec_id = 100")).count() == 0


def test_pipeline_stages(spark, docs, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, none):
        rows = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, str(tmp_path))
            assert rows.columns == start.columns
            rows = spark.createDataFrame(rows.collect(), rows.schema)
        found = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path))
        want = packing.token_table(rows, tokenizer_path()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        assert found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] == want
