"""The pipeline stage by stage on the smallest tables, and the queries against their SQL."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_advice_r01 import mix_by_hand
from test_operators import classes_by_hand
from tokenizers import Tokenizer

import corpus_pipeline
from cadastra.llm import registry, token_store
from cadastra.llm.common import stage
from cadastra.llm.words import words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "token_store":
            assert docs.columns == columns
        if name in ("language_id", "near_dedup", "decontamination"):
            assert 0 < counts[-1] <= counts[-2]
    assert counts[-1] == counts[-2] and docs.where("not verified").count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    key = lambda row: [x if not isinstance(x, float) else round(x, 9) for x in row]
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    ours = sorted((key(r) for r in got.select(*columns).collect()), key=str)
    theirs = sorted((key(r) for r in want.select(", ".join(columns)).fetchall()), key=str)
    assert ours == theirs


def test_run_against_brute_force(spark, tmp_path):
    """The five stages in plain Python: the same documents, as often, in the same order, with the same ids."""
    rng = random.Random(21)
    vocabulary = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "am", "con", "ad", "el") for b in ("em", "sum", "or", "et", "is", "ur")]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(n))
    items = [(k, prose(20)) for k in range(4)]
    rows = [(i, prose(rng.randint(15, 160)), rng.choice(["xx", "yy", None]), rng.choice("aaaab")) for i in range(60)]
    for k in range(12):  # near and exact copies, leaks
        w = rows[k][1].split()
        w[len(w) // 2] = "changed"
        rows.append((100 + k, " ".join(w) if k % 3 and len(w) > 60 else rows[k][1].upper(), None, rng.choice("bbc")))
        rows.append((200 + k, f"{prose(30)} {items[k % 4][1]} {prose(9)}", "xx", "a"))
    rows += [(300, None, "xx", "a"), (301, "", None, None), (302, "12 ... !!", "yy", "c"), (303, prose(40), "xx", None), (304, "one two", None, "d")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    classes = classes_by_hand(left)
    left = [r for r in left if classes[r[0]] == r[0]]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words(t.encode())] for i in range(len(w) - 4)}
    leaked = lambda t: any(len(shingles(q) & shingles(t)) >= 0.8 * len(shingles(q)) for _, q in items)
    left = [r for r in left if not leaked(r[1])]
    order = mix_by_hand([(i, t, s) for i, t, _, s in left])
    plain, text = Tokenizer.from_str(token_store.tokenizer_file()), {r[0]: r[1] for r in left}
    want, start = [], 0
    for _, i, _ in order:
        ids = plain.encode(text[i], add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
        start += len(ids)
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32", "verified").collect()
    assert 30 < len(left) < 70 and sorted(map(tuple, got), key=lambda r: r[1]) == want


@pytest.mark.parametrize("kind", ["empty", "nulls", "clashes"])
def test_stages_on_odd_tables(spark, kind):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = {
        "empty": [],
        "nulls": [(None, None, None, None, None), (1, None, None, None, None), (None, "some words here and there", None, None, None), (2, "", "xx", "s", 0)],
        "clashes": [(1, "a few words of one text", "xx", "s", 1), (2, "and others of the second", "yy", None, 2)],
    }[kind]
    docs = spark.createDataFrame(rows, schema)
    if kind == "clashes":
        for c in ("id", "kept", "label", "size", "place", "position", "__row", "copies", "key"):
            docs = docs.withColumn(c, F.lit("clash"))
    for name, function in corpus_pipeline.STAGES:
        out = stage(function(spark, docs, SF), name)
        n = {"empty": 0, "nulls": 1 if name == "language_id" else out.count(), "clashes": 2}[kind]
        assert out.count() == n or name == "mixing"
        if name != "token_store":
            assert out.columns == docs.columns
            docs = out
