"""The pipeline's stages against brute force on a small table, and its shape on odd and empty ones."""

import re
from collections import defaultdict

import pytest

pytest.importorskip("wayloom.llm")
import corpus_pipeline
from pyspark.sql import functions as F

from wayloom.llm import decontaminate, registry

from .test_operators import brute_hits, words
from .test_similarity import brute

FRENCH = "le petit garçon est allé à la plage avec sa mère et il a mangé une pomme près de la forêt numéro %s"
ENGLISH = "the small boy went to the beach with his mother and he ate an apple close to the forest number %s"
NUMBERS = ["one two", "three four", "five six", "seven eight", "nine ten", "eleven twelve", "many more of them", "another thing entirely", "seventeen", "last of all"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    items = [(k, (FRENCH if k % 2 else ENGLISH) % (NUMBERS[k // 2 % 10] + " " + NUMBERS[k // 3 % 10]), "fr" if k % 2 else "en", f"s{k % 4}") for k in range(60)]
    items += [(100, "", "en", "s1"), (101, None, None, None), (102, "12 34 !!", "en", "s2"), (103, ENGLISH % "zebra alpha beta gamma delta epsilon", "en", None), (104, items[5][1].replace(" ", "  "), "fr", "s0")]
    items += [(200 + k, " ".join(f"long{i}" for i in range(400)) + " and the end %d" % k, "en", "s3") for k in range(4)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in items], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    tests = [("t1", "Zebra, alpha beta gamma delta!"), ("t2", None)]
    spark.createDataFrame(tests, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items, tests


def test_stages(spark, corpus):
    folder, items, tests = corpus
    docs, text = spark.read.parquet(f"{folder}/documents.parquet"), {i: t for i, t, _, _ in items}
    columns = docs.columns
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = ids(docs)
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = before, ids(docs)
        if name != "mix":
            assert docs.columns == columns
    before, after = kept["language_id"]
    assert set(before) - set(after) == {100, 101, 102}
    before, after = kept["exact_dedup"]
    first = {}
    for i in before:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[i]), i)
    assert after == sorted(first.values()) and len(after) < len(before)
    before, after = kept["near_dedup"]
    assert after == brute([(i, text[i]) for i in before]) and {200, 201, 202, 203} & set(after) == {200}
    before, after = kept["decontaminate"]
    hit = {r[0] for r in brute_hits(tests, [(i, text[i]) for i in before]) if r[5]}
    assert after == sorted(set(before) - hit) and hit == {103}
    taken, target = defaultdict(int), {}
    for r in docs.collect():
        assert r["size"] == len(words(r["text"])) and 0 < r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_empty(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_registered(spark, corpus):
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)] and set(registry.oracle_sql()) <= set(names)
    assert corpus_pipeline.run(spark, corpus[0]).count() > 0


def test_no_row_is_lost(spark):
    """Rows of one doc_id with different texts, and rows without a doc_id, through the stages that drop rows."""
    rows = [(1, "same text here", "en", "a"), (2, "same text here", "en", "a"), (2, "unique other words entirely", "en", "b"), (None, "same text here", "en", None), (None, "a lone row without id", None, "c"), (None, "a lone row without id", None, "c")]
    docs = spark.createDataFrame([(*r, 1, "own") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")
    want = sorted([(1, "same text here"), (2, "unique other words entirely"), (None, "a lone row without id")], key=str)
    got = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    assert got(stages["exact_dedup"](spark, docs, "")) == got(stages["near_dedup"](spark, docs, "")) == want
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert got(stages["language_id"](spark, none, "")) == sorted(((r[0], r[1]) for r in rows), key=str)
    items = spark.createDataFrame([("x", "same text here")], "item_id string, text string")
    assert got(decontaminate.drop_documents(docs, items)) == sorted([(2, "unique other words entirely"), *[(None, "a lone row without id")] * 2], key=str)
    mix = stages["mix"](spark, docs, "")
    assert mix.columns[: len(docs.columns)] == docs.columns and {r["size"] for r in mix.collect()} == {"own"}
    # the whole chain, on one frame
    for name in ("language_id", "exact_dedup", "near_dedup"):
        none = stages[name](spark, none, "")
    assert got(none) == want
