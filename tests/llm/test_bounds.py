"""What bounds may not change: languages beside larger ones, items in several blocks."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("wayloom.llm")
from wayloom.llm import decontaminate, language


def test_counts_of_a_small_language(spark):
    """No language, context or count is left out, whatever the others have."""
    big = [(i, " ".join(chr(97 + (i * 7 + k * k) % 26) * 3 for k in range(60)), "aa") for i in range(80)]
    small = [(100 + i, "żółć gęślą jaźń", "zz") for i in range(3)]
    frame = spark.createDataFrame([*big, *small], "doc_id long, text string, lang string")
    got = defaultdict(dict)
    for r in language.counts(frame, 2000).collect():
        got[r["lang"]][r["gram"]] = r["n"]
    for lang, rows in (("aa", big), ("zz", small)):
        g, n = np.unique(language.runs([t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]), return_counts=True)
        assert got[lang] == dict(zip(g.tolist(), n.tolist(), strict=True))


def test_overlapping_items_in_blocks(spark):
    w = [f"p{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, "start " + " ".join(w) + " end")], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(w[:10])), ("b", " ".join(w[5:15]))], "item_id string, text string").coalesce(1)
    got = [decontaminate.drop_spans(docs, items, block_bytes=n).collect() for n in (8_000_000, 30)]
    assert got[0] == got[1] and got[0][0]["text"] == "start  p15 p16 p17 p18 p19 end"
