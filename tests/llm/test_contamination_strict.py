"""op8 row by row against brute force; an item with a null id gives hits but is not named."""

import pytest

from corpusflow.llm import decontaminate

from . import cases


@pytest.mark.parametrize("window", [4])
def test_every_row_matches_brute_force(spark, window):
    texts = cases.texts(7)
    docs = cases.table(spark, texts)
    items = [(1, texts[5]), (20, " ".join((texts[6] or "").split()[3:12])), (3, "ab"), (4, None), (5, " .,"), (6, texts[5]),
             (7, "Nowhere to be found"), (None, "É ß"), (8, texts[40])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((i, n, k, ",".join(x for x in found.split(",") if x != "None"), bad)
                  for i, n, k, found, bad in cases.contamination(cases.pairs(docs), items, window))
    got = decontaminate.contamination(docs, bench, window=window).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in got) == want
