"""Values looked up in text layers: cursors, wrapped values, gaps, pass-through."""

import random

import pytest
from pyspark.sql import functions as F

from docledger.operators import text_layer as L

ITEM = "doc_id string, item_idx int, field string, value string, x_pct double, y_pct double, w_pct double, h_pct double"


def runs_of(text, blank=()):
    """A piece for each character but breaks; positions in ``blank`` have none."""
    return [(i, i + 1, 5.0 * i, 80.0, 5.0 * i + 5, 90.0) for i, c in enumerate(text) if c not in "\r\n" and i not in blank]


def resolve(spark, pages, items):
    layer = spark.createDataFrame(
        [(d, p, t, 100.0, 200.0, runs_of(t, blank)) for d, p, t, blank in pages], f"doc_id string, page int, text string, width double, height double, runs array<{L.RUN}>"
    )
    asked = spark.createDataFrame([(d, i, "f", v, *([0.1] * 4 if boxed else [None] * 4)) for d, i, v, boxed in items], ITEM)
    found = L.text_native_boxes(asked, layer).collect()
    return {(r.doc_id, r.item_idx): (round(r.x_pct * 100 / 5), r.y_pct) for r in found}


def search(pages, items):
    """One document, item by item. pages: (text, positions without a piece). -> item: (page, first position with a piece)"""
    cursors, out = {}, {}
    for i, value in enumerate(items):
        if not value:
            continue
        for p, (text, blank) in enumerate(pages):
            at = cursors.get((p, value), 0)
            s = text.lower().find(value.lower(), at)
            e = s + len(value)
            if s < 0:
                kept = [k for k, c in enumerate(text) if c not in "\r\n"]
                flat = "".join(text[k] for k in kept)
                s = flat.find(value, sum(k < at for k in kept))
                if s < 0:
                    continue
                s, e = kept[s], kept[s + len(value) - 1] + 1
            cursors[p, value] = e
            boxed = [k for k in range(s, e) if text[k] not in "\r\n" and k not in blank]
            if boxed:
                out[i] = (p, boxed[0])
                break
    return out


def test_two_pages_repeated_wrapped_and_boxed(spark):
    pages = [("d", 0, "Total $74,000 and $74,\r\n000", ()), ("d", 1, "page two: $74,000, $9", ())]
    items = [("d", 0, "$74,000", False), ("d", 1, "$74,000", False), ("d", 2, "$74,000", False), ("d", 3, "$74,000", False), ("d", 4, "$9", False), ("d", 5, "kept", True), ("d", 6, "absent", False), ("d", 7, "", False)]
    found = resolve(spark, pages, items)
    assert {k: v[0] for k, v in found.items()} == {("d", 0): 6, ("d", 1): 18, ("d", 2): 10, ("d", 4): 19, ("d", 5): 2}
    assert found["d", 0][1] == (200 - 90) / 400 and found["d", 2][1] == (200 + 200 - 90) / 400


def test_both_occurrences_wrapped_and_any_case(spark):
    pages = [("d", 0, "$74,\r\n000 x $74,\r\n000", ()), ("e", 0, "NGUYỄN İ nguyễn", ()), ("f", 0, "NGUYỄN nguyễn", ())]
    items = [("d", 0, "$74,000", False), ("d", 1, "$74,000", False), ("e", 0, "nguyễn", False), ("f", 0, "nguyễn", False), ("f", 1, "Nguyễn", False)]
    found = resolve(spark, pages, items)
    assert {k: v[0] for k, v in found.items()} == {("d", 0): 0, ("d", 1): 12, ("e", 0): 9, ("f", 0): 0, ("f", 1): 0}


@pytest.mark.parametrize("seed", range(3))
def test_random_documents_equal_item_by_item_search(spark, seed):
    r = random.Random(seed)
    pages, items, expected = [], [], {}
    for d in range(40):
        texts = []
        for p in range(r.randint(1, 4)):
            text = "".join(r.choice("abAB \n\r") for _ in range(r.randint(0, 30)))
            blank = {k for k in range(len(text)) if r.random() < (0.6 if d % 3 == 0 else 0.0)}
            texts.append((text, blank))
            pages.append((f"d{d}", p, text, blank))
        values = ["".join(r.choice("abAB ") for _ in range(r.randint(0, 3))) for _ in range(r.randint(1, 12))]
        items += [(f"d{d}", i, v, False) for i, v in enumerate(values)]
        for i, (p, at) in search(texts, values).items():
            expected[f"d{d}", i] = (at, (200 * p + 110) / (200 * len(texts)))
    found = resolve(spark, pages, items)
    assert found.keys() == expected.keys()
    assert all(found[k][0] == expected[k][0] and abs(found[k][1] - expected[k][1]) < 1e-12 for k in found)


def test_bisection_and_layers_from_rows(spark):
    arrays = spark.createDataFrame([([],), ([1],), ([1, 2, 2, 5, 9],), (list(range(100)),)], "a array<int>")
    for bound in (0, 1, 2, 4, 99, 200):
        got = arrays.select(L.bisect(F.col("a"), lambda x: x <= bound).alias("n"), F.size(F.filter("a", lambda x: x <= bound)).alias("m")).collect()
        assert all(r.n == r.m for r in got)
    rows = spark.createDataFrame([("d", 0, *x) for x in reversed(runs_of("ab c"))], "doc_id string, page int, start int, end int, left double, bottom double, right double, top double")
    assert [tuple(x) for x in L.layer_of(rows).first().runs] == runs_of("ab c")


def test_empty_tables(spark):
    assert resolve(spark, [], []) == {}
    assert resolve(spark, [("d", 0, None, ())][:0], [("d", 0, "x", False), ("d", 1, None, False)]) == {}
