"""Totals of lost table rows, against the definition carried out fragment by fragment."""

from __future__ import annotations

import random
import re

from docledger import fixed_values as V
from docledger.operators.geometry import recover_rows

FRAGS = "doc_id string, page int, table_idx int, frag_idx int, text string, x1 double, y1 double, x2 double, y2 double"
MISSING = "doc_id string, page int, field string"


def amount(text):
    """The first digits from a dollar sign on; the fixtures have no separators and no prose."""
    m = re.search(r"\d+", text[max(text.find("$"), 0) :])
    return float(m[0]) if m else None


def of_table(frags, fields):
    """{field: amount} of one table's (x1, y1, frag_idx, text)."""
    left = min(f[0] for f in frags)
    labels = sorted((f for f in frags if f[0] - left < V.LABEL_BAND), key=lambda f: (f[1], f[0], f[3], f[2]))
    out = {}
    for field in fields:
        pattern = re.compile(V.BALANCE_LABELS[field], re.I)
        begins = lambda i: any(
            pattern.match(re.sub(r"\s", "", "".join(f[3] for f in labels[i : i + k]))) for k in range(1, V.LABEL_RUN + 1)
        )
        y = next((labels[i][1] for i in range(len(labels)) if begins(i)), None)
        if y is None:
            continue
        near = sorted(f for f in ((f[0], f[2], f[1], f[3]) for f in frags if f[0] - left >= V.LABEL_BAND) if y - 5 <= f[2] <= y + 60)
        columns = []
        for k, f in enumerate(near):
            if k == 0 or f[0] - near[k - 1][0] > V.COLUMN_GAP:
                columns.append([])
            columns[-1].append((f[2], f[0], f[1], f[3]))
        found = [amount(re.sub(r"\s", "", "".join(f[3] for f in sorted(c)))) for c in columns]
        found = [a for a in found if a is not None]
        if found:
            out[field] = found[-1]
    return out


def brute(frags, missing):
    out = {}
    for doc, page in {m[:2] for m in missing}:
        fields = [m[2] for m in missing if m[:2] == (doc, page)]
        for table in sorted({f[2] for f in frags if f[:2] == (doc, page)}, reverse=True):
            own = [(f[5], f[6], f[3], f[4]) for f in frags if f[:3] == (doc, page, table)]
            for field, a in of_table(own, fields).items():
                out[doc, page, field] = a
    return out


def got(spark, frags, missing):
    rows = recover_rows(spark.createDataFrame(frags, FRAGS), spark.createDataFrame(missing, MISSING)).collect()
    assert len({(r.doc_id, r.page, r.field) for r in rows}) == len(rows)
    return {(r.doc_id, r.page, r.field): r.value for r in rows}


def test_random_tables(spark):
    rng = random.Random(5)
    words = ["Total", "To", "tal ", "Assets", "Ass", "ets", "Current", " Lia", "bilities", "Liabilities", "Equity", "Net", "Cash", "", "Note 4"]
    phrases = [["To", "tal ", "Ass", "ets"], ["Total", "Current", "Assets"], ["Total", " Lia", "bilities", "and", "Equity"], ["Total Liabilities", ""], ["Net", "", "Assets"]]
    frags, missing = [], []
    for d in range(60):
        for table in range(rng.randint(1, 3)):
            y, coming = 0.0, []
            for k in range(rng.choice([3, 12, 60])):
                # steps of up to two bands, and several fragments of one height
                y += rng.choice([0, 0, 7, 22, 22, 90, 300, 600])
                label = rng.random() < 0.75
                if label and not coming:
                    coming = rng.choice([*phrases, [rng.choice(words)]])[:]
                text = coming.pop(0) if label else rng.choice(["$12", "345", "$", "6", "n/a", "-"])
                x = float(rng.choice([10, 12, 59]) if label else rng.choice([60, 75, 200, 215, 236, 500]))
                frags.append((f"d{d % 50}", d // 50, table, k, text, x, y, x + 30, y + 20))
        for field in rng.sample(V.BALANCE_KEYS, rng.randint(0, len(V.BALANCE_KEYS))):
            missing.append((f"d{d % 50}", d // 50, field))
    want = brute(frags, missing)
    assert len(want) > 20 and got(spark, frags, missing) == want


def test_run_over_many_bands(spark):
    """A label in eight pieces, each in another band; with nine it is none."""
    for pieces in (["T", "ot", "al", "A", "ss", "e", "t", "s"], ["T", "o", "t", "al", "A", "ss", "e", "t", "s"]):
        frags = [("d", 0, 0, i, p, 10.0, 700.0 * i, 20.0, 700.0 * i + 9) for i, p in enumerate(pieces)]
        frags += [("d", 0, 0, 50, "$7", 300.0, 0.0, 310.0, 9.0)]
        want = {("d", 0, "total_assets"): 7.0} if len(pieces) == 8 else {}
        assert brute(frags, [("d", 0, "total_assets")]) == want == got(spark, frags, [("d", 0, "total_assets")])


def test_one_long_table_and_nothing(spark):
    frags = [("d", 0, 0, i, "Cash", 10.0, 9.0 * i, 20.0, 9.0 * i + 8) for i in range(5000)]
    frags[4321] = (*frags[4321][:4], "Total Equity", *frags[4321][5:])
    frags += [("d", 0, 0, 9000 + i, f"${i}", 300.0, 9.0 * i, 310.0, 9.0 * i + 8) for i in range(0, 5000, 7)]
    missing = [("d", 0, f) for f in V.BALANCE_KEYS]
    want = brute(frags, missing)
    assert want and got(spark, frags, missing) == want
    assert got(spark, [], missing) == got(spark, frags, []) == {}
    blank = [("d", 0, 0, 1, None, 10.0, 5.0, 20.0, 9.0), ("d", 0, 0, 2, "$5", None, None, None, None)]
    assert got(spark, blank, missing) == {}
