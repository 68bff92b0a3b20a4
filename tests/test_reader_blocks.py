"""The balance reader gives the same totals however a page is cut into blocks."""

import random

from docledger.operators import balance as B

LABELS = [
    "Total current assets", "TOTAL ASSETS", "Total current liabilities", "Total liabilities", "Total equity", "Total Liabililies", "Total",
    "Current assets", "Current/short-term liabilities", "Fixed assets", "Cash", "TOTAL CURRENT ASSETS TOTAL ASSETS TOTAL EQUITY", "Total assets Total liabilities",
    "", "Debt (Total Liabilities / Total Assets)", "Year 1", "CURRENT YEAR",
]


def random_rows(seed):
    r = random.Random(seed)
    rows = []
    for doc in range(60):
        for page in range(r.randint(1, 3)):
            for i in range(r.randint(1, 30)):
                cells = [r.choice(LABELS)] + [r.choice(["", "$", f"${r.randint(1, 999)}", f"{r.randint(1, 9)},000", "text", "Year 2", "PRIOR YEAR"]) for _ in range(r.randint(0, 3))]
                rows.append((f"d{doc}", page, i, cells))
    return rows


def first_wins(rows, below_of):
    """Fields of one page whose cells name several labels: cell by cell, rank among the missing."""
    out = {}
    for i, cells in enumerate(rows):
        found = [f for f, name in (("total_current_assets", "CURRENTASSETS"), ("total_assets", "TOTALASSETS"), ("total_equity", "TOTALEQUITY")) if name in cells[0].replace(" ", "") and f not in out]
        for rank, f in enumerate(found):
            below = below_of(i)
            col = rank if len(found) > 1 else 0
            if below and col < len(below) and below[col].startswith("$"):
                out[f] = float(below[col][1:])
    return out


def test_blocks_and_thinning_change_nothing(spark, monkeypatch):
    table = spark.createDataFrame(random_rows(3), "doc_id string, page int, row_idx int, cells array<string>")
    whole = {tuple(r) for r in B.read_pages(table).collect()}
    assert len(whole) > 50
    monkeypatch.setattr(B, "ROW_BLOCK", 4)
    monkeypatch.setattr(B, "PAGE_BLOCK", 2)
    monkeypatch.setattr(B, "_FOLDED", 1)
    assert {tuple(r) for r in B.read_pages(table).collect()} == whole


def test_rank_among_missing_fields(spark):
    """Earlier cells settle fields, which moves the ranks of later ones."""
    r = random.Random(5)
    rows, expected = [], {}
    for doc in range(40):
        lines = []
        for _ in range(r.randint(1, 5)):
            lines.append([r.choice(["TOTAL CURRENT ASSETS TOTAL ASSETS TOTAL EQUITY", "TOTAL ASSETS TOTAL EQUITY", "TOTAL CURRENT ASSETS TOTAL EQUITY"])])
            lines.append([r.choice(["", f"${r.randint(1, 99)}"]) for _ in range(3)])
        rows += [(f"d{doc}", 0, i, cells) for i, cells in enumerate(lines)]
        # rows without any text are passed over
        filled = [c for c in lines if any(c)]
        totals = first_wins(filled, lambda i, f=filled: f[i + 1] if i + 1 < len(f) else None)
        if totals:
            expected[f"d{doc}"] = totals
    table = spark.createDataFrame(rows, "doc_id string, page int, row_idx int, cells array<string>")
    names = ("total_current_assets", "total_assets", "total_equity")
    found = {x.doc_id: {n: x[n] for n in names if x[n] is not None} for x in B.read_pages(table).collect()}
    assert found == expected
