"""Unique upload names against names given one by one."""

import random

import pytest

from docledger.operators import upload


def one_by_one(uploads, existing):
    taken: dict = {}
    for who, name in existing:
        taken.setdefault(who, set()).add(name)
    out = {}
    for who, i, name in sorted(uploads, key=lambda u: u[1]):
        held = taken.setdefault(who, set())
        base, ext = (name.rsplit(".", 1)[0], name.rsplit(".", 1)[1].lower()) if "." in name else (name, "pdf")
        n = 0
        while (final := f"{base}{f' ({n})' if n else ''}.{ext}") in held:
            n += 1
        held.add(final)
        out[i] = final
    return out


def compare(spark, uploads, existing):
    ups = spark.createDataFrame(uploads, "uploader_id string, upload_idx long, name string")
    held = spark.createDataFrame(existing, "uploader_id string, name string")
    found = upload.unique_names(ups, held).collect()
    assert len(found) == len(uploads)
    assert {r.upload_idx: r.final_name for r in found} == one_by_one(uploads, existing)


@pytest.mark.parametrize("seed", range(3))
def test_random_families(spark, seed):
    r = random.Random(seed)

    def name():
        tail = "".join(f" ({r.randint(0, 5)})" for _ in range(r.choice([0, 0, 0, 1, 1, 2, 3])))
        return r.choice("ab") + tail + r.choice([".pdf", ".PDF", ".csv", ""])

    uploads = [(f"u{r.randint(0, 8)}", i, name()) for i in r.sample(range(3000), 900)]
    compare(spark, uploads, [(f"u{r.randint(0, 8)}", name() if r.random() < 0.9 else "odd") for _ in range(120)])


def test_one_family_holds_most_rows(spark):
    r = random.Random(9)
    names = ["x.pdf"] * 6 + ["x (3).pdf", "x (700).pdf"] + [f"x ({k}).pdf" for k in range(1, 400, 7)] + ["x (1) (1).pdf", "x (8) (2).pdf"]
    uploads = [("hot", i, r.choice(names)) for i in range(3000)] + [(f"u{i % 40}", 3000 + i, "x.pdf") for i in range(400)]
    compare(spark, uploads, [("hot", f"x ({k}).pdf") for k in range(2, 60, 5)] + [("hot", "x.pdf")])


def test_names_that_do_not_compete_and_no_rows(spark):
    compare(spark, [("u", 1, "a.pdf"), ("u", 2, "b (01).pdf"), ("u", 3, "b.pdf"), ("u", 4, "a.pdf")], [])
    compare(spark, [], [("u", "a.pdf")])
