"""Misread label matching (MAT2): Python measures how alike two texts are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V


def closest(labels: dict[str, str], least: float, margin: float):
    """Function of a series of texts: the field whose label has the best matching-block ratio with
    each, if it is good enough and no other good one is within the margin. The labels travel with
    it, so workers need no installed package."""

    def measure(texts):
        from difflib import SequenceMatcher

        # a matcher prepares its second sequence once: keep one for each label
        matchers = [(field, SequenceMatcher(b=label)) for field, label in labels.items()]
        known = {None: None}

        def field_of(text):
            if text not in known:
                for _, m in matchers:
                    m.set_seq1(text)
                ratios = [(m.ratio(), field) for field, m in matchers]
                best = max(r for r, _ in ratios)
                rivals = [field for r, field in ratios if r >= least and best - r < margin]
                known[text] = rivals[0] if len(rivals) == 1 else None
            return known[text]

        return texts.map(field_of, na_action="ignore").astype(object).where(texts.notna(), None)

    import pandas as pd

    measure.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return measure


def plausible(c: Column) -> Column:
    """Lossless native filter: a ratio of 0.85 is impossible outside these lengths."""
    ok = F.lit(False)
    for size in sorted({len(label) for label in V.CANONICAL_LABELS.values()}):
        ok = ok | (2 * F.least(F.length(c), F.lit(size)) / (F.length(c) + size) >= V.FUZZY_THRESHOLD)
    return ok


def _measured(c: Column, kind: str, measure) -> Column:
    # kept from being evaluated a second time in a filter on its result
    return F.pandas_udf(measure, kind).asNondeterministic()(c)


def _closest():
    return closest({field: label.lower() for field, label in V.CANONICAL_LABELS.items()}, V.FUZZY_THRESHOLD, V.FUZZY_MARGIN)


def fuzzy_label(c: Column) -> Column:
    """Field of a misread label cell, or NULL: the closest label, if it is close enough and no
    other close one is within the margin. Filter rows with ``plausible`` first."""
    return _measured(F.lower(c), "string", _closest())


def fuzzy_labels(texts: Column) -> Column:
    """``fuzzy_label`` of each text of an array, NULL for NULL."""
    one = _closest()

    def measure(arrays):
        import pandas as pd

        whole = pd.Series([t for a in arrays for t in a], dtype=object)
        fields = iter(one(whole))
        return pd.Series([[next(fields) for _ in a] for a in arrays], dtype=object)

    import pandas as pd

    measure.__annotations__ = {"arrays": pd.Series, "return": pd.Series}
    return _measured(F.transform(texts, F.lower), "array<string>", measure)
