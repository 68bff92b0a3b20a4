"""Rules on upload batches: structure policy, unique names, batch limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..session import cut
from .ordered import carry_last, number_rows


def forbidden_entry(name: Column) -> Column:
    return F.lower(name).endswith(".bin") | F.lower(name).contains("word/embeddings/")


def structure_verdict(docs: DataFrame, entries: DataFrame, flags: DataFrame) -> DataFrame:
    """Add ``final_status, final_message``: a forbidden container overrides the scan (VAL5).

    ``docs``: doc_id, format, scan_status, scan_message; ``entries``: doc_id, entry_idx,
    entry_name; ``flags``: doc_id, has_open_action, has_embedded_files.
    """
    bad = (
        entries.filter(forbidden_entry(F.col("entry_name")))
        .groupBy("doc_id")
        .agg(F.min_by("entry_name", "entry_idx").alias("bad_entry"))
    )
    reason = (
        F.when(
            (F.col("format") == "DOCX") & F.col("bad_entry").isNotNull(),
            F.concat(F.lit("DOCX file contains forbidden entry: "), F.col("bad_entry")),
        )
        .when((F.col("format") == "PDF") & F.col("has_open_action"), "PDF contains forbidden open action execution elements")
        .when((F.col("format") == "PDF") & F.col("has_embedded_files"), "PDF contains forbidden embedded files")
    )
    return (
        docs.join(bad, "doc_id", "left")
        .join(flags, "doc_id", "left")
        .withColumn("__reason", reason)
        .withColumns(
            {
                "final_status": F.when(F.col("__reason").isNotNull(), "INFECTED").otherwise(F.col("scan_status")),
                "final_message": F.when(
                    F.col("__reason").isNotNull(),
                    F.concat(F.lit("Structural Validation Failed: "), F.col("__reason")),
                ).otherwise(F.col("scan_message")),
            }
        )
        .drop("__reason", "bad_entry", "has_open_action", "has_embedded_files")
    )


def split_name(name: Column) -> tuple[Column, Column]:
    """``(base, lower-case extension)``; a name without a dot is a ``pdf``."""
    has_dot = name.contains(".")
    base = F.when(has_dot, F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(name)
    ext = F.when(has_dot, F.lower(F.substring_index(name, ".", -1))).otherwise("pdf")
    return base, ext


def numbered_name(base: Column, n: Column, ext: Column) -> Column:
    suffix = F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(base, suffix, F.lit("."), ext)


_COUNTER = r"(?s) \(([1-9]\d{0,17})\)$"
_BLOCK = 4096


_KEYS = ["uploader_id", "__base", "__ext"]


def unique_names(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``final_name``: the lowest free of ``base.ext``, ``base (1).ext``, ... in order of arrival (VAL9).

    ``uploads``: uploader_id, upload_idx (order of arrival), name; ``existing``: uploader_id
    and name of live documents. The n-th upload of a name takes its n-th free counter. Names of a batch
    compete only in pairs: ``x (2).pdf`` may be taken by the third upload of ``x.pdf`` or by the first of
    ``x (2).pdf``, whichever comes first. These contests are settled before, level by level of nested
    counters; a counter that a name loses is then like one that is taken.
    """
    base, ext = split_name(F.col("name"))
    work = uploads.withColumns({"__base": base, "__ext": ext})
    held = _held_counters(existing)
    lost = _lost_counters(work, held)
    slots = held if lost is None else held.unionByName(lost)
    return _nth_free_counter(work, slots).drop("__base", "__ext")


def _held_counters(existing: DataFrame) -> DataFrame:
    """``uploader_id, __base, __ext, c``: counters that live documents hold; a name like ``x (2).pdf`` holds 2 of
    ``x`` and 0 of ``x (2)``."""
    taken = existing.select(
        "uploader_id", F.regexp_extract("name", r"(?s)^(.*)\.[^.]*$", 1).alias("__stem"), F.regexp_extract("name", r"(?s)\.([^.]*)$", 1).alias("__ext")
    )
    counter = F.regexp_extract("__stem", _COUNTER, 1)
    plain = taken.select("uploader_id", F.col("__stem").alias("__base"), "__ext", F.lit(0).cast("long").alias("c"))
    numbered = taken.filter(counter != "").select(
        "uploader_id", F.regexp_replace("__stem", _COUNTER, "").alias("__base"), "__ext", counter.cast("long").alias("c")
    )
    return plain.unionByName(numbered).distinct()


def _before(rows: DataFrame, order: str, number: str, probes: DataFrame, at: str, out: str, block: Column) -> DataFrame:
    """``probes`` with ``out``: how many ``rows`` of the same key, numbered in ``order``, come before ``at``."""
    marks = rows.select(*_KEYS, F.col(order).alias("__at"), F.lit(1).alias("__turn"), F.col(number).alias("__n"))
    asked = probes.withColumns({"__at": F.col(at), "__turn": F.lit(0), "__n": F.lit(None).cast("long")})
    both = asked.unionByName(marks, allowMissingColumns=True)
    counted = carry_last(both, _KEYS, ["__at", "__turn"], F.col("__n"), out, [block])
    return counted.filter("__turn = 0").withColumn(out, F.coalesce(out, F.lit(0).cast("long"))).drop("__at", "__turn", "__n")


def _lost_counters(work: DataFrame, held: DataFrame) -> DataFrame | None:
    """``uploader_id, __base, __ext, c``: counters that a name of the batch loses to another one of the batch; None
    where no two names compete.

    Counter k of a name is met by its upload number k + 1 less the counters it has lost or found held
    below k. It is lost if the name that is spelt so arrives before that upload. One row for each
    pair of competing names takes part, whatever the number of uploads.
    """
    bases = work.groupBy(*_KEYS).agg(F.min("upload_idx").alias("first_at"))
    spelt = bases.withColumn("c", F.regexp_extract("__base", _COUNTER, 1)).filter("c <> ''")
    spelt = spelt.select(
        "uploader_id", F.regexp_replace("__base", _COUNTER, "").alias("__base"), "__ext", F.col("c").cast("long").alias("c"), "first_at",
        F.col("__base").alias("spelt"), F.regexp_count("__base", F.lit(r" \([1-9]\d{0,17}\)(?=(?: \([1-9]\d{0,17}\))*$)")).alias("level"),
    )
    contests = spelt.join(bases.select(*_KEYS), _KEYS).join(held, [*_KEYS, "c"], "left_anti")
    mine = work.join(contests.select(*_KEYS).distinct(), _KEYS, "left_semi")
    uploads = number_rows(mine, _KEYS, ["upload_idx"], "n", [F.floor(F.col("upload_idx") / _BLOCK)])
    ranked = _before(uploads, "upload_idx", "n", contests, "first_at", "uploads_before", F.floor(F.col("__at") / _BLOCK))
    counters = number_rows(held.join(contests.select(*_KEYS).distinct(), _KEYS, "left_semi"), _KEYS, ["c"], "i", [F.floor(F.col("c") / _BLOCK)])
    known = cut(_before(counters, "c", "i", ranked, "c", "held_below", F.floor(F.col("__at") / _BLOCK)))
    levels = sorted(r.level for r in known.select("level").distinct().collect())
    settled: list[DataFrame] = []
    for level in levels:
        # does the name itself lose its counter 0 to the name it is spelt after?
        rows = known.filter(F.col("level") == level)
        if settled:
            zero = settled[-1].filter("c = 0").select(*_KEYS, F.lit(1).alias("zero"))
            rows = rows.join(zero, _KEYS, "left")
        else:
            rows = rows.withColumn("zero", F.lit(None).cast("int"))
        # counters that only this name's own rivals decide: a scan in their order
        state = F.struct(F.lit(0).cast("long").alias("lost"), F.array().cast("array<struct<spelt:string,c:bigint,lost:boolean>>").alias("out"))

        def meet(acc: Column, x: Column) -> Column:
            upload = x["c"] + 1 - x["held_below"] - acc["lost"] - F.coalesce(x["zero"], F.lit(0))
            loses = upload > x["uploads_before"]
            return F.struct(
                (acc["lost"] + loses.cast("long")).alias("lost"),
                F.array_append(acc["out"], F.struct(x["spelt"].alias("spelt"), x["c"].alias("c"), loses.alias("lost"))).alias("out"),
            )

        met = rows.groupBy(*_KEYS).agg(F.sort_array(F.collect_list(F.struct("c", "spelt", "held_below", "uploads_before", "zero"))).alias("x"))
        outcome = met.select(*_KEYS, F.explode(F.aggregate("x", state, meet, lambda acc: acc["out"])).alias("o"))
        won = F.col("o.lost")
        settled.append(
            cut(
                outcome.select(
                    "uploader_id", F.when(won, F.col("__base")).otherwise(F.col("o.spelt")).alias("__base"), "__ext",
                    F.when(won, F.col("o.c")).otherwise(F.lit(0).cast("long")).alias("c"),
                )
            )
        )
    return reduce(DataFrame.unionByName, settled) if settled else None


def _nth_free_counter(work: DataFrame, taken: DataFrame) -> DataFrame:
    """The n-th upload of a name takes the n-th counter that is not in ``taken`` (uploader_id, __base, __ext, c).

    With taken counters t1 < t2 < ..., there are ``t_i - i + 1`` free ones below t_i, so
    t_i pushes back every upload whose number is above that. One ordered pass over uploads
    and taken counters gives how many were passed; no candidates are listed.
    """
    slots = taken.join(work.select(*_KEYS).distinct(), _KEYS, "left_semi").distinct()
    slots = number_rows(slots, _KEYS, ["c"], "i", [F.floor(F.col("c") / _BLOCK)])
    ups = number_rows(work, _KEYS, ["upload_idx"], "n", [F.floor(F.col("upload_idx") / _BLOCK)])
    events = ups.withColumns({"i": F.lit(None).cast("long"), "turn": F.lit(1)}).unionByName(
        slots.select(*_KEYS, (F.col("c") - F.col("i") + 2).alias("n"), "i", F.lit(0).alias("turn")),
        allowMissingColumns=True,
    ).withColumn("tie", F.coalesce(F.col("i"), F.lit(0)))
    passed = carry_last(
        events, _KEYS, ["n", "turn", "tie"], F.col("i"), "skip", [F.floor(F.col("n") / _BLOCK)]
    )
    at = F.col("n") - 1 + F.coalesce("skip", F.lit(0))
    return (
        passed.filter(F.col("turn") == 1)
        .withColumn("final_name", numbered_name(F.col("__base"), at, F.col("__ext")))
        .drop("i", "n", "turn", "tie", "skip")
    )


def batch_gate(files: DataFrame) -> DataFrame:
    """Add ``batch_error`` per file of a request: too many files, or a file too large (VAL10).

    ``files``: request_id, byte_size. Requests are counted with map-side combine and joined
    back, so one huge request is not gathered in a window."""
    sizes = files.groupBy("request_id").agg(F.count("*").alias("n_files"))
    error = F.when(
        F.col("n_files") > V.MAX_BATCH_FILES,
        F.concat(
            F.lit("Batch upload limit exceeded — maximum 10 documents per request, got "),
            F.col("n_files").cast("string"),
        ),
    ).when(F.col("byte_size") > V.MAX_FILE_BYTES, "File exceeds the maximum upload size")
    return files.join(sizes, "request_id").withColumn("batch_error", error)
