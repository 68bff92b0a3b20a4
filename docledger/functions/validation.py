"""Checks on uploaded files: names, formats, signatures, scan replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V


def lower_extension(filename: Column) -> Column:
    """Text after the last dot, lower-cased; the whole name when there is no dot."""
    return F.substring_index(F.lower(filename), ".", -1)


def route(filename: Column, text_len: Column) -> Column:
    """``(path, error)``: which reading path a file takes (VAL1). ``text_len`` is the sum
    of the stripped text lengths of a PDF's pages."""
    has_dot = filename.contains(".")
    ext = F.when(has_dot, lower_extension(filename))
    path = (
        F.when(ext.isin("png", "jpg", "jpeg"), "ocr")
        .when(ext.isin("docx", "csv"), "text_native")
        .when(
            ext == "pdf",
            F.when(F.coalesce(text_len, F.lit(0)) < V.SCANNED_TEXT_LENGTH, "ocr").otherwise("text_native"),
        )
    )
    shown = F.when(has_dot, F.concat(F.lit("."), ext)).otherwise("")
    error = F.when(
        path.isNull(), F.concat(F.lit("unsupported file extension: '"), shown, F.lit("'"))
    )
    return F.struct(path.alias("path"), error.alias("error"))


def declared_format(filename: Column) -> Column:
    """``(format, mime, error)`` from the name; a name without a dot is a PDF (VAL3)."""
    ext = F.when(filename.contains("."), F.upper(F.substring_index(filename, ".", -1))).otherwise("PDF")
    known = ext.isin(V.FORMATS)
    mime = F.try_element_at(F.create_map(*[F.lit(x) for kv in V.MIME_TYPES.items() for x in kv]), ext)
    return F.struct(
        F.when(known, ext).alias("format"),
        F.when(known, mime).alias("mime"),
        F.when(~known, "Unsupported document format").alias("error"),
    )


def signature_ok(fmt: Column, content: Column) -> Column:
    """The first bytes are those of the declared format; CSV has none to check (VAL2)."""
    head = F.hex(F.substring(content, F.lit(1), F.lit(4)))
    ok = F.when(fmt == "CSV", True)
    for name, magic in V.SIGNATURES.items():
        ok = ok.when(fmt == name, F.coalesce(head.startswith(magic), F.lit(False)))
    return ok.otherwise(False)


def image_mime(content: Column) -> Column:
    """``image/png`` or ``image/jpeg`` from the bytes, else NULL (VAL4)."""
    head = F.hex(F.substring(content, F.lit(1), F.lit(4)))
    return F.when(head.startswith(V.SIGNATURES["PNG"]), "image/png").when(
        head.startswith(V.SIGNATURES["JPG"]), "image/jpeg"
    )


def scan_verdict(reply: Column, strict: bool = False) -> Column:
    """``(status, message)`` of a scanner reply (VAL6).

    The default looks for ``OK`` first, so a malware name containing it reads as clean;
    ``strict=True`` looks for ``FOUND`` first.
    """
    name = F.nullif(F.regexp_extract(reply, r":\s*(.+?)\s+FOUND", 1), F.lit(""))
    infected = F.struct(
        F.lit("INFECTED").alias("status"),
        F.concat(
            F.lit("Malware detected: "), F.coalesce(name, F.lit("Unknown malware")), F.lit(".\nDocument quarantined.")
        ).alias("message"),
    )
    clean = F.struct(F.lit("CLEAN").alias("status"), F.lit("No malware detected.").alias("message"))
    error = F.struct(
        F.lit("ERROR").alias("status"),
        F.when(reply.isNull(), "Malware scan failed.")
        .otherwise("Malware scan returned an unrecognized response.")
        .alias("message"),
    )
    tests = [(reply.contains("OK"), clean), (reply.contains("FOUND"), infected)]
    if strict:
        tests.reverse()
    return F.when(*tests[0]).when(*tests[1]).otherwise(error)


def stored_link(status: Column, path: Column) -> Column:
    """Only clean files keep a link (VAL7)."""
    return F.when(status == "CLEAN", path).otherwise(V.REJECTED_LINK)


def accessible(status: Column) -> Column:
    """A document can be opened when clean or never scanned (VAL7)."""
    return status.isNull() | (status == "CLEAN")


def safe_name(c: Column) -> Column:
    """Last path component with unusual characters replaced (VAL8)."""
    last = F.regexp_extract(c, r"(?s)([^/]*)/*$", 1)
    return F.when(c.isNull() | c.contains("\u0000"), "avatar").otherwise(
        F.regexp_replace(last, r"[^A-Za-z0-9._-]", "_")
    )
