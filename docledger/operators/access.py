"""What a viewer who does not own a document may see of its result.

The result arrives as JSON text of unknown shape, so every step fails closed: a shape that
is not recognised loses data, it never leaks it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

_HIDDEN = ["redaction", "preview_image_base64"]
_READINESS = ["loan_readiness", "balance_sheet_readiness"]
_MAP = "map<string,variant>"


def _entries(v: Column) -> Column:
    """The fields of an object, NULL for anything else: one cast is both the shape test and
    the parts to rebuild from."""
    return F.try_variant_get(v, "$", _MAP)


def _object(entries: Column) -> Column:
    return F.to_variant_object(entries)


def scrub_readiness(v: Column) -> Column:
    """A readiness object with every ``checks.*.value`` nulled; NULL (meaning: remove it)
    when the shape is unexpected (ACL4)."""
    nothing = F.parse_json(F.lit("null"))

    def rebuild(obj: Column, checks: Column) -> Column:
        # a value is replaced where it exists and added where it does not
        cleaned = F.transform_values(
            checks,
            lambda _, c: F.map_concat(F.map_filter(c, lambda k, _v: k != "value"), F.create_map(F.lit("value"), nothing)),
        )
        rest = F.map_filter(obj, lambda k, _v: k != "checks")
        well_formed = F.forall(F.map_values(checks), lambda c: c.isNotNull())
        return F.when(well_formed, _object(F.map_concat(rest, F.create_map(F.lit("checks"), _object(cleaned)))))

    def checked(obj: Column) -> Column:
        parts = _entries(F.try_element_at(obj, F.lit("checks")))
        shapes = let(parts, lambda p: F.when(p.isNotNull(), F.transform_values(p, lambda _, c: _entries(c))))
        return let(shapes, lambda checks: F.when(checks.isNotNull(), rebuild(obj, checks)))

    return let(_entries(v), lambda obj: F.when(obj.isNotNull(), checked(obj)))


def strip_sensitive(json: Column) -> Column:
    """The result JSON a non-owner sees (ACL3): sensitive fields removed, hidden parts
    dropped, readiness values nulled; NULL when the text is not a JSON object."""
    nothing = F.parse_json(F.lit("null"))

    def kept_fields(obj: Column) -> Column:
        names = F.try_variant_get(F.try_element_at(obj, F.lit("sensitive_field_keys")), "$", "array<variant>")
        listed = F.transform(names, lambda k: F.try_variant_get(k, "$", "string"))
        fields = _entries(F.try_element_at(obj, F.lit("fields")))

        def pick(n: Column, f: Column) -> Column:
            kept = F.map_filter(f, lambda k, _v: ~F.coalesce(F.array_contains(n, k), F.lit(False)))
            return F.when(n.isNotNull() & f.isNotNull(), _object(kept)).otherwise(nothing)

        return let(listed, lambda n: let(fields, lambda f: pick(n, f)))

    def with_root(obj: Column) -> Column:
        # parts that need work are rebuilt where they stand, in one pass over the root
        def part(k: Column, v: Column) -> Column:
            scrubbed = F.when(F.is_variant_null(v), v).otherwise(scrub_readiness(v))
            return F.when(k == "fields", kept_fields(obj)).when(k.isin(_READINESS), scrubbed).otherwise(v)

        visible = F.map_filter(obj, lambda k, _v: ~k.isin(_HIDDEN))
        shown = F.map_filter(F.transform_values(visible, part), lambda _k, v: v.isNotNull())
        return F.to_json(_object(shown))

    root = let(F.try_parse_json(json), _entries)
    return let(root, lambda obj: F.when(obj.isNotNull(), with_root(obj)))


def shown_result(json: Column, owner: Column) -> Column:
    """Owners see the stored result, everyone else the stripped one (ACL3)."""
    return F.when(owner, json).otherwise(strip_sensitive(json))
