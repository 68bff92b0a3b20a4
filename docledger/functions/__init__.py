"""Column functions; every one can be used in a caller's own DataFrame code."""

from .amounts import parse_amount, parse_amount_bs, parse_vnd, same_amount
from .cleaning import clean_value, looks_like_address, looks_like_bsb, looks_like_name, strip_diacritics
from .display import (
    audit_display, client_ip, display_date, display_list, elapsed_seconds, field_label, http_status,
    human_size, identity_defaults, percent_display, progress, ratio_display, scan_info,
)
from .extract_au import (
    annual_salary, context_name, income, label_fields, pay_period_days, pay_period_error, regex_fields,
    suppress_salary, with_text_fields,
)
from .extract_vn import (
    minus_keep_dups, restore_surname, vn_cells, vn_income, vn_label_fields, vn_regex_fields, with_vn_fields,
)
from .fuzzy import fuzzy_label
from .text import (
    despace, find_all, find_dewrapped, find_first, let, line_of_offset, literal_occurrences, match_spans, strip,
)
from .validation import (
    accessible, declared_format, image_mime, route, safe_name, scan_verdict, signature_ok, stored_link,
)

__all__ = [n for n in dir() if not n.startswith("_")]
