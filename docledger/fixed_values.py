"""Fixed values.

Everything in this file is a value that must stay exactly as it is for results to be
right: match patterns (Java regex dialect), phrase lists, key lists, thresholds and
display texts. Nothing here is logic.

Dialect notes: ``U`` = Unicode classes, ``i`` = case-insensitive, ``d`` = ``.`` stops
only at ``\\n``.
"""

# --- fixed values: Australian text patterns ------------------------------------------
DATE = r"(?U)\b\d{2}/\d{2}/\d{4}\b"
SALARY = r"(?U)\$\s?\d{1,3}(?:\s*,\s*\d{3})*(?:\.\d{2})?\b"
ABN = r"(?U)\b\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}\b"
PHONE = r"(?U)\b0[2-478](?:[ ]?\d){8}\b"

AU_LISTS = {"abn": ABN, "phone": PHONE, "dates": DATE, "salary": SALARY}

AU_LABELS = {
    "name": r"(?iU)E?mployee(?:\s*Name)?\s*:[ \t]*([^\[\n]*)",
    "address": r"(?iU)E?mployee\s*Address\s*:[ \t]*([^\[\n]*)",
    "employer_name": r"(?iU)E?mployer(?:\s*Name)?\s*:[ \t]*([^\[\n]*)",
    "employer_address": r"(?iU)E?mployer\s*Address\s*:[ \t]*([^\[\n]*)",
    "bsb": r"(?iU)B?SB\s*:[ \t]*([^\[\n]*)",
    "account_number": r"(?iU)A?ccount\s*:[ \t]*([^\[\n]*)",
}

AU_INCOME = {
    "gross": r"(?iU)(?:T?otal\s*g?ross\s*payment|G?ross\s*Pay)\s*:?[ \t]*([^\[\n]*)",
    "net": r"(?iU)(?:N?ET\s*PAY|T?otal\s*n?et\s*payment|N?et\s*Pay)\s*:?[ \t]*([^\[\n]*)",
}

ANNUAL_SALARY = r"(?iU)Annual\s*salary\s*:[ \t]*(?:\[[^\[\]]*\]\s*)?(\$[\d,]+(?:\.\d{2})?)"
PAY_PERIOD = r"(?iU)Pay\s*period\s*:[ \t]*(\d{2}/\d{2}/\d{4})\s*to\s*(\d{2}/\d{2}/\d{4})"
AMOUNT = r"(?U)(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{2})?"
ADDRESS_SHAPE = r"(?U)\b(?:NSW|VIC|QLD|WA|SA|TAS|ACT|NT)\s+\d{4}\b"
NAME_CONTEXT = ["employee", "mployee", "slip for", "full name", "worker", "staff", "candidate"]
AU_STATES = ["NSW", "VIC", "QLD", "WA", "SA", "TAS", "ACT", "NT"]

# --- fixed values: balance-sheet patterns --------------------------------------------
BALANCE_LABELS = {
    "total_current_assets": r"Total\s*Current\s*Assets",
    "total_assets": r"Total\s*Assets",
    "total_current_liabilities": r"Total\s*Current\s*Liabilities",
    "total_liabilities": r"Total\s*Liabilities(?!\s*(?:and|&))",
    "total_equity": r"Total\s*(?:(?:Owner|Shareholder)(?:'s|s'|'|s)?\s*)?Equity|Net\s*Assets|Net\s*Worth",
}
BALANCE_KEYS = list(BALANCE_LABELS)
BALANCE_VALUE_SUFFIX = r"\s*:?[ \t]*(?:\([^()]*\)\s*)?([^\[\n]*)"
SECTION_ASSETS = r"(?iU)^Current\s*Assets$"
SECTION_LIABILITIES = r"(?iU)^Current(?:/short-?term)?\s*Liabilities$"
SECTION_OTHER = r"(?iU)^(?:Fixed\s*Assets|Long-Term\s*Liabilities|Intermediate\s*Liabilities)$"
BARE_TOTAL = r"(?i)^Total$"
ANY_TOTAL = r"(?i)Total"
PERIOD_CURRENT = r"(?iU)\bCURRENT\b|\bTHIS\s*Y"
PERIOD_PRIOR = r"(?iU)\bPRIOR\b|\bPREVIOUS\b|\bLAST\s*Y"
PERIOD_NUMBERED = r"(?iU)\b(?:F?Y|Year)\s*(\d+)\b"
BARE_SYMBOL = r"^[$Ss]+$"
PERIOD_THOUSANDS = r"(?U)\d{1,3}(?:\.\d{3})+\.\d{2}"
BALANCE_AMOUNT = r"(?U)(?:\d{1,3}(?:[,\s]\d{3})+|\d+)(?:\.\d{2})?"
BARE_AMOUNT = r"(?U)\$\s*\d[\d,.\s]*\d|\$\s*\d"
CANONICAL_LABELS = {
    "total_current_assets": "Total Current Assets",
    "total_assets": "Total Assets",
    "total_current_liabilities": "Total Current Liabilities",
    "total_liabilities": "Total Liabilities",
    "total_equity": "Total Equity",
}

# --- fixed values: Vietnamese text patterns ------------------------------------------
CCCD = r"(?U)\b\d{12}\b"
VN_PHONE = r"(?U)(?:\+84|0)(?:3|5|7|8|9)\d{8}\b"
TAX_CODE = r"(?U)\b\d{10}(?:-\d{3})?\b"
VN_SALARY = r"(?U)\b\d{1,3}(?:[,.]\d{3})+\b"
VN_AMOUNT = r"(?U)\d{1,3}(?:[.,]\d{3})+|\d+"
VN_BARE_LABELS = {
    "name": r"(?iUd)H[oọ]?\s*(?:và)?\s*t[eê]n|BÊN\s*B|T[eê]n\s*NV|[ÔO]ng\s*/\s*[Bb][àa]",
    "address": r"(?iUd)[ĐD][iị]a\s*ch[iỉ]",
}
VN_LABELS = {
    "name": r"(?iUd)(?:H[oọ]?\s*(?:và)?\s*t[eê]n|BÊN\s*B|T[eê]n\s*NV|[ÔO]ng\s*/\s*[Bb][àa])\s*:[ \t]*(.+)",
    "address": r"(?iUd)[ĐD][iị]a\s*ch[iỉ]\s*:[ \t]*(.+)",
    "bank_account": r"(?iUd)(?:S[oố]\s*t[àa]i\s*kho[aả]n|S[oố]\s*TK|STK)\s*:[ \t]*(.+)",
}
VN_INCOME = {
    "gross": r"(?iUd)T[oổ]ng\s*thu\s*nh[aậ]p[^:\n]*:[ \t]*(.+)",
    "net": r"(?iUd)Th[uự]c\s*l[iĩ]nh[^:\n]*:[ \t]*(.+)",
}
VN_SURNAMES = [
    "Nguyễn", "Trần", "Lê", "Phạm", "Hoàng", "Huỳnh", "Phan", "Vũ", "Võ", "Đặng", "Bùi",
    "Đỗ", "Hồ", "Ngô", "Dương", "Lý", "Đinh", "Đoàn", "Vương", "Trương", "Mai", "Đào",
    "Lương", "Tô", "Tăng", "Chu", "Cao", "Trịnh", "Đàm", "Kiều", "Lâm",
]

# --- fixed values: what a label value may not be -------------------------------------
ANGLE_PLACEHOLDER = r"^<[^<>]*>$"
CURLY_PLACEHOLDER = r"^\{[^{}]*\}$"
FILLER_START = r"^[.…_\-]"
BRACKET_PLACEHOLDER = r"^\[[^\[\]]*\]$"
GENERIC_ROLES = ["người lao động", "người sử dụng lao động", "nlđ", "nsdlđ"]
PLACEHOLDER_NAME = r"(?iU)^(?:nguyen\s+)?(?:van|thi)\s+[a-z]$"
BOILERPLATE = r"(?iU)ban\s*hành|th[oô]ng\s*t[uư]\s*s[oố]|m[aẫ]u\s*s[oố]|ngh[iị]\s*đ[iị]nh|ph[uụ]\s*l[uụ]c"

# --- fixed values: keys --------------------------------------------------------------
LIST_KEYS = ["abn", "phone", "dates", "salary"]
READINESS_TRIGGER_KEYS = [
    "total_current_assets", "total_current_liabilities", "total_liabilities", "total_equity",
]
SENSITIVE_LIST_KEYS = ["abn", "phone", "salary"]
VISIBLE_KEYS = {
    "BALANCE_SHEET": [
        "total_current_assets", "total_assets", "total_current_liabilities",
        "total_liabilities", "total_equity",
    ],
    "PAY_SLIP": [
        "name", "address", "abn", "bsb", "account_number", "salary", "income",
        "annual_salary", "dates", "phone",
    ],
    "CONTRACT": [
        "name", "address", "abn", "bsb", "account_number", "salary", "income",
        "income_basis", "annual_salary", "dates", "phone",
    ],
}

# --- fixed values: thresholds --------------------------------------------------------
SCANNED_TEXT_LENGTH = 50
FUZZY_THRESHOLD = 0.85
FUZZY_MARGIN = 0.05
MONEY_TOLERANCE = 0.01
LABEL_BAND = 50
LABEL_RUN = 8
VALUE_WINDOW_ABOVE = 5
VALUE_WINDOW_BELOW = 60
COLUMN_GAP = 20
LEFT_MARGIN = 0.35
RIGHT_MARGIN = 0.15
BOTTOM_MARGIN = 0.35
LINE_OVERLAP = 0.6
RIGHT_GAP_OF_PAGE = 0.3
BELOW_GAP_OF_HEIGHT = 2
IOU_HIT = 0.5
MIN_MONTHLY_INCOME = 4000.0
MAX_REPAYMENT_RATIO = 0.30
MAX_DTI_RATIO = 0.40
MIN_CURRENT_RATIO = 1.0
MAX_DEBT_TO_EQUITY = 2.0
WEEKLY_DAYS = (6, 8)
FORTNIGHTLY_DAYS = (12, 16)
MONTHLY_DAYS = (27, 32)
AUDIT_CAPACITY = 1000
PAGE_SIZE = 7
MIN_BLUR = 100.0
MIN_CONTRAST = 15.0
MAX_BATCH_FILES = 10
MAX_FILE_BYTES = 10 * 1024 * 1024
EXPECTED_SECONDS = 200
CLIENT_DEADLINES = (180, 600)

# --- fixed values: files -------------------------------------------------------------
SIGNATURES = {
    "PDF": "25504446", "DOCX": "504B0304", "PNG": "89504E47", "JPG": "FFD8FF", "JPEG": "FFD8FF",
}
FORMATS = ["PDF", "DOCX", "CSV", "PNG", "JPG", "JPEG"]
MIME_TYPES = {
    "PDF": "application/pdf",
    "DOCX": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "CSV": "text/csv",
    "PNG": "image/png",
    "JPEG": "image/jpeg",
    "JPG": "image/jpeg",
}
REJECTED_LINK = "REJECTED_NOT_STORED"

# --- fixed values: display texts -----------------------------------------------------
SCAN_TEXTS = {
    # status: (title, label, default description, description may be the scan message, shows a date)
    "CLEAN": ("0 MALWARE DETECTED", "Clean", "No malware detected.", True, True),
    "INFECTED": ("MALWARE DETECTED", "Infected", "Malware detected.", True, True),
    "PENDING": ("SCAN PENDING", "Pending", "This document is waiting to be scanned.", False, False),
    "ERROR": ("SCAN FAILED", "Error", "An error occurred during scanning.", True, False),
}
SCAN_TEXT_DEFAULT = ("NOT SCANNED", "Not scanned", "Malware scanning has been skipped for this document.")
EXCEPTION_STATUS = {
    "NotFoundException": 404, "BadRequestException": 400, "ConflictException": 409,
    "IllegalArgumentException": 400,
}
