"""Fixed values that must equal the matching rules' constants for identical results.

They are stated once, as plain text, in their natural order.  Java regex syntax
(used by Spark) with ``\\z`` for "end of input"; the DuckDB oracle uses the same
text with its own option string.
"""

# Companies house ids treated as "not registered" (compared after lower()).
INVALID_COMPANIES_HOUSE_IDS = ("notregis", "not reg", "n/a", "none", "0", "")

# Company-name clean-up patterns.
# NAME_LEGAL: legal forms and punctuation, replaced by a blank (strict rule).
NAME_LEGAL = (
    r"^the\s|\s?:\s?|\[|\]|\(|\)|'|\*.*\*|&|,|;|\"|ltd\.?\z|limited\.?\z"
    r"|\sllp\.?\z|\splc\.?\z|\sllc\.?\z|\sand\s|\sco[\.|\s]|\scompany[\s|$]"
)
# NAME_LEGAL_GENERAL: the same plus runs of blanks (general rule).
NAME_LEGAL_GENERAL = NAME_LEGAL + r"|\s+"
# NAME_NOISE: trailing remarks, duplicate markers, long digit runs, dashes, dots (general rule).
NAME_NOISE = (
    r"\s/.*|\s-(\s)?.*|(\s|\.|\(|\_)?duplic.*|\sdupilcat.*|\sdupicat.*|\sdissolved.*"
    r"|\*?do not .*|((\s|\*)?in)?\sliquidat.*|\sceased trading.*|\strading as.*|t/a.*"
    r"|\sacquired by.*|\splease\s.*|(do not)?(use)?(.)?(\d{5}(\d*)).*|-|\."
)
# NAME_SQUEEZE: dots and blanks removed at the end of both rules.
NAME_SQUEEZE = r"\.|\s"

# Sources whose names follow the general rule (prefix test), others the strict one.
GENERAL_NAME_SOURCE_PREFIX = "dit."

# Contact email validity (unanchored search) and the JSON-schema limits.
EMAIL_PATTERN = r"[^@]+@[^@]+\.[^@]+"
COMPANIES_HOUSE_ID_LENGTH = 8

# Spark (Java) inline flags: case-insensitive (Unicode), dot matches newline.
JAVA_FLAGS = "(?isu)"
