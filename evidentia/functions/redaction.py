"""Redaction, masking and the classification of values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import fnv1a_hex, shannon_entropy

REDACTED = "[REDACTED]"
#: Secrets in text by scheme, form or prefix, and the two that go by shape alone (an id can have that shape too).
TOKEN_PATTERNS: dict[str, str] = {
    "auth_scheme_token": r"(?i)\b(?:Bearer|Token|Basic)\s+[A-Za-z0-9._~+/=-]{8,}\b",
    "jwt_token": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    "prefixed_token": r"(?i)(?:sk|pk|rk|ghp|gho|ghu|ghs|glpat|xox[baprs])[-_][A-Za-z0-9_.=-]{12,}",
    "long_hex_token": r"\b[A-Fa-f0-9]{32,}\b",
    "long_token_like_string": r"\b[A-Za-z0-9_-]{40,}\b",
}
GENERIC = ("long_hex_token", "long_token_like_string")
#: Names whose values never rest.
SENSITIVE_COLUMNS = ("password", "token", "secret", "api_key", "ssn")
SENSITIVE_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "x-csrf-token")
_DENY_NAME = r"(?i)pass(word|wd|code)?|secret|token|api_?key|auth|session|ssn|\bpin\b|cvv|card_?number|account_?number|iban|dob|birth"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_IBAN = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"
_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?Z$"
_ENUM = r"^[A-Za-z0-9][A-Za-z0-9_.:/-]{0,23}$"


def redact_tokens(s: Column, is_id: bool = False) -> Column:
    """The text without secrets. A field that is known to be an id keeps what only has the shape of a secret."""
    for reason, pattern in TOKEN_PATTERNS.items():
        if not (is_id and reason in GENERIC):
            s = F.regexp_replace(s, pattern, REDACTED)
    return s


def redaction_reasons(s: Column) -> Column:
    """Names of the patterns that match, each on what the ones before it leave."""
    reasons = []
    for reason, pattern in TOKEN_PATTERNS.items():
        reasons.append(F.when(s.rlike(pattern), F.lit(reason)))
        s = F.regexp_replace(s, pattern, REDACTED)
    return F.array_compact(F.array(*reasons))


def _plain_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def redact_columns(row: Column, extra: tuple[str, ...] = ()) -> Column:
    """A row image (map of texts) whose sensitive columns are masked, whatever their spelling, and whose other values hold no secrets."""
    names = ["".join(c for c in n.lower() if c.isalnum()) for n in (*SENSITIVE_COLUMNS, *extra)]
    return F.transform_values(row, lambda k, v: F.when(_plain_name(k).isin(*names), F.lit(REDACTED)).otherwise(redact_tokens(v)))


def redact_headers(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_HEADERS), F.lit(REDACTED)).otherwise(redact_tokens(v)))


def redact_cookies(header: Column) -> Column:
    """A Cookie header with its names only."""
    return F.regexp_replace(header, r"(^|;\s*)([^=;\s]+)=[^;]*", "$1$2=" + REDACTED.replace("[", r"\[").replace("]", r"\]"))


def redact_url(url: Column) -> Column:
    """The URL without user info and secrets, with the values of its query masked but for small numbers."""
    bare = F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@?#]*@", "$1")
    masked = F.regexp_replace(bare, r"([?&][^=&#]+)=(?![0-9]{1,4}(?:[&#]|$))[^&#]*", "$1=" + r"\[REDACTED\]")
    return redact_tokens(masked)


def redact_storage_key(key: Column) -> Column:
    return redact_tokens(F.regexp_replace(key, r"[0-9]{6,}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", r"\[ID\]"))


def mask_text(s: Column) -> Column:
    """Every visible character as a star."""
    return F.regexp_replace(s, r"[^\s]", "*")


def luhn_run(s: Column) -> Column:
    """The text holds a run of 13 to 19 digits, single blanks or dashes between them, whose check digit holds."""
    runs = F.transform(F.regexp_extract_all(s, F.lit(r"(?<![0-9])((?:[0-9][ -]?){12,18}[0-9])(?![0-9])"), F.lit(1)), lambda r: F.regexp_replace(r, "[ -]", ""))
    return F.exists(runs, _luhn)


def _luhn(digits: Column) -> Column:
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def classify_value(value: Column, name: Column | None = None, deny: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> Column:
    """struct<action, reason> of a textual value; the first rule that holds decides, what no rule knows is redacted.

    Numbers, booleans and nulls come as their JSON text with `name` and are kept unless a card number.
    """
    named = F.coalesce(name, F.lit("")) if name is not None else F.lit("")
    plain = _plain_name(named)
    kept = plain.isin(*[k.lower().replace("_", "") for k in keep]) if keep else F.lit(False)
    denied = (named.rlike(_DENY_NAME) | (plain.isin(*[d.lower().replace("_", "") for d in deny]) if deny else F.lit(False))) & ~kept
    number = value.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$")
    entropy = (F.length(value) >= 24) & ~value.rlike(r"\s") & (shannon_entropy(value) >= 3.5)
    rules = (
        (denied, "deny_field"), (value.isNull() | value.isin("true", "false", "null"), None), (value.rlike(_EMAIL), "email_value"), (value.rlike(TOKEN_PATTERNS["jwt_token"]), "jwt_value"), (luhn_run(value), "luhn_value"), (number, None),
        (F.size(redaction_reasons(value)) > 0, "token_like_value"), (value.rlike(_INSTANT), None), (entropy, "high_entropy_value"), (F.regexp_replace(value, r"\s+", "").rlike(_IBAN), "iban_value"), (value.rlike(_ENUM), None), (kept, None),
    )
    out = F.struct(F.lit("redact").alias("action"), F.lit("free_text_value").alias("reason"))
    for holds, reason in reversed(rules):
        verdict = F.struct(F.lit("keep" if reason is None else "redact").alias("action"), F.lit(reason).cast("string").alias("reason"))
        out = F.when(F.coalesce(holds, F.lit(False)), verdict).otherwise(out)
    return out


def redacted_shape(value: Column, salt: str) -> Column:
    """struct<len, charset, hash8, casefold_hash8>: what may be told of a redacted value. Values that could be guessed from their hash have none."""
    charset = F.when(value.rlike("^[A-Za-z]+$"), "alpha").when(value.rlike("^[0-9]+$"), "num").when(value.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("mixed")
    small = (F.length(value) < 6) | ((charset == "num") & (F.length(value) < 12))
    folded = F.lower(value)
    return F.struct(
        F.length(value).alias("len"), charset.alias("charset"), F.when(~small, fnv1a_hex(value, f"{salt}:")).alias("hash8"),
        F.when(~small & (folded != value), fnv1a_hex(folded, f"{salt}:")).alias("casefold_hash8"))
