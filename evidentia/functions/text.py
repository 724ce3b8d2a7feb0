"""Text, URL, hash and id functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a(s: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-16 code units; a character beyond the first plane is two."""
    chars = F.regexp_extract_all(s, F.lit(r"(?s)."), F.lit(0))

    def unit(h: Column, u: Column) -> Column:
        return (h.bitwiseXOR(u) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        over = code - 65536
        return F.when(code < 65536, unit(h, code)).otherwise(unit(unit(h, F.shiftright(over, 10) + 55296), over.bitwiseAND(F.lit(1023)) + 56320))

    return F.aggregate(chars, F.lit(2166136261).cast("long"), step)


#: Texts and bytes that are hashed side by side; below so many texts still open, each is finished on its own.
_SIDE_BY_SIDE, _AT_ONCE, _FEW = 4096, 32 << 20, 32


def hash_side_by_side(texts: list[bytes]) -> list[int]:
    """FNV-1a of the 16-bit units of each text: unit by unit, all texts that are so long at once."""
    units, sizes = np.frombuffer(b"".join(texts), "<u2"), np.array([len(t) // 2 for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    at, left = (np.cumsum(sizes) - sizes)[order], sizes[order]
    longer = len(texts) - np.cumsum(np.bincount(sizes)) if texts else sizes  # texts of more than i units
    h, i = np.full(len(texts), 2166136261, np.uint32), 0
    for n in longer[: np.searchsorted(-longer, 1 - _FEW)].tolist():
        h[:n] = (h[:n] ^ units[at[:n] + i]) * np.uint32(16777619)
        i += 1
    for k in range(int((left > i).sum())):
        one = int(h[k])
        for u in units[at[k] + i : at[k] + left[k]].tolist():
            one = ((one ^ u) * 16777619) & 4294967295
        h[k] = one
    out = np.empty(len(texts), np.int64)
    out[order] = h
    return out.tolist()


def _hash_array(column: pa.Array) -> pa.Array:
    out, held, size = [], [], 0
    for text in column.cast(pa.binary()).to_pylist():
        held.append(None if text is None else text.decode("utf-8", "replace").encode("utf-16-le"))
        size += len(held[-1] or b"")
        if len(held) == _SIDE_BY_SIDE or size >= _AT_ONCE:
            out, held, size = out + _hash_all(held), [], 0
    return pa.array(out + _hash_all(held), pa.int64())


def _hash_all(held: list[bytes | None]) -> list[int | None]:
    hashes = iter(hash_side_by_side([t for t in held if t is not None]))
    return [None if t is None else next(hashes) for t in held]


def fnv1a_texts(s: Column) -> Column:
    """fnv1a() of whole texts: the same numbers, for columns whose values are long."""

    @F.arrow_udf("long")
    def hashed(v: pa.Array) -> pa.Array:
        return _hash_array(v)

    return hashed(s)


def fnv1a_base36(s: Column, of: Callable[[Column], Column] = fnv1a) -> Column:
    return F.lower(F.conv(of(s).cast("string"), 10, 36))


def fnv1a_hex(s: Column, salt: str = "") -> Column:
    return F.lower(F.lpad(F.conv(fnv1a(F.concat(F.lit(salt), s)).cast("string"), 10, 16), 8, "0"))


def tokens(s: Column, least: int = 3, most: int = 10**6) -> Column:
    """Lower-case alphanumeric tokens of `least` characters or more."""
    return F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda t: (F.length(t) >= least) & (F.length(t) <= most))


def issue_tokens(s: Column) -> Column:
    """Tokens of 2 to 39 characters, without redaction marks."""
    return tokens(F.regexp_replace(F.lower(s), r"\[redacted\]", " "), 2, 39)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def summary_signature(s: Column) -> Column:
    """Lower case, no redaction marks, digits as #, white space collapsed, first 300 characters."""
    low = F.regexp_replace(F.lower(F.substring(s, 1, 300)), r"\[redacted\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[0-9]+", "#"), r"\s+", " "))


def url_path(url: Column) -> Column:
    """Path of an absolute or relative URL, without query and fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def route(url: Column) -> Column:
    """The path with segments of two digits or more as <id>."""
    return F.array_join(F.transform(F.split(url_path(url), "/"), lambda s: F.when(s.rlike("^[0-9]{2,}$"), "<id>").otherwise(s)), "/")


def endpoint_key(method: Column, url: Column) -> Column:
    return F.concat_ws(" ", F.upper(method), F.regexp_replace(url, r"\?.*$", ""))


def canonical_kind(kind: Column) -> Column:
    """Trimmed kind, with the long spellings resolved whatever their case."""
    trimmed = F.trim(kind)
    known: Column = trimmed
    for alias, name in KIND_ALIASES.items():
        known = F.when(F.lower(trimmed) == alias, F.lit(name)).otherwise(known)
    return known


#: Long spellings of event kinds.
KIND_ALIASES = {"error": "err", "console": "con", "network": "net.req", "rejection": "rej", "failed-request": "net.err"}

#: Kinds that contribute to the index.
INDEXED_KINDS = (
    "err", "rej", "con", "net.req", "net.res", "net.err", "nav", "navigation", "session.lifecycle", "tab.boundary", "clk", "inp", "snap", "frame.ctx",
    "probe.ready", "probe.error", "bug.flag", "mark", "backend.req.start", "backend.req.end", "backend.req.error", "backend.uncaught", "backend.otel.span",
    "backend.log", "backend.db.query", "app-lifecycle", "native-crash", "view-snapshot", "perf", "media.voice", "media.video", "tx", "backend.otel.log", "capture.gap",
)


def token_estimate(s: Column) -> Column:
    return F.ceil(F.length(s) / 4).cast("long")


def shannon_entropy(s: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars)
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(each, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def luhn_valid(digits: Column) -> Column:
    """The check digit of a card-like number holds."""
    d = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    doubled = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return digits.rlike("^[0-9]{12,19}$") & (F.when(digits.rlike("^[0-9]{12,19}$"), F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False))


def traceparent(header: Column) -> tuple[Column, Column]:
    """(trace id, span id) of a valid header, else nulls."""
    pattern = r"^[0-9a-f]{2}-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-f]{2}$"
    low = F.lower(F.trim(header))
    trace, span = F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)
    good = (trace != "") & (trace != "0" * 32) & (span != "0" * 16)
    return F.when(good, trace), F.when(good, span)


def redact(s: Column) -> Column:
    """The text without secrets: the token patterns, and values assigned to names that speak of one."""
    from evidentia.functions.redaction import redact_tokens

    return F.regexp_replace(redact_tokens(s), r"(?i)\b(token|secret|password|api[_-]?key)\s*[=:]\s*\"?(?!\[REDACTED)[^\s\"&]{6,}\"?", r"$1=\[REDACTED\]")


def redact_query(url: Column) -> Column:
    """The URL with the values of its query parameters masked."""
    return F.regexp_replace(url, r"([?&][^=&#]+)=[^&#]*", "$1=[REDACTED]")


def statement_shape(sql: Column) -> Column:
    """A statement without its literals: strings and numbers as ?, lists of them as one, white space collapsed."""
    s = F.regexp_replace(sql, r"'(?:[^']|'')*'", "?")
    s = F.regexp_replace(s, r"\b[0-9]+(?:\.[0-9]+)?\b|\$[0-9]+|@p[0-9]+", "?")
    s = F.regexp_replace(s, r"\(\s*\?(?:\s*,\s*\?)+\s*\)", "(?)")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _bare_sql(sql: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")


_NAME = r"((?:[\[\"`]?\w+[\]\"`]?\.)?[\[\"`]?\w+[\]\"`]?)"


def _table(c: Column) -> Column:
    """A table's name without schema and quotes."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, r"^.*\.", ""), r"[\[\]\"`]", ""), F.lit(""))


def parse_mutation(sql: Column) -> Column:
    """struct<op, table, where> of a statement that writes, null for others. Writes inside a WITH count."""
    bare = F.trim(F.regexp_replace(_bare_sql(sql), r"\s+", " "))
    writes = (("insert", r"(?i)\b(?:insert|replace)(?: ignore)? into " + _NAME), ("update", r"(?i)\bupdate (?:only )?" + _NAME + r"(?: (?:as )?\w+)? set\b"), ("delete", r"(?i)\bdelete from (?:only )?" + _NAME), ("merge", r"(?i)\bmerge into " + _NAME))
    # the leading keyword decides; a WITH by what stands first in it
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z]+)", 1))
    where = F.nullif(F.trim(F.regexp_extract(bare, r"(?i) where (.+?)(?: returning .*)?;?$", 1)), F.lit(""))
    out = F.lit(None)
    for op, pattern in reversed(writes):
        table = _table(F.regexp_extract(bare, pattern, 1))
        mine = (head == op) | ((head == "replace") & F.lit(op == "insert")) | (head == "with")
        out = F.when(mine & table.isNotNull(), F.struct(F.lit(op).alias("op"), table.alias("table"), where.alias("where"))).otherwise(out)
    return out


def parse_read(sql: Column) -> Column:
    """The first table of a statement that only reads, else null."""
    bare = _bare_sql(sql)
    table = _table(F.regexp_extract(bare, r"(?i)\bfrom\s+" + _NAME, 1))
    return F.when(statement_class(sql) == "read", table)


def limit_offset(sql: Column, params: Column | None = None) -> Column:
    """struct<limit, offset>: literals, $n resolved from an array of texts, and the form `LIMIT offset, count`; what cannot be resolved is null."""
    bare = _bare_sql(sql)

    def value(token: Column) -> Column:
        at = F.regexp_extract(token, r"^\$(\d+)$", 1)
        given = F.try_element_at(params, F.nullif(at, F.lit("")).cast("int")) if params is not None else F.lit(None)
        return F.when(token.rlike(r"^\d+$"), token.try_cast("long")).otherwise(F.when(given.rlike(r"^\d+$"), given.try_cast("long")))

    pair = r"(?i)\blimit\s+(\d+)\s*,\s*(\d+)"
    both = bare.rlike(pair)
    limit, offset = F.regexp_extract(bare, r"(?i)\blimit\s+(\d+|\$\d+)", 1), F.regexp_extract(bare, r"(?i)\boffset\s+(\d+|\$\d+)", 1)
    return F.struct(F.when(both, F.regexp_extract(bare, pair, 2).try_cast("long")).otherwise(value(limit)).alias("limit"), F.when(both, F.regexp_extract(bare, pair, 1).try_cast("long")).otherwise(value(offset)).alias("offset"))


def valid_correlation_id(s: Column, most: int = 64) -> Column:
    """The trimmed id if it is one, else null."""
    t = F.trim(s)
    return F.when(t.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]*$") & (F.length(t) <= most), t)


def error_signature(kind: Column, msg: Column, stack: Column) -> Column:
    """Hash of an error's kind, message and first three lines of its stack."""
    top = F.array_join(F.slice(F.split(F.coalesce(stack, F.lit("")), "\n"), 1, 3), "\n")
    return fnv1a_base36(F.concat_ws("|", kind, F.coalesce(msg, F.lit("")), top))


def stable_route(url: Column) -> Column:
    """Path of a URL with UUIDs, numbers and hexadecimal segments as :id: from six digits on if one is 0 to 9, from eight on in any case, as words
    of the letters a to f alone are shorter."""
    segment = r"(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9]+|(?=[0-9a-f]*[0-9])[0-9a-f]{6,}|[0-9a-f]{8,})$"
    return F.array_join(F.transform(F.split(url_path(url), "/"), lambda s: F.when(s.rlike(segment), ":id").otherwise(s)), "/")


def stable_message(msg: Column) -> Column:
    """Lower case, numbers as #, but for the status codes of HTTP messages; white space collapsed."""
    low = F.lower(F.coalesce(msg, F.lit("")))
    held = F.regexp_replace(low, r"\b(http|status|status code|code)([ :=]+)([1-5])([0-9])([0-9])\b", "$1$2<$3.$4.$5>")
    letters = F.translate(F.regexp_replace(held, r"(?<![.<])\b[0-9]+(?:[.,][0-9]+)*\b(?![.>])", "#"), "<>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(letters, r"([1-5])\.([0-9])\.([0-9])", "$1$2$3"), r"\s+", " "))


def bug_signature(detector: Column, message: Column, route: Column, target: Column | None = None) -> Column:
    """Signature of a distinct bug that holds across sessions: detector, message without its numbers, route without its ids, and what it happened to."""
    parts = [detector, stable_message(message), stable_route(F.coalesce(route, F.lit(""))), F.coalesce(target if target is not None else F.lit(None).cast("string"), F.lit(""))]
    return F.concat(F.lit("bugsig2:"), fnv1a_base36(F.concat_ws("|", *parts)))


#: Schemes of scripts that belong to no application.
FOREIGN_SCHEMES = ("chrome-extension:", "moz-extension:", "safari-extension:", "safari-web-extension:", "webpack-internal:", "node:", "blob:", "data:")
MOST_FRAMES = 5


def stack_frames(stack: Column, most: int = MOST_FRAMES) -> Column:
    """array<struct<fn, file, line, column>> of the located frames of a stack that an application could own, innermost first; the header line is none."""
    line = r"^\s*at (?:(?:async )?(.*?) \()?((?:[a-z-]+:)?[^\s()]+?):(\d+):(\d+)\)?\s*$"

    def frame(s: Column) -> Column:
        file = F.regexp_replace(F.regexp_extract(s, line, 2), r"\?.*$", "")
        return F.struct(F.nullif(F.trim(F.regexp_extract(s, line, 1)), F.lit("")).alias("fn"), file.alias("file"), F.regexp_extract(s, line, 3).try_cast("int").alias("line"), F.regexp_extract(s, line, 4).try_cast("int").alias("column"))

    lines = F.slice(F.split(stack, "\n"), 2, 1000)
    own = F.filter(F.transform(lines, frame), lambda f: f["file"].contains("/") & ~f["file"].startswith("<") & ~F.lower(f["file"]).rlike("^(" + "|".join(FOREIGN_SCHEMES) + ")"))
    return F.slice(own, 1, most)


#: Languages that write a comma before the fraction.
COMMA_DECIMAL = ("de", "fr", "es", "it", "pt", "nl", "pl", "ru", "tr", "sv", "da", "nb", "fi", "cs", "el", "uk", "id", "vi")


def parse_number(text: Column, lang: Column) -> Column:
    """struct<value, unit> of a number as a page shows it, null where its separators make none.

    The later of dot and comma parts the fraction; one kind alone groups if repeated or, before exactly three digits, as the language does.
    """
    t = F.trim(F.translate(F.translate(F.translate(text, "٠١٢٣٤٥٦٧٨٩", "0123456789"), "۰۱۲۳۴۵۶۷۸۹", "0123456789"), "٫٬", ",."))
    shape = r"^([$€£¥₹]|[A-Z]{3})?\s*(-?[\d.,   ]*\d)\s*([$€£¥₹%]|[A-Z]{3})?$"
    core = F.regexp_replace(F.regexp_extract(t, shape, 2), "[   ]", "")
    unit = F.coalesce(F.nullif(F.regexp_extract(t, shape, 1), F.lit("")), F.nullif(F.regexp_extract(t, shape, 3), F.lit("")))
    comma = F.coalesce(F.lower(F.regexp_extract(lang, "^([A-Za-z]+)", 1)).isin(*COMMA_DECIMAL), F.lit(False))
    dots, commas = F.length(core) - F.length(F.translate(core, ".", "")), F.length(core) - F.length(F.translate(core, ",", ""))
    tail = F.length(F.regexp_extract(core, r"[.,](\d*)$", 1))
    last = F.regexp_extract(core, r"([.,])\d*$", 1)
    sep = (
        F.when((dots > 0) & (commas > 0), last).when(dots + commas == 0, "").when(dots + commas > 1, "")
        .when(tail == 3, F.when(last == ",", F.when(comma, ",").otherwise("")).otherwise(F.when(comma, "").otherwise("."))).when((last == ",") & (tail > 2) & ~comma, "?").otherwise(last)
    )
    whole = F.when(sep.isin(".", ","), F.regexp_extract(core, r"^(.*)[.,]\d*$", 1)).otherwise(core)
    part = F.when(sep.isin(".", ","), F.regexp_extract(core, r"[.,](\d*)$", 1)).otherwise("")
    plain = F.translate(whole, "-", "")
    grouped = plain.rlike(r"^\d+$") | (plain.rlike(r"^\d{1,3}(\.\d{3})+$") & (sep != ".")) | (plain.rlike(r"^\d{1,3}(,\d{3})+$") & (sep != ","))
    good = (core != "") & (sep != "?") & grouped & ((part != "") | ~sep.isin(".", ","))
    value = F.concat(F.translate(whole, ".,", ""), F.when(part != "", F.concat(F.lit("."), part)).otherwise("")).try_cast("double")
    return F.when(good, F.struct(value.alias("value"), unit.alias("unit")))


def statement_class(sql: Column) -> Column:
    """read, mutation or other, by the leading keyword after comments (a documented subset of full parsing)."""
    head = F.lower(F.regexp_extract(F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "), r"^\s*([A-Za-z]+)", 1))
    writes = F.lower(sql).rlike(r"\b(insert\s+into|update\s+\S+\s+set|delete\s+from|merge\s+into)\b")
    return (
        F.when(head == "", "unparsable").when(head.isin("insert", "update", "delete", "merge", "replace"), "mutation")
        .when((head == "with") & writes, "mutation").when(head.isin("select", "with", "values", "table"), "read").otherwise("other")
    )
