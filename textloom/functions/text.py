"""Column functions on text that stay inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import fixed


def java(pattern: str, flags: str = "U") -> str:
    """A pattern whose classes follow Unicode, as the rules are written for."""
    return f"(?{flags}){pattern}"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, java(r"^\s+|\s+$"), "")


def tokens(x: Column) -> Column:
    """Estimated tokens: a quarter of the code points, one at least; null counts as empty."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(x, F.lit(""))) / 4)).cast("long")


#: What lies between words, and the shortest word.
WORD_GAP, WORD_CHARS = "[^a-z0-9]+", 2


def words(x: Column) -> Column:
    """Lower-case runs of two or more ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), WORD_GAP), lambda w: F.length(w) >= WORD_CHARS)


def chunks(x: Column, target: int = fixed.CHUNK) -> Column:
    """Paragraphs merged up to ``target`` characters; what is over twice as long is cut every ``target``."""
    parts = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), java(r"\n\s*\n")), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def take(acc: Column, p: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(p) + 1 > target)
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n"), p))
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, p).otherwise(joined).alias("open"))

    merged = F.aggregate(parts, start, take, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))

    def cut(c: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c)), F.lit(target))
        return F.when(F.length(c) <= 2 * target, F.array(c)).otherwise(F.transform(starts, lambda i: F.substring(c, i, F.lit(target))))

    return F.flatten(F.transform(merged, cut))


def is_logs(x: Column) -> Column:
    lines = F.split(x, "\n", fixed.SAMPLE_LINES + 1)
    sample = F.slice(lines, 1, fixed.SAMPLE_LINES)
    hits = F.size(F.filter(sample, lambda s: s.rlike(java(fixed.LOG_LEVEL)) | s.rlike(java(fixed.LOG_LINE_START))))
    return (F.size(lines) >= fixed.MIN_LOG_LINES) & (hits >= F.greatest(F.lit(fixed.MIN_LOG_HITS), F.floor(F.size(sample) * 0.25)))


def is_code(x: Column) -> Column:
    lines = F.slice(F.split(x, "\n", fixed.CODE_LINES + 1), 1, fixed.CODE_LINES)
    strong = F.exists(lines, lambda s: s.rlike(java(fixed.STRONG_CODE)))
    weak = F.size(F.filter(lines, lambda s: s.rlike(java(fixed.WEAK_CODE)))) >= 2
    return strip(x).startswith("```") | strong | weak


def _matches(one: str, two: str):
    return lambda s: s.rlike(java(one)) | s.rlike(java(two))


def language(code: Column, hint: Column | None = None) -> Column:
    """By hint, else the first language of which two of the first 30 lines speak, else ``unknown``."""
    lines = F.slice(F.split(code, "\n", 31), 1, 30)
    found = F.lit("unknown")
    for name, patterns in reversed(fixed.LANGUAGE_PATTERNS.items()):
        n = F.size(F.filter(lines, _matches(*patterns)))
        found = F.when(n >= 2, name).otherwise(found)
    if hint is None:
        return found
    known = F.create_map(*(F.lit(v) for kv in fixed.LANGUAGE_HINTS.items() for v in kv))
    return F.coalesce(F.try_element_at(known, F.lower(strip(hint))), found)


def _set(points: tuple[int, ...]) -> str:
    return "[" + "".join(map(chr, points)) + "]"


FLAG = r"(\x{1F3F4}[\x{E0020}-\x{E007E}]{1,6}\x{E007F})"
SMUGGLED = r"[\x{E0001}\x{E0020}-\x{E007F}\x{FE00}-\x{FE0D}\x{E0100}-\x{E01EF}]"


def invisible(x: Column, is_code: Column | bool = False, strip_nbsp: bool = False) -> Column:
    """``text, invisible, bidi, smuggled, nbsp``: the text without characters that show nothing, and counts of the input."""
    code = F.lit(is_code) if isinstance(is_code, bool) else is_code
    prose, wide = _set(fixed.INVISIBLE), _set(fixed.INVISIBLE + fixed.JOINERS)
    count = lambda p: F.regexp_count(x, F.lit(p)).cast("long")
    smuggled = F.regexp_count(F.regexp_replace(x, FLAG, ""), F.lit(SMUGGLED)).cast("long")
    out = F.when(code, F.regexp_replace(x, wide, "")).otherwise(F.regexp_replace(x, prose, ""))
    out = F.regexp_replace(out, _set(fixed.BIDI), "")
    out = F.regexp_replace(out, f"{FLAG}|{SMUGGLED}", "$1")
    if strip_nbsp:
        out = F.regexp_replace(out, _set(fixed.NBSP), " ")
    zero = F.lit(0).cast("long")
    found = F.struct(out.alias("text"), F.when(code, count(wide)).otherwise(count(prose)).alias("invisible"), count(_set(fixed.BIDI)).alias("bidi"), smuggled.alias("smuggled"), count(_set(fixed.NBSP)).alias("nbsp"))
    plain = F.struct(x.alias("text"), zero.alias("invisible"), zero.alias("bidi"), zero.alias("smuggled"), zero.alias("nbsp"))
    return F.when(x.rlike(r"[^\x00-\x7F]"), found).otherwise(plain)


def scan(x: Column) -> Column:
    """``invisible, bidi, nbsp, mixed``: what ``invisible`` would find in code, and words of several scripts; nothing is changed."""
    from textloom.functions.kernels import mixed_scripts

    count = lambda points: F.regexp_count(x, F.lit(_set(points))).cast("long")
    return F.struct(count(fixed.INVISIBLE + fixed.JOINERS).alias("invisible"), count(fixed.BIDI).alias("bidi"), count(fixed.NBSP).alias("nbsp"), mixed_scripts(x).alias("mixed"))


def without_volatile(x: Column) -> Column:
    for pattern in fixed.VOLATILE:
        x = F.regexp_replace(x, java(pattern, "iU"), "")
    return x


def csv_field(x: Column) -> Column:
    return F.when(x.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def client_name(agent: Column, explicit: Column | None = None) -> Column:
    """Explicit name, else the first known part of the agent string, else its product token, else empty."""
    agent = strip(F.coalesce(agent, F.lit("")))
    found = F.substring(F.split_part(F.split_part(agent, F.lit(" "), F.lit(1)), F.lit("/"), F.lit(1)), 1, 64)
    for part, name in reversed(fixed.CLIENTS):
        found = F.when(F.lower(agent).contains(part), name).otherwise(found)
    if explicit is None:
        return found
    own = F.substring(strip(F.coalesce(explicit, F.lit(""))), 1, 64)
    return F.when(own != "", own).otherwise(found)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for empty or zero vectors, null where lengths differ."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when((F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)
