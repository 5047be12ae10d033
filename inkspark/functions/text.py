"""Column functions over text. Lengths named ``units`` count UTF-16 code units, others code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed ranges: ideographs and emoji that weigh a token each.
IDEOGRAPHS = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{1F000}-\x{1FAFF}]"


def units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def units_slice(text: Column, start: Column, end: Column) -> Column:
    """The half-open span [start, end) in UTF-16 units."""
    wide = F.encode(text, "UTF-16BE")
    return F.decode(F.substring(wide, 2 * start + 1, 2 * (end - start)), "UTF-16BE")


def splits_pair(text: Column, at: Column) -> Column:
    """Whether a place in UTF-16 units lies inside a surrogate pair."""
    unit = F.hex(F.substring(F.encode(text, "UTF-16BE"), 2 * at + 1, F.lit(1)))
    return (at > 0) & (at < units(text)) & unit.between("DC", "DF")


def span_error(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """Null for a span that is in range, not empty, splits no pair and reads as the quote."""
    return (
        F.when(start.isNull() | end.isNull() | (start < 0) | (end <= start) | (end > units(text)), "RANGE")
        .when(splits_pair(text, start) | splits_pair(text, end), "SURROGATE")
        .when(~units_slice(text, start, end).eqNullSafe(quote), "QUOTE"))


def canonical(text: Column) -> Column:
    """Line feeds only, no byte order mark, no blank lines at either end; the first line keeps its leading spaces."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "^\ufeff", "")
    return F.regexp_replace(F.regexp_replace(lines, r"^(?:[ \t]*\n)+", ""), r"(?:\n[ \t]*)+$", "")


def stored_tokens(text: Column) -> Column:
    return F.ceil(units(text) / 4).cast("long")


def budget_tokens(text: Column) -> Column:
    wide = F.regexp_count(text, F.lit(IDEOGRAPHS))
    points = F.length(text)
    return F.greatest(wide + F.ceil((points - wide) / 3), F.ceil(points / 2)).cast("long")


def spoken_millis(text: Column, han_per_second: float = 4.2, words_per_second: float = 2.6, pause: float = 0.12) -> Column:
    """Han characters and words at their own rates, a pause for each mark, at least 400 ms."""
    han = F.regexp_count(text, F.lit(r"\p{IsHan}"))
    words = F.regexp_count(text, F.lit(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"))
    marks = F.regexp_count(text, F.lit("[,.!?;:，。！？；：、]"))
    seconds = han / F.lit(han_per_second) + words / F.lit(words_per_second) + marks * F.lit(pause)
    return F.greatest(F.lit(400), F.ceil(F.round(seconds * 1000, 6))).cast("long")


def word_tokens(text: Column) -> Column:
    """Lower-cased letter and digit runs, and each Han character by itself."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))


def phrase_count(text: Column, phrase: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def escaped(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def spoken_text(text: Column) -> Column:
    """Markdown links as their text, no tags or emphasis marks, white space runs as one space."""
    steps = ((r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]*>", " "), (r"&lt;.*?&gt;", " "), (r"[*_`#~]+", ""), (r"[ \t\r\n]+", " "))
    return F.trim(reduce(lambda t, s: F.regexp_replace(t, *s), steps, text))


def srt_time(millis: Column) -> Column:
    part = lambda by, of, width: F.lpad((F.floor(millis / by) % of).cast("string"), width, "0")
    return F.concat(part(3_600_000, 100, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit(","), part(1, 1000, 3))


def block_kind(line: Column) -> Column:
    """Kind of a block of markdown by how it starts."""
    return (
        F.when(line.rlike(r"^#{1,6}[ \t]"), "HEADING").when(line.rlike(r"^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]"), "LIST_ITEM")
        .when(line.startswith(">"), "QUOTE").when(line.startswith("```"), "CODE").otherwise("PARAGRAPH"))


def isbn_ok(value: Column) -> Column:
    """Checksum of ISBN-10 (mod 11, X for 10) or ISBN-13 (mod 10, 978 or 979), hyphens and spaces aside."""
    plain = F.upper(F.regexp_replace(value, "[- ]", ""))
    digit = lambda i: F.when(F.substring(plain, i, 1) == "X", 10).otherwise(F.substring(plain, i, 1).try_cast("int"))
    ten = reduce(lambda a, b: a + b, [digit(i) * (11 - i) for i in range(1, 11)]) % 11 == 0
    thirteen = reduce(lambda a, b: a + b, [digit(i) * (1 if i % 2 else 3) for i in range(1, 14)]) % 10 == 0
    return F.when(plain.rlike("^[0-9]{9}[0-9X]$"), ten).when(plain.rlike("^97[89][0-9]{10}$"), thirteen).otherwise(F.lit(False))


def language_tag_ok(tag: Column) -> Column:
    return tag.rlike(r"^[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*$") & (F.length(tag) <= 64)


def safe_path(path: Column) -> Column:
    """Relative, without scheme, drive, backslash, encoded separators or dot segments."""
    odd = path.rlike(r"^(?:/|[A-Za-z]:|[A-Za-z][A-Za-z0-9+.-]*:)") | path.contains("\\") | path.rlike("(?i)%(?:2e|2f|5c|00)")
    return (path != "") & ~odd & F.forall(F.split(path, "/"), lambda part: (part != "") & (part != ".") & (part != ".."))


def redacted(text: Column) -> Column:
    """Values of sensitive keys and token-shaped runs masked."""
    keyed = F.regexp_replace(text, r"(?i)\b(token|secret|password|api[_-]?key|authorization)(\s*[=:]\s*)(\"[^\"]*\"|[^\s,;]+)", "$1$2[REDACTED]")
    return F.regexp_replace(keyed, r"\b[A-Za-z0-9_-]{32,}\b", "[REDACTED]")


def sanitized_log(text: Column, most: int = 6144) -> Column:
    """No ANSI or control characters, no urls or temporary paths; head and tail of what is longer than ``most``."""
    plain = F.regexp_replace(F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    hidden = F.regexp_replace(F.regexp_replace(plain, r"https?://\S+", "[url]"), r"/tmp/\S+", "[path]")
    half = most // 2
    return F.when(F.length(hidden) > most, F.concat(F.left(hidden, F.lit(half)), F.lit("..."), F.right(hidden, F.lit(half)))).otherwise(hidden)


def hard_pieces(text: Column, most: int) -> Column:
    """Pieces of ``most`` UTF-16 units, one at least; a cut that would split a pair falls before it."""
    n = F.greatest(F.lit(1), F.ceil(units(text) / most)).cast("int")
    plain = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * most + 1, F.lit(most)))
    cut = lambda i: F.least(i * most, units(text)) - F.when(splits_pair(text, i * most), 1).otherwise(0)
    paired = F.transform(F.sequence(F.lit(0), n - 1), lambda i: units_slice(text, cut(i), cut(i + 1)))
    return F.when(units(text) == F.length(text), plain).otherwise(paired)


def sentence_atoms(text: Column, most: int = 48) -> Column:
    """The first sentences, without bullets, by line and end mark."""
    lines = F.regexp_replace(F.regexp_replace(text, r"(?m)^[-*] ", ""), r"([.!?]) +", "$1\n")
    return F.slice(F.filter(F.transform(F.split(lines, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, most)


def copy_shingles(text: Column, size: int = 60, step: int = 20) -> Column:
    """Shingles of the letters and digits alone, every ``step`` characters."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    n = F.ceil((F.length(plain) - (size - 1)) / step).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(plain, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def private_address(address: Column) -> Column:
    """Whether an IPv4 address is private, local, shared, multicast or reserved; null if it is none."""
    part = lambda i: F.split(address, r"\.")[i].try_cast("int")
    a, b = part(0), part(1)
    found = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    return F.when(address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), found)
