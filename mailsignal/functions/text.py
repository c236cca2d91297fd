"""Text cleaning and tokenising as built-in Column expressions (JVM side, codegen).

Regex note: Python's ``\\s``/``\\S`` are Unicode-aware, Java's and RE2's are ASCII
and disagree on vertical tab. The classes below spell out ASCII whitespace so
that Spark and the SQL oracle read the same characters.
"""

from __future__ import annotations

import unicodedata
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsignal import lexicon as L

WS = r"[ \t\n\x0B\f\r]"
NWS = r"[^ \t\n\x0B\f\r]"
URL_NONSPACE = r"http[s]?://" + NWS + "+"
# A blank-delimited token with an inner '@'. It can only start at the token's start and never backs up,
# so a token of any length is read once (the plain NWS+@NWS+ retries from each of its characters).
EMAIL_TOKEN = "(?<!" + NWS + ")" + NWS + r"[^@ \t\n\x0B\f\r]*+@" + NWS + "++"

HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_SCRIPT_STYLE = r"(?is)<(script|style)\b[^>]*>.*?</(script|style)[ \t\n\f\r]*>"
HTML_TAG = r"<[a-zA-Z/!?][^>]*>"
# A character reference with or without its semicolon: decimal, hexadecimal or a name.
REFERENCE = r"&(?:#(?:[0-9]++|[xX][0-9a-fA-F]++)(?![0-9a-fA-F])|[a-zA-Z][a-zA-Z0-9]*+);?"
REFERENCE_BUCKETS = 64
# Runs of anything but ASCII letters (and digits): white space is part of a run, so one blank is left for each. Java reads these classes
# several times faster than a negated list of ranges and characters.
NOT_LETTERS, NOT_WORDS = r"\P{Alpha}+", r"\P{Alnum}+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze_ws(c) -> Column:
    """Runs of whitespace to one blank, then trim (``' '.join(s.split())``)."""
    return F.trim(F.regexp_replace(_c(c), WS + "+", " "))


def _name_table() -> list[dict[str, str]]:
    """HTML5 reference names (without semicolon) and their characters, dealt to buckets by CRC-32, as a map is searched in order."""
    out: list[dict[str, str]] = [{} for _ in range(REFERENCE_BUCKETS)]
    for name, chars in html5.items():
        name = name.rstrip(";")
        out[crc32(name.encode()) % REFERENCE_BUCKETS][name] = chars
    return out


NAME_TABLE = _name_table()
#: Numeric references to C1 controls mean the Windows-1252 characters of these bytes, where it has one.
WINDOWS_1252 = {str(n): bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _literal_map(pairs: dict[str, str]) -> Column:
    """One string literal, which the optimizer folds to a map; the separators are no characters of the table."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in pairs.items())), F.lit("\x02"), F.lit("\x01"))


def _numeric_reference(body: Column) -> Column:
    """'#65' or '#x41' to its character; U+FFFD for zero, surrogates and what is beyond Unicode."""
    is_hex = body.rlike("^#[xX]")
    digits = F.regexp_replace(body, "^#[xX]?0*", "")
    number = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    utf32 = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    short = F.length(digits).between(1, 7)      # 10FFFF is 1114111: longer ones are beyond, and would overflow
    return F.when(short & valid, F.coalesce(F.element_at(_literal_map(WINDOWS_1252), number.cast("string")), utf32)).otherwise("\ufffd")


def decode_references(c) -> Column:
    """Decode every numeric and HTML5-named character reference in one pass from left to right; unknown names stay."""
    names = F.array(*[_literal_map(b) for b in NAME_TABLE])

    def one(ref: Column) -> Column:
        body = F.translate(ref, "&;", "")
        bucket = F.element_at(names, (F.crc32(body.cast("binary")) % REFERENCE_BUCKETS).cast("int") + 1)
        return F.when(body.startswith("#"), _numeric_reference(body)).otherwise(F.coalesce(F.element_at(bucket, body), ref))

    def every(x: Column) -> Column:
        between, refs = F.split(x, REFERENCE, -1), F.regexp_extract_all(x, F.lit(REFERENCE), F.lit(0))
        return F.array_join(F.zip_with(between, refs, lambda b, r: F.concat(b, F.coalesce(one(r), F.lit("")))), "")

    # the one-element array evaluates the text once for all its uses
    return F.transform(F.array(_c(c)), lambda x: F.when(x.contains("&"), every(x)).otherwise(x))[0]


def html_to_text(c) -> Column:
    """Drop comments, script/style blocks and tags (no separator), decode character references."""
    t = F.regexp_replace(_c(c), HTML_COMMENT, "")
    t = F.regexp_replace(t, HTML_SCRIPT_STYLE, "")
    t = F.regexp_replace(t, HTML_TAG, "")
    return decode_references(t)


def clean_text(c) -> Column:
    """lower -> HTML to text -> URLs, addresses, non-letters to blanks -> squeeze."""
    t = F.lower(F.coalesce(_c(c), F.lit("")))
    t = html_to_text(t)
    t = F.regexp_replace(t, URL_NONSPACE, " ")
    t = F.regexp_replace(t, EMAIL_TOKEN, " ")
    return F.trim(F.regexp_replace(t, NOT_LETTERS, " "))


def light_clean(c) -> Column:
    """Live-stack clean: lower, keep [a-z0-9] and whitespace, squeeze."""
    t = F.lower(F.coalesce(_c(c), F.lit("")))
    return F.trim(F.regexp_replace(t, NOT_WORDS, " "))


def tokens(c) -> Column:
    """Whitespace tokens of an already cleaned text (no empty tokens)."""
    return F.filter(F.split(_c(c), " "), lambda x: x != "")


def whitespace_tokens(c) -> Column:
    """``str.split()`` on raw text: runs of whitespace, empties dropped."""
    return F.filter(F.split(F.coalesce(_c(c), F.lit("")), WS + "+"), lambda x: x != "")


def drop_stopwords(c, min_len: int = 3) -> Column:
    """Drop stop words and tokens shorter than ``min_len`` (default: length > 2)."""
    # ``isin`` over a literal list becomes a hash-set lookup (InSet) instead of a list scan.
    return F.filter(_c(c), lambda x: (F.length(x) >= min_len) & ~x.isin(L.STOP_WORDS))


def vector_tokens(c) -> Column:
    """Vectoriser token rule: words of two or more word characters."""
    return F.regexp_extract_all(_c(c), F.lit(r"(\w\w+)"), 1)


def with_bigrams(c) -> Column:
    """Unigrams followed by adjacent-pair bigrams (n-gram range 1..2).

    Built from two shifted slices zipped together, so the token array is evaluated a fixed
    number of times per row (a lambda indexing into it would re-evaluate it per element)."""
    arr = _c(c)
    n = F.greatest(F.size(arr) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(arr, 1, n).alias("a"), F.slice(arr, 2, n).alias("b"))
    bigrams = F.transform(pairs, lambda x: F.concat(x["a"], F.lit(" "), x["b"]))
    return F.concat(arr, bigrams)


def _fold_table() -> tuple[str, str]:
    """Letters outside ASCII whose NFKD form is one ASCII letter plus marks (Latin blocks and its extensions)."""
    src, dst = [], []
    for cp in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        ch = chr(cp)
        d = unicodedata.normalize("NFKD", ch)
        if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:]):
            src.append(ch)
            dst.append(d[0])
    return "".join(src), "".join(dst)


ACCENTED, UNACCENTED = _fold_table()
COMBINING = r"\p{Mn}+"


def accent_fold(c) -> Column:
    """Strip diacritics from Latin letters (NFKD minus combining marks)."""
    return F.regexp_replace(F.translate(_c(c), ACCENTED, UNACCENTED), COMBINING, "")
