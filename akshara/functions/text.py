"""Text, number, date, URL and key functions: Column to Column, in the JVM but for nfc()."""

from __future__ import annotations

import re
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akshara.functions import lexicon as L

DEVANAGARI = "\u0900-\u097f"
WHITE = r"[\s\p{Z}]+"
#: What NFC does inside the Devanagari block: seven letters fall apart and three join.
DECOMPOSED = {chr(c): unicodedata.normalize("NFC", chr(c)) for c in range(0x958, 0x960)} | {chr(c) + "\u093c": chr(c + 1) for c in (0x928, 0x930, 0x933)}
@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def normalized(text: Column, full: bool = False) -> Column:
    """Zero-width characters deleted, NFC, white space collapsed and trimmed. full: NFC of every script, by an Arrow function; else of Devanagari alone."""
    plain = F.coalesce(text, F.lit(""))
    even = plain
    for c in "\t\n\v\f\r":
        even = F.replace(even, F.lit(c), F.lit(" "))
    even = F.replace(F.replace(even, F.lit("  "), F.lit(" ")), F.lit("  "), F.lit(" "))
    even = F.when(F.contains(even, F.lit("  ")), F.regexp_replace(even, " +", " ")).otherwise(even)
    out = F.translate(plain, L.ZERO_WIDTH, "")
    if full:
        out = F.regexp_replace(nfc(out), WHITE, " ")
    else:
        for old, new in DECOMPOSED.items():
            out = F.replace(out, F.lit(old), F.lit(new))
        # a dozen passes over a text, so only for one that may hold what they change
        changed = plain.rlike("[\u0958-\u095f]") | plain.rlike("[\u200b-\u200d]")
        for c in ("\u093c", "\ufeff", "\u00ad"):
            changed = changed | F.contains(plain, F.lit(c))
        out = F.regexp_replace(F.when(changed, out).otherwise(plain), WHITE, " ")
    # most texts have white space of ASCII alone and nothing else to change; what could be is a no-break space, a soft hyphen or beyond U+0900
    special = F.octet_length(plain) != F.length(plain)
    if not full:
        special = special & (plain.rlike("[\u0900-\U0010ffff]") | F.contains(plain, F.lit("\u00a0")) | F.contains(plain, F.lit("\u00ad")))
    return F.trim(F.when(special, out).otherwise(even))


def has_devanagari(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[{DEVANAGARI}]"), F.lit(False))


def tokens(text: Column, least_hi: int = 3, least_en: int = 4, lowered: bool = False) -> Column:
    """Distinct Devanagari runs and lower-cased Latin runs of normalized text; lowered: it is in lower case."""
    hi = F.regexp_extract_all(text, F.lit(f"[{DEVANAGARI}]{{{least_hi},}}"), F.lit(0))
    en = F.regexp_extract_all(text if lowered else F.lower(text), F.lit(f"[a-z]{{{least_en},}}"), F.lit(0))
    return F.when(F.octet_length(text) == F.length(text), F.array_distinct(en)).otherwise(F.array_union(hi, en))


def title_words(title: Column) -> Column:
    """Words that tell titles apart; titles without Devanagari lose a publisher suffix that starts with a capital."""
    latin = F.regexp_replace(F.coalesce(title, F.lit("")), r"[\s\p{Z}]*[-–—|][\s\p{Z}]*[A-Z][\p{L}\p{N}_\s\p{Z},.]+$", "")
    latin = F.array_except(F.regexp_extract_all(F.lower(latin), F.lit("[a-z]{4,}"), F.lit(0)), F.lit(list(L.GENERIC)))
    mixed = F.regexp_replace(normalized(title), r"[\s\p{Z}]+[-–—|][\s\p{Z}]+[^-–—|]{2,30}$", "")
    mixed = F.array_except(tokens(mixed), F.lit([*L.STOPWORDS, *L.GENERIC]))
    return F.when(has_devanagari(title), mixed).otherwise(F.array_distinct(latin))


#: Letters that NFC joins with a combining mark into a letter beyond a-z, and their marks.
JOINED = {c: "".join(chr(m) for m in range(0x300, 0x370) if len(unicodedata.normalize("NFC", c + chr(m))) == 1) for c in "abcdefghijklmnopqrstuvwxyz"}


def normal_key(text: Column) -> Column:
    """Lower case, letters a-z, digits, Devanagari and single spaces, of text in NFC.

    A Latin letter that NFC would join with a mark after it goes with its marks,
    as the joined letter would; so no function outside the JVM is needed.
    """
    out = F.lower(normalized(text))
    joined = "|".join(f"{c}\\p{{M}}*?[{marks}]" for c, marks in JOINED.items() if marks)
    # looked at only where a mark follows a letter, since 26 patterns at every place are slow
    out = F.regexp_replace(out, f"(?=[a-z]\\p{{M}})(?:{joined})", "")
    # normalized() leaves no white space but blanks
    return F.trim(F.regexp_replace(F.regexp_replace(out, f"[^a-z0-9{DEVANAGARI}\\s\\p{{Z}}]+", ""), " {2,}", " "))


def light_stem(word: Column) -> Column:
    """The word without the first listed suffix that leaves two letters, then without trailing vowel signs down to two letters."""
    out = word
    for suffix in reversed(L.SUFFIXES):
        n = len(suffix)
        out = F.when(word.endswith(suffix) & (F.length(word) >= n + 2), F.left(word, F.length(word) - n)).otherwise(out)
    # a word of Latin letters, which sort before all others, stays as it is
    return F.when(word >= F.lit("\u0900"), F.regexp_replace(out, f"^(.{{2}}.*?)[{L.MATRAS}]+$", "$1")).otherwise(word)


def story_key(title: Column) -> Column:
    """Distinct stems of the words that tell titles apart."""
    return F.array_distinct(F.transform(title_words(title), light_stem))


def normal_term(term: str) -> str:
    """What normalized() and lower case make of a listed term, worked out while the plan is built."""
    return " ".join(unicodedata.normalize("NFC", term.translate(dict.fromkeys(map(ord, L.ZERO_WIDTH)))).split()).lower()


def stem_of(word: str) -> str:
    """light_stem() of a listed term, worked out while the plan is built."""
    end = next((s for s in L.SUFFIXES if word.endswith(s) and len(word) >= len(s) + 2), "")
    return re.sub(f"^(.{{2}}.*?)[{L.MATRAS}]+$", r"\1", word.removesuffix(end))


def term_hits(terms, blob: Column, words: Column, stems: Column) -> Column:
    """The listed terms found, in the list's order: phrases by substring, words as a token or by equal stems.

    Sets meet, so the cost of single words follows the text and not the list; a
    list of thousands is a table for operators.lexicon.
    """
    terms = list(dict.fromkeys(terms))
    none = F.array().cast("array<string>")
    phrases, single = [t for t in terms if " " in t], [t for t in terms if " " not in t]
    found = [F.filter(F.array(*[F.when(F.contains(blob, F.lit(t)), F.lit(t)) for t in phrases]), lambda x: x.isNotNull())] if phrases else []
    if single:
        found.append(F.array_intersect(F.lit(single), words))
    # a stem that several terms have stands for all of them
    by_stem: dict[str, list[str]] = {}
    for t in single:
        by_stem.setdefault(stem_of(t), []).append(t)
    same = [s for s, of in by_stem.items() if of == [s]]
    other = {s: of for s, of in by_stem.items() if of != [s]}
    if same:
        found.append(F.array_intersect(F.lit(same), stems))
    if other:
        of = F.create_map(*[x for s, t in other.items() for x in (F.lit(s), F.lit(t))])
        found.append(F.flatten(F.transform(F.array_intersect(F.lit(list(other)), stems), lambda s: F.element_at(of, s))))
    if not found:
        return none
    return found[0] if len(found) == 1 else F.array_intersect(F.lit(terms), F.concat(*found))


def numbers(text: Column) -> Column:
    """Distinct numbers as digit strings without leading zeros: commas group, and . : - / separate."""
    folded = F.translate(F.coalesce(text, F.lit("")), "०१२३४५६७८९", "0123456789")
    runs = F.transform(F.regexp_extract_all(folded, F.lit(r"[0-9][0-9,.:/\-]*"), F.lit(0)), lambda r: F.replace(r, F.lit(","), F.lit("")))
    parts = F.flatten(F.transform(runs, lambda r: F.filter(F.split(r, r"[.:/\-]"), lambda p: p != "")))
    return F.array_distinct(F.transform(parts, lambda p: F.regexp_replace(p, "^0+(?=.)", "")))


def by_value(digits: Column) -> Column:
    """Digit strings in the order of their values."""
    return F.transform(F.array_sort(F.transform(digits, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda s: s["x"])


def percent(part: Column, whole: Column) -> Column:
    """Half-even rounded percentage, null of an empty whole."""
    return F.when(whole > 0, F.bround(F.lit(100.0) * part / whole, 0).cast("int"))


def parsed_date(value: Column) -> Column:
    """The date of a text in one of the accepted forms or an ISO timestamp, else null."""
    text = F.when(value.rlike(r"^[\s\p{Z}]|[\s\p{Z}]$"), F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).otherwise(value)
    text = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), F.left(text, F.lit(10))).otherwise(text)
    return F.coalesce(*[F.try_to_date(text, f) for f in L.DATE_FORMATS])


def in_window(day: Column, first: str | None, last: str | None) -> Column:
    """Three-valued: an open window holds everything, an unknown date is null."""
    if first is None and last is None:
        return F.lit(True)
    out = day.isNotNull()
    out = out & (day >= F.lit(first).cast("date")) if first else out
    out = out & (day <= F.lit(last).cast("date")) if last else out
    return F.when(day.isNotNull(), out)


def url_key(url: Column) -> Column:
    """Host without www., path without trailing slashes, sorted query without utm_ parameters; no scheme, fragment or ;parameters of the last path segment."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), ";[^/]*$", "")
    path = F.regexp_replace(path, "/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_"))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit("")))


def snippet(body: Column, n: int = 170) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), WHITE, " "))
    return F.concat(F.left(text, F.lit(n)), F.when(F.length(text) > n, F.lit("…")).otherwise(F.lit("")))


def short_url(url: Column, n: int = 44) -> Column:
    trimmed = F.regexp_replace(F.coalesce(url, F.lit("")), r"^https?://(www\.)?", "")
    suffix = F.when(F.instr(trimmed, "?") > 0, F.lit("?…")).otherwise(F.lit(""))
    base = F.substring_index(trimmed, "?", 1)
    room = F.lit(n) - F.length(suffix)
    host = F.substring_index(base, "/", 1)
    path = F.substr(base, F.length(host) + F.lit(2))
    keep = F.greatest(F.lit(8), room - F.length(host) - 2)
    return F.when(F.length(base) <= room, F.concat(base, suffix)).when(path == "", F.concat(F.left(base, room), F.lit("…"))).otherwise(F.concat(host, F.lit("/…"), F.right(path, keep), suffix))


def script_letters(text: Column) -> tuple[Column, Column]:
    """How many Devanagari characters and Latin letters a text has. Counting matches would make a string of each."""
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return without("".join(map(chr, range(0x900, 0x980)))), without(string.ascii_letters)


def script_ratio(text: Column) -> Column:
    """Share of Devanagari among Devanagari and Latin letters, 0 where there are none."""
    hi, en = script_letters(text)
    return F.coalesce(F.try_divide(hi, hi + en), F.lit(0.0))


def band(value: Column, good: int, fair: int, lower_is_better: bool = False) -> Column:
    first, second = (value <= good, value <= fair) if lower_is_better else (value >= good, value >= fair)
    return F.when(value.isNull(), "none").when(first, "ok").when(second, "warn").otherwise("err")


def word_grams(text: Column, n: int = 4) -> Column:
    """Hashes of the distinct word n-grams of a text, in no order."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z{DEVANAGARI}]{{2,}}"), F.lit(0))
    every = lambda w: F.when(F.size(w) < n, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(n))))))
    return F.get(F.transform(F.array(w), every), F.lit(0))


def gram_share(source: Column, story: Column) -> Column:
    """Percentage of the story's grams that the source has, 0 of none."""
    return F.coalesce(percent(F.size(F.array_intersect(source, story)), F.size(story)), F.lit(0))


def copied_share(source: Column, story: Column) -> Column:
    """Percentage of the story's distinct word 4-grams that the source has; 0 for texts too short to compare."""
    pair = F.array(F.struct(word_grams(source).alias("a"), word_grams(story).alias("b")))
    share = F.get(F.transform(pair, lambda p: gram_share(p["a"], p["b"])), F.lit(0))
    short = (F.length(F.coalesce(source, F.lit(""))) < 30) | (F.length(F.coalesce(story, F.lit(""))) < 30)
    return F.when(short, F.lit(0)).otherwise(share)


# They must be these for equal results.
SOURCE_SUFFIXES = (r"(?i)\s*\(RSB Hindi\)$", r"(?i)\s+Indian Railways$", r"(?i)\s+Press Releases?$")


def short_source(name: Column) -> Column:
    """A source's name without suffixes that every row repeats; the name itself where nothing else is left."""
    out = F.coalesce(name, F.lit(""))
    for suffix in SOURCE_SUFFIXES:
        out = F.regexp_replace(out, suffix, "")
    return F.coalesce(F.nullif(F.trim(out), F.lit("")), name, F.lit(""))


def article_key(link: Column, title: Column, source: Column, date: Column) -> Column:
    """sha256 of a JSON array: the link, or title, source and date where there is none."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    fields = F.concat(F.lit('["fields", '), quoted(title), F.lit(", "), quoted(source), F.lit(", "), quoted(date), F.lit("]"))
    return F.sha2(F.when(F.coalesce(link, F.lit("")) != "", F.concat(F.lit('["link", '), quoted(link), F.lit("]"))).otherwise(fields), 256)
