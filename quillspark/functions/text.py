"""Text functions as column expressions; only NFC needs Python (vectorised in Arrow)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Invisible characters that the strong normaliser deletes (fixed values), and the weaker set.
INVISIBLE = "\u200b\ufeff\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2066\u2067\u2068\u2069"
INVISIBLE_FEW = "\u200b\ufeff\u200f"
#: Blocks of Arabic letters, as a character class (fixed values).
ARABIC = "[\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF]"
LATIN = "[A-Za-z]"


def _nfc(x: pa.Array) -> pa.Array:
    # the standard library's normaliser returns normal texts as they are
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in x.to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    """Unicode normal form C. Texts whose characters are all below U+0300 are normal as they are and don't go to Python."""
    may_change = F.rlike(c, F.lit("[^\\x{0}-\\x{2FF}]"))
    return F.coalesce(F.arrow_udf(_nfc, "string")(F.when(may_change, c)), c)


def collapse(c: Column) -> Column:
    """White space runs (Unicode) to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


def remove_spaces(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)\\s+", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def normalize(c: Column, invisible: str = INVISIBLE) -> Column:
    """Strong form: NFC, invisible characters deleted, white space collapsed. Null is empty."""
    return collapse(F.translate(nfc(F.coalesce(c, F.lit(""))), invisible, ""))


def normalize_weak(c: Column) -> Column:
    """NFC and stripped. Null is empty."""
    return strip(nfc(F.coalesce(c, F.lit(""))))


def first_filled(*cols: Column) -> Column:
    """The first value that isn't null or empty; else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(""))


def tokens(c: Column) -> Column:
    """White-space separated tokens, none empty."""
    return F.filter(F.split(c, "(?U)\\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def chars(c: Column) -> Column:
    """Code points as an array; none for an empty text."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def codepoint_label(ch: Column) -> Column:
    """U+XXXX of the first character."""
    digits = F.hex(F.ascii(ch))
    return F.concat(F.lit("U+"), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), "0"))


def visible(ch: Column) -> Column:
    """Tokens that can be read: names for white space characters."""
    return F.when(ch == " ", "<space>").when(ch == "\t", "<tab>").when(ch == "\n", "<newline>").otherwise(ch)


def language_code(c: Column) -> Column:
    """Aliases and prefixes to two-letter codes; else lower-cased as it is."""
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(x.isin("ar", "ara", "arabic") | x.startswith("ar-") | x.startswith("ar_"), "ar").when(x.isin("en", "eng", "english") | x.startswith("en-") | x.startswith("en_"), "en").otherwise(x)


def script_score(text: Column, language: Column, source_type: Column, domain: Column) -> Column:
    """100 if the script agrees with the language, 10 for real sources, 1 for handwriting."""
    agrees = ((language == "ar") & text.rlike(ARABIC)) | ((language == "en") & text.rlike(LATIN))
    one = lambda cond, n: F.when(cond, n).otherwise(0)
    return one(agrees, 100) + one(source_type == "real", 10) + one(domain == "handwriting", 1)


def adjacent_repeats(c: Column) -> Column:
    """How many characters equal the one before."""
    return F.regexp_count(c, F.lit("(?s)(.)(?=\\1)"))


def numeric_like(c: Column) -> Column:
    return c.rlike("^[\\p{Nd}\\s.,:;/\\\\+\\-()%]+$") & c.rlike("\\p{Nd}")


def text_type(c: Column) -> Column:
    """numeric_like, single_word or multi_word."""
    return F.when(numeric_like(c), "numeric_like").when(word_count(c) <= 1, "single_word").otherwise("multi_word")


def as_boolean(c: Column) -> Column:
    """Boolean texts; anything else is false."""
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("true", "1", "yes", "y")


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "[/\\\\]"), -1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty if none."""
    return F.lower(F.regexp_extract(filename(path), "(\\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(filename(path), "\\.[^.]+$", "")


def portable_path(path: Column) -> Column:
    """Forward slashes, no ./ in front."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^(\\./)+", "")


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(c, "[_\\-\\s.]+"), lambda x: x != "")


def shape(c: Column) -> Column:
    """Letters runs as <A>, digits runs as <N>."""
    letters = F.regexp_replace(F.regexp_replace(c, "[0-9]+", "\u0001"), "[A-Za-z]+", "<A>")
    return F.replace(letters, F.lit("\u0001"), F.lit("<N>"))


def safe_suffix(ext: Column) -> Column:
    """Known image suffixes; else .png."""
    return F.when(ext.isin(".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp"), ext).otherwise(".png")


def collapse_runs(indices: Column, blank: int = 0) -> Column:
    """Greedy CTC decode of an array of indices: repeats dropped, then blanks."""
    return F.filter(F.transform(indices, lambda x, i: F.when((x != blank) & ((i == 0) | (x != F.get(indices, i - 1))), x)), lambda x: x.isNotNull())


def encode(text: Column, vocabulary: Column) -> Column:
    """Indices of a text's characters by a map; a character that isn't there raises."""
    return F.transform(chars(text), lambda c: F.coalesce(F.element_at(vocabulary, c), F.raise_error(F.concat(F.lit("unknown character "), codepoint_label(c))).cast("int")))


def page_and_word(c: Column) -> Column:
    """A struct of an id "page_word" (two runs of digits): ``page_id``, ``word_index``, and ``error`` for any other text."""
    fits = F.coalesce(F.rlike(c, F.lit("^[0-9]+_[0-9]+$")), F.lit(False))
    part = lambda i: F.when(fits, F.split_part(c, F.lit("_"), F.lit(i)).cast("bigint"))
    return F.struct(part(1).alias("page_id"), part(2).alias("word_index"), F.when(~fits, F.concat(F.lit("not a page and word: "), F.coalesce(c, F.lit("")))).alias("error"))
