"""Display form, words, content key and card handling of captions.

All of it runs in the JVM: ``translate`` for single characters and ICU's
composer, reached through ``reflect``, for the few texts with combining marks.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Letters of other alphabets that look like a Latin letter.
LOOK_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "H", "Ӏ": "I", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ғ": "F",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "Ё": "Ë", "ё": "ë", "Ї": "Ï", "ї": "ï",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "Օ": "O", "Լ": "L", "Տ": "S", "Ս": "U",
    # Latin look-alikes and phonetic letters
    "ɡ": "g", "ɑ": "a", "ı": "i", "ſ": "s",
}

# Characters without width, and spaces of fixed width.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E,
             0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x2066, 0x2067, 0x2068, 0x2069, 0xFEFF]
FIXED_SPACES = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
#: Full-width ASCII lies at one offset from ASCII.
FULL_WIDTH = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}

_SINGLE = {**FULL_WIDTH, **LOOK_ALIKE, **{chr(c): " " for c in FIXED_SPACES}}
_FROM = "".join(_SINGLE) + "".join(map(chr, INVISIBLE))
_TO = "".join(_SINGLE.values())

NOT_ASCII = r"[^\x00-\x7F]"
#: Letters and digits; everything else separates words.
NOT_WORD = r"[^\p{L}\p{N}]+"
APOSTROPHES = "['’]"


def _composed(c: Column) -> Column:
    nfc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(r"\p{M}"), nfc).otherwise(c)


def look_alike_mapped(c: Column) -> Column:
    """Full-width forms, fixed spaces, invisible characters and look-alike
    letters replaced one by one; combining accents are left alone."""
    return F.when(c.rlike(NOT_ASCII), F.translate(c, _FROM, _TO)).otherwise(c)


def display(c: Column) -> Column:
    """One character for all that look the same; accents, case, ordinary white
    space, quotes and dashes are kept.  Null stays null."""
    mapped = F.translate(_composed(c), _FROM, _TO)
    return F.when(c.rlike(NOT_ASCII), _composed(mapped)).otherwise(c)


def words_of(shown: Column) -> Column:
    """Runs of letters and digits of a display form, in lower case, with the
    apostrophes deleted first; empty array for empty text."""
    bare = F.regexp_replace(F.lower(shown), APOSTROPHES, "")
    return F.filter(F.split(bare, NOT_WORD), lambda w: w != "")


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, NOT_WORD, "")


def _card(low: Column) -> tuple[Column, Column]:
    """The fields of a text, and whether they make it a card."""
    fields = F.filter(F.split(low, "[|;]"), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    is_card = (
        low.rlike("[|;]")
        & (F.size(fields) >= 2)
        & F.forall(fields, lambda p: p.rlike(r"^[^:]*[\p{L}\p{N}][^:]*:(?s:.)*[\p{L}\p{N}]"))
    )
    return fields, is_card


def content_key(shown: Column) -> Column:
    """Equal for texts of the same content.  A card (two or more ``name: value``
    fields between ``|`` or ``;``) gives its fields in sorted order, joined by
    ``|``; any other text its letters and digits, which hold no ``|``."""
    low = F.lower(shown)
    fields, is_card = _card(low)
    pair = F.transform(
        fields,
        lambda p: F.concat(_squeezed(F.substring_index(p, ":", 1)), F.lit(":"), _squeezed(F.regexp_replace(p, r"^[^:]*:", ""))),
    )
    return F.when(is_card, F.array_join(F.array_sort(pair), "|")).otherwise(_squeezed(low))


def spelled(shown: Column) -> Column:
    """The words in order, joined by blanks; of a card its fields in sorted order,
    as ``name:value`` joined by ``|``, each of words joined by blanks.  It holds
    both the words (``words_spelled``) and the content key (``key_spelled``)."""
    low = F.lower(shown)
    fields, is_card = _card(low)
    joined = lambda c: F.array_join(words_of(c), " ")
    pair = F.transform(
        fields, lambda p: F.concat(joined(F.substring_index(p, ":", 1)), F.lit(":"), joined(F.regexp_replace(p, r"^[^:]*:", "")))
    )
    return F.when(is_card, F.array_join(F.array_sort(pair), "|")).otherwise(joined(low))


def words_spelled(c: Column) -> Column:
    return F.split(c, "[ :|]")


def key_spelled(c: Column) -> Column:
    squeezed = F.replace(c, F.lit(" "), F.lit(""))
    return F.when(c.contains("|"), F.array_join(F.array_sort(F.split(squeezed, "[|]")), "|")).otherwise(squeezed)


def captions(manifest, least_words: int = 6):
    """``(pos, text, shown)`` of the captions of at least ``least_words`` words.
    Null, empty and short texts are left out."""
    shown = display(F.col("text"))
    return (
        manifest.select("pos", "text")
        .where(F.col("text").isNotNull() & F.col("pos").isNotNull())
        .select("pos", "text", shown.alias("shown"))
        .where(F.size(words_of(F.col("shown"))) >= least_words)
    )
