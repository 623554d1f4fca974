"""Visually identical text with different characters: the confusables skeleton.

The skeleton of a text is made in three steps: decompose; replace each
character by its prototype (nothing for an invisible character, a plain blank
for any kind of blank, the compatibility form for full-width letters and joined
letters, the Latin letter for a look-alike); decompose again. Texts that look
the same have equal skeletons. Case, accents, superscripts, punctuation and
line breaks survive.

The table is made of three parts: compatibility forms of the same look, fonts
among them, by rule; small capitals and the letters of Lisu and Coptic, which
repeat Latin capitals, by their names; single letters and signs as a list. ASCII
characters stay as they are, so 0 and O, or 1, l and I, are never the same.

Null and empty texts have no skeleton and are never in a pair. Equal texts are
one class, however many copies there are.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.plans.skew import HOT_SHARE, grid_join, salted_lookup
from tidewright.session import cut, spread

#: Look-alike letters and signs, each with the prototype that it is replaced by.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "α": "a", "ρ": "p", "ι": "i", "υ": "u", "γ": "y", "β": "ß", "τ": "ᴛ", "κ": "ĸ", "Ϲ": "C", "ϲ": "c", "ϳ": "j", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "ё": "ë",
    "к": "ĸ", "т": "ᴛ",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z", "Ꮟ": "b",
    "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B", "Ᏻ": "G",
    # Armenian
    "Օ": "O", "օ": "o", "Տ": "S", "Լ": "L", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q",
    # Latin
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ᴦ": "r",
    # Signs
    "‐": "-", "‑": "-", "⁃": "-", "˗": "-", "⁄": "/", "∕": "/", "∶": ":", "։": ":", "‚": ",", "ʼ": "’", "ʹ": "'", "∙": "·", "⋅": "·", "•": "·",
}

#: Compatibility forms that look like their plain characters; superscripts, fractions and the like don't.
SAME_LOOK = ("<font>", "<wide>", "<narrow>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Invisible characters outside the format category.
FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0"
#: Letters that look the same in both cases, so that their small capitals look like small letters.
ALIKE_IN_CASE = "COSUVWXZ"
#: Names of Lisu and Coptic letters and the Latin capitals that they look like.
LISU = "BA B PA P DA D TA T GA G KA K JA J CA C DZA Z TSA F MA M NA N LA L SA S ZHA R NGA V HA H WA W SHA X YA Y A A E E I I O O U U".split()
COPTIC = "ALFA A VIDA B EIE E ZATA Z HATE H IAUDA I KAPA K MI M NI N O O RO P SIMA C TAU T UA Y KHI X".split()
#: Compatibility forms that a reader can tell from the plain ones.
DISTINCT = "ſ"


@lru_cache(1)
def prototypes() -> dict[int, str | None]:
    """Code point to prototype, None for an invisible character."""
    table: dict[int, str | None] = {}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if kind == "Cf" or char in FILLERS or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or kind == "Cc" and char not in "\t\n\v\f\r\x85":
            table[code] = None
        elif kind == "Zs" or char == "\t":
            table[code] = " "
        elif kind in ("Zl", "Zp") or char in "\x85\v\f":
            table[code] = "\n"
        elif (form := unicodedata.decomposition(char)).startswith(SAME_LOOK) and char not in DISTINCT:
            plain = unicodedata.normalize("NFKD", char)
            if plain[0] != " ":
                table[code] = "".join(LOOKALIKES.get(c, c) for c in plain)  # a bold alpha looks like an a
        elif form and not form.startswith("<"):
            continue  # taken apart before
    named = {f"LISU LETTER {n}": c for n, c in zip(LISU[::2], LISU[1::2], strict=True)} | {f"COPTIC CAPITAL LETTER {n}": c for n, c in zip(COPTIC[::2], COPTIC[1::2], strict=True)}
    named |= {"COPTIC SMALL LETTER O": "o", "COPTIC SMALL LETTER SIMA": "c"} | {f"LATIN LETTER SMALL CAPITAL {c}": c.lower() for c in ALIKE_IN_CASE}
    for name, plain in named.items():
        try:
            table[ord(unicodedata.lookup(name))] = plain
        except KeyError:  # there is no such small capital
            continue
    for char, plain in LOOKALIKES.items():
        table[ord(char)] = plain
    return table


def skeleton(text: str) -> str:
    """The skeleton of one text."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii() and text.isprintable():
        return text
    form = unicodedata.normalize("NFD", text).translate(prototypes())
    return form if form.isascii() else unicodedata.normalize("NFD", form)


@F.pandas_udf(T.StringType())
def skeleton_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else skeleton(t))


@F.pandas_udf(T.BinaryType())
def skeleton_key(texts: pd.Series) -> pd.Series:
    """16 bytes that are equal for texts of equal skeleton; null for a null or empty text."""
    import hashlib

    return texts.map(lambda t: hashlib.md5(skeleton(t).encode("utf-8", "surrogatepass")).digest() if t else None)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (id, look, exact) per text that is neither null nor empty: keys of the skeleton and of the text."""
    texts = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != "")))
    return texts.select("id", skeleton_key("text").alias("look"), F.unhex(F.md5("text")).alias("exact"))


def alike_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, look, exact) of the texts whose skeleton at least one unequal text shares.

    Copies are counted into one class per (look, exact) by partial aggregation
    before the classes of a skeleton are compared, so a text with very many
    copies is one record.
    """
    keys = cut(keyed(docs, id_col, text_col))  # ids and digests alone
    forms = keys.groupBy("look", "exact").agg(F.count(F.lit(1)).alias("n"))
    several = cut(forms.groupBy("look").agg(F.count(F.lit(1)).alias("n_forms"), F.sum("n").alias("n_texts")).where("n_forms > 1").select("look", "n_texts"))
    hot = several.where(F.col("n_texts") >= max(1000, -(-keys.count() // HOT_SHARE)))
    return salted_lookup(keys, several.select("look"), "look", F.col("id"), "inner", hot=hot)


def alike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (doc_id_a, doc_id_b), a < b, of unequal texts that look the same; a repeated id is one document.

    The texts of a skeleton that very many share are cut into blocks on both
    sides. ``alike_classes`` gives the same as classes with members.
    """
    members = cut(alike_members(docs, id_col, text_col).distinct())
    a, b = (members.select("look", F.col("id").alias(f"doc_id_{s}"), F.col("exact").alias(f"exact_{s}")) for s in "ab")
    pairs = grid_join(a, b, ["look"]).where("doc_id_a < doc_id_b and exact_a <> exact_b")
    return pairs.select("doc_id_a", "doc_id_b").distinct()


def alike_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: its class (the smallest id of equal look), the class's number of unequal forms and of texts."""
    keys = cut(keyed(docs, id_col, text_col))
    forms = keys.groupBy("look", "exact").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    looks = forms.groupBy("look").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("n_forms"), F.sum("n").alias("n_texts"))
    return salted_lookup(keys, looks, "look", F.col("id")).select(F.col("id").alias(id_col), "class_id", "n_forms", "n_texts")


def one_form(docs: DataFrame, text_col: str = "text", into: str = "text_form") -> DataFrame:
    """All columns of docs and the consistent form of the text (the composed skeleton); null stays null."""
    return spread(docs).withColumn(into, compose_udf(text_col))


@F.pandas_udf(T.StringType())
def compose_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", skeleton(t)))
