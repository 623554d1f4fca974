"""Text functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the marks of ASCII.
ASCII_MARKS = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"


def trimmed(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def bare_item(text: Column) -> Column:
    """Trimmed, then without ASCII marks at both ends."""
    return F.regexp_replace(trimmed(text), f"^[{ASCII_MARKS}]+|[{ASCII_MARKS}]+$", "")


@F.pandas_udf(T.StringType())
def match_form(texts: pd.Series) -> pd.Series:
    """Trimmed and case-folded."""
    return texts.map(lambda t: None if t is None else t.strip().casefold())


def fold(text: str) -> str:
    """Compatibility forms, case folded, separators to blanks, other marks but -() gone, blanks single."""
    plain = unicodedata.normalize("NFKC", text).casefold()
    plain = re.sub(r"[\/\\,;•·]", " ", plain)
    return " ".join(re.sub(r"[^\w\s()\-]", "", plain).split())


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t))


def folded_ascii(text: Column) -> Column:
    """``fold`` for ASCII text, without Python."""
    spaced = F.regexp_replace(F.lower(text), r"[/\\,;]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[^a-z0-9_\s()\-]", ""), r"\s+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))


def token_sort(text: Column) -> Column:
    """The sorted words of a text in one string."""
    return F.array_join(F.array_sort(words(text)), " ")


def title_keep_paren(text: str) -> str:
    """Title case, but for a trailing parenthesis."""
    head, mark, tail = text.partition("(")
    return head.title() + mark + tail


@F.pandas_udf(T.StringType())
def titled(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else title_keep_paren(t))


def slug_key(text: Column) -> Column:
    """Lower case, other characters to _, no _ at the ends, c_ before a digit."""
    base = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(base.rlike("^[0-9]"), F.concat(F.lit("c_"), base)).otherwise(base)


def model_slug(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("__"))


def digest(text: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, length)


def context_block(fields: dict[str, Column]) -> Column:
    """[FIELD] and its value, or its values as - lines, blocks parted by a blank line; missing and empty fields are left out."""
    blocks = [F.when(F.size(v) > 0, F.concat(F.lit(f"[{name.upper()}]\n"), F.array_join(F.transform(v, lambda x: F.concat(F.lit("- "), x)), "\n"))) for name, v in fields.items()]
    return F.concat_ws("\n\n", *blocks)


#: Number words of the prompts.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def prompt(item: Column, classes: list[str], context: Column | None = None) -> Column:
    """The scoring request for one item: the task, the classes, the context if any, the item and the answer's form."""
    count = NUMBER_WORDS[len(classes)] if len(classes) < len(NUMBER_WORDS) else str(len(classes))
    parts = [F.lit(f"Score the item below for {count} classes, each from 0 to 1."), F.lit("\n".join(f"- {c}" for c in classes))]
    if context is not None:
        parts += [F.concat(F.lit("Context:\n"), context)]
    skeleton = "{" + ", ".join(f'"{c}": 0.0' for c in classes) + "}"
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Item: "), item), F.lit(f"Answer with this JSON only: {skeleton}"))


#: Terms that a prompt may not hold.
FORBIDDEN = ["physician_survey_consensus", "physician_interview_consensus", "delta_physician", "delta_llm", "ground truth", "ground_truth"]


def holds_forbidden(text: Column, terms: list[str] = FORBIDDEN) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t))


def shown_number(value: Column) -> Column:
    """Four decimals, N/A for a missing number."""
    return F.when(value.isNull() | F.isnan(value), "N/A").otherwise(F.format_string("%.4f", value))


def shown_p(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), "N/A").when(value < 0.0001, "< 0.0001").otherwise(F.format_string("%.4f", value))


def context_line(fields: dict[str, Column]) -> Column:
    """All fields in one line, name and value; lists are joined by commas, missing ones left blank."""
    parts = [F.concat(F.lit(f"{name}: "), F.coalesce(F.array_join(v, ", "), F.lit(""))) for name, v in fields.items()]
    return F.concat_ws("; ", *parts)
