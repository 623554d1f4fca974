"""Mapping free-entered values to a canonical list.

A value is turned into tokens (compatibility forms folded, lower case, numbers
apart from units, known abbreviations spelled out). Then:

1. an automaton over all canonical names and aliases finds the mentions in it;
   they are taken longest first where they don't overlap, and the longest wins;
   two equally long ones of different items are no match, and neither is a
   value with other words of the list outside its mentions or other numbers;
2. remaining values go to token-set similarity: every token must be a token of
   the canonical item up to a few typing errors or an abbreviation, every token
   of the item must be there, but for the form after a dose; the least total
   cost wins, a tie between two items is no match.

Numbers must be equal in any case. Abbreviations are learned from the aliases
of the list (an alias that differs from its item in one word, seen twice) on
top of a table that can be given, as can the words that say nothing.

Each distinct value is mapped once and looked up by its rows, those of a very
frequent value being spread. Tasks know the vocabulary of the whole list and go
through its items in blocks of BLOCK, so ties, vocabulary and abbreviations are
those of the whole list whatever the block.

Null or blank values are left out; a value that means nothing maps to 0. An
empty list maps everything to 0. Repeated values get the same item. Items
without text and null ids are left out of the list.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.plans.skew import salted_lookup

#: Items that a task holds at once; it changes no result.
BLOCK = 50_000
CACHE = 200_000

#: Abbreviations and spellings, unless others are given.
ABBREVIATIONS = {
    "milligram": "mg", "milligrams": "mg", "mgs": "mg", "tab": "tablet", "tabs": "tablet", "tablets": "tablet", "cap": "capsule", "caps": "capsule", "capsules": "capsule", "inj": "injection",
    "supp": "suppository", "soln": "solution", "sol": "solution", "ab": "antibody", "scr": "screen", "seq": "sequencing", "us": "ultrasound", "wo": "without", "hist": "history",
    "susp": "suspected", "interm": "intermittent", "insuff": "insufficiency", "recurr": "recurrent", "bilat": "bilateral", "unspec": "unspecified", "inflam": "inflammation", "sev": "severe",
    "chr": "chronic", "infxn": "infection", "oedema": "edema", "congen": "congenital", "prog": "progressive", "juv": "juvenile", "ac": "acute", "neurop": "neuropathy",
}
#: Words that say nothing about the item, unless others are given.
FILLERS = frozenset("a an the pt patient takes taking taken on hx history of see chart confirmed noted note per home med meds medication reported known possible probable likely query also still and".split())
FORM_UNIT = "mg"

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")


def number(token: str) -> str:
    """One spelling for equal numbers: 7,50 and 7.5."""
    whole, _, part = token.replace(",", ".").partition(".")
    part = part.rstrip("0") if "." not in part else part
    return (whole.lstrip("0") or "0") + ("." + part if part else "")


def tokens(text: str) -> list[str]:
    plain = unicodedata.normalize("NFKC", text).casefold().replace("_", " ")
    plain = "".join(c for c in plain if unicodedata.category(c) != "Cf")
    plain = re.sub(r"\bu/s\b", "us", re.sub(r"\bw/o\b", "without", plain))
    return [number(t) if t[0].isdigit() else t for t in TOKEN.findall(plain)]


def allowed(length: int) -> int:
    """Typing errors that a word of this length may have."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 10 else 3


def errors(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between a and b; most + 1 when more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, old = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if older and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        older, old = old, new
    return old[-1]


def shortened(word: str, by: int) -> set[str]:
    """The word with up to so many letters left out."""
    out = layer = {word}
    for _ in range(by):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out = out | layer
    return out


class Vocabulary:
    """What all items of the list share: their tokens, and what abbreviations stand for."""

    def __init__(self, listed: set[str], learned: dict[tuple[str, str], int], abbreviations: dict[str, str], fillers: frozenset[str]):
        self.listed, self.abbreviations, self.fillers = listed, abbreviations, fillers
        self.spelled = {a: b for a, b in abbreviations.items() if a not in listed}
        for (a, b), _ in sorted(learned.items(), key=lambda x: (x[1], x[0])):
            if a not in listed:
                self.spelled[a] = b
        self.words = sorted(t for t in listed if not t[0].isdigit())
        self.longest = max(map(len, self.words), default=0)
        self.near: dict[str, set[str]] = defaultdict(set)
        for word in self.words:
            for short in shortened(word, allowed(len(word))):
                self.near[short].add(word)
        self.long_fillers = [f for f in fillers if len(f) > 6]
        self.spell_long = lru_cache(CACHE)(self._spell_long)
        self.match_word = lru_cache(CACHE)(self._match_word)

    def spell(self, found: list[str]) -> list[str]:
        return [self.spelled.get(t) or self.spell_long(t) for t in found]

    def _spell_long(self, token: str) -> str:
        """What a long abbreviation with up to two typing errors stands for; else the token."""
        if not 7 < len(token) < 20 or token in self.listed:
            return token
        return next((b for a, b in self.spelled.items() if len(a) > 7 and a in self.abbreviations and errors(token, a, 2) <= 2), token)

    def content(self, text: str) -> list[str]:
        """The spelled tokens of a text without fillers that no item has."""
        return [t for t in self.spell(tokens(text)) if t in self.listed or not self.filler(t)]

    def filler(self, token: str) -> bool:
        return token in self.fillers or len(token) > 6 and token not in self.listed and any(errors(token, f, 2) <= 2 for f in self.long_fillers if abs(len(f) - len(token)) < 3)

    def _match_word(self, word: str) -> dict[str, float]:
        """Words of the list that the word can stand for, with their costs."""
        if word in self.listed:
            return {word: 0.0}
        if word[0].isdigit() or len(word) > self.longest + 3:
            return {}
        out: dict[str, float] = {}
        for short in shortened(word, allowed(len(word) + 1)):
            for w in self.near.get(short, ()):
                if w not in out and (e := errors(word, w, allowed(len(w)))) <= allowed(len(w)) and (e < 3 or word[0] == w[0]):
                    out[w] = float(e)
        if len(word) >= 3:
            i = bisect.bisect_right(self.words, word)
            while i < len(self.words) and self.words[i].startswith(word):
                out[self.words[i]] = min(out.get(self.words[i], 9.0), 0.5)
                i += 1
        return out


class Value:
    """One value on its way through the blocks of the list."""

    def __init__(self, text: str, vocabulary: Vocabulary):
        self.found = vocabulary.content(text)
        self.line = " " + " ".join(self.found) + " "
        self.numbers = Counter(t for t in self.found if t[0].isdigit())
        self.hits: dict[tuple[int, int], set[int]] = defaultdict(set)
        self.alike = set()
        words = [t for t in self.found if not t[0].isdigit()]
        self.options = [vocabulary.match_word(t) for t in words]
        if not all(self.options):
            self.options = []
        self.scored: list[tuple[float, int]] = []

    def decided(self, vocabulary: Vocabulary) -> int:
        """The canonical id meant, 0 for none."""
        taken: list[tuple[int, int]] = []
        for start, end in sorted(self.hits, key=lambda h: (h[0] - h[1], h[0])):  # longest first
            if all(end <= s + 1 or e <= start + 1 for s, e in taken):  # the blank between two mentions belongs to both
                taken.append((start, end))
        longest = {key for s, e in taken if e - s == taken[0][1] - taken[0][0] for key in self.hits[s, e]}
        if len(longest) == 1 and next(iter(longest)) in self.alike:
            rest, last = [], 0
            for start, end in sorted(taken):
                rest += self.line[last:start].split()
                last = end
            rest += self.line[last:].split()
            if not any(vocabulary.match_word(t) for t in rest):
                return next(iter(longest))
        self.scored.sort()
        if not self.scored or len(self.scored) > 1 and self.scored[0][0] == self.scored[1][0]:
            return 0
        return self.scored[0][1]


class Block:
    """A block of the list: (canonical_id, item, variants)."""

    def __init__(self, rows: list[tuple[int, str, list[str] | None]], vocabulary: Vocabulary):
        self.items = {key: vocabulary.spell(tokens(item)) for key, item, _ in rows}
        self.numbers = {key: Counter(t for t in item if t[0].isdigit()) for key, item in self.items.items()}
        self.holding: dict[str, set[int]] = defaultdict(set)
        patterns: dict[str, set[int]] = defaultdict(set)
        for key, item, variants in rows:
            for t in self.items[key]:
                self.holding[t].add(key)
            for name in [item, *(v for v in variants or [] if v)]:
                if found := vocabulary.content(name):
                    patterns[" " + " ".join(found) + " "].add(key)
        self.automaton = ahocorasick.Automaton()
        for pattern, keys in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), keys))
        self.any = bool(patterns)
        if patterns:
            self.automaton.make_automaton()

    def visit(self, value: Value) -> None:
        """Add the block's mentions in the value, the items of equal numbers among them, and its two best similar items."""
        if not value.found:
            return
        if self.any:
            for end, (length, keys) in self.automaton.iter(value.line):
                value.hits[end - length + 1, end + 1] |= keys
                value.alike |= {k for k in keys if self.numbers[k] == value.numbers}
        candidates: set[int] | None = None
        for words in sorted(value.options, key=lambda o: sum(len(self.holding.get(w, ())) for w in o)):
            keys = set().union(*(self.holding.get(w, ()) for w in words))
            candidates = keys if candidates is None else candidates & keys
            if not candidates:
                return
        scored = []
        for key in candidates or ():
            if self.numbers[key] == value.numbers and (cost := self._cost(value.options, self.items[key])) is not None:
                scored.append((cost, key))
        value.scored += sorted(scored)[:2]

    def _cost(self, options: list[dict[str, float]], item: list[str]) -> float | None:
        """The least cost of giving each token a word of the item; None when a token or a needed word is left."""
        free = [t for t in item if not t[0].isdigit()]
        total = 0.0
        for words in sorted(options, key=lambda o: min(o.values())):
            best = min((w for w in words if w in free), key=lambda w: words[w], default=None)
            if best is None:
                return None
            free.remove(best)
            total += words[best]
        if free:
            form = item[item.index(FORM_UNIT) :] if FORM_UNIT in item and len(item) > len([t for t in item if not t[0].isdigit()]) else []
            if any(t not in form for t in free):
                return None
            total += 0.25 * len(free)
        return total


@F.pandas_udf(T.StructType().add("listed", T.ArrayType(T.StringType())).add("learned", T.ArrayType(T.StringType())))
def said_udf(items: pd.Series, variants: pd.Series) -> pd.DataFrame:
    """The tokens of an item, and the words that its variants put for one of them."""
    out = []
    for item, others in zip(items, variants, strict=True):
        have = Counter(tokens(item))
        learned = []
        for variant in others if others is not None else []:
            said = Counter(tokens(variant or ""))
            more, less = list((said - have).elements()), list((have - said).elements())
            if variant and len(more) == len(less) == 1 and not more[0][0].isdigit() and not less[0][0].isdigit():
                learned.append(f"{more[0]} {less[0]}")
        out.append((sorted(have), learned))
    return pd.DataFrame(out, columns=["listed", "learned"])


#: What a Python worker has built, by broadcast and block: one vocabulary and one block.
_BUILT: dict[str, tuple] = {}


def _built(slot: str, name: tuple, make):
    if _BUILT.get(slot, (None, None))[0] != name:
        _BUILT[slot] = (name, make())
    return _BUILT[slot][1]


def mapped(
    entries: DataFrame, listed: DataFrame, text_col: str, id_col: str = "canonical_id", item_col: str = "canonical_item", variants_col: str = "variants", into: str = "mapped_id",
    abbreviations: dict[str, str] = ABBREVIATIONS, fillers: frozenset[str] = FILLERS, block: int | None = None,
) -> DataFrame:
    """All columns of the entries whose value is neither null nor blank, and the canonical id meant (0: none)."""
    context = entries.sparkSession.sparkContext
    items = listed.select(F.col(id_col).cast("int").alias("key"), F.col(item_col).alias("item"), F.col(variants_col).alias("variants")).where("key is not null and trim(item) <> ''")
    said = items.select(said_udf("item", "variants").alias("s"))
    words = {r[0] for r in said.select(F.explode("s.listed")).distinct().collect()}  # the vocabulary of the list
    pairs = said.select(F.explode("s.learned").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").collect()  # of the same vocabulary
    known = context.broadcast((words, {tuple(p.split(" ")): n for p, n in pairs}, abbreviations, fillers))
    blocks, rows = [], []
    for row in items.orderBy("key").toLocalIterator():  # one block at a time
        rows.append((row[0], row[1], list(row[2]) if row[2] is not None else None))
        if len(rows) == (block or BLOCK):
            blocks.append(context.broadcast(rows))
            rows = []
    if rows:
        blocks.append(context.broadcast(rows))
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = _built("vocabulary", (run_id,), lambda: Vocabulary(*known.value))
        for pdf in batches:
            values = [Value(t, vocabulary) for t in pdf["value"]]
            for i, held in enumerate(blocks):
                one = _built("block", (run_id, i), lambda held=held: Block(held.value, vocabulary))
                for value in values:
                    one.visit(value)
            yield pd.DataFrame({"value": pdf["value"], into: pd.Series([v.decided(vocabulary) for v in values], dtype="int32")})

    kept = entries.where(F.col(text_col).isNotNull() & (F.regexp_replace(F.col(text_col), r"[\s\p{Z}\p{C}]", "") != ""))
    # spread again, as few bytes of values can be much work
    partitions = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = kept.select(F.col(text_col).alias("value")).distinct().repartition(partitions)
    meant = distinct.mapInPandas(run, f"value string, `{into}` int").withColumnRenamed("value", "__value")
    return salted_lookup(kept.withColumn("__value", F.col(text_col)), meant, "__value", F.xxhash64(*entries.columns)).drop("__value").select(*entries.columns, into)


def unmatched_report(done: DataFrame, text_col: str, into: str = "mapped_id") -> DataFrame:
    """The values that mean nothing on the list, with the number of entries."""
    return done.where(F.col(into) == 0).groupBy(F.col(text_col).alias("value")).agg(F.count(F.lit(1)).alias("n_entries"))
