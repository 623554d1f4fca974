"""Evaluation texts leaking into training text: suffix arrays over shards of the corpus.

Both sides are turned into words: the confusables skeleton (what a reader
cannot see is gone), lower case, runs of letters and digits, each a 64-bit
number. A shard of documents becomes a suffix array, sorted by whole suffixes;
every suffix of every passage with at least ``min_words`` words left is looked
up in it by binary search. Each place where a match can't go on to the left is
then followed to its end, which gives the longest match of each passage in each
document and where it stands. A word that no passage has ends every match, so
only the runs of words between such words are entered; this drops no match.

Passages are turned into words by the executors, equal ones once, and reach the
tasks in blocks of BLOCK_WORDS words, which a task goes through one after the
other; the corpus is read once, whatever the number of blocks.

A null or empty document or passage, or a passage of fewer than ``min_words``
words, matches nothing. A repeated document matches once per document id, a
repeated passage once per passage id. Null ids match nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.lookalike import skeleton
from tidewright.plans.skew import grid_join
from tidewright.session import cut, spread

MIN_WORDS = 12
#: Words of passages that are broadcast together, and that a task holds at once.
BLOCK_WORDS = 1_000_000
#: Words of one suffix array.
SHARD_WORDS = 1_000_000
#: Places that are followed at once.
HITS = 1 << 20
#: Bits of the filter of passage words; BITS / 8 bytes are broadcast.
BITS = 1 << 23
#: Words of which a task remembers the numbers.
REMEMBERED = 1_000_000

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFC", skeleton(text)).lower())


def word_number(word: str) -> int:
    """64 bits of a word, never 0."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1


class Numbers(dict):
    """Word to number; 0 for a word that no passage has, if a filter is given."""

    def __init__(self, bits: np.ndarray | None = None):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        number = word_number(word)
        if self.bits is not None and not int(self.bits[(number % BITS) >> 6]) >> (number & 63) & 1:
            number = 0
        self[word] = number
        return number

    def of(self, text: str) -> np.ndarray:
        return np.array([self[w] for w in words(text)], np.uint64)


class Passages:
    """A block of passages: their words, the passage of each word and the words left from it on."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        sizes = np.array([len(t) for _, t in rows], np.int64)
        self.tokens = np.concatenate([t for _, t in rows])
        self.owner = np.repeat(np.array([k for k, _ in rows], np.int64), sizes)
        self.first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.tokens))


class SuffixArray:
    """All suffixes of the runs of a shard in their order; a run ends with a 0, which is below every word."""

    def __init__(self, tokens: np.ndarray):
        self.alphabet, codes = np.unique(np.concatenate([tokens, np.zeros(1, np.uint64)]), return_inverse=True)
        self.codes = codes[:-1].astype(np.int64)
        n = len(self.codes)
        ends = np.flatnonzero(self.codes == 0)
        self.left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) if n else np.zeros(0, np.int64)
        rank, reach, longest = self.codes, 1, int(self.left.max(initial=0))
        order = np.argsort(rank, kind="stable")
        while reach < longest:  # ranks by the first ``reach`` words give ranks by twice as many
            then = np.where(self.left > reach, rank[np.minimum(np.arange(n) + reach, n - 1)] + 1, 0)
            key = rank * (int(rank.max()) + 2) + then
            order = np.argsort(key, kind="stable")
            step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = step
            reach *= 2
        self.at = order[self.codes[order] != 0]

    def coded(self, tokens: np.ndarray) -> np.ndarray:
        """The words of passages in the codes of the shard; -1 for one that isn't in it."""
        i = np.minimum(np.searchsorted(self.alphabet, tokens), len(self.alphabet) - 1)
        return np.where(self.alphabet[i] == tokens, i, -1)

    def range(self, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each head (a row of words) the range of suffixes that begin with it."""
        return self._search(heads, False), self._search(heads, True)

    def _search(self, heads: np.ndarray, after: bool) -> np.ndarray:
        low, high = np.zeros(len(heads), np.int64), np.full(len(heads), len(self.at), np.int64)
        depth = np.arange(heads.shape[1])
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            places = np.minimum(self.at[middle][:, None] + depth, len(self.codes) - 1)
            differ = self.codes[places] - heads[open_]
            sign = np.sign(differ[np.arange(len(open_)), (differ != 0).argmax(axis=1)])
            right = (sign < 0) | (after & (sign == 0))
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        return low


_COLUMNS = ["content", "doc_id", "n_words", "eval_at", "doc_at"]


def _longest(found: pd.DataFrame) -> pd.DataFrame:
    return found.sort_values(_COLUMNS, ascending=[True, True, False, True, True]).drop_duplicates(["content", "doc_id"])


def search(array: SuffixArray, passages: Passages, min_words: int, run_start: np.ndarray, run_doc: np.ndarray, run_at: np.ndarray) -> pd.DataFrame | None:
    """Longest match of each passage in each document of the shard; the places of each suffix are followed in parts of HITS."""
    codes = array.coded(passages.tokens)
    unknown = np.concatenate([[0], np.cumsum(codes < 0)])
    starts = np.flatnonzero(passages.left >= min_words)
    starts = starts[unknown[starts + min_words] == unknown[starts]]
    if not len(starts):
        return None
    begin, end = array.range(codes[starts[:, None] + np.arange(min_words)])
    hit = end > begin
    starts, begin, many = starts[hit], begin[hit], (end - begin)[hit]
    upto = np.cumsum(many)
    best = None
    for a in range(0, int(upto[-1]) if len(upto) else 0, HITS):
        number = np.arange(a, min(a + HITS, int(upto[-1])))
        query = np.searchsorted(upto, number, side="right")
        start, at = starts[query], array.at[begin[query] + number - (upto - many)[query]]
        # only where the match can't go on to the left
        inside = (passages.first[start] < start) & (at > 0)
        fresh = ~(inside & (codes[start - 1] == array.codes[at - 1]))
        start, at = start[fresh], at[fresh]
        length, going = np.full(len(start), min_words, np.int64), np.arange(len(start))
        while going.size:
            p, t = start[going], at[going]
            open_ = (length[going] < passages.left[p]) & (length[going] < array.left[t])
            going = going[open_]
            going = going[codes[start[going] + length[going]] == array.codes[at[going] + length[going]]]
            length[going] += 1
        run = np.searchsorted(run_start, at, side="right") - 1
        part = pd.DataFrame({"content": passages.owner[start], "doc_id": run_doc[run], "n_words": length, "eval_at": start - passages.first[start] + 1, "doc_at": run_at[run] + at - run_start[run] + 1})
        best = _longest(part if best is None else pd.concat([best, part]))
    return best


def runs_of(numbers: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The begins and ends of the runs of at least so many words that passages have."""
    edge = np.diff(np.concatenate([[0], (numbers != 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= least
    return begin[long], end[long]


def shards(batches: Iterator[pd.DataFrame], bits: np.ndarray, blocks: list[Broadcast], min_words: int) -> Iterator[pd.DataFrame]:
    numbers = Numbers(bits)
    stop = np.zeros(1, np.uint64)
    parts: list[np.ndarray] = []
    docs, ats, sizes = [], [], []
    held = 0

    def flush() -> Iterator[pd.DataFrame]:
        array = SuffixArray(np.concatenate(parts))
        run_start = np.cumsum([0, *sizes[:-1]])
        for block in blocks:
            found = search(array, block.value, min_words, run_start, np.array(docs, np.int64), np.array(ats, np.int64))
            if len(blocks) > 1:  # a task holds one block at a time
                vars(block).pop("_value", None)
            if found is not None:
                yield found

    for batch in batches:
        for key, text in zip(batch["doc_id"], batch["text"], strict=True):
            found = numbers.of(text)
            for begin, end in zip(*runs_of(found, min_words), strict=True):
                parts += [found[begin:end], stop]
                docs.append(key)
                ats.append(begin)
                sizes.append(end - begin + 1)
                held += end - begin + 1
            if held >= SHARD_WORDS:
                yield from flush()
                parts, docs, ats, sizes, held = [], [], [], [], 0
    if parts:
        yield from flush()


@F.pandas_udf(T.ArrayType(T.LongType()))
def numbers_udf(texts: pd.Series) -> pd.Series:
    numbers = Numbers()
    return texts.map(lambda t: numbers.of(t).view(np.int64) if t else np.zeros(0, np.int64))


def leaks(docs: DataFrame, evals: DataFrame, doc_id: str = "doc_id", text: str = "text", eval_id: str = "eval_id", eval_text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(eval_id, doc_id, n_words, eval_at, doc_at): the longest verbatim match of each leaked passage in each document.

    ``eval_at`` and ``doc_at`` are 1-based word positions.
    """
    context = docs.sparkSession.sparkContext
    corpus = spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null and text <> ''"))
    worded = evals.select(F.col(eval_id).cast("bigint").alias("eval_id"), numbers_udf(eval_text).alias("tokens")).where((F.size("tokens") >= min_words) & F.col("eval_id").isNotNull())
    contents = worded.groupBy("tokens").agg(F.min("eval_id").alias("content"))
    blocks, rows, size, bits = [], [], 0, np.zeros(BITS // 64, np.uint64)

    def add() -> None:
        blocks.append(context.broadcast(Passages(rows)))
        at = blocks[-1].value.tokens % np.uint64(BITS)
        np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        vars(blocks[-1]).pop("_value", None)

    for tokens, content in contents.toLocalIterator():  # numbers of one block at a time
        rows.append((content, np.array(tokens, np.int64).view(np.uint64)))
        size += len(tokens)
        if size >= BLOCK_WORDS:
            add()
            rows, size = [], 0
    if rows:
        add()
    filter_ = context.broadcast(bits)
    found = corpus.mapInPandas(lambda batches: shards(batches, filter_.value, blocks, min_words), ", ".join(f"{c} bigint" for c in _COLUMNS))
    # a document delivered twice under one id, in two shards, is one document
    best = F.max_by(F.struct("n_words", "eval_at", "doc_at"), F.struct("n_words", -F.col("eval_at"), -F.col("doc_at")))
    found = cut(found.groupBy("content", "doc_id").agg(best.alias("m")).select("content", "doc_id", "m.*"))  # ids and positions alone
    members = worded.join(contents, "tokens").select("eval_id", "content")
    return grid_join(found, members, ["content"]).select("eval_id", "doc_id", "n_words", "eval_at", "doc_at").distinct()


def without_leaks(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no passage."""
    return docs.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")


def leaked_items(evals: DataFrame, found: DataFrame, eval_id: str = "eval_id") -> DataFrame:
    """One row per passage: the number of documents that hold it and its longest match (0 when it did not leak)."""
    per = found.groupBy("eval_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"))
    joined = evals.select(F.col(eval_id).alias("eval_id"), "split").join(per, "eval_id", "left")
    return joined.select("eval_id", "split", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("longest", F.lit(0)).alias("longest"))
