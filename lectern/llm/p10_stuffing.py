"""Problem 10: documents that are repeated keywords, links or product tags rather than sentences.

The document's symbols (words in lower case, runs of digits as one symbol, marks) go through a suffix automaton. For each end of a symbol the
longest substring that occurs elsewhere in the document too is its deepest repeated state; together these are the repeated maximal
substrings, and the characters they cover are the coverage. It is combined with clause structure: the share of characters in
sentences that have enough words, few repeats among them and phrases longer than keywords. A document is a case if its clauses are too few and
what stands in their place is covered by repeats, links, tags or prices; the thresholds are parameters.

The automaton is held in flat arrays. Its states but the prefixes' own are the branching nodes of the suffix tree of the reversed text, their suffix links
the tree's edges; sorted reversed prefixes with the lengths they share with their neighbours describe that tree, and the deepest repeated state of a
prefix is as long as what it shares with the nearer neighbour. Sorting is by doubling over all documents of a batch at once, whose symbols are kept apart; what
is unique already is not sorted again.

Null, empty and blank texts are no cases. Repeated rows count once. Texts are taken whole, whatever their length. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread, table

#: Documents are read together up to so many characters; a longer one goes alone.
BATCH = 1_500_000
TOP = 0x32000
#: A repeated substring counts from so many symbols and characters on.
MIN_SYMBOLS, MIN_CHARS = 2, 8
#: A clause has at least so many words, of which so many are different, and phrases of so many words on average.
CLAUSE_WORDS, CLAUSE_VARIETY, PHRASE_WORDS = 6, 0.62, 3.4
#: A sentence of fewer words is none if repeats cover so much of it and such sentences are this short on average.
SHORT_WORDS, SHORT_COVERED, SHORT_MEAN = 9, 0.8, 6.5
#: A case has at most so much in clauses, and so much of the rest covered.
MOST_CLAUSE, LEAST_COVERED = 0.35, 0.5
LINK = re.compile(r"(?:https?://|www\.|\b[\w-]+(?:\.[\w-]+)*\.(?:example|com|org|net|info|biz|shop|site|online|[a-z]{2})/)\S*", re.I)
TAG = re.compile(r"(?<![\w/])[#@]\w[\w-]*")
PRICE = re.compile(r"\bSKU[-\s]?\d+|(?:EUR|USD|GBP|PLN|CHF|€|\$|£)\s?\d+(?:[.,]\d+)?|\d+(?:[.,]\d\d)?\s?(?:EUR|USD|GBP|PLN|zł|€|£)", re.I)
#: What any price or product number holds.
MONEY = re.compile("SKU|EUR|USD|GBP|PLN|CHF|zł|[€$£]", re.I)
SENTENCE_END = re.compile(r"(?<=[.!?;…:])[\"'”»)\]]*\s+|\n\s*\n")
#: Lines of reference lists, contents pages, indexes and tables, which have a structure of their own instead of clauses.
APPARATUS = re.compile(r"^(?:\W*[^\W\d_][\w'’ -]*,[^\n]{0,80}?\((?:1[5-9]|20)\d\d[a-z]?\)[^\n]*|[^\n]*\.{3,}[ \t]*\d+[ \t]*|[^\n,]{2,60}(?:,[ \t]*\d+(?:[–-]\d+)?)+[ \t]*|[ \t]*(?:\{\||\|[-+}|]|[|!] )[^\n]*)$", re.M)
PHRASE_END = re.compile(r"[,|/·•–—\t]|\s-\s")
WORD = re.compile(r"[^\W_]+(?:['’ʼ-][^\W_]+)*")


def deepest_repeats(symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each place the length of the longest substring ending there that occurs elsewhere in its document. doc ascends."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    # The reversed text, a symbol of one document never equal to one of another.
    key = (doc[::-1].astype(np.int64) << 32) + symbols[::-1]
    order = np.argsort(key, kind="stable")
    new = np.r_[True, np.diff(key[order]) != 0]
    rank = np.empty(n, np.int64)  # where the group of equal ones begins in the order
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.bincount(rank, minlength=n)
    levels, step, open_ = [rank.astype(np.int32)], 1, np.flatnonzero(size[rank] > 1)
    while len(open_):
        after = open_ + step
        key = rank[open_] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = open_[by], key[by]
        old = rank[at]
        begin = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], np.arange(len(at)), 0))
        first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(at)), 0))
        fresh = old + first - begin
        rank[at] = fresh
        _, where, count = np.unique(first, return_inverse=True, return_counts=True)
        open_ = at[count[where] > 1]
        levels.append(rank.astype(np.int32))
        step *= 2
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    a, b = place[:-1].copy(), place[1:].copy()
    shared = np.zeros(n + 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        same = (a < n) & (b < n)
        same &= level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)]
        shared[1:n][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return np.maximum(shared[rank], shared[rank + 1])[::-1]


SPACE, LETTER, DIGIT, MARK = range(4)


@functools.cache
def alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point its kind, its lower case, and whether it is a letter; the last entry stands for all beyond."""
    kind, lower, letter = np.zeros(TOP, np.uint8), np.arange(TOP, dtype=np.uint32), np.zeros(TOP, bool)
    for c in range(TOP):
        x = chr(c)
        kind[c] = SPACE if x.isspace() else DIGIT if x.isdecimal() else LETTER if x.isalnum() else MARK
        lower[c], letter[c] = ord(x.lower()[0]), x.isalpha()
    return kind, lower, letter


def symbols_of(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and numbers of the symbols of texts that stand one after another: a word in lower case by a hash of it, any run of digits alike, marks one by one."""
    kinds, lower, _ = alphabet()
    low = np.minimum(codes, TOP - 1)
    kind = kinds[low]
    begins = (kind == MARK) | np.r_[True, (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])]
    edges = np.flatnonzero(begins)
    ends = np.r_[edges[1:], len(codes)]
    folded = np.where(low == TOP - 1, codes, lower[low]).astype(np.uint64)
    folded[kind == DIGIT] = 0
    with np.errstate(over="ignore"):
        at = np.arange(len(codes)) - np.repeat(edges, ends - edges)
        powers = np.cumprod(np.r_[np.uint64(1), np.full(int(at.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64)])
        number = np.add.reduceat((folded + np.uint64(1)) * powers[at], edges)
    number[kind[edges] == DIGIT] = 0
    some = kind[edges] != SPACE
    return edges[some], ends[some], np.unique(number[some], return_inverse=True)[1]


def features(texts: list[str]) -> list[tuple[int, float, float, float, float]]:
    """Of each text: words; share of characters in clauses; coverage by repeats outside of clauses; share of link, tag and price characters outside; coverage of all."""
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH):
            size += len(texts[end])
            end += 1
        out += _features(texts[at:end])
        at = end
    return out


def _features(texts: list[str]) -> list[tuple[int, float, float, float, float]]:
    sizes = np.array([len(t) + 1 for t in texts])  # a line end after each, so that what ends with a text ends before the next
    offsets = np.r_[0, np.cumsum(sizes)]
    codes = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    starts, ends, symbols = symbols_of(codes, doc)
    covered, clause, marked = (np.zeros(len(codes) + 1, np.int32) for _ in range(3))
    n = deepest_repeats(symbols, doc[starts])
    i = np.flatnonzero(n >= MIN_SYMBOLS)
    first, last = starts[i - n[i] + 1], ends[i]
    long = last - first >= MIN_CHARS
    np.add.at(covered, first[long], 1)
    np.subtract.at(covered, last[long], 1)
    is_covered = np.cumsum(covered)[:-1] > 0
    share = np.r_[0, np.cumsum(is_covered)]
    words, rows = [], []
    for k, (text, o) in enumerate(zip(texts, offsets.tolist())):
        words.append(len(WORD.findall(text)))
        for rule, needed in ((LINK, "/" in text or "www." in text.lower()), (TAG, "#" in text or "@" in text), (PRICE, MONEY.search(text))):
            for m in rule.finditer(text) if needed else ():
                marked[o + m.start()] += 1
                marked[o + m.end()] -= 1
        for m in APPARATUS.finditer(text):
            clause[o + m.start()] += 1
            clause[o + m.end()] -= 1
            marked[o + m.start() : o + m.end()] = 0  # links in them are theirs
        marked[o + len(text)] -= marked[o : o + len(text) + 1].sum()  # a link cut in two by them ends with its text
        begin = 0
        for m in [*SENTENCE_END.finditer(text), None]:
            end = m.start() if m else len(text)
            s = text[begin:end]
            if s.rstrip().endswith((".", "!", "?", ";", ":", "…", '"', "”", "»", ")", "'")):
                own = WORD.findall(s.lower())
                parts = PHRASE_END.split(s)
                phrases = sum(1 for x in parts if WORD.search(x)) if len(parts) > 1 else bool(own)
                rows.append((k, o + begin, o + end, len(own), len(set(own)), phrases))
            begin = m.end() if m else end
    if rows:
        k, begin, end, count, different, phrases = np.array(rows, np.int64).T
        c = (share[end] - share[begin]) / np.maximum(1, end - begin)
        short = (count > 0) & (c >= SHORT_COVERED)
        many = np.bincount(k[short], minlength=len(texts))
        curt = (many > 0) & (np.bincount(k[short], count[short], len(texts)) < SHORT_MEAN * many)
        good = (count >= CLAUSE_WORDS) & (different >= CLAUSE_VARIETY * count) & (count >= PHRASE_WORDS * phrases) & ~(curt[k] & (count < SHORT_WORDS) & (c >= SHORT_COVERED))
        np.add.at(clause, begin[good], 1)
        np.subtract.at(clause, end[good], 1)
    clause, marked = (np.cumsum(x)[:-1] > 0 for x in (clause, marked))
    solid = alphabet()[2][np.minimum(codes, TOP - 1)]  # letters only: leader dots and numbers say nothing, repeated or not
    rest = solid & ~(clause & ~marked)
    total, outside, bare, links, whole = (np.bincount(doc[x], minlength=len(texts)) for x in (solid, rest, rest & is_covered, rest & marked, solid & is_covered))
    some, size = np.maximum(1, total), np.maximum(1, outside)
    return [x if x[0] else (0, 1.0, 0.0, 0.0, 0.0) for x in zip(words, (1 - outside / some).tolist(), (bare / size).tolist(), (links / size).tolist(), (whole / some).tolist())]


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, clause, covered, marked, covered_all) of each distinct row with a text."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            rows = [(i, *x) for i, x in zip(f["doc_id"], features(f["text"].tolist()))]
            yield pd.DataFrame(rows, columns=["doc_id", "words", "clause", "covered", "marked", "covered_all"])

    d = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(d).mapInPandas(score, "doc_id bigint,words bigint,clause double,covered double,marked double,covered_all double")


def is_stuffed():
    return (F.col("words") > 0) & (F.col("clause") <= MOST_CLAUSE) & (F.col("covered") + F.col("marked") >= LEAST_COVERED)


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return scored(table(spark, sf_dir, "documents")).select("doc_id", "words", r("clause"), r("covered"), r("marked"), r("covered_all")).distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents")).filter(is_stuffed()).select("doc_id").distinct()


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores}
