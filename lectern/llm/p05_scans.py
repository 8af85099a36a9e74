"""Problem 5: text of scanned pages to continuous paragraphs.

Running lines and page numbers: outermost lines of each page (and the next ones beside a number that stands alone) are reduced to keys; a key that recurs in its attachment is a running line, and the
commonest distance between printed and counted page number gives each page's expected number. Both are counted in partial aggregates.
Misread words: every word of the corpus enters a frequency lexicon. A symmetric-delete index over it takes out, on either side, any one letter, or up to
two units of a confusion pair (`ri` here, `n` there), which leave the mark of their pair. Words that meet are weighed by an edit distance in which confusions
cost little and any other edit 1, and by the ratio of their frequencies, which is not asked of a word with signs, digits or foreign letters in it. The counts of the word pairs before and
after the place pick among several candidates, and must support a candidate that needs another edit than confusions. A word with signs or digits in it whose repair is no word of the lexicon is looked up
by parts: its unit with a letter to either side must occur, as printed, in other words.
Broken words: a word divided at a line end is joined unless the corpus writes it with the hyphen.

Each text is read by Python once, which gives its body, words, divided words and compounds; all else works on these arrays.

Defined cases: null, empty and blank texts have no noise and an empty text; rows without id are left out of p5_found; re-delivered rows count
once; rows without attachment_id have no running lines or expected numbers; a page number that is null makes no expectation. Texts are read whole. In words of more than LONG letters
one unit can be misread, not two. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import bloom
from ..session import cut, table
from ..skew import skew_join

# What is read, what was printed, and the cost of taking one for the other.
CONFUSIONS = (
    ("c", "e", 0.5), ("l", "i", 0.5), ("f", "t", 0.6), ("@", "a", 0.2), ("0", "o", 0.2), ("ri", "n", 0.5), ("1", "l", 0.2), ("1", "i", 0.3),
    ("ii", "u", 0.5), ("cl", "d", 0.5), ("rn", "m", 0.4), ("m", "rn", 0.6), ("9", "g", 0.2), ("b", "h", 0.6), ("vv", "w", 0.3), ("5", "s", 0.2),
    ("|", "i", 0.2), ("|", "l", 0.2), ("8", "b", 0.3), ("6", "b", 0.3), ("li", "h", 0.6), ("0", "о", 0.2), ("н", "и", 0.6), ("л", "п", 0.6), ("3", "з", 0.2), ("0", "ο", 0.2), ("v", "ν", 0.2),
    ("ο", "σ", 0.8), ("u", "υ", 0.3), ("p", "ρ", 0.3), ("a", "α", 0.3), ("o", "ο", 0.3), ("o", "о", 0.3), ("a", "а", 0.3), ("e", "е", 0.3),
)
#: Any other edit costs so much.
EDIT_COST = 1.0
MAX_COST = 1.3
MAX_UNITS = 2
LONG = 64
#: A word can stand for a misread one if it is that frequent, and so many times as frequent as the other.
LEAST_COUNT, RATIO = 4, 8
#: A word of fewer letters has too many neighbours: it needs another ratio, and confusions only.
SHORT, SHORT_RATIO = 4, 50
#: A candidate by another edit than confusions must be so many times as frequent, and needs so many places where it stands beside the word before, and beside the word after.
OTHER_RATIO, LEAST_SUPPORT = 50, 2
#: A running line stands on two pages at least, on three in an attachment of more pages than this; a title may hold for one chapter of a long book only.
FEW_PAGES = 16
HYPHEN = "-‐‑\xad¬"
LABEL = r"(?:page|pag|pg|seite|strona|str|p|s|σελίδα|σελ|стор|ст|с|n°)\.?"
NUMBER = r"(?:\d{1,5}|[ivxlcdm]{1,12}|[\dloiszbg|]{1,5})(?!\w)"
EDGE_NUMBER = re.compile(rf"[^\w|]*(?:{LABEL}[ \t]*)?(?P<n>{NUMBER})(?:[ \t]*/[ \t]*\d{{1,5}})?[^\w\n|]*", re.I)
#: A line that can be nothing but a page number.
SURE = re.compile(rf"^\W*{LABEL}\s*\d+\s*$|^\s*[\[—–-]\s*\d+\s*[\]—–-]\s*$|^\s*\d+\s*/\s*\d+\s*$", re.I)
BREAK = re.compile(rf"([^\W\d_]+)[{HYPHEN}][ \t]*\r?\n\s*([^\W\d_]+)")
BREAK_INLINE = re.compile(rf"([^\W\d_]+)(?:[{HYPHEN}][ \t\r\n]+|[\xad¬])([^\W\d_]+)")
BREAK_END = re.compile(rf"([^\W\d_]{{2,}})[{HYPHEN}]\s*\Z")
SUSPENDED = {"und", "oder", "bis", "sowie", "and", "or", "to", "et", "ou", "i", "lub", "oraz", "та", "і", "και", "ή"}
TOKEN = re.compile(r"[^\W_]+(?:[@|][^\W_]+)*(?:[@|](?=\W|$))?|[@|][^\W_]{2,}")
COMPOUND = re.compile(r"[^\W\d_]+(?:[-‐‑][^\W\d_]+)+")
READ = "source_table string,record_id bigint,body string,header boolean,page_number boolean,inline boolean,words array<string>,divided array<struct<a:string,b:string>>,compounds array<string>"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
DIGITS = str.maketrans("loiszbg|", "10152691")


def number_of(text: str) -> set[int]:
    """What a printed number may say: as digits, as digits with misread ones, as a Roman number."""
    t, out = text.lower(), set()
    if (re.search(r"\d", t) or set(t) <= set("lio|")) and (u := t.translate(DIGITS)).isdigit():
        out.add(int(u))
    if set(t) <= set(ROMAN):
        v = [ROMAN[c] for c in t]
        n = sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))
        if n < 2000:
            out.add(n)
    return out


def line_key(line: str) -> str:
    """Letters and digits of a line, without case and spacing."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFC", line).lower())


def _lines(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"[^\r\n]+", text) if m.group().strip()]


def strip_numbers(line: str) -> list[tuple[str, str | None]]:
    """Ways to read a line: as it is, and without a number at its head or foot."""
    out: list[tuple[str, str | None]] = [(line, None)]
    s = line.strip()
    if m := EDGE_NUMBER.match(s):
        if m.end() == len(s):
            out.append(("", m["n"]))
        elif s[m.end() - 1].isspace() or not s[m.end() - 1].isalnum():
            out.append((s[m.end() :], m["n"]))
    if m := re.search(rf"(?:^|[\s—–\-\[(|])(?:{LABEL}[ \t]*)?(?P<n>{NUMBER})(?:[ \t]*/[ \t]*\d{{1,5}})?[^\w\n|]*$", s, re.I):
        if m.start():
            out.append((s[: m.start()], m["n"]))
    return out


def is_running_shape(line: str) -> bool:
    s = line.strip()
    return bool(s) and not re.search(r"[.;:?!]\W*$", s) and not s[:1].islower() or bool(re.fullmatch(r"(?:\S[ ]{1,3}){6,}\S?.*", s))


def edge_lines(text: str) -> set[tuple[int, int]]:
    """The outermost line at head and foot; where it or the line next to it is a number alone, both."""
    spans, out = _lines(text), set()
    for side in (spans[:2], spans[-2:][::-1]):
        alone = any(n is not None and not line_key(rest) for s, e in side for rest, n in strip_numbers(text[s:e]))
        out |= set(side if alone else side[:1])
    return out


def edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each page: keys of lines that may be running lines, and distances of numbers that may be its own."""
    for f in frames:
        out = set()
        for a, p, text in zip(f["attachment_id"], f["page_number"], f["text"]):
            for s, e in edge_lines(text):
                line = text[s:e]
                for rest, n in strip_numbers(line):
                    key = line_key(rest)
                    if n is not None and (not key or is_running_shape(rest)):
                        out |= {(a, p, "n", "", v - p) for v in number_of(n)}
                    if len(key) >= 5 and is_running_shape(rest):
                        out.add((a, p, "k", key, 0))
        yield pd.DataFrame(list(out), columns=["attachment_id", "page_number", "kind", "key", "distance"])


def attachments(pages: DataFrame) -> DataFrame:
    """(attachment_id, keys, distance) of attachments with running lines or numbers."""
    some = pages.filter("attachment_id IS NOT NULL AND page_number IS NOT NULL AND length(trim(text)) > 0").select("attachment_id", "page_number", "text")
    e = cut(some.mapInPandas(edges, "attachment_id bigint,page_number int,kind string,key string,distance int"))
    size = some.select("attachment_id", "page_number").distinct().groupBy("attachment_id").agg(F.count(F.lit(1)).alias("pages"))
    counts = e.distinct().groupBy("attachment_id", "kind", "key", "distance").agg(F.count(F.lit(1)).alias("n")).join(size, "attachment_id")
    keys = counts.filter((F.col("kind") == "k") & (F.col("n") >= F.when(F.col("pages") <= FEW_PAGES, 2).otherwise(3))).groupBy("attachment_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    numbers = counts.filter("kind = 'n'").groupBy("attachment_id").agg(F.max(F.struct("n", (-F.abs("distance")).alias("d"), "distance")).alias("m")).select("attachment_id", F.when(F.col("m.n") >= 2, F.col("m.distance")).alias("distance"))
    return keys.join(numbers, "attachment_id", "full").select("attachment_id", "keys", "distance")


def _alike(key: str, keys: list[str]) -> bool:
    if len(key) < 5:
        return False
    for k in keys:
        if key == k or min(len(key), len(k)) >= 8 and (k.startswith(key) or key.startswith(k)) and min(len(key), len(k)) >= 0.6 * max(len(key), len(k)):
            return True
        if abs(len(key) - len(k)) <= 0.3 * len(k) and SequenceMatcher(None, key, k, False).ratio() >= 0.84:
            return True
    return False


def clean_page(text: str, page: int | None, keys: list[str], distance: int | None) -> tuple[str, bool, bool]:
    """Body, whether there was a running line, whether there was a page number."""
    header = number = False
    for side in (0, -1):
        for _ in range(2):
            spans = _lines(text)
            if not spans:
                break
            s, e = spans[side]
            line = text[s:e]
            readings = [(bool(n is not None and page is not None and distance is not None and page + distance in number_of(n)), line_key(rest), n) for rest, n in strip_numbers(line)]
            hit = False
            for own, key, n in sorted(readings, key=lambda x: not x[0]):  # the one with the page's own number first
                sure = distance is None and n is not None and bool(SURE.search(line.strip()))
                if not key and (own or sure):
                    hit = number = True
                elif key and _alike(key, keys) and (n is None or own or distance is None):
                    hit = header = True
                    number |= own
                if hit:
                    break
            if not hit:
                break
            text = text[:s] + text[e:]
    return text, header, number


def clean_block(text: str, first: int | None, last: int | None, keys: list[str], distance: int | None) -> tuple[str, bool, bool]:
    """As clean_page, where noise may be run together with the text."""
    header = number = False
    expected = range(first + distance, last + distance + 1) if distance is not None and first is not None and last is not None else range(0)
    own = lambda n: any(v in expected for v in number_of(n))
    plain = [(i, c.lower()) for i, c in enumerate(text) if c.isalnum()]
    letters = "".join(c if len(c) == 1 else c[0] for _, c in plain)

    def number_at(s: str, end: bool) -> int:
        """Length of the expected number at the head or foot of s."""
        m = re.search(rf"(?:^|(?<=\s))[^\w|]*(?:{LABEL}[ \t]*)?(?P<n>{NUMBER})(?:[ \t]*/[ \t]*\d{{1,5}})?[^\w|]*$", s, re.I) if end else EDGE_NUMBER.match(s)
        if not m or not own(m["n"]):
            return 0
        if not end and m.end() < len(s) and s[m.end() - 1].isalnum():
            return 0
        return m.end() - m.start()

    found: list[tuple[int, int]] = []
    for key in sorted(keys, key=len, reverse=True):
        if len(key) < 6:
            continue
        at = letters.find(key)
        while at >= 0:
            a, z = plain[at][0], plain[at + len(key) - 1][0] + 1
            if (a == 0 or not text[a - 1].isalnum()) and (z == len(text) or not text[z].isalnum()) and not any(a < y and x < z for x, y in found):
                found.append((a, z))
            at = letters.find(key, at + 1)
        if not found:  # misread or cut short at either end of the block
            for a0, span in ((0, letters[: len(key)]), (len(letters) - len(key), letters[-len(key) :])):
                if len(letters) >= len(key) >= 10 and SequenceMatcher(None, span, key, False).ratio() >= 0.86:
                    a, z = plain[max(0, a0)][0], plain[max(0, a0) + len(key) - 1][0] + 1
                    while z < len(text) and text[z].isalnum():
                        z += 1
                    found.append((a, z))
    for a, z in sorted(found, reverse=True):
        header = True
        if n := number_at(text[:a].rstrip(), True):
            number, a = True, len(text[:a].rstrip()) - n
        if n := number_at(text[z:].lstrip(), False):
            number, z = True, z + len(text[z:]) - len(text[z:].lstrip()) + n
        text = text[:a] + ("\n" if a and z < len(text) else "") + text[z:]
    for s, e in reversed(_lines(text)):
        m = EDGE_NUMBER.fullmatch(text[s:e].strip())
        alone = s == 0 and e == len(text.rstrip()) and distance is None
        if m and (own(m["n"]) or alone and SURE.search(text.strip())):
            number, text = True, text[:s] + text[e:]
    s = text.strip()
    if expected and (n := number_at(s, False)) and (n < len(s)) and re.match(r"\W*[A-ZΑ-ΩА-ЯÀ-ÞĄĆĘŁŃÓŚŹŻ„“«]", s[n:]):
        number, s = True, s[n:].strip()
    if expected and (n := number_at(s, True)) and n < len(s) and re.search(rf"[.?!…”»\"{HYPHEN}]\s*$|{LABEL}\s*\d+\W*$|[\]—–-]\s*$", s[: len(s) - n] if not re.search(rf"{LABEL}\s*\d+\W*$", s, re.I) else s, re.I):
        number, s = True, s[: len(s) - n].strip()
    return s, header, number


def breaks(text: str, inline: bool) -> list[tuple[str, str]]:
    """(left, right) of words divided; right is empty at the end of the text."""
    out = [(m[1], m[2]) for m in (BREAK_INLINE if inline else BREAK).finditer(text) if not m[2][0].isupper() or m[1].isupper()]
    out = [(a, b) for a, b in out if b.lower() not in SUSPENDED]
    if m := BREAK_END.search(text):
        out.append((m[1], ""))
    return out


def whole_words(text: str, inline: bool) -> str:
    """The text with divided words joined, for counting."""
    return (BREAK_INLINE if inline else BREAK).sub(lambda m: m[0] if m[2].lower() in SUSPENDED or m[2][0].isupper() and not m[1].isupper() else m[1] + m[2], text)


def words(text: str, inline: bool) -> list[str]:
    t = whole_words(text, inline)
    t = re.sub(rf"^\s*[^\W\d_]*[a-zà-ÿ][^\W\d_]*(?=\W)|[^\W\d_]+[{HYPHEN}]\s*\Z", lambda m: "" if m.group().lstrip()[:1].islower() or m.start() else m.group(), t)
    return TOKEN.findall(t.lower())


def _script(c: str) -> int:
    return 0 if not c.isalpha() else 1 if c < "\u0370" else 2 if c < "\u0400" else 3


def odd(word: str) -> bool:
    """Signs, digits or letters of another script inside a word of three letters or more."""
    kinds = [_script(c) for c in word]
    letters = len(kinds) - kinds.count(0)
    return letters >= 3 and (0 < kinds.count(0) <= 2 or len(set(kinds) - {0}) > 1)


@functools.cache
def _pairs() -> dict[str, list[tuple[str, str, float]]]:
    """The confusion pairs by the first character as read."""
    out: dict[str, list] = {}
    for x, y, c in CONFUSIONS:
        out.setdefault(x[0], []).append((x, y, c))
    return out


def cost(read: str, printed: str, limit: float = MAX_COST) -> tuple[float, bool]:
    """Weighted edit distance: confusion pairs at their cost, any other edit at EDIT_COST; and whether it holds another edit. Infinite beyond the limit.

    The two sides of a pair begin with different characters, so what is equal can be passed over."""

    def walk(i: int, j: int, left: float) -> tuple[float, bool]:
        while i < len(read) and j < len(printed) and read[i] == printed[j]:
            i, j = i + 1, j + 1
        if i == len(read) and j == len(printed):
            return 0.0, False
        best = (np.inf, False)
        for x, y, c in _pairs().get(read[i], ()) if i < len(read) else ():
            if c <= left + 1e-9 and read.startswith(x, i) and printed.startswith(y, j):
                d, other = walk(i + len(x), j + len(y), left - c)
                best = min(best, (round(c + d, 6), other))
        if EDIT_COST <= left + 1e-9:
            for a, b in ((1, 1), (1, 0), (0, 1)):
                if i + a <= len(read) and j + b <= len(printed):
                    d, _ = walk(i + a, j + b, left - EDIT_COST)
                    best = min(best, (EDIT_COST + d, True))
        return best

    return walk(0, 0, limit)


def spots(word: str, side: int) -> list[tuple[int, int, int]]:
    """(start, end, pair) of the units of confusion pairs in a word. side: 0 as read, 1 as printed."""
    return sorted((i, i + len(pair[side]), k) for k, pair in enumerate(CONFUSIONS) if pair[side] in word for i in range(len(word)) if word.startswith(pair[side], i))


def index_keys(word: str, side: int) -> set[str]:
    """The word, the word without any one letter, and with one to MAX_UNITS units of confusion pairs taken out, each leaving the mark of its pair."""
    out = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) > SHORT else set()
    own = spots(word, side)
    for r in range(1, (MAX_UNITS if len(word) <= LONG else 1) + 1):
        for take in itertools.combinations(own, r):
            if all(a[1] <= b[0] for a, b in zip(take, take[1:])):
                w = word
                for a, z, k in reversed(take):
                    w = f"{w[:a]}\x00{chr(0xE000 + k)}{w[z:]}"
                out.add(w)
    return out


def _hash(key: str) -> int:
    h = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def repairs(lexicon: DataFrame) -> DataFrame:
    """(word, printed, cost, other, n_printed): candidates of the words of a lexicon (word, n). other: by another edit than confusions."""

    def keyed(side: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = [(_hash(k), w, n, o) for w, n in zip(f["word"], f["n"]) if (o := odd(w)) or w.isalpha() for k in index_keys(w, side)]
                yield pd.DataFrame(rows, columns=["key", "word", "n", "odd"])

        return run

    def weighed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [cost(a, b) for a, b in zip(f["word"], f["printed"])]
            yield f.assign(cost=[c for c, _ in made], other=[o for _, o in made])

    schema = "key bigint,word string,n bigint,odd boolean"
    wrong = lexicon.mapInPandas(keyed(0), schema)
    right = lexicon.filter(~F.col("word").rlike("[0-9@|]")).mapInPandas(keyed(1), schema).filter("NOT odd")
    right = right.select("key", F.col("word").alias("printed"), F.col("n").alias("n_printed"))
    often = (F.col("n_printed") >= LEAST_COUNT) & (F.col("n_printed") >= F.when(F.length("word") < SHORT, SHORT_RATIO).otherwise(RATIO) * F.col("n"))
    met = skew_join(wrong, right, ["key"]).filter((F.col("word") != F.col("printed")) & (F.col("odd") | often))
    near = met.select("word", "printed", "n_printed").distinct().mapInPandas(weighed, "word string,printed string,n_printed bigint,cost double,other boolean")
    return near.join(lexicon, "word").filter((F.col("cost") <= MAX_COST) & (~F.col("other") | (F.col("n_printed") >= OTHER_RATIO * F.col("n")))).drop("n")


def part_repairs(lexicon: DataFrame, known: DataFrame) -> DataFrame:
    """As repairs, for odd words that have no candidate: units between two letters that other words have, as printed, at least LEAST_COUNT words for each."""

    def windows(side: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for w in f["word"]:
                    if odd(w) != (side == 0):
                        continue
                    padded = f"^{w}$"
                    for a, z, k in spots(w, side):
                        unit = w[a:z]
                        beside = {_script(c) for c in (padded[a], padded[z + 1]) if c.isalpha()}
                        if side or not unit.isalpha() or beside and _script(unit[0]) not in beside:
                            rows.append((f"{padded[a]}\x00{chr(0xE000 + k)}{padded[z + 1]}", w, w[:a] + CONFUSIONS[k][1] + w[z:] if not side else "", CONFUSIONS[k][2]))
                yield pd.DataFrame(rows, columns=["key", "word", "printed", "cost"])

        return run

    schema = "key string,word string,printed string,cost double"
    lone = lexicon.filter(~F.col("word").rlike(r"^\p{L}+$") | F.col("word").rlike("[a-z]") & F.col("word").rlike(r"[\u0370-\u04ff]")).join(known.select("word").distinct(), "word", "left_anti")
    n = lexicon.select("word").mapInPandas(windows(1), schema).groupBy("key").agg(F.count_distinct("word").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    met = lone.select("word").mapInPandas(windows(0), schema).join(n, "key")  # one row of n for each pair of letters around a pair
    best = F.max(F.struct("n", (-F.col("cost")).alias("c"), "printed")).alias("b")
    return met.groupBy("word").agg(best).select("word", "b.printed", F.lit(0).cast("bigint").alias("n_printed"), (-F.col("b.c")).alias("cost"), F.lit(False).alias("other"))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, record_id, body, header, page_number, inline, words, divided, compounds) of every row with a text."""
    pages, blocks = table(spark, sf_dir, "document_pages"), table(spark, sf_dir, "clean_document_blocks")
    known = cut(attachments(pages))
    p = pages.select(F.lit("document_pages").alias("source_table"), F.col("id").alias("record_id"), "attachment_id", F.col("page_number").cast("int").alias("first"), F.col("page_number").cast("int").alias("last"), "text")
    b = blocks.select(F.lit("clean_document_blocks").alias("source_table"), F.col("id").alias("record_id"), "attachment_id", F.col("page_start").cast("int").alias("first"), F.col("page_end").cast("int").alias("last"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_int = lambda x: None if pd.isna(x) else int(x)
        for f in frames:
            out = []
            for t, i, a, z, text, keys, d in zip(f["source_table"], f["record_id"], f["first"], f["last"], f["text"], f["keys"], f["distance"]):
                keys, d, a, z = [] if keys is None else list(keys), as_int(d), as_int(a), as_int(z)
                page = t == "document_pages"
                body, header, number = clean_page(text, a, keys, d) if page else clean_block(text, a, z, keys, d)
                divided = [{"a": x.lower(), "b": y.lower()} for x, y in set(breaks(body, not page))]
                out.append((t, i, body, header, number, not page, words(body, not page), divided, [re.sub("[‐‑]", "-", m.group().lower()) for m in COMPOUND.finditer(body)]))
            yield pd.DataFrame(out, columns=["source_table", "record_id", "body", "header", "page_number", "inline", "words", "divided", "compounds"])

    rows = p.unionByName(b).filter("record_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["source_table", "record_id"])
    return skew_join(rows, known, ["attachment_id"], "left").mapInPandas(run, READ)


def _counted(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lexicon (word, n) and written compounds (word, n)."""
    n = F.count(F.lit(1)).alias("n")
    return cut(bodies.select(F.explode("words").alias("word")).groupBy("word").agg(n)), bodies.select(F.explode("compounds").alias("word")).groupBy("word").agg(n)


def _broken(bodies: DataFrame, lexicon: DataFrame, compounds: DataFrame) -> DataFrame:
    """(source_table, record_id, word, is_compound) of words divided at line ends."""
    found = bodies.select("source_table", "record_id", F.explode("divided").alias("x")).select("source_table", "record_id", "x.a", "x.b")
    found = cut(found.withColumn("joined", F.concat("a", "b")).withColumn("hyphened", F.concat_ws("-", "a", "b")))
    known = lexicon.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    comps = compounds.select(F.col("word").alias("hyphened"), F.col("n").alias("n_hyphened"))
    j = skew_join(skew_join(found, comps, ["hyphened"], "left"), known, ["joined"], "left")
    # The joined form also counts the divided places themselves, so a compound must be written out more often than that.
    return j.select("source_table", "record_id", F.col("hyphened").alias("word"), (F.coalesce("n_hyphened", F.lit(0)) * 2 > F.coalesce("n_joined", F.lit(0))).alias("is_compound"))


def places(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows (source_table, record_id, items array<string>) -> (source_table, record_id, item, before, after) of items that wanted (item) holds: a Bloom filter by batch, then an exact join."""
    known = cut(wanted.distinct().withColumn("h", F.xxhash64("item")))
    shared = rows.sparkSession.sparkContext.broadcast(bloom.build(known, "h", known.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, h = b.column("items"), b.column("h")
            flat, row = items.flatten(), pc.list_parent_indices(items).to_numpy()
            hashes = h.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.arange(len(flat)) if shared.value is None else np.flatnonzero(bloom.might_contain(shared.value, hashes))
            take = lambda by, flat=flat, row=row, at=at: pc.fill_null(flat.take(pa.array(np.clip(at + by, 0, max(0, len(flat) - 1)), mask=(at + by < 0) | (at + by >= len(flat)) | (row[np.clip(at + by, 0, max(0, len(flat) - 1))] != row[at]) if len(at) else None)), "")
            yield pa.RecordBatch.from_arrays([b.column("source_table").take(pa.array(row[at])), b.column("record_id").take(pa.array(row[at])), take(0), take(-1), take(1)], ["source_table", "record_id", "item", "before", "after"])

    hashed = rows.select("source_table", "record_id", "items", F.transform("items", lambda x: F.xxhash64(x)).alias("h"))
    found = hashed.mapInArrow(run, "source_table string,record_id bigint,item string,before string,after string")
    return skew_join(found, known.select("item"), ["item"], "left_semi")


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bodies, divided words, and repairs of misread words."""
    bodies = cut(cleaned(spark, sf_dir))
    lexicon, compounds = _counted(bodies)
    whole = cut(repairs(lexicon))
    candidates = cut(whole.unionByName(part_repairs(lexicon, whole.filter("NOT other"))))
    return bodies, _broken(bodies, lexicon, compounds), chosen(bodies, candidates)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies, broken, fixes = _parts(spark, sf_dir)
    case = lambda df, noise: df.select("source_table", "record_id", F.lit(noise).alias("noise"))
    return case(bodies.filter("header"), "header").unionByName(case(bodies.filter("page_number"), "page_number")).unionByName(case(broken.filter("NOT is_compound"), "hyphen")).unionByName(case(fixes, "misread")).distinct()


def p5_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, record_id, word, printed): the repair of every misread place; among candidates the word pairs it would make, then the cost, then the frequency decide."""
    return _parts(spark, sf_dir)[2]


def chosen(bodies: DataFrame, candidates: DataFrame) -> DataFrame:
    suspects = places(bodies.select("source_table", "record_id", F.col("words").alias("items")), candidates.select(F.col("word").alias("item"))).withColumnRenamed("item", "word").distinct()
    open_ = cut(skew_join(cut(suspects), candidates, ["word"]))
    pairs = open_.select(F.concat_ws(" ", "before", "printed").alias("item")).unionByName(open_.select(F.concat_ws(" ", "printed", "after").alias("item")))
    made = F.when(F.size("words") > 1, F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    n = cut(places(bodies.select("source_table", "record_id", made.alias("items")), pairs).groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    w = open_.withColumn("p1", F.concat_ws(" ", "before", "printed")).withColumn("p2", F.concat_ws(" ", "printed", "after"))
    w = skew_join(skew_join(w, n.select(F.col("item").alias("p1"), F.col("n").alias("n1")), ["p1"], "left"), n.select(F.col("item").alias("p2"), F.col("n").alias("n2")), ["p2"], "left")
    support = F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))
    best = F.min(F.struct((-support).alias("s"), "cost", (-F.col("n_printed")).alias("f"), "printed")).alias("b")
    return w.filter(~F.col("other") | (F.col("n1") >= LEAST_SUPPORT) & (F.col("n2") >= LEAST_SUPPORT)).groupBy("source_table", "record_id", "word").agg(best).select("source_table", "record_id", "word", "b.printed")


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, record_id, clean_text): paragraphs without running lines and numbers, words joined and repaired."""
    bodies, broken, repaired = _parts(spark, sf_dir)
    fixes = repaired.groupBy("source_table", "record_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "printed"))).alias("fixes"))
    kept = broken.filter("is_compound").groupBy("source_table", "record_id").agg(F.collect_set("word").alias("compounds"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for body, inline, fix, own in zip(f["body"], f["inline"], f["fixes"], f["compounds"]):
                own, fix = set(own) if own is not None else set(), dict(fix) if fix is not None else {}

                def together(m: re.Match, own=own) -> str:
                    if m[2].lower() in SUSPENDED or m[2][0].isupper() and not m[1].isupper():
                        return m[0]
                    return f"{m[1]}-{m[2]}" if f"{m[1]}-{m[2]}".lower() in own else m[1] + m[2]

                def repaired(m: re.Match, fix=fix) -> str:
                    s = fix.get(m.group().lower())
                    return m.group() if s is None else s.upper() if m.group().isupper() and len(s) > 1 else s.capitalize() if m.group()[:1].isupper() else s

                t = TOKEN.sub(repaired, (BREAK_INLINE if inline else BREAK).sub(together, body))
                parts = re.split(r"\n\s*\n|(?<=[.?!…])[ \t]*\r?\n(?=[ \t]{2,}\S)", t)
                out.append("\n\n".join(x for x in (re.sub(r"\s+", " ", p).strip() for p in parts) if x))
            yield pd.DataFrame({"source_table": f["source_table"], "record_id": f["record_id"], "clean_text": out})

    keys = ["source_table", "record_id"]
    return bodies.select(*keys, "body", "inline").join(fixes, keys, "left").join(kept, keys, "left").mapInPandas(run, "source_table string,record_id bigint,clean_text string")


QUERIES = {"p5_found": p5_found, "p5_repairs": p5_repairs, "p5_text": p5_text}
