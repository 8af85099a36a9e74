"""Problem 3: bodies with Markdown, HTML, wiki and LaTeX markup to readable text that keeps headings, lists, code and formulas.

A body is cut into leaf blocks in order, each with the path of tags it stands in. A bidirectional LSTM (lstm) reads the whole sequence, each block as
a bag of hashed words, signs with what stands beside them, and tag path, and gives every block a class (what it is rendered as) and a probability for each
syntax. What it gives 0.5 or more is found; no rule adds to it or takes from it. It is trained on TRAIN_BODIES bodies written for it
(markup_bodies), in which markup is inserted and so labelled by construction; no row of the tables is trained on. Training takes place once per driver process.

Front matter and what stands in code are no markup. Null, empty and blank bodies have no blocks and an empty text. Repeated rows count once in p3_found
and stay in p3_text; rows with a null id are left out of p3_found. Bodies of any length are read whole. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread, table
from . import lstm, markup_bodies as M

SYNTAXES = ("markdown", "html", "wiki", "latex")
CLASSES = ("text", "heading", "list", "code", "formula", "quote", "table", "meta")
TRAIN_BODIES = 2_400
BUCKETS, WIDTH, HIDDEN, EPOCHS, ROWS = 8192, 24, 24, 12, 32
#: Words share few vectors, so that the network can't learn a training text by heart; signs have one each but for collisions.
WORD_BUCKETS = 32
SOURCES = (("obsidian_notes", "note_id", "markdown"), ("obsidian_sections", "section_id", "markdown"), ("notes", "id", "note_html"))

# Names of elements.
BLOCK_TAGS = "address|article|aside|blockquote|body|br|caption|center|dd|div|dl|dt|figure|figcaption|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|section|table|tbody|td|tfoot|th|thead|tr|ul"
INLINE_TAGS = "a|abbr|acronym|b|big|cite|code|del|dfn|em|font|i|img|input|ins|kbd|label|link|mark|meta|nowiki|pre|q|ref|s|samp|script|small|span|strike|strong|style|sub|sup|title|tt|u|var"
ATTRIBUTES = r"(?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))*\s*"
TAG = re.compile(rf"</?(?P<name>{BLOCK_TAGS}|{INLINE_TAGS})(?P<attr>{ATTRIBUTES})/?>", re.I)
BLOCK_TAG = re.compile(rf"<(?P<close>/?)(?P<name>{BLOCK_TAGS}){ATTRIBUTES}(?P<empty>/?)>", re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
COMMENT = r"<!--(?:[^-]|-(?!->))*-->"

FRONT = re.compile(r"\A﻿?---[ \t]*\r?\n(?:.*\r?\n)*?---[ \t]*(?:\r?\n|\Z)")
# Blocks that are whole before anything in them is read.
WHOLE = re.compile(
    r"(?P<fence>^[ \t>]*(?P<mark>`{3,}|~{3,})[^\n`]*\n(?:[\s\S]*?\n)??[ \t>]*(?P=mark)[`~]*[ \t]*(?=\r?$|<|\n|\Z))"
    r"|(?P<open>^[ \t>]*(?:`{3,}|~{3,})[^\n`]*\n[\s\S]*\Z)"
    r"|(?P<pre><(?P<el>pre|script|style|textarea)\b[^>]*>[\s\S]*?(?:</(?P=el)\s*>|\Z))"
    rf"|(?P<comment>{COMMENT})"
    r"|(?P<display>\$\$[\s\S]+?\$\$|\\\[[\s\S]+?\\\]|\\begin\{(?P<env>equation|align|gather|multline|eqnarray|displaymath|math)(?P<star>\*?)\}[\s\S]*?(?:\\end\{(?P=env)(?P=star)\}|\Z))"
    r"|(?P<wikitable>^\{\|[\s\S]*?(?:^\|\}|\Z))",
    re.M | re.I,
)
INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)(?:(?!\n\s*\n)[\s\S])+?(?<!`)\1(?!`)|<(code|tt|kbd|samp|nowiki)\b[^>]*>[\s\S]*?</\2\s*>", re.I)
LIST_LINE = re.compile(r"[ \t]*(?:[-+*]|\d{1,9}[.)]|\\item\b)[ \t]+\S|[;:]+[ \t]*\S")
HEAD_LINE = re.compile(r"[ \t]{0,3}#{1,6}[ \t]+\S|(={2,6})[ \t]*[^=\n].*?\1[ \t]*\r?$|\\(?:(?:sub)*section|chapter|title)\*?\s*\{")
LETTERS = re.compile(r"[^\W\d_]+")
SIGN = re.compile(r"(?:(?<=(.))|\A)([^\w\s]+|_+)(?=(.)|\Z)", re.S)
#: Signs with no white space between them.
TOUCHING = re.compile(r"(?=([^\w\s]+|_+)([^\W_]+)([^\w\s]+|_+))")
#: A pair of equal signs around a phrase that they touch.
AROUND = re.compile(r"(?<![\w\\])([*_~=$'`]+)(?=\S)[^\n*_~=$'`]+?(?<=\S)\1(?!\w)")


class Path:
    """The tags around a block, innermost first; paths share what they have in common, however deep tags are nested."""

    __slots__ = ("name", "up", "level", "quoted")

    def __init__(self, name: str, up: Path | None):
        self.name, self.up = name, up
        self.level = int(name[1]) if re.fullmatch("h[1-6]", name) else up.level if up else 0
        self.quoted = name == "blockquote" or bool(up and up.quoted)

    def names(self, most: int) -> list[str]:
        out, at = [], self
        while at and len(out) < most:
            out.append(at.name)
            at = at.up
        return out


class Block:
    """kind: the way it was cut out; path: the tags around it."""

    __slots__ = ("kind", "path", "text")

    def __init__(self, kind: str, path: Path | None, text: str):
        self.kind, self.path, self.text = kind, path, text


def blocks(body: str | None) -> list[Block]:
    """The leaf sequence of a body."""
    if not body or not body.strip():
        return []
    out: list[Block] = []
    path: Path | None = None
    open_: Counter[str] = Counter()
    start = 0
    if m := FRONT.match(body):
        out.append(Block("front", None, m.group()))
        start = m.end()

    def lines(text: str) -> None:
        held: list[str] = []

        def flush() -> None:
            if held and "".join(held).strip():
                out.append(Block("p", path, "\n".join(held)))
            held.clear()

        for line in text.split("\n"):
            if not line.strip():
                flush()
            elif LIST_LINE.match(line):
                flush()
                held.append(line)
            elif HEAD_LINE.match(line):
                flush()
                out.append(Block("p", path, line))
            else:
                held.append(line)
        flush()

    def leave() -> None:
        nonlocal path
        open_[path.name] -= 1
        path = path.up

    def piece(text: str) -> None:
        nonlocal path
        at = 0
        for m in BLOCK_TAG.finditer(text):
            lines(text[at : m.start()])
            name = m["name"].lower()
            out.append(Block("tag", path, m.group()))
            if m["close"]:
                if open_[name]:
                    while path.name != name:
                        leave()
                    leave()
            elif not m["empty"] and name not in ("br", "hr"):
                if name in ("p", "li", "tr", "td", "th", "dt", "dd") and path and path.name == name:
                    leave()
                path = Path(name, path)
                open_[name] += 1
            at = m.end()
        lines(text[at:])

    # Inline code hides what only looks like a block.
    for m in WHOLE.finditer(body, start):
        if m.start() < start:
            continue
        piece(body[start : m.start()])
        kind = next(k for k in ("fence", "open", "pre", "comment", "display", "wikitable") if m[k] is not None)
        out.append(Block("fence" if kind == "open" else kind, path, m.group()))
        start = m.end()
    piece(body[start:])
    return out


@functools.lru_cache(1 << 16)
def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


@functools.lru_cache(1 << 16)
def _word(word: str) -> int:
    return _hash(f"w:{zlib.crc32(word.encode('utf-8', 'surrogatepass')) % WORD_BUCKETS}")


def _side(c: str) -> str:
    return "^" if not c or c == "\n" else "_" if c.isspace() else "0" if c.isdigit() else "A" if c.isupper() else "a"


@functools.lru_cache(1 << 16)
def _sign(before: str, sign: str, after: str) -> tuple[int, int]:
    return _hash(f"s:{sign[:8]}"), _hash(f"x:{_side(before)}{sign[:8]}{_side(after)}")


def shown(b: Block) -> str:
    """What of a block is looked at: code shows its marks, not what stands inside."""
    if b.kind in ("fence", "pre", "comment", "front"):
        return b.text.lstrip()[:160].split("\n")[0].split(">")[0]  # the opening mark or tag
    return INLINE_CODE.sub(lambda m: f"{m[1]}x{m[1]}" if m[1] else f"<{m[2]}>x</{m[2]}>", b.text)


def _shape(line: str) -> str:
    """How a line begins: white space, signs, and whether letters or digits follow."""
    return re.sub(r"[^\W\d_]+", "W", re.sub(r"\d+", "0", line[:24].rstrip("\r")))[:5]


def features(b: Block) -> np.ndarray:
    """Hashed words, signs with what stands beside them, the path and the kind."""
    t = shown(b)
    out = {_hash(f"k:{b.kind}"), _hash(f"b:{_shape(t)}"), _hash(f"c:{_shape(t)[:2]}"), *(_hash(f"t:{x}") for x in (b.path.names(4) if b.path else ()))}
    if b.path:
        out.add(_hash(f"l:{b.path.level > 0}{b.path.quoted}"))
    if b.kind in ("tag", "pre"):
        out.add(_hash(f"o:{(m := BLOCK_TAG.match(t) or re.match('<([a-zA-Z]+)', t)) and m[0][:4].lower()}"))
    out.update(map(_word, set(LETTERS.findall(t.lower()))))
    for triple in set(SIGN.findall(t)):
        out.update(_sign(*triple))
    for a, w, z in set(TOUCHING.findall(t)):
        out.add(_hash(f"j:{a[-3:]}{'0' if w.isdigit() else 'a'}{z[:3]}"))
    out.update(_hash(f"p:{x[:5]}") for x in set(AROUND.findall(t)))
    if "\n" in t:  # how the lines after the first begin
        out.update(_hash(f"n:{x}") for x in {_shape(line) for line in t.split("\n")[1:] if line.strip()})
    return np.fromiter(out, np.int64, len(out))


def _loss(logits: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Cross-entropy of the class and of each syntax; y: class, then a bit for each syntax."""
    k, n = len(CLASSES), len(y)
    e = np.exp(logits[:, :k] - logits[:, :k].max(1, keepdims=True))
    e /= e.sum(1, keepdims=True)
    d = np.empty_like(logits)
    d[:, :k] = e
    d[np.arange(n), y[:, 0]] -= 1
    s = 1 / (1 + np.exp(-logits[:, k:]))
    d[:, k:] = (s - y[:, 1:]) * np.where(y[:, 1:] > 0, 1.5, 1)
    return 0.0, d / n


def examples(n: int, seed: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Blocks of n written bodies and their labels: the class, then a bit for each syntax. A body whose leaves aren't cut as they were written is left out."""
    r = random.Random(seed)
    cuts, labels = [], []
    while len(cuts) < n:
        leaves = M.body(r)
        bs = blocks(M.text(leaves))
        if len(bs) == len(leaves):
            cuts.append(bs)
            labels.append(np.array([[CLASSES.index(x.kind), *(x.marks >> i & 1 for i in range(len(SYNTAXES)))] for x in leaves]))
    return cuts, labels


@functools.cache
def model(bodies: int = TRAIN_BODIES, epochs: int = EPOCHS) -> lstm.Params:
    """The network, trained on bodies that were written for it."""
    cuts, labels = examples(bodies, 11)
    p = lstm.init(BUCKETS, WIDTH, HIDDEN, len(CLASSES) + len(SYNTAXES), 7)
    return lstm.train(p, [[features(b) for b in bs] for bs in cuts], labels, _loss, epochs, ROWS, 0.02, 7)


def labelled(p: lstm.Params, bodies: list[str | None], rows: int = 256) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks and logits of each body; bodies of like length go through the network together."""
    cut = [blocks(b) for b in bodies]
    out: list = [(c, np.zeros((0, len(CLASSES) + len(SYNTAXES)))) for c in cut]
    order = sorted((i for i, c in enumerate(cut) if c), key=lambda i: len(cut[i]))
    at = 0
    while at < len(order):
        own = [order[at]]
        while len(own) < rows and at + len(own) < len(order) and (len(own) + 1) * len(cut[order[at + len(own)]]) <= 20_000:
            own.append(order[at + len(own)])
        logits, _ = lstm.forward(p, [[features(b) for b in cut[i]] for i in own])
        for i, x in zip(own, np.split(logits, np.cumsum([len(cut[i]) for i in own])[:-1])):
            out[i] = (cut[i], x)
        at += len(own)
    return out


def found(logits: np.ndarray) -> np.ndarray:
    """The syntaxes of a body: those that some block has with a probability of 0.5 or more."""
    return (logits[:, len(CLASSES) :] >= 0).any(0)


EMPHASIS = re.compile(
    r"(?<![\w*\\])\*{1,3}(?=[^\s*])([^*\n]+?)(?<=[^\s*\\])\*{1,3}(?![\w*])|(?<![\w\\])_{1,3}(?=[^\s_])([^_\n]+?)(?<=[^\s_\\])_{1,3}(?!\w)|~~(?=\S)([^~\n]+)(?<=\S)~~"
    r"|(?<![=\w])==(?=[^\s=])([^=\n]+)(?<=[^\s=])==(?![=\w])"
)
MATH = re.compile(r"\$\$[\s\S]+?\$\$|\\\[[\s\S]+?\\\]|\\\([\s\S]+?\\\)|(?<![\\$\w])\$(?=[^\s$])(?=[^$\n]*(?:[\\^_=<>{}+]|\b[A-Za-z]\b))[^$\n]*?(?<=[^\s\\])\$(?![\d$])")


def _settled(step: Callable[[str], str], text: str) -> str:
    """The text after as many steps as change it: one for each level of nesting."""
    while (after := step(text)) != text:
        text = after
    return text


def plain(text: str) -> str:
    """Inline markup of all syntaxes taken off; code and formulas stay as they are."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        s = m.group()
        kept.append(html.unescape(TAG.sub("", s)) if s.startswith("<") else s.strip("`").strip() if s.startswith("`") else s)
        return f"\x00{len(kept) - 1}\x00"

    t = MATH.sub(keep, INLINE_CODE.sub(keep, text.replace("\x00", "")))
    t = re.sub(COMMENT, "", t)
    t = re.sub(r"!?\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]", r"\1", t)
    t = re.sub(r"\{\{[^{}|]*\|?([^{}]*)\}\}", lambda m: m[1].split("|")[0], t)
    t = re.sub(r"\[(?:https?|ftp)://[^\s\]]+[ \t]([^\]\n]+)\]", r"\1", t)
    t = re.sub(r"!?\[([^\[\]\n]*)\]\((?:<[^>\n]*>|[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+[\"'(][^\n]*?[\"')])?\)", r"\1", t)
    t = re.sub(r"(?<!\[)\[([^\[\]\n]+)\][ ]?\[[^\[\]\n]*\](?!\])", r"\1", t)
    t = re.sub(r"\[\^[^\]\n]+\]:?", "", t)
    t = re.sub(r"\\(?:label|ref|cite|index)\w*\*?\s*(?:\[[^\]\n]*\])?\{[^{}]*\}", "", t)
    t = _settled(lambda t: re.sub(r"\\[A-Za-z]{2,}\*?\s*(?:\[[^\]\n]*\]\s*)?\{([^{}]*)\}", r"\1", t), t)
    t = re.sub(r"\\item\b[ \t]*|\\(?:begin|end)\{[A-Za-z]+\*?\}", "", t)
    t = re.sub(r"\{\\(?:bf|it|em|tt|sc|rm|sl)\b[ ]?([^{}]*)\}", r"\1", t)
    t = re.sub(r"'{2,5}(?=\S)([^'\n]+(?:'[^'\n]+)*)'{2,5}", r"\1", t)
    t = _settled(lambda t: EMPHASIS.sub(lambda m: next(g for g in m.groups() if g is not None), t), t)
    t = _settled(lambda t: html.unescape(TAG.sub(" ", t)), t)  # escaped tags are tags once unescaped
    t = re.sub(r"\s+", " ", TAG.sub(" ", t)).strip()
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], t)


def render(bs: list[Block], logits: np.ndarray) -> str:
    """Readable text, a paragraph or structure each, by the class the network gives."""
    out: list[str] = []
    for b, k in zip(bs, logits[:, : len(CLASSES)].argmax(1)):
        t, kind = b.text.replace("\r", ""), CLASSES[k]
        if kind == "meta":
            continue
        if kind == "code":
            body = re.sub(r"^[ \t>]*(?:`{3,}|~{3,})[^\n]*\n?|\n?[ \t>]*(?:`{3,}|~{3,})\s*$", "", t) if b.kind == "fence" else html.unescape(TAG.sub("", t)) if b.kind == "pre" else t
            out.append(f"```\n{body.strip(chr(10))}\n```")
        elif kind == "formula":
            out.append(f"$$ {' '.join(re.sub(r'^(?:[$]{2}|..begin.(?:[a-z]+)[*]?.|..)|(?:[$]{2}|..end.(?:[a-z]+)[*]?.|..)$', '', t.strip()).split())} $$" if t.strip().startswith("$$") else t.strip())
        elif kind == "heading":
            level = (b.path.level if b.path else 0) or len(re.match(r"[ \t]*([#=]*)", t)[1]) or 2
            s = re.sub(r"^[ \t]*(?:#+|={2,6})[ \t]*|[ \t]*(?:#+|={2,6})[ \t]*$|\n[ \t]*[=-]{2,}[ \t]*$", "", t.strip())
            out.append(f"{'#' * min(6, level)} {plain(s)}")
        elif kind == "list":
            m = re.match(r"([ \t]*)(?:([-+*]|\\item|[;:]+)|(\d{1,9})[.)])[ \t]*(?:\[([ xX])\][ \t]+)?", t)
            s = plain(t[m.end() :] if m else t)
            out.append(f"{m[1] if m else ''}{f'{m[3]}.' if m and m[3] else '-'} {s}")
        elif kind == "table":
            rows = [re.sub(r"^[{|!+-]+|[|}]+$", "", r.strip()) for r in t.split("\n")]
            cells = [" | ".join(plain(c) for c in re.split(r"\|\||!!|\|", r) if c.strip()) for r in rows if re.search(r"\w", r) and not re.match(r"\s*class=", r)]
            out += [c for c in cells if c]
        elif kind == "quote":
            out.append("> " + plain(re.sub(r"^[ \t]*>[ \t]?(?:\[![\w-]+\][+-]?[ \t]*)?", "", t, flags=re.M)))
        else:
            s = plain(t)
            if s:
                out.append(s)
    joined = ""
    for i, s in enumerate(out):
        tight = i and re.match(r"\s*(?:-|\d+\.) ", s) and re.match(r"\s*(?:-|\d+\.) ", out[i - 1])
        joined += ("" if not i else "\n" if tight else "\n\n") + s
    return joined


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("source_table"), F.col(k).cast("string").alias("record_id"), F.col(c).alias("body")) for t, k, c in SOURCES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _applied(rows: DataFrame, schema: str, f) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield f(frame, labelled(shared.value, frame["body"].tolist()))

    return spread(rows).mapInPandas(run, schema)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(frame: pd.DataFrame, read: list) -> pd.DataFrame:
        hits = [(s, r, SYNTAXES[i]) for s, r, (bs, x) in zip(frame["source_table"], frame["record_id"], read) if len(bs) for i in np.flatnonzero(found(x))]
        return pd.DataFrame(hits, columns=["source_table", "record_id", "syntax"])

    return _applied(bodies(spark, sf_dir).filter("record_id IS NOT NULL"), "source_table string,record_id string,syntax string", rows).distinct()


def p3_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(frame: pd.DataFrame, read: list) -> pd.DataFrame:
        return pd.DataFrame({"source_table": frame["source_table"], "record_id": frame["record_id"], "plain_text": [render(bs, x) for bs, x in read]})

    return _applied(bodies(spark, sf_dir), "source_table string,record_id string,plain_text string", rows)


QUERIES = {"p3_found": p3_found, "p3_text": p3_text}
