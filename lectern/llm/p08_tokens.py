"""Problem 8: token ids of every text by a public tokenizer, as a reduction of a monoid.

A text is halved until a piece has at most LEAF characters; pieces are encoded on their own and neighbours joined up the tree. The
tokenizer splits a text into pretokens from left to right, each match depending on what it takes and one character more, and encodes each
pretoken alone. So of the left piece all pretokens but the last stand (but the last two where they are an apostrophe and one letter, which may become a
contraction); from there on the text is split anew over a window that grows
into the right piece until a boundary falls on one the right piece has itself. From a common boundary on both splits are the same, so the tokens to either
side of the window provably stand and only the window is encoded again. Decoding concatenates the pieces' bytes up the tree.

Null and empty texts have an empty list. Strings of special tokens are ordinary text. Repeated rows give repeated rows; rows with a null id
keep it. The path of the vocabulary is a parameter; each Python worker loads it once.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread, table

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
LEAF = 16_384
WINDOW = 64
# Fixed value: the published splitting pattern of the byte-level vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def tokenizer(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("byte-level", pat_str=PATTERN.pattern, mergeable_ranks=ranks(path), special_tokens={})


def encode(path: str, texts: list[str]) -> list[list[int]]:
    t = tokenizer(path)
    return [t.encode_ordinary(x) for x in texts]


@dataclass
class Piece:
    """text[start:end] encoded; what is before last stands whatever follows."""

    start: int
    end: int
    last: int
    ids: list[int]


def _unsettled(text: str, spans: list[tuple[int, int]]) -> int:
    """Where the pretokens begin that may change with what follows: the last one, with an apostrophe before a single letter."""
    a, z = spans[-1]
    if len(spans) > 1 and z - a == 1 and text[spans[-2][0] : a] == "'":
        return spans[-2][0]
    return a


def _last_pretoken(text: str, start: int, end: int) -> int:
    two: list[tuple[int, int]] = [(start, start)]
    for m in PATTERN.finditer(text, start, end):
        two = [*two[-1:], m.span()]
    return _unsettled(text, two)


def leaf(path: str, text: str, start: int, end: int) -> Piece:
    return Piece(start, end, _last_pretoken(text, start, end), encode(path, [text[start:end]])[0])


def join(path: str, text: str, a: Piece, b: Piece) -> Piece:
    """The piece of both; associative, with empty pieces neutral."""
    if a.start == a.end or b.start == b.end:
        return b if a.start == a.end else a
    size = WINDOW
    while True:
        end = min(b.end, b.start + size)
        whole = end == b.end
        cut = lambda at: [m.span() for m in PATTERN.finditer(text, at, end)]
        new, own = cut(a.last), cut(b.start)
        if not whole:  # the last matches may go on beyond the window
            new, own = new[:-2], own[:-2]
        # Not behind white space: a run of it is split by what follows, which a window encoded alone would not show.
        common = {e for _, e in own} & {e for _, e in new if e > b.start and (e == b.end or not text[e - 1].isspace())}
        if common or whole:
            break
        size *= 2
    sync = min(common) if common else b.end
    tail, middle, head = encode(path, [text[a.last : a.end], text[a.last : sync], text[b.start : sync]])
    last = b.last if b.last >= sync else _unsettled(text, [x for x in new if x[1] <= sync])
    return Piece(a.start, b.end, last, a.ids[: len(a.ids) - len(tail)] + middle + b.ids[len(head) :])


def encode_tree(path: str, text: str, start: int = 0, end: int | None = None, size: int = LEAF) -> Piece:
    end = len(text) if end is None else end
    if end - start <= size:
        return leaf(path, text, start, end)
    half = (start + end) // 2
    return join(path, text, encode_tree(path, text, start, half, size), encode_tree(path, text, half, end, size))


def encode_all(path: str, texts: list[str | None], size: int = LEAF) -> list[list[int]]:
    """Texts of one leaf go through in one batch, longer ones up the tree."""
    short = [i for i, t in enumerate(texts) if t and len(t) <= size]
    out: list[list[int]] = [[] for _ in texts]
    for i, ids in zip(short, encode(path, [texts[i] for i in short])):
        out[i] = ids
    for i, t in enumerate(texts):
        if t and len(t) > size:
            out[i] = encode_tree(path, t, size=size).ids
    return out


@functools.cache
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: t for t, i in ranks(path).items()}


def decode_tree(path: str, ids: list[int]) -> bytes:
    if len(ids) <= LEAF:
        table_ = token_bytes(path)
        return b"".join(table_[i] for i in ids)
    half = len(ids) // 2
    return decode_tree(path, ids[:half]) + decode_tree(path, ids[half:])


def _batches(texts: list, limit: int = 4_000_000) -> Iterator[slice]:
    """Slices of at most so many characters, so that a batch of long texts needs no more memory than one of them."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > limit and i > begin:
            yield slice(begin, i)
            begin, size = i, len(t or "")
    yield slice(begin, len(texts))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(doc_id, ids) of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].tolist()
            for s in _batches(texts):
                yield pd.DataFrame({"doc_id": f["doc_id"].iloc[s], "ids": encode_all(path, texts[s])})

    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInPandas(run, f"doc_id {docs.schema[id_col].dataType.simpleString()},ids array<int>")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(doc_id, n_tokens) of every row; the ids stay in the worker."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].tolist()
            n = [len(ids) for s in _batches(texts) for ids in encode_all(path, texts[s])]
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_tokens": n})

    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInPandas(run, f"doc_id {docs.schema[id_col].dataType.simpleString()},n_tokens bigint")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, tokens, and how many come back from their ids byte for byte."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].tolist()
            ids = [x for s in _batches(texts) for x in encode_all(BYTE_BPE, texts[s])]
            ok = [decode_tree(BYTE_BPE, i) == (t or "").encode() for i, t in zip(ids, texts)]
            yield pd.DataFrame({"source": f["source"], "n_tokens": [len(i) for i in ids], "ok": ok})

    rows = spread(docs).mapInPandas(run, "source string,n_tokens bigint,ok boolean")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("ok").cast("long")).alias("n_exact"))


QUERIES = {"p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip}
SQL: dict[str, str] = {}
