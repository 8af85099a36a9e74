"""Text functions, Column to Column; JVM built-ins unless a docstring says otherwise. Null gives null unless stated."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

# The character entities that are replaced natively, ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"


def sub(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, F.lit(by))


@cache
def accents() -> tuple[str, str]:
    """Lower-case letters with marks and the letters below them, from their canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x2000) if chr(c).isalpha() and chr(c) == chr(c).lower()]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case without accents and without combining marks; ł and the like stay."""
    return sub(F.translate(F.lower(c), *accents()), r"\p{Mn}+")


def unescape_all(c: Column) -> Column:
    """All entities of HTML; an Arrow function, as the built-ins can't express it."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else html.unescape(x)), "string")(c)


def unescape(c: Column) -> Column:
    """All entities of HTML: the common ones by built-ins, a text with any other by the Arrow function."""
    common = c
    for a, b in ENTITIES:
        common = F.replace(common, F.lit(a), F.lit(b))
    other = c.rlike("&(?!(?:" + "|".join(a[1:-1] for a, _ in ENTITIES) + ");)[#A-Za-z]")
    return F.when(other, unescape_all(c)).otherwise(common)


def collapse(c: Column) -> Column:
    return F.trim(sub(c, r"[\s\u00a0]+", " "))


def plain_text(c: Column) -> Column:
    """Tags to blanks, then entities, then white space; escaped tags survive."""
    return collapse(unescape(sub(c, "<[^>]*>", " ")))


def paragraph_text(c: Column) -> Column:
    """As plain_text, with paragraphs parted by blank lines kept."""
    t = unescape(sub(c, "<[^>]*>", " "))
    parts = F.filter(F.transform(F.split(t, r"\n\s*\n"), collapse), lambda p: p != "")
    return F.array_join(parts, "\n\n")


def without_nul(c: Column) -> Column:
    return F.trim(F.translate(c, "\x00", ""))


def plain(c: Column) -> Column:
    """Entities, no NUL or soft hyphen, runs of blanks and tabs collapsed; line ends stay."""
    return F.trim(sub(F.translate(unescape(c), "\x00\u00ad", ""), r"[ \t]+", " "))


def _norm(x: str | None) -> str | None:
    return None if x is None else re.sub("[^a-z0-9]+", "", unicodedata.normalize("NFKD", x).casefold())


def norm_key(c: Column) -> Column:
    """Compatibility decomposition and full case folding, then only a-z and 0-9. A text of ASCII takes built-ins only."""
    return F.when(c.rlike(r"^[\x00-\x7f]*$"), sub(F.lower(c), "[^a-z0-9]+")).otherwise(F.pandas_udf(lambda s: s.map(_norm), "string")(c))


def year(c: Column) -> Column:
    """The first year from 1800 to 2199; empty string if none."""
    return F.regexp_extract(c, r"(1[89]\d\d|2[01]\d\d)", 1)


def margin_key(c: Column) -> Column:
    """A margin line with page words, Roman numerals and digits reduced to marks."""
    words = F.split(F.trim(sub(F.lower(c), NOT_W + "+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("^([0-9]+|[ivxlcdm]+)$"), "#").when(w == "strona", "page").otherwise(w)), " ")


def join_lines(c: Column) -> Column:
    """One line; a hyphen at a line end goes if the next line starts in lower case."""
    return collapse(sub(c, r"(\p{L})[-\u00ad]\s*\n\s*(\p{Ll})", "$1$2"))


def collapse_letter_spacing(c: Column) -> Column:
    """T E X T to TEXT, 1 . 2 to 1.2; letters that stand alone in runs of three or more. An Arrow function."""
    run = re.compile(r"(?<!\w)(?:[^\W\d_] ){2,}[^\W\d_](?!\w)")
    dot = re.compile(r"(?<=\d) ?\. ?(?=\d)")
    one = lambda x: None if x is None else dot.sub(".", run.sub(lambda m: m.group().replace(" ", ""), x))
    return F.pandas_udf(lambda s: s.map(one), "string")(c)


def without_repetition(c: Column) -> Column:
    """A text of four or more words, an even number, whose halves are equal, to its first half."""
    w = F.split(F.trim(c), r"\s+")
    n = F.size(w)
    half = F.floor(n / 2).cast("int")
    first, second = F.slice(w, F.lit(1), F.greatest(half, F.lit(1))), F.slice(w, F.greatest(half, F.lit(1)) + 1, F.greatest(half, F.lit(1)))
    return F.when((n >= 4) & (n % 2 == 0) & (first == second), F.array_join(first, " ")).otherwise(c)


def ends_sentence(c: Column) -> Column:
    return c.rlike(r"[.!?][\"'”»)\]]*\s*$")


def is_page_number(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike(r"^(page\s+)?([ivxlcdm]+|[0-9]+)$")


def word_count(c: Column) -> Column:
    return F.size(F.split(F.trim(c), r"\s+"))


def heading_words(c: Column) -> Column:
    """Starts with a word that names a part of a text, or a section number, is short and no sentence."""
    t = F.trim(c)
    named = F.lower(t).rlike(r"^(abstract|introduction|conclusions?|references|bibliography|contents|chapter|part|annex|appendix|summary|wstęp|rozdział|spis)\b")
    numbered = t.rlike(r"^([0-9]+(\.[0-9]+)*\.?|[IVXLC]+\.)\s+\p{Lu}")
    return (named | numbered) & (F.length(t) <= 120) & (word_count(t) <= 16) & ~ends_sentence(t)


def all_caps_heading(c: Column) -> Column:
    t = F.trim(c)
    return (t == F.upper(t)) & t.rlike(r"\p{Lu}{2}") & (F.length(t) <= 120) & (word_count(t) <= 14) & ~ends_sentence(t)


def compact(c: Column) -> Column:
    return sub(F.lower(c), NOT_W + "+")


def locator(c: Column) -> Column:
    """For finding a passage: no tags, divided words joined, everything else but letters and digits a blank."""
    t = sub(sub(F.translate(sub(c, "<[^>]*>", " "), "\u00ad", ""), rf"({W})-\s+({W})", "$1$2"), NOT_W + "+", " ")
    return F.trim(F.lower(t))


# Titles that say nothing.
GENERIC_TITLE = r"(?i)^(?:paper|full.?text(?: pdf)?|article|document|manuscript|download|untitled|main|submission|accepted.?manuscript|attachment|[a-f0-9]{8,})(?:\.pdf)?$"


def bad_title(c: Column) -> Column:
    """Nothing, a generic name, a hexadecimal number or the name of a PDF; null is bad."""
    t = F.btrim(sub(sub(c, "<[^>]*>", " "), r"\s+", " "), F.lit(" ._-"))
    return F.coalesce((t == "") | t.rlike(GENERIC_TITLE) | F.lower(t).endswith(".pdf"), F.lit(True))


def publication_date(c: Column) -> Column:
    """Y-M-D with zeros, else the year, else as it stands."""
    part = lambda i: F.regexp_extract(c, r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", i)
    y = year(c)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))).when(y != "", y).otherwise(c)


CREATORS = "array<struct<creatorType:string,firstName:string,lastName:string>>"


def creator_names(json: Column) -> Column:
    """Names of authors, of all creators if there are none; first of equal names ignoring case."""
    people = F.from_json(json, CREATORS)
    authors = F.filter(people, lambda p: p["creatorType"].isin("author", "bookAuthor"))
    names = F.transform(F.when(F.size(authors) > 0, authors).otherwise(people), lambda p: F.trim(F.concat_ws(" ", p["firstName"], p["lastName"])))
    return distinct_by(F.filter(names, lambda n: n != ""), F.lower)


def distinct_by(values: Column, key) -> Column:
    """The first of each key, in order."""
    keys = F.transform(values, key)
    return F.filter(values, lambda v, i: F.array_position(keys, key(v)) == i + 1)


def position_page(position: Column, label: Column) -> Column:
    """pageIndex + 1 of a JSON position, else the first digits of the label."""
    index = F.get_json_object(position, "$.pageIndex").try_cast("int")
    digits = F.regexp_extract(label, r"([0-9]+)", 1)
    return F.when(index >= 0, index + 1).when(digits != "", digits.try_cast("int"))


def safe_snippet(c: Column) -> Column:
    """Only mark tags survive, all else is escaped."""
    t = F.replace(F.replace(c, F.lit("<mark>"), F.lit("\x01")), F.lit("</mark>"), F.lit("\x02"))
    t = sub(t, "<[^>]*>", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\x01", "<mark>"), ("\x02", "</mark>")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


#: (pattern, replacement) in order; the same for Java and RE2 but for the marks of groups. Fences go before entities are read, all else after.
MARKDOWN_FENCE = (r"(?s)```.*?```", " ")
MARKDOWN_STEPS = (
    (r"<[^>]*>", " "), (r"`([^`]*)`", "$1"), (r"!?\[\[[^\]|#]+(?:#[^\]|]+)?\|([^\]]+)\]\]", "$1"), (r"!?\[\[([^\]|#]+)(?:#[^\]|]+)?\]\]", "$1"),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^\s{0,3}#{1,6}\s*", ""), (r"(?m)^\s*(?:[-*+] |\d+[.)] )", ""), (r"[*_~>|]", " "),
)


def markdown_plain(c: Column) -> Column:
    """Text of Markdown: fences dropped; code, links and embeds to what they show; marks of headings, lists and emphasis gone; paragraphs kept."""
    c = unescape(sub(c, *MARKDOWN_FENCE))
    for pattern, by in MARKDOWN_STEPS:
        c = sub(c, pattern, by)
    return F.array_join(F.filter(F.transform(F.split(c, r"\n\s*\n"), collapse), lambda x: x != ""), "\n\n")


def first_heading(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"(?m)^#[ \t]+([^\r\n]+)", 1))


def stem(c: Column) -> Column:
    return sub(c, r"\.[^.]*$")


def inline_tags(c: Column) -> Column:
    """#tag and #tag/sub, not after a letter or slash, code removed; ordered, once each."""
    t = sub(sub(c, r"(?s)```.*?```", " "), r"`[^`]*`", " ")
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?:^|[^\p{L}\p{N}_/#&])#(\p{L}[\p{L}\p{N}_/-]*)"), F.lit(1)))


LINK = r"(!?)\[\[([^\]|#]*)(?:#([^\]|]*))?(?:\|([^\]]*))?\]\]"


def links(c: Column) -> Column:
    """array<struct<embed, target, heading, display>> of [[target#heading|display]]."""
    g = [F.regexp_extract_all(c, F.lit(LINK), F.lit(i)) for i in (1, 2, 3, 4)]
    return F.transform(F.arrays_zip(*g), lambda z: F.struct((z["0"] == "!").alias("embed"), F.trim(z["1"]).alias("target"), F.trim(z["2"]).alias("heading"), F.trim(z["3"]).alias("display")))


def tokens(c: Column) -> Column:
    """Index terms: runs of letters and digits of the folded text; _ parts them."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


# Words too common to be searched for, of two languages.
STOP_WORDS = tuple(dict.fromkeys((
    "a about according all an and answer are as at be been being by can could did do does explain for from give how i in is it library me my of on please say says should tell that the their them there these this to was were what when where which who why with would "
    "a aby ale biblioteka bibliotece biblioteki by był była było co czy dla do gdzie i jak jaka jakie jest która które mi mnie moja moje mojej na o od opisz oraz po powiedz przez się są ta ten te to w we według z za ze"
).split()))


def query_terms(c: Column, most: int = 10) -> Column:
    """Words of three or more letters that aren't stop-words; ordered, once each."""
    words = F.regexp_extract_all(F.translate(F.lower(c), "ς", "σ"), F.lit(W + "+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))), 1, most)


# Letters and words that tell languages apart, and the names a language goes by.
LANGUAGE_SIGNS = (("pol", "[ąćęłńóśźż]"), ("ukr", "[іїєґ]"), ("rus", "[а-яё]"), ("ell", "[α-ωάέήίόύώϊϋΐΰ]"), ("ara", "[\u0600-\u06ff]"), ("deu", "[äöüß]"))
LANGUAGE_WORDS = {
    "eng": ("and", "the", "of", "to", "in", "for", "with", "from", "on", "law", "legal", "article", "report"),
    "pol": ("oraz", "dla", "przez", "jest", "nie", "się", "w", "z", "na", "prawa", "prawny", "prawne", "raport"),
    "deu": ("und", "der", "die", "das", "von", "für", "mit", "auf", "recht", "bericht"),
    "fra": ("et", "le", "la", "les", "de", "des", "pour", "avec", "droit", "rapport"),
    "spa": ("y", "el", "la", "los", "de", "para", "con", "derecho", "informe"),
    "ita": ("e", "il", "la", "di", "per", "con", "diritto", "rapporto"),
    "nld": ("en", "de", "het", "van", "voor", "met", "recht", "rapport"),
    "por": ("e", "o", "a", "de", "para", "com", "direito", "relatório"),
}
LANGUAGE_NAMES = {
    "ara": ("ar", "arabic"), "ces": ("cs", "ces", "czech"), "deu": ("de", "deu", "german"), "nld": ("nl", "nld", "dutch"), "eng": ("en", "eng", "english"), "spa": ("es", "spa", "spanish"), "fra": ("fr", "fra", "fre", "french"),
    "ell": ("el", "ell", "greek"), "ita": ("it", "ita", "italian"), "pol": ("pl", "pol", "polish"), "por": ("pt", "por", "portuguese"), "rus": ("ru", "rus", "russian"), "slk": ("sk", "slk", "slovak"), "ukr": ("uk", "ukr", "ukrainian"),
}
LANGUAGE_CODES = {name: code for code, names in LANGUAGE_NAMES.items() for name in names}


def language_code(c: Column) -> Column:
    """Of the first part of a notation that names a language."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    return F.element_at(F.create_map(*[F.lit(x) for p in LANGUAGE_CODES.items() for x in p]), F.try_element_at(F.filter(parts, lambda p: p.isin(*LANGUAGE_CODES)), F.lit(1)))


def language(code: Column, text: Column) -> Column:
    """A known code wins, then letters, then a vote of common words: three at least and two more than the next."""
    t = F.lower(text)
    words = F.regexp_extract_all(t, F.lit(r"\p{L}+"), F.lit(0))
    among = lambda v: F.size(F.filter(words, lambda w: w.isin(*v)))
    votes = {k: among(v) for k, v in LANGUAGE_WORDS.items()}
    out = F.when(language_code(code).isNotNull(), language_code(code))
    for name, sign in LANGUAGE_SIGNS:
        out = out.when(t.rlike(sign), name)
    for k, v in votes.items():
        others = F.greatest(*[x for n, x in votes.items() if n != k])
        out = out.when((v >= 3) & (v >= others + 2), k)
    return out


def select_languages(installed: list[str], wanted: str, manual: bool = False) -> dict:
    """Recogniser languages: a manual list restricted to what is installed, or the detected one with English."""
    if manual:
        chosen = [x for x in wanted.split("+") if x in installed]
        return {"languages": "+".join(chosen), "mode": "manual", "missing": [x for x in wanted.split("+") if x not in installed] or None}
    code = LANGUAGE_CODES.get(re.split("[-_]", wanted.lower())[0], wanted)
    parts = [x for x in dict.fromkeys([code, "eng"]) if x in installed]
    return {"languages": "+".join(parts), "mode": "detected", "detected": code, "missing": None if code in installed else code}


def model_token(name: Column) -> Column:
    name = F.trim(name)
    slug = F.substring(F.btrim(sub(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), 1, 48)
    return F.concat_ws("-", F.when(slug == "", "model").otherwise(slug), F.substring(F.sha2(name, 256), 1, 12))


def note_id(path: Column) -> Column:
    return F.sha1(F.lower(path))


def section_id(note: Column, ordinal: Column, heading: Column) -> Column:
    return F.sha1(F.concat_ws("\x00", note, ordinal.cast("string"), heading))


def highlight(c: Column, words: list[str]) -> Column:
    """<mark> around whole words, the longest first, twenty at most."""
    some = sorted(dict.fromkeys(w for w in words if w), key=len, reverse=True)[:20]
    return sub(c, rf"(?iu)(?<!{W})({'|'.join(map(re.escape, some))})(?!{W})", "<mark>$1</mark>") if some else c


def alnum_count(c: Column) -> Column:
    return F.length(sub(c, r"[^\p{L}\p{N}]+"))


def parse_frontmatter(text: str | None) -> dict[str, list[str]]:
    """Keys in lower case to lists of values: scalars, inline lists, dash lists, of the first 400 lines."""
    lines = (text or "").replace("\r\n", "\n").split("\n")
    if not lines or lines[0].strip("\ufeff \t") != "---":
        return {}
    end = next((i for i, x in enumerate(lines[1:400], 1) if x.strip() == "---"), None)
    if end is None:
        return {}
    out: dict[str, list[str]] = {}
    key = None
    scalar = lambda s: s.strip().strip("\"'").strip()
    for line in lines[1:end]:
        if m := re.match(r"\s*-\s+(.*)", line):
            if key is not None and scalar(m[1]):
                out[key].append(scalar(m[1]).lstrip("#"))
        elif m := re.match(r"([^\s:#][^:]*):\s*(.*)", line):
            key, value = m[1].strip().lower(), m[2].strip()
            value = value[1:-1] if value.startswith("[") and value.endswith("]") else value
            out[key] = [v.lstrip("#") for v in map(scalar, re.split("[,;]", value)) if v]
    return out


def frontmatter(c: Column) -> Column:
    """map<string,array<string>>; an Arrow function, for its state goes from line to line."""
    return F.pandas_udf(lambda s: s.map(parse_frontmatter), "map<string,array<string>>")(c)
