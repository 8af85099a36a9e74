"""Queries of the text functions over the library's tables, with their SQL."""

from __future__ import annotations

import html.entities

from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table


def _over(name: str, key: str, made):
    """A query of key and computed columns of the distinct rows of a table; made gives the columns once there is a session."""
    return lambda spark, d: table(spark, d, name).select(F.col(key).alias("key"), *[f.alias(c) for c, f in made().items()]).distinct()


def _sql(name: str, key: str, **made: str) -> str:
    return f"SELECT DISTINCT {key} AS key, {', '.join(f'{e} AS {c}' for c, e in made.items())} FROM {name}"


def _unescape(x: str) -> str:
    """Numbers and the named entities of Latin letters and signs, ampersand last."""
    for pattern, value in (("&#(\\d+);", "chr(e::INTEGER)"), ("&#[xX]([0-9a-fA-F]+);", "chr(('0x' || e)::INTEGER)")):
        head = "'&#' || e || ';'" if "\\d" in pattern else "'&#x' || e || ';'"
        x = f"list_reduce(list_prepend({x}, list_distinct(regexp_extract_all({x}, '{pattern}', 1))), lambda acc, e: replace(acc, {head}, {value}))"
    named = {f"&{n};": c for n, c in html.entities.entitydefs.items() if n != "amp"}
    pairs = [(a, b.replace("'", "''")) for a, b in (*named.items(), ("&amp;", "&"))]
    return f"list_reduce(list_prepend([{x}, ''], [{', '.join(f'[{a!r}, {chr(39)}{b}{chr(39)}]' for a, b in pairs)}]), lambda acc, e: [replace(acc[1], e[1], e[2]), ''])[1]"


_ws = lambda x: f"trim(regexp_replace({x}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"
_tags = lambda x: f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
_end = "'[.!?][\"''”»)\\]]*\\s*$'"
_words = lambda x: f"len(regexp_split_to_array(trim({x}), '\\s+'))"


def _paragraphs(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '\\n\\s*\\n'), lambda p: {_ws('p')}), lambda p: p <> ''), chr(10) || chr(10))"


def _markdown(x: str) -> str:
    x = _unescape(f"regexp_replace({x}, '{T.MARKDOWN_FENCE[0]}', ' ', 'g')")
    for pattern, by in T.MARKDOWN_STEPS:
        x = f"regexp_replace({x}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return _paragraphs(x)


_NL2 = "chr(10) || chr(10)"
_part = lambda i: f"regexp_extract(date_created, '([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}})', {i})"
_YEAR = "regexp_extract({}, '(1[89]\\d\\d|2[01]\\d\\d)', 1)"
_fold = lambda x: f"regexp_replace(strip_accents(lower({x})), '\\p{{Mn}}+', '', 'g')"
_norm = lambda x: f"regexp_replace(strip_accents(replace(replace(replace(lower({x}), 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl')), '[^a-z0-9]+', '', 'g')"
_TOKENS = lambda x: f"regexp_extract_all({_fold(x)}, '[\\p{{L}}\\p{{N}}]+')"

c = F.col
# The fields of the metadata that are searched, in order.
FIELDS = ("abstractNote", "publicationTitle", "bookTitle", "conferenceName", "shortTitle", "rights", "place", "publisher", "series")


def metadata_text():
    """Title, names, type and nine fields of the metadata, those that aren't empty parted by points; as plain text."""
    full = lambda p: F.array_join(F.filter(F.array(p["firstName"], p["lastName"]), lambda x: x != ""), " ")
    names = F.array_join(F.transform(F.from_json("creators_json", T.CREATORS), full), ", ")
    m = F.from_json("metadata_json", "map<string,string>")
    parts = F.filter(F.array(c("title"), names, c("item_type"), *[m[x] for x in FIELDS]), lambda x: x.isNotNull() & (x != ""))
    return T.plain_text(F.array_join(parts, ". "))


QUERIES = {
    "plain_text": _over("notes", "id", lambda: dict(plain=T.plain_text(c("note_html")))),
    "paragraph_text": _over("notes", "id", lambda: dict(plain=T.paragraph_text(c("note_html")))),
    "entity_unescape_all": _over("notes", "id", lambda: dict(plain=T.unescape_all(c("note_html")))),
    "plain_lines": _over("document_pages", "id", lambda: dict(plain=T.plain(c("text")))),
    "clean_text": _over("document_pages", "id", lambda: dict(plain=T.without_nul(c("text")))),
    "norm_key": _over("items", "id", lambda: dict(k=T.norm_key(c("title")))),
    "year_extract": _over("items", "id", lambda: dict(year=T.year(c("date_created")))),
    "canonical_margin": _over("clean_document_blocks", "id", lambda: dict(k=T.margin_key(c("text")))),
    "join_lines": _over("document_pages", "id", lambda: dict(line=T.join_lines(c("text")))),
    "letter_spacing": _over("document_pages", "id", lambda: dict(t=T.collapse_letter_spacing(c("text")))),
    "exact_repetition": _over("documents", "doc_id", lambda: dict(t=T.without_repetition(c("text")))),
    "sentence_end": _over("clean_document_blocks", "id", lambda: dict(ends=T.ends_sentence(c("text")))),
    "page_number_lines": _over("clean_document_blocks", "id", lambda: dict(is_number=T.is_page_number(c("text")))),
    "heading_flags": _over("clean_document_blocks", "id", lambda: dict(heading=T.heading_words(c("text")), caps=T.all_caps_heading(c("text")))),
    "compact_text": _over("clean_document_blocks", "id", lambda: dict(k=T.compact(c("text")))),
    "locator_text": _over("clean_document_blocks", "id", lambda: dict(k=T.locator(c("text")))),
    "bad_title": _over("notes", "id", lambda: dict(bad=T.bad_title(c("title")))),
    "publication_date": _over("items", "id", lambda: dict(d=T.publication_date(c("date_created")))),
    "creator_names": _over("items", "id", lambda: dict(names=F.array_join(T.creator_names(c("creators_json")), "; "))),
    "position_page": _over("semantic_chunks", "id", lambda: dict(page_number=T.position_page(F.lit(None).cast("string"), c("page")))),
    "safe_snippet": _over("notes", "id", lambda: dict(snippet=T.safe_snippet(F.replace(c("note_html"), F.lit("b>"), F.lit("mark>"))))),
    "markdown_plain": _over("obsidian_sections", "section_id", lambda: dict(plain=T.markdown_plain(c("markdown")))),
    "frontmatter": _over("obsidian_notes", "note_id", lambda: dict(keys=F.array_join(F.array_sort(F.map_keys(T.frontmatter(c("markdown")))), ","))),
    "note_title": _over("obsidian_notes", "note_id", lambda: dict(title=F.coalesce(c("title"), F.nullif(T.first_heading(c("markdown")), F.lit("")), T.stem(c("filename"))))),
    "inline_tags": _over("obsidian_notes", "note_id", lambda: dict(tags=F.array_join(T.inline_tags(c("markdown")), ","))),
    "metadata_text": _over("items", "id", lambda: dict(t=metadata_text())),
    "language_vote": _over("documents", "doc_id", lambda: dict(language=T.language(c("lang"), c("text")))),
    "language_of_text": _over("documents", "doc_id", lambda: dict(language=T.language(F.lit(None).cast("string"), c("text")))),
    "content_hashes": _over("documents", "doc_id", lambda: dict(sha=F.sha2(c("text"), 256), sha1=F.sha1(c("text")))),
    "section_ids": _over("obsidian_sections", "section_id", lambda: dict(made=T.section_id(c("note_id"), c("ordinal"), c("heading")))),
    "model_token": _over("semantic_chunks", "model", lambda: dict(token=T.model_token(c("model")))),
    "query_terms": _over("items", "id", lambda: dict(terms=F.array_join(T.query_terms(c("title")), " "))),
    "highlight": _over("items", "id", lambda: dict(t=T.highlight(c("title"), ["the", "history", "of"]))),
    "needs_recognition": _over("document_pages", "id", lambda: dict(needed=F.coalesce(T.alnum_count(c("text")), F.lit(0)) < 80)),
    "index_tokens": _over("documents", "doc_id", lambda: dict(n=F.size(T.tokens(F.coalesce(c("text"), F.lit("")))), n_distinct=F.size(F.array_distinct(T.tokens(F.coalesce(c("text"), F.lit(""))))))),
    "note_links": lambda spark, d: table(spark, d, "obsidian_notes").select("note_id", "markdown").distinct().select(c("note_id").alias("key"), F.posexplode(T.links(c("markdown"))).alias("pos", "l")).select("key", "pos", "l.embed", "l.target", "l.heading", "l.display"),
}

_mk = lambda x: f"array_to_string(list_transform(string_split(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda w: CASE WHEN regexp_matches(w, '^([0-9]+|[ivxlcdm]+)$') THEN '#' WHEN w = 'strona' THEN 'page' ELSE w END), ' ')"
SQL = {
    "plain_text": _sql("notes", "id", plain=_ws(_unescape(_tags("note_html")))),
    "paragraph_text": _sql("notes", "id", plain=_paragraphs(_unescape(_tags("note_html")))),
    "plain_lines": _sql("document_pages", "id", plain=f"trim(regexp_replace(replace({_unescape('text')}, chr(173), ''), '[ \\t]+', ' ', 'g'))"),
    "clean_text": _sql("document_pages", "id", plain="trim(text)"),
    "norm_key": _sql("items", "id", k=_norm("title")),
    "year_extract": _sql("items", "id", year=_YEAR.format("date_created")),
    "canonical_margin": _sql("clean_document_blocks", "id", k=_mk("text")),
    "join_lines": _sql("document_pages", "id", line=_ws("regexp_replace(text, '(\\p{L})[-\\x{00ad}]\\s*\\n\\s*(\\p{Ll})', '\\1\\2', 'g')")),
    "exact_repetition": _sql("documents", "doc_id", t="CASE WHEN len(w) >= 4 AND len(w) % 2 = 0 AND w[1:len(w) // 2] = w[len(w) // 2 + 1:] THEN array_to_string(w[1:len(w) // 2], ' ') ELSE text END").replace("FROM documents", "FROM (SELECT *, regexp_split_to_array(trim(text, E' '), '\\s+') AS w FROM documents)"),
    "sentence_end": _sql("clean_document_blocks", "id", ends=f"regexp_matches(text, {_end})"),
    "page_number_lines": _sql("clean_document_blocks", "id", is_number="regexp_matches(lower(trim(text)), '^(page\\s+)?([ivxlcdm]+|[0-9]+)$')"),
    "heading_flags": _sql("clean_document_blocks", "id", heading=f"(regexp_matches(lower(trim(text)), '^(abstract|introduction|conclusions?|references|bibliography|contents|chapter|part|annex|appendix|summary|wstęp|rozdział|spis)\\b') OR regexp_matches(trim(text), '^([0-9]+(\\.[0-9]+)*\\.?|[IVXLC]+\\.)\\s+\\p{{Lu}}')) AND length(trim(text)) <= 120 AND {_words('text')} <= 16 AND NOT regexp_matches(trim(text), {_end})", caps=f"trim(text) = upper(trim(text)) AND regexp_matches(trim(text), '\\p{{Lu}}{{2}}') AND length(trim(text)) <= 120 AND {_words('text')} <= 14 AND NOT regexp_matches(trim(text), {_end})"),
    "compact_text": _sql("clean_document_blocks", "id", k="regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g')"),
    "locator_text": _sql("clean_document_blocks", "id", k="trim(lower(regexp_replace(regexp_replace(replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), chr(173), ''), '([\\p{L}\\p{N}_])-\\s+([\\p{L}\\p{N}_])', '\\1\\2', 'g'), '[^\\p{L}\\p{N}_]+', ' ', 'g')))"),
    "bad_title": _sql("notes", "id", bad=f"coalesce(t = '' OR regexp_matches(t, '{T.GENERIC_TITLE}') OR lower(t) LIKE '%.pdf', true)").replace("FROM notes", "FROM (SELECT *, trim(regexp_replace(regexp_replace(title, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ._-') AS t FROM notes)"),
    "publication_date": _sql("items", "id", d=f"CASE WHEN {_part(1)} <> '' THEN {_part(1)} || '-' || lpad({_part(2)}, 2, '0') || '-' || lpad({_part(3)}, 2, '0') WHEN {_YEAR.format('date_created')} <> '' THEN {_YEAR.format('date_created')} ELSE date_created END"),
    "position_page": _sql("semantic_chunks", "id", page_number="try_cast(nullif(regexp_extract(page, '([0-9]+)', 1), '') AS INTEGER)"),
    "markdown_plain": _sql("obsidian_sections", "section_id", plain=_markdown("markdown")),
    "note_title": _sql("obsidian_notes", "note_id", title="coalesce(title, nullif(trim(regexp_extract(markdown, '(?m)^#[ \\t]+([^\\r\\n]+)', 1)), ''), regexp_replace(filename, '\\.[^.]*$', ''))"),
    "metadata_text": _sql("items", "id", t=_ws(_unescape(_tags("array_to_string(list_filter([title, names, item_type, " + ", ".join(f"json_extract_string(metadata_json, '$.{x}')" for x in FIELDS) + "], lambda x: x <> ''), '. ')")))).replace("FROM items", "FROM (SELECT *, array_to_string(list_transform(from_json(creators_json, '[{\"firstName\":\"VARCHAR\",\"lastName\":\"VARCHAR\"}]'), lambda p: array_to_string(list_filter([p.firstName, p.lastName], lambda x: x <> ''), ' ')), ', ') AS names FROM items)"),
    "content_hashes": _sql("documents", "doc_id", sha="sha256(text)", sha1="sha1(text)"),
    "section_ids": _sql("obsidian_sections", "section_id", made="sha1(concat_ws(chr(0), note_id, ordinal::VARCHAR, heading))"),
    "model_token": _sql("semantic_chunks", "model", token="substr(trim(regexp_replace(lower(model), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48) || '-' || substr(sha256(model), 1, 12)"),
    "needs_recognition": _sql("document_pages", "id", needed="coalesce(length(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')), 0) < 80"),
    "index_tokens": _sql("documents", "doc_id", n=f"len({_TOKENS(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')})::INTEGER", n_distinct=f"len(list_distinct({_TOKENS(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}))::INTEGER"),
}

_once = lambda xs, key: f"list_filter({xs}, lambda v, i: list_position(list_transform({xs}, lambda z: {key.format('z')}), {key.format('v')}) = i)"
_PEOPLE = "SELECT DISTINCT id, CASE WHEN len(a) > 0 THEN a ELSE p END AS p FROM (SELECT id, p, list_filter(p, lambda x: x.creatorType IN ('author', 'bookAuthor')) AS a FROM (SELECT id, from_json(creators_json, '[{\"creatorType\":\"VARCHAR\",\"firstName\":\"VARCHAR\",\"lastName\":\"VARCHAR\"}]') AS p FROM items))"
_NAMES = f"SELECT id, list_filter(list_transform(p, lambda x: trim(concat_ws(' ', x.firstName, x.lastName), ' ')), lambda n: n <> '') AS n FROM ({_PEOPLE})"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TERMS = f"SELECT id, list_filter(regexp_extract_all(replace(lower(title), 'ς', 'σ'), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS w FROM (SELECT DISTINCT id, title FROM items)"


def _language(code: str) -> str:
    votes = {k: f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in v)})))" for k, v in T.LANGUAGE_WORDS.items()}
    signs = " ".join(f"WHEN regexp_matches(t, '{sign}') THEN '{name}'" for name, sign in T.LANGUAGE_SIGNS)
    vote = " ".join(f"WHEN {v} >= 3 AND {v} >= greatest({', '.join(x for n, x in votes.items() if n != k)}) + 2 THEN '{k}'" for k, v in votes.items())
    codes = "CASE " + " ".join(f"WHEN c = '{a}' THEN '{b}'" for a, b in T.LANGUAGE_CODES.items()) + " END"
    return f"SELECT DISTINCT doc_id AS key, coalesce({codes}, CASE {signs} {vote} END) AS language FROM (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), '\\p{{L}}+') AS w, list_filter(regexp_extract_all(lower({code}), '[a-z]+'), lambda x: x IN ({', '.join(repr(x) for x in T.LANGUAGE_CODES)}))[1] AS c FROM documents)"


SQL |= {
    "creator_names": f"SELECT id AS key, array_to_string({_once('n', 'lower({})')}, '; ') AS names FROM ({_NAMES})",
    "query_terms": f"SELECT id AS key, array_to_string(({_once('w', '{}')})[1:10], ' ') AS terms FROM ({_TERMS})",
    "language_vote": _language("lang"),
    "language_of_text": _language("NULL::VARCHAR"),
}
_LINK = T.LINK.replace("'", "''")
_TAG = r"(?:^|[^\p{L}\p{N}_/#&])#(\p{L}[\p{L}\p{N}_/-]*)"
_BARE = "regexp_replace(regexp_replace(markdown, '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g')"
SQL |= {
    "inline_tags": f"SELECT DISTINCT note_id AS key, array_to_string({_once('t', '{}')}, ',') AS tags FROM (SELECT note_id, regexp_extract_all({_BARE}, '{_TAG}', 1) AS t FROM obsidian_notes)",
    "note_links": "SELECT key, pos, embed, target, heading, display FROM (SELECT key, generate_subscripts(g1, 1)::INTEGER - 1 AS pos, unnest(g1) = '!' AS embed, trim(unnest(g2), ' ') AS target, coalesce(trim(unnest(g3), ' '), '') AS heading, coalesce(trim(unnest(g4), ' '), '') AS display FROM (SELECT note_id AS key, " + ", ".join(f"regexp_extract_all(markdown, '{_LINK}', {i}) AS g{i}" for i in (1, 2, 3, 4)) + " FROM (SELECT DISTINCT note_id, markdown FROM obsidian_notes)))",
}
_SNIP = "replace(replace(replace(note_html, 'b>', 'mark>'), '<mark>', chr(1)), '</mark>', chr(2))"
SQL |= {
    "entity_unescape_all": _sql("notes", "id", plain=_unescape("note_html")),
    "safe_snippet": _sql("notes", "id", snippet=f"replace(replace(replace(replace(replace(regexp_replace({_SNIP}, '<[^>]*>', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(1), '<mark>'), chr(2), '</mark>')"),
}
