"""Joins, filters, aggregates, windows and set operations of the library as declarative plans.

Each plan is one SQL text over named tables; Catalyst picks joins and pushes filters and columns down. {name} is a table, its repeated rows removed where
the plan says {name:distinct}. Nested values come from small views that are written for each engine (VIEWS).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..session import table

#: name -> (DataFrame maker, SQL of the same view)
VIEWS = {
    "membership": (
        lambda s, d: table(s, d, "items").select(F.col("id").alias("item_id"), F.explode(F.from_json("collections_json", "array<bigint>")).alias("collection_id")).distinct(),
        "SELECT DISTINCT id AS item_id, unnest(from_json(collections_json, '[\"BIGINT\"]')) AS collection_id FROM items",
    ),
    "tags": (
        lambda s, d: table(s, d, "items").select(F.col("id").alias("item_id"), F.posexplode(F.from_json("tags_json", "array<string>")).alias("pos", "tag")).distinct(),
        "SELECT DISTINCT id AS item_id, (generate_subscripts(t, 1) - 1)::INTEGER AS pos, unnest(t) AS tag FROM (SELECT id, from_json(tags_json, '[\"VARCHAR\"]') AS t FROM items)",
    ),
    "creators": (
        lambda s, d: table(s, d, "items").select(F.col("id").alias("item_id"), F.posexplode(F.from_json("creators_json", T.CREATORS)).alias("pos", "c")).select("item_id", "pos", F.col("c.firstName").alias("first_name"), F.col("c.lastName").alias("last_name"), F.col("c.creatorType").alias("kind")).distinct(),
        "SELECT DISTINCT id AS item_id, (generate_subscripts(c, 1) - 1)::INTEGER AS pos, unnest(c).firstName AS first_name, unnest(c).lastName AS last_name, unnest(c).creatorType AS kind FROM (SELECT id, from_json(creators_json, '[{\"creatorType\":\"VARCHAR\",\"firstName\":\"VARCHAR\",\"lastName\":\"VARCHAR\"}]') AS c FROM items)",
    ),
    "fields": (
        lambda s, d: table(s, d, "item_sources").select("item_id", "source_item_id", "annotation_count", "date_added", F.explode(F.from_json("metadata_json", "map<string,string>")).alias("field", "value")).distinct(),
        "SELECT DISTINCT item_id, source_item_id, annotation_count, date_added, k AS field, json_extract_string(metadata_json, '$.\"' || k || '\"') AS value FROM (SELECT *, unnest(json_keys(metadata_json)) AS k FROM item_sources WHERE metadata_json IS NOT NULL)",
    ),
    "folders": (
        lambda s, d: table(s, d, "obsidian_notes").select("note_id", F.split("folder", "/").alias("p")).distinct().select("note_id", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i")).select("note_id", F.array_join(F.slice("p", F.lit(1), F.col("i")), "/").alias("folder"), F.col("i").alias("level")),
        "SELECT note_id, array_to_string(p[1:i], '/') AS folder, i::INTEGER AS level FROM (SELECT DISTINCT note_id, string_split(folder, '/') AS p, unnest(range(1, len(string_split(folder, '/')) + 1)) AS i FROM obsidian_notes)",
    ),
    "lines": (
        lambda s, d: table(s, d, "document_pages").filter("text IS NOT NULL").select("id", "attachment_id", "page_number", F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n").alias("l")).distinct().select("id", "attachment_id", "page_number", F.filter("l", lambda x: F.trim(x) != "").alias("l")).select("id", "attachment_id", "page_number", F.size("l").alias("n"), F.posexplode("l").alias("pos", "line")),
        "SELECT id, attachment_id, page_number, len(l)::INTEGER AS n, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS line FROM (SELECT DISTINCT id, attachment_id, page_number, list_filter(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM document_pages WHERE text IS NOT NULL)",
    ),
    "newest_source": (
        lambda s, d: table(s, d, "item_sources").groupBy("item_id", "source_item_id").agg(F.max_by(F.struct("annotation_count", "date_added", "metadata_json"), "loaded_at").alias("r")).select("item_id", "source_item_id", "r.*"),
        "SELECT item_id, source_item_id, arg_max(r, loaded_at).a AS annotation_count, arg_max(r, loaded_at).d AS date_added, arg_max(r, loaded_at).m AS metadata_json FROM (SELECT *, {'a': annotation_count, 'd': date_added, 'm': metadata_json} AS r FROM item_sources) GROUP BY item_id, source_item_id",
    ),
}
#: The fuzzy date interval of a text: first and last possible day, null if no year from 1800 to 2199 is in it.
_Y, _M, _D = (f"regexp_extract(date_created, '(1[89][0-9][0-9]|2[01][0-9][0-9])(?:[-/. ]+([0-9]{{1,2}}))?(?:[-/. ]+([0-9]{{1,2}}))?', {i})" for i in (1, 2, 3))
_LAST = "CASE WHEN m = '' THEN '31' WHEN m = '02' THEN '29' WHEN m IN ('04','06','09','11') THEN '30' ELSE '31' END"
_DATES = f"""SELECT id, concat(y, '-', CASE WHEN m = '' THEN '01' ELSE m END, '-', CASE WHEN d = '' THEN '01' ELSE d END) AS lo,
  concat(y, '-', CASE WHEN m = '' THEN '12' ELSE m END, '-', CASE WHEN d = '' THEN {_LAST} ELSE d END) AS hi FROM (
  SELECT id, y, m, CASE WHEN m <> '' AND try_cast(d AS INT) BETWEEN 1 AND 31 THEN lpad(d, 2, '0') ELSE '' END AS d FROM (
    SELECT id, y, CASE WHEN try_cast(m AS INT) BETWEEN 1 AND 12 THEN lpad(m, 2, '0') ELSE '' END AS m, d FROM (
      SELECT DISTINCT id, {_Y} AS y, {_M} AS m, {_D} AS d FROM {{items}}) x WHERE y <> '') i) k"""
_LIVE = "(SELECT note_id, max(imported_at) AS imported_at FROM {obsidian_notes} GROUP BY note_id)"
_MARGIN = "lower(regexp_replace(line, '[^a-zA-ZÀ-žα-ωА-я]+', '', 'g'))"

_PAGES = "(SELECT attachment_id, count(DISTINCT page_number) AS total FROM {document_pages} GROUP BY attachment_id)"
#: At least three, or 18 % of the pages, halves rounded to even.
_SHARE = "greatest(3, CASE WHEN total * 18 % 100 = 50 THEN floor(total * 0.18) + floor(total * 0.18) % 2 ELSE floor(total * 0.18 + 0.5) END)"
#: Blocks with their compact text, the next block of the attachment, and the pairs and headings whose text stands in a longer paragraph within two pages. Pages are blocked by three, so a block meets
#: the paragraphs of its own and the neighbouring page groups only.
_CONTAINED = """WITH k AS (SELECT id, attachment_id, page_start, block_type, length(text) AS n, lower(regexp_replace(text, '[^\\\\p{{L}}\\\\p{{N}}_]+', '', 'g')) AS k, row_number() OVER (PARTITION BY attachment_id ORDER BY ordinal, id) AS place FROM (SELECT DISTINCT id, attachment_id, page_start, block_type, text, ordinal FROM {clean_document_blocks} WHERE text IS NOT NULL AND page_start IS NOT NULL) b),
    long AS (SELECT id, attachment_id, page_start, place, k, CAST(floor(page_start / 3) AS INT) AS g FROM k WHERE block_type = 'paragraph'), near AS (SELECT -1 AS o UNION ALL SELECT 0 UNION ALL SELECT 1),
    short AS (SELECT id, attachment_id, page_start, place, k, CAST(floor(page_start / 3) AS INT) + o AS g FROM k CROSS JOIN near WHERE block_type = 'paragraph' AND n BETWEEN 35 AND 320 AND length(k) >= 28),
    pairs AS (SELECT a.id, b.id AS outer_id FROM short a JOIN long b ON a.attachment_id = b.attachment_id AND a.g = b.g WHERE a.id <> b.id AND abs(a.page_start - b.page_start) <= 2 AND length(b.k) >= 1.35 * length(a.k) AND position(a.k IN b.k) > 0),
    head AS (SELECT h.id, p.id AS next_id, h.attachment_id, h.page_start, h.place, concat(h.k, p.k) AS k, CAST(floor(h.page_start / 3) AS INT) + o AS g FROM k h JOIN k p ON p.attachment_id = h.attachment_id AND p.place = h.place + 1 CROSS JOIN near WHERE h.block_type = 'heading' AND p.block_type = 'paragraph' AND p.page_start = h.page_start AND length(concat(h.k, p.k)) BETWEEN 35 AND 360),
    heads AS (SELECT DISTINCT a.id, a.next_id FROM head a JOIN long b ON a.attachment_id = b.attachment_id AND a.g = b.g WHERE b.id <> a.next_id AND abs(a.page_start - b.page_start) <= 2 AND length(b.k) >= 1.2 * length(a.k) AND position(a.k IN b.k) > 0) """

PLANS = {
    # joins
    "block_context": "SELECT b.id, b.block_type, p.char_count, i.title AS item_title FROM {clean_document_blocks:distinct} b JOIN {document_pages:distinct} p ON p.attachment_id = b.attachment_id AND p.page_number = b.page_start JOIN {items:distinct} i ON i.id = b.item_id",
    "notes_items_left": "SELECT n.id, coalesce(i.title, n.title) AS title, i.id AS item_id FROM {notes:distinct} n LEFT JOIN {items:distinct} i ON i.id = n.item_id",
    "deleted_anti": f"SELECT n.note_id, n.title FROM {{obsidian_notes:distinct}} n JOIN {_LIVE} l ON l.note_id = n.note_id AND l.imported_at = n.imported_at WHERE NOT EXISTS (SELECT 1 FROM {{obsidian_notes}} x WHERE x.note_id = n.note_id AND x.removed_at IS NOT NULL)",
    "attachments_with_pages": "SELECT DISTINCT b.attachment_id FROM {clean_document_blocks} b WHERE EXISTS (SELECT 1 FROM {document_pages} p WHERE p.attachment_id = b.attachment_id)",
    "pages_without_blocks": "SELECT DISTINCT p.id, p.attachment_id FROM {document_pages} p WHERE NOT EXISTS (SELECT 1 FROM {clean_document_blocks} b WHERE b.attachment_id = p.attachment_id)",
    "unfiled_anti": "SELECT DISTINCT i.id FROM {items} i WHERE NOT EXISTS (SELECT 1 FROM {membership} m WHERE m.item_id = i.id)",
    "search_eligibility": "SELECT attachment_id, item_id, is_cache, CASE WHEN NOT is_cache THEN true ELSE NOT has_ok AND rn = 1 END AS eligible FROM (SELECT a.*, coalesce(max(CASE WHEN NOT is_cache AND pages > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id), 0) = 1 AS has_ok, row_number() OVER (PARTITION BY item_id, is_cache ORDER BY chars DESC, attachment_id) AS rn FROM (SELECT attachment_id, item_id, source = 'pdf-text' AS is_cache, count(DISTINCT page_start) AS pages, sum(char_count) AS chars FROM {clean_document_blocks:distinct} GROUP BY attachment_id, item_id, source = 'pdf-text') a) b",
    "closure_counts": "SELECT c.collection_id, count(DISTINCT m.item_id) AS n_items FROM {zotero_collections:distinct} c LEFT JOIN {collection_descendants:distinct} d ON d.ancestor_id = c.collection_id LEFT JOIN {membership} m ON m.collection_id = d.descendant_id GROUP BY c.collection_id",
    "source_mapping": "SELECT DISTINCT s.source_item_id, s.item_id, i.title FROM {item_sources} s LEFT JOIN {items:distinct} i ON i.id = s.item_id",
    "hit_enrichment": "SELECT h.attachment_id, h.id, i.title, i.date_created FROM (SELECT * FROM {document_pages:distinct} WHERE char_count IS NOT NULL ORDER BY char_count DESC, id LIMIT 50) h LEFT JOIN {items:distinct} i ON i.id = h.item_id",
    "nearest_page_block": "SELECT page_id, block_id FROM (SELECT p.id AS page_id, b.id AS block_id, row_number() OVER (PARTITION BY p.id ORDER BY CASE WHEN p.page_number BETWEEN b.page_start AND b.page_end THEN 0 ELSE 1 END, abs(b.page_start - p.page_number), b.id) AS rn FROM {document_pages:distinct} p JOIN {clean_document_blocks:distinct} b ON b.attachment_id = p.attachment_id) x WHERE rn = 1",
    "page_text_choice": "SELECT p.id, CASE WHEN p.text IS NOT NULL AND p.text <> b.text AND length(p.text) > length(b.text) THEN 'page' ELSE 'block' END AS taken FROM {document_pages:distinct} p JOIN (SELECT attachment_id, page_start, max(text) AS text FROM {clean_document_blocks} GROUP BY attachment_id, page_start) b ON b.attachment_id = p.attachment_id AND b.page_start = p.page_number",
    "containment_selfjoin": _CONTAINED + "SELECT DISTINCT id AS inner_id, outer_id FROM pairs",
    "asset_resolve": """WITH t AS (SELECT DISTINCT id, note_id, replace(trim(target), chr(92), '/') AS t FROM {obsidian_links} WHERE trim(target) <> ''),
    r AS (SELECT t.id, regexp_replace(t.t, '^([.]/|/)+', '', 'g') AS target, n.folder FROM t LEFT JOIN (SELECT note_id, max(folder) AS folder FROM {obsidian_notes} GROUP BY note_id) n ON n.note_id = t.note_id),
    a AS (SELECT lower(relative_path) AS k, min(relative_path) AS path FROM {obsidian_assets} GROUP BY lower(relative_path)), f AS (SELECT lower(filename) AS k, count(*) AS n, min(relative_path) AS path FROM {obsidian_assets} GROUP BY lower(filename))
    SELECT r.id AS link_id, CASE WHEN c.path IS NOT NULL THEN c.path WHEN p.path IS NOT NULL THEN p.path WHEN f.n = 1 THEN f.path END AS path, CASE WHEN c.path IS NOT NULL OR p.path IS NOT NULL THEN 'exact' WHEN f.n = 1 THEN 'filename' WHEN f.n > 1 THEN 'ambiguous' ELSE 'missing' END AS status
    FROM r LEFT JOIN a c ON c.k = CASE WHEN r.folder <> '' THEN lower(concat(r.folder, '/', r.target)) END LEFT JOIN a p ON p.k = lower(r.target) LEFT JOIN f ON f.k = lower(substring_index(r.target, '/', -1))""",
    "author_match": "SELECT DISTINCT c.item_id FROM {creators} c JOIN (SELECT min(last_name) AS wanted FROM {creators}) w ON lower(c.last_name) = lower(w.wanted)",
    "run_compare": "SELECT v.chunks, v.newest, c.blocks, c.model_rows, v.chunks > 0 AND v.newest IS NOT NULL AND c.blocks > 0 AND v.models = c.model_rows AS ready FROM (SELECT count(DISTINCT id) AS chunks, max(updated_at) AS newest, count(DISTINCT model) AS models FROM {semantic_chunks}) v CROSS JOIN (SELECT (SELECT count(DISTINCT id) FROM {clean_document_blocks}) AS blocks, (SELECT count(DISTINCT concat(model, dimensions)) FROM {semantic_chunks}) AS model_rows) c",
    # filters
    "scope_filter": "SELECT s.scope, c.id, c.kind FROM (SELECT DISTINCT id, kind FROM {semantic_chunks}) c JOIN (SELECT 'documents' AS scope, 'document' AS k UNION ALL SELECT 'documents', 'footnote' UNION ALL SELECT 'documents', 'table' UNION ALL SELECT 'annotations', 'annotation' UNION ALL SELECT 'annotations', 'embedded_annotation' UNION ALL SELECT 'metadata', 'metadata' UNION ALL SELECT 'notes', 'note' UNION ALL SELECT 'obsidian', 'obsidian' UNION ALL SELECT 'all', NULL) s ON s.scope = 'all' OR s.k = c.kind",
    "collection_subtree": "SELECT DISTINCT d.ancestor_id, m.item_id FROM {membership} m JOIN {collection_descendants} d ON d.descendant_id = m.collection_id",
    "collections_or_unfiled": "SELECT DISTINCT m.collection_id, m.item_id FROM {membership} m UNION SELECT NULL AS collection_id, i.id AS item_id FROM {items} i WHERE NOT EXISTS (SELECT 1 FROM {membership} m WHERE m.item_id = i.id)",
    "date_interval": _DATES,
    "date_overlap_filter": f"SELECT id FROM ({_DATES}) r WHERE hi >= '1950-01-01' AND lo <= '1979-12-31'",
    "folder_filter": "SELECT DISTINCT note_id FROM {obsidian_notes} WHERE folder IN ('Inbox', 'Archiwum')",
    "item_drilldown": "SELECT id, item_id, attachment_id, page_number, row_number() OVER (PARTITION BY item_id ORDER BY id) AS place FROM (SELECT DISTINCT id, item_id, attachment_id, page_number FROM {document_pages} WHERE item_id IS NOT NULL) d",
    "non_blank": "SELECT DISTINCT id FROM {notes} WHERE length(trim(concat(coalesce(title, ''), ' ', coalesce(note_html, '')))) > 0",
    "generated_notes": "SELECT DISTINCT id, CASE WHEN note_html LIKE '%data-annotation%' THEN 'annotation_note' ELSE 'note' END AS kind FROM {notes}",
    "pdf_predicate": "SELECT relative_path FROM {obsidian_assets} WHERE content_type = 'application/pdf' OR lower(relative_path) LIKE '%.pdf'",
    # aggregates
    "item_counts_view": "SELECT i.id, coalesce(s.n, 0) AS sources, coalesce(n.n, 0) AS notes, coalesce(p.n, 0) AS pages FROM {items:distinct} i LEFT JOIN (SELECT item_id, count(DISTINCT source_item_id) AS n FROM {item_sources} GROUP BY item_id) s ON s.item_id = i.id LEFT JOIN (SELECT item_id, count(DISTINCT id) AS n FROM {notes} GROUP BY item_id) n ON n.item_id = i.id LEFT JOIN (SELECT item_id, count(DISTINCT id) AS n FROM {document_pages} GROUP BY item_id) p ON p.item_id = i.id",
    "library_stats": "SELECT (SELECT count(DISTINCT id) FROM {items}) AS items, (SELECT count(DISTINCT attachment_id) FROM {document_pages}) AS attachments, (SELECT count(DISTINCT id) FROM {document_pages}) AS pages, (SELECT count(DISTINCT id) FROM {notes}) AS notes, (SELECT count(DISTINCT note_id) FROM {obsidian_notes}) AS vault_notes",
    "folder_counts": "SELECT folder, count(DISTINCT note_id) AS n FROM {folders} GROUP BY folder",
    "repeated_margins": f"SELECT attachment_id, k, count(DISTINCT page_number) AS pages FROM (SELECT l.attachment_id, page_number, {_MARGIN} AS k, t.total FROM {{lines}} l JOIN {_PAGES} t ON t.attachment_id = l.attachment_id WHERE pos = 0 OR pos = n - 1) x WHERE length(k) >= 5 GROUP BY attachment_id, k, total HAVING count(DISTINCT page_number) >= CASE WHEN total <= 40 THEN 2 ELSE 3 END",
    "repeated_lines": f"SELECT l.attachment_id, line, count(*) AS n FROM {{lines}} l JOIN {_PAGES} t ON t.attachment_id = l.attachment_id WHERE pos < 2 OR pos >= n - 2 GROUP BY l.attachment_id, line, total HAVING count(*) >= {_SHARE}",
    "weighted_median": "SELECT attachment_id, min(v) AS median_size FROM (SELECT attachment_id, v, sum(w) OVER (PARTITION BY attachment_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(w) OVER (PARTITION BY attachment_id) AS total FROM (SELECT attachment_id, length(block_type) AS v, sum(char_count) AS w FROM {clean_document_blocks:distinct} WHERE char_count >= 35 AND block_type IS NOT NULL GROUP BY attachment_id, length(block_type)) a) b WHERE run * 2 >= total GROUP BY attachment_id",
    "attachment_rollup": "SELECT attachment_id, count(*) AS blocks, CAST(sum(CASE WHEN block_type = 'paragraph' THEN 1 ELSE 0 END) AS BIGINT) AS paragraphs, CAST(sum(CASE WHEN block_type = 'heading' THEN 1 ELSE 0 END) AS BIGINT) AS headings, CAST(sum(char_count) AS BIGINT) AS chars FROM {clean_document_blocks:distinct} GROUP BY attachment_id",
    "status_counts": "SELECT coalesce(source, '') AS source, count(*) AS n, CAST(sum(coalesce(char_count, 0)) AS BIGINT) AS chars FROM {clean_document_blocks:distinct} GROUP BY coalesce(source, '')",
    "chunk_plan": "SELECT kind, model, count(DISTINCT id) AS n FROM {semantic_chunks} GROUP BY kind, model",
    "max_page": "SELECT attachment_id, max(page_number) AS last_page FROM {document_pages} GROUP BY attachment_id",
    "distinct_sources": "SELECT item_id, count(DISTINCT source_item_id) AS n_sources, count(DISTINCT source_key) AS n_keys FROM {item_sources} GROUP BY item_id",
    "publication_groups": "SELECT coalesce(CAST(item_id AS VARCHAR(20)), chunk_key) AS publication, count(DISTINCT id) AS hits, min(id) AS best FROM {semantic_chunks} GROUP BY coalesce(CAST(item_id AS VARCHAR(20)), chunk_key)",
    # entity resolution
    "entity_canonical": "SELECT item_id, source_item_id FROM (SELECT item_id, source_item_id, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(annotation_count, 0) DESC, CASE WHEN date_added IS NULL THEN 1 ELSE 0 END, date_added, source_item_id) AS rn FROM {newest_source}) x WHERE rn = 1",
    "metadata_fill": "SELECT f.item_id, f.field, min(f.value) AS value FROM (SELECT f.*, row_number() OVER (PARTITION BY f.item_id, f.field ORDER BY CASE WHEN f.source_item_id = c.source_item_id THEN 0 ELSE 1 END, CASE WHEN f.date_added IS NULL THEN 1 ELSE 0 END, f.date_added, f.source_item_id, f.value) AS rn FROM {fields} f JOIN (SELECT item_id, source_item_id FROM (SELECT item_id, source_item_id, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(annotation_count, 0) DESC, CASE WHEN date_added IS NULL THEN 1 ELSE 0 END, date_added, source_item_id) AS rn FROM {newest_source}) n WHERE rn = 1) c ON c.item_id = f.item_id WHERE f.value IS NOT NULL AND f.value <> '') f WHERE rn = 1 GROUP BY f.item_id, f.field",
    "creators_pick": "SELECT item_id, last_name FROM (SELECT c.item_id, c.last_name, row_number() OVER (PARTITION BY c.item_id ORDER BY CASE WHEN coalesce(c.last_name, '') = '' THEN 1 ELSE 0 END, c.pos, c.last_name) AS rn FROM {creators} c) x WHERE rn = 1",
    "tag_union": "SELECT tag, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item FROM {tags} GROUP BY tag",
    "attachment_dedupe": "SELECT item_id, k, min(id) AS first_id, count(DISTINCT id) AS n FROM (SELECT id, item_id, coalesce(sha2(text, 256), CAST(id AS VARCHAR(20))) AS k FROM {document_pages} WHERE item_id IS NOT NULL) x GROUP BY item_id, k",
    "annotation_merge": "SELECT id, kind, label FROM (SELECT id, kind, label, row_number() OVER (PARTITION BY kind, label, h, page ORDER BY attachment_id, id) AS rn FROM (SELECT DISTINCT id, kind, label, page, attachment_id, sha2(text, 256) AS h FROM {semantic_chunks} WHERE kind IN ('annotation', 'embedded_annotation')) d) x WHERE rn = 1",
    "run_statistics": "SELECT count(*) AS records, count(DISTINCT item_id) AS unified, count(*) - count(DISTINCT item_id) AS removed, CAST(sum(coalesce(annotation_count, 0)) AS BIGINT) AS annotations FROM {newest_source}",
    # windows
    "section_carry_forward": "SELECT id, coalesce(max(h) OVER (PARTITION BY attachment_id, g), '') AS section FROM (SELECT *, CASE WHEN block_type = 'heading' THEN text END AS h, sum(CASE WHEN block_type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY attachment_id ORDER BY ordinal, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {clean_document_blocks:distinct}) x",
    "section_boundaries": "SELECT section_id, start_line, lead(start_line) OVER (PARTITION BY note_id ORDER BY ordinal, section_id) AS next_start FROM {obsidian_sections:distinct}",
    "contents_propagation": "SELECT id, c = 1 OR (t = 1 AND (coalesce(l1, 0) = 1 OR (coalesce(t1, 0) = 1 AND coalesce(l2, 0) = 1) OR (coalesce(t1, 0) = 1 AND coalesce(t2, 0) = 1 AND coalesce(l3, 0) = 1))) AS is_contents FROM (SELECT id, c, t, lag(c, 1) OVER w AS l1, lag(c, 2) OVER w AS l2, lag(c, 3) OVER w AS l3, lag(t, 1) OVER w AS t1, lag(t, 2) OVER w AS t2 FROM (SELECT id, attachment_id, page_number, CASE WHEN lower(coalesce(text, '')) LIKE '%contents%' THEN 1 ELSE 0 END AS c, CASE WHEN coalesce(text, '') LIKE '%....%' THEN 1 ELSE 0 END AS t FROM {document_pages:distinct}) p WINDOW w AS (PARTITION BY attachment_id ORDER BY page_number, id)) x",
    "history_retention": "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT * FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 100) r) x WHERE rn <= 100",
    "newest_per_owner": "SELECT note_id, id FROM (SELECT note_id, id, row_number() OVER (PARTITION BY note_id ORDER BY imported_at DESC, id DESC) AS rn FROM {obsidian_links:distinct} WHERE imported_at IS NOT NULL) x WHERE rn <= 2",
    # sorts and top-k
    "sorted_page": "SELECT id, title FROM {items:distinct} WHERE title IS NOT NULL ORDER BY lower(title), id LIMIT 40 OFFSET 40",
    "page_window": "SELECT p.attachment_id, p.page_number, count(b.id) AS blocks FROM (SELECT DISTINCT attachment_id, page_number FROM {document_pages}) p LEFT JOIN (SELECT DISTINCT id, attachment_id, page_start FROM {clean_document_blocks}) b ON b.attachment_id = p.attachment_id AND b.page_start = p.page_number GROUP BY p.attachment_id, p.page_number",
    "preferred_attachment": "SELECT item_id, attachment_id FROM (SELECT item_id, attachment_id, layout, max(layout) OVER (PARTITION BY item_id) AS has_layout, row_number() OVER (PARTITION BY item_id ORDER BY chars DESC, blocks DESC, attachment_id) AS rn FROM (SELECT item_id, attachment_id, min(CASE WHEN source = 'pdf-layout' THEN 1 ELSE 0 END) AS layout, sum(char_count) AS chars, count(*) AS blocks FROM {clean_document_blocks:distinct} WHERE item_id IS NOT NULL GROUP BY item_id, attachment_id) a) x WHERE layout = 1 OR has_layout = 0 AND rn = 1",
    # sets
    "result_streams": "SELECT 'item' AS kind, CAST(id AS VARCHAR(40)) AS k, title FROM {items:distinct} UNION ALL SELECT 'note', CAST(id AS VARCHAR(40)), title FROM {notes:distinct} UNION ALL SELECT 'vault', note_id, title FROM {obsidian_notes:distinct} UNION ALL SELECT 'page', CAST(id AS VARCHAR(40)), NULL FROM (SELECT DISTINCT id FROM {document_pages}) p UNION ALL SELECT kind, CAST(id AS VARCHAR(40)), title FROM (SELECT DISTINCT id, kind, title FROM {semantic_chunks} WHERE kind IN ('annotation', 'embedded_annotation')) c",
    "key_difference": "SELECT DISTINCT attachment_id FROM {document_pages} EXCEPT SELECT DISTINCT attachment_id FROM {clean_document_blocks}",
    "distinct_closure": "SELECT DISTINCT ancestor_id, descendant_id FROM {collection_descendants}",
    "stale_chunk_purge": "SELECT DISTINCT c.id FROM {semantic_chunks} c WHERE EXISTS (SELECT 1 FROM {items} i WHERE i.id = c.item_id)",
    # incremental
    "foreign_key_check": "SELECT 'item_sources.item_id' AS reference, (SELECT count(*) FROM {item_sources:distinct} s WHERE NOT EXISTS (SELECT 1 FROM {items} i WHERE i.id = s.item_id)) AS broken UNION ALL SELECT 'document_pages.item_id', (SELECT count(*) FROM {document_pages:distinct} s WHERE s.item_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {items} i WHERE i.id = s.item_id)) UNION ALL SELECT 'obsidian_sections.note_id', (SELECT count(*) FROM {obsidian_sections:distinct} s WHERE NOT EXISTS (SELECT 1 FROM {obsidian_notes} n WHERE n.note_id = s.note_id)) UNION ALL SELECT 'collection_descendants.descendant_id', (SELECT count(*) FROM {collection_descendants:distinct} s WHERE NOT EXISTS (SELECT 1 FROM {zotero_collections} c WHERE c.collection_id = s.descendant_id))",
    "sync_change_report": "SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' WHEN a.v <> b.v THEN 'modified' ELSE 'unchanged' END AS status FROM (SELECT note_id AS k, min(checksum) AS v FROM {obsidian_notes} WHERE imported_at < TIMESTAMP '2016-01-01 00:00:00' GROUP BY note_id) a FULL JOIN (SELECT note_id AS k, max(checksum) AS v FROM {obsidian_notes} WHERE imported_at >= TIMESTAMP '2014-01-01 00:00:00' GROUP BY note_id) b ON a.k = b.k) x GROUP BY status",
    "checksum_upsert": "SELECT note_id, checksum, 'kept' AS origin FROM (SELECT note_id, min(checksum) AS checksum FROM {obsidian_notes} WHERE imported_at < TIMESTAMP '2016-01-01 00:00:00' GROUP BY note_id) a WHERE NOT EXISTS (SELECT 1 FROM {obsidian_notes} b WHERE b.note_id = a.note_id AND b.imported_at >= TIMESTAMP '2016-01-01 00:00:00') UNION ALL SELECT note_id, max(checksum), 'new' FROM {obsidian_notes} WHERE imported_at >= TIMESTAMP '2016-01-01 00:00:00' GROUP BY note_id",
    "cache_worklist": "SELECT DISTINCT d.attachment_id FROM {document_pages} d LEFT JOIN (SELECT attachment_id, count(DISTINCT page_start) AS pages FROM {clean_document_blocks} GROUP BY attachment_id) c ON c.attachment_id = d.attachment_id LEFT JOIN (SELECT attachment_id, count(DISTINCT page_number) AS pages FROM {document_pages} GROUP BY attachment_id) p ON p.attachment_id = d.attachment_id WHERE c.pages IS NULL OR c.pages <> p.pages",
    "vector_worklist": "SELECT DISTINCT b.id FROM {clean_document_blocks} b WHERE NOT EXISTS (SELECT 1 FROM {semantic_chunks} c WHERE c.attachment_id = b.attachment_id AND c.model = 'veld-embed-base' AND c.content_hash = sha1(b.text))",
    # index rows and lookups
    "item_index_rows": "SELECT i.id, i.title, coalesce(c.authors, '') AS authors FROM {items:distinct} i LEFT JOIN (SELECT item_id, min(trim(concat(coalesce(first_name, ''), ' ', coalesce(last_name, '')))) AS authors FROM {creators} WHERE pos = 0 GROUP BY item_id) c ON c.item_id = i.id",
    "page_index_rows": "SELECT p.id, i.title AS parent_title, i.creators_json AS authors FROM {document_pages:distinct} p JOIN {items:distinct} i ON i.id = p.item_id",
    "block_index_rows": "SELECT DISTINCT id, title, section_title, block_type FROM {clean_document_blocks}",
    "vault_index_rows": "SELECT s.section_id, s.heading, n.relative_path, n.tags_json, n.authors_json FROM {obsidian_sections:distinct} s JOIN (SELECT DISTINCT note_id, relative_path, tags_json, authors_json FROM {obsidian_notes}) n ON n.note_id = s.note_id",
    "raw_page_window": "SELECT id, attachment_id, page_number, page_number < last_page AS has_more FROM (SELECT id, attachment_id, page_number, max(page_number) OVER (PARTITION BY attachment_id) AS last_page FROM (SELECT DISTINCT id, attachment_id, page_number FROM {document_pages} WHERE page_number IS NOT NULL) d) x",
    "clean_status": "SELECT attachment_id, count(DISTINCT id) >= 1 AS clean FROM {clean_document_blocks} GROUP BY attachment_id",
    "vault_context": "SELECT n.note_id, n.title, s.section_id, s.heading FROM {obsidian_notes:distinct} n LEFT JOIN {obsidian_sections:distinct} s ON s.note_id = n.note_id AND s.ordinal = 0",
    "membership_map": "SELECT DISTINCT m.item_id, c.name FROM {membership} m JOIN {zotero_collections:distinct} c ON c.collection_id = m.collection_id",
    # repeated fragments: a short paragraph within a longer one nearby, or a heading and its paragraph together
    "fragments_removed": _CONTAINED + "SELECT id FROM pairs UNION SELECT id FROM heads UNION SELECT next_id AS id FROM heads",
    # annotations and previous runs
    "annotation_place": "SELECT DISTINCT id, attachment_id, coalesce(try_cast(nullif(regexp_extract(page, '([0-9]+)', 1), '') AS INT), 1) AS page FROM {semantic_chunks} WHERE kind IN ('annotation', 'embedded_annotation')",
    "mirror_status": "SELECT status, count(*) AS n FROM (SELECT CASE WHEN b.k IS NULL THEN 'deleted' WHEN a.k IS NULL THEN 'copied' WHEN a.size = b.size AND a.at = b.at THEN 'reused' ELSE 'copied' END AS status FROM (SELECT note_id AS k, max(length(markdown)) AS size, max(modified_at) AS at FROM {obsidian_notes} WHERE imported_at < TIMESTAMP '2016-01-01 00:00:00' GROUP BY note_id) a FULL JOIN (SELECT note_id AS k, max(length(markdown)) AS size, max(modified_at) AS at FROM {obsidian_notes} WHERE imported_at >= TIMESTAMP '2014-01-01 00:00:00' GROUP BY note_id) b ON a.k = b.k) x GROUP BY status",
    "run_report": "SELECT 'items' AS stage, count(DISTINCT id) AS n FROM {items} UNION ALL SELECT 'pages', count(DISTINCT id) FROM {document_pages} UNION ALL SELECT 'blocks', count(DISTINCT id) FROM {clean_document_blocks} UNION ALL SELECT 'chunks', count(DISTINCT id) FROM {semantic_chunks} UNION ALL SELECT 'notes', count(DISTINCT note_id) FROM {obsidian_notes} UNION ALL SELECT 'empty_pages', count(DISTINCT id) FROM {document_pages} WHERE trim(coalesce(text, '')) = ''",
    "model_registry": "SELECT model, min(dimensions) AS dimensions, count(DISTINCT id) AS chunks, max(updated_at) AS completed_at, row_number() OVER (ORDER BY min(id)) AS place FROM {semantic_chunks} WHERE model IS NOT NULL GROUP BY model",
    # block classes by rules in order, the first that matches
    "block_class": "SELECT id, CASE WHEN regexp_like(t, '\\\\.{{4,}}\\\\s*[0-9]+\\\\s*$') THEN 'toc_entry' WHEN regexp_like(t, '^[0-9]+(\\\\s+[0-9]+)+') THEN 'table_row' WHEN regexp_like(lower(t), '^(ibid|op\\\\. cit|[0-9]{{1,3}}\\\\s+(see|cf|vgl|voir|zob))') THEN 'footnote' WHEN regexp_like(t, '^(\\\\(?[a-z0-9]{{1,3}}[.)]|[-*+])\\\\s') THEN 'list_item' WHEN length(t) <= 100 AND NOT regexp_like(t, '[.!?;,]$') THEN 'heading' ELSE 'paragraph' END AS class FROM (SELECT DISTINCT id, trim(text) AS t FROM {clean_document_blocks} WHERE text IS NOT NULL) x",
    "drop_running_lines": f"SELECT l.id, l.pos FROM {{lines}} l WHERE (l.pos < 2 OR l.pos >= l.n - 2) AND EXISTS (SELECT 1 FROM (SELECT a.attachment_id, line FROM {{lines}} a JOIN {_PAGES} t ON t.attachment_id = a.attachment_id WHERE pos < 2 OR pos >= n - 2 GROUP BY a.attachment_id, line, total HAVING count(*) >= {_SHARE}) r WHERE r.attachment_id = l.attachment_id AND r.line = l.line)",
}
NAMES = re.compile(r"\{(\w+)(?::(\w+))?\}")
#: Arrays of vectors can't be compared cheaply; a distinct over these tables leaves them out.
NESTED = {"semantic_chunks": ["embedding"]}


def _unbrace(sql: str) -> str:
    return re.sub(r"\{\{(\d*,?\d*)\}\}", r"{\1}", sql.replace("\\p{{L}}", "\\p{L}").replace("\\p{{N}}", "\\p{N}"))


def run(spark: SparkSession, d: str, name: str) -> DataFrame:
    sql, frames = PLANS[name], {}

    def bind(m: re.Match) -> str:
        t, how = m[1], m[2]
        key = f"{t}_{how or 'all'}"
        df = VIEWS[t][0](spark, d) if t in VIEWS else table(spark, d, t)
        if how == "nested":
            df = df.drop(*NESTED.get(t, [])).distinct()
        frames[key] = df.distinct() if how == "distinct" else df
        return f"\x00{key}\x01"

    text = _unbrace(NAMES.sub(bind, sql.replace("{{", "\x02").replace("}}", "\x03")).replace("\x02", "{{").replace("\x03", "}}"))
    text = re.sub(r"regexp_replace\(([^()]*(?:\([^()]*\)[^()]*)*), ('[^']*'), '', 'g'\)", r"regexp_replace(\1, \2, '')", text)
    text = text.replace("VARCHAR(20)", "STRING").replace("VARCHAR(40)", "STRING")
    views = {k: f"lectern_{k}_{abs(hash((d, k))) % 10**9}" for k in frames}
    for k, df in frames.items():
        df.createOrReplaceTempView(views[k])
    out = spark.sql(re.sub("\x00(\\w+)\x01", lambda m: views[m[1]], text))
    return out


def oracle(name: str) -> str:
    sql = PLANS[name].replace("{{", "\x02").replace("}}", "\x03")
    used = [v for v in VIEWS if re.search(rf"\{{{v}(?::\w+)?\}}", sql)]

    def bind(m: re.Match) -> str:
        t, how = m[1], m[2]
        if how == "nested":
            return f"(SELECT DISTINCT * EXCLUDE ({', '.join(NESTED[t])}) FROM {t})"
        return f"(SELECT DISTINCT * FROM {t})" if how == "distinct" else t

    text = _unbrace(NAMES.sub(bind, sql).replace("\x02", "{{").replace("\x03", "}}")).replace("regexp_like", "regexp_matches").replace("\\\\", "\\")
    text = re.sub(r"substring_index\((\S+), '/', -1\)", r"string_split(\1, '/')[-1]", text)
    text = re.sub(r"sha2\((\w+), 256\)", r"sha256(\1)", text)
    views = ", ".join(f"{v} AS ({VIEWS[v][1]})" for v in used)
    if views and text.startswith("WITH "):
        return f"WITH {views}, {text[5:]}"
    return f"WITH {views} {text}" if views else text


def _query(name: str):
    return lambda spark, d: run(spark, d, name)


QUERIES = {n: _query(n) for n in PLANS}
SQL = {n: oracle(n) for n in PLANS}
