import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

#: Schemas of the library's tables, for fixtures.
SCHEMAS = {
    "items": "id long, canonical_source_item_id long, zotero_key string, item_type string, title string, date_created string, date_added string, date_modified string, doi string, isbn string, url string, metadata_json string, creators_json string, tags_json string, collections_json string, source_count long",
    "item_sources": "item_id long, source_item_id long, source_key string, date_added string, annotation_count long, metadata_json string, loaded_at timestamp",
    "obsidian_notes": "note_id string, relative_path string, folder string, filename string, title string, markdown string, tags_json string, aliases_json string, authors_json string, checksum string, imported_at timestamp, removed_at timestamp",
    "obsidian_sections": "section_id string, note_id string, ordinal long, heading string, heading_path string, heading_level int, markdown string",
    "obsidian_links": "id long, note_id string, target string, imported_at timestamp",
    "obsidian_assets": "relative_path string, filename string",
    "zotero_collections": "collection_id long, name string, parent_id long, path string, depth int",
    "collection_descendants": "ancestor_id long, descendant_id long",
    "duplicate_groups": "item_id long, match_method string, match_key string",
    "document_pages": "id long, attachment_id long, item_id long, page_number int, text string, char_count long",
    "clean_document_blocks": "id long, attachment_id long, item_id long, ordinal long, block_type string, section_title string, source string, page_start int, page_end int, text string, char_count long",
    "semantic_chunks": "id long, model string, dimensions int, chunk_key string, content_hash string, kind string, label string, item_id long, attachment_id long, page string, section_title string, title string, embedding array<float>, text string",
    "notes": "id long, item_id long, attachment_id long, title string, note_html string",
    "documents": "doc_id long, text string, lang string, source string, item_id long, title string",
}


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def write(spark, tmp_path):
    """write(table, rows of dicts, extra columns with clashing names) -> the folder; tables not written are empty."""

    def _write(tables: dict, clash: str | None = None) -> str:
        for name, schema in SCHEMAS.items():
            cols = [c.split()[0] for c in schema.split(", ")]
            rows = [tuple(r.get(c) for c in cols) for r in tables.get(name, [])]
            df = spark.createDataFrame(rows, schema)
            if clash:
                from pyspark.sql import functions as F

                for c in clash.split():
                    if c not in df.columns:
                        df = df.withColumn(c, F.lit("clash"))
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return _write
