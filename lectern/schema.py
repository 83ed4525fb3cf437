
from __future__ import annotations

from pyspark.sql import types as T

_AUTHOR = "struct<surname:string,forename:string>"

DDL = {
    "documents": f"doc_hash string, full_hash string, paths array<string>, title string, year int, year_source string, authors array<{_AUTHOR}>, doi string, journal string, abstract string, filename string, n_chunks int, n_figures int, n_taxa int, file_type string",
    "chunks": "doc_hash string, chunk_id string, chunk_index int, text string, headings array<string>, section_class string, captions array<string>, start_char int, end_char int, figure_refs array<string>",
    "taxa": "taxon_id string, scientific_name string, scientific_name_authorship string, taxon_rank string, taxonomic_status string, parent_name_usage_id string, accepted_name_usage_id string, accepted_name string, kingdom string, phylum string, class string, order string, family string, genus string, source string, source_record_id string, citation string, fetched_at timestamp",
    "names": "name string, name_lowercase string, taxon_id string, name_type string",
    "taxon_mentions": "taxon_id string, matched_name string, accepted_name string, taxon_rank string, doc_hash string, chunk_id string, chunk_index int, char_start int, char_end int, mention_text string, name_type string, confidence double, method string",
    "lexicon_terms": "category string, canonical string, variant string, lang string, description string",
    "lexicon_mentions": "category string, doc_hash string, chunk_id string, canonical string, surface string, char_start int, char_end int",
    "works": "work_id string, guid_type string, title string, year int, journal string, doi string, doc_hash string, held boolean, source string, confidence double, license string, license_url string, license_source string, publishable boolean, served boolean, serve_reason string, imported_at timestamp",
    "work_authors": "work_id string, position int, surname string, surname_normalized string, forename string",
    "citations": "citing_work_id string, cited_work_id string, citing_doc_hash string, ref_id string, raw string, match_method string, match_score double",
    "work_aliases": "alias_key string, work_id string",
    "taxon_work_links": "taxon_id string, work_id string, link_type string, confidence double",
    "external_lookups": "lookup_key string, status string, work_id string, looked_up_at timestamp",
    "references": "doc_hash string, ref_id string, title string, authors array<string>, year int, journal string, doi string, raw string",
    "intext_citations": "doc_hash string, target string, surface string, section string, para_index int",
    "paragraphs": "doc_hash string, para_index int, text string",
    "figures": "doc_hash string, figure_id string, figure_type string, page int, figure_number string, filename string, caption_text string, panels array<struct<label:string,description:string>>, panel_count int, rois array<struct<label:string,parent:string,roi_px:array<int>>>",
    "missing_figures": "doc_hash string, figure_number string, candidate_caption string, mention_count int",
    "stage_timings": "doc_hash string, stage string, started_at timestamp, ended_at timestamp, duration_s double, ok boolean",
    "stage_failures": "doc_hash string, stage string, reason_code string, reason_detail string",
    "quality_flags": "doc_hash string, gate string, severity string, detail string, metric double",
    "stage_state": "doc_hash string, stage string, engine_version string, fingerprint string, completed_at timestamp",
    "chunk_vectors": "doc_hash string, chunk_id string, text string, vector array<float>",
}


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(DDL[table])
