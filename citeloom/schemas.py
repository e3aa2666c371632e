"""Schemas of the source records and the served tables, and the tables' constraints."""

from __future__ import annotations

_ref = "struct<id:string,display_name:string>"

#: One harvested work, as JSON. The inverted index may be an object or a string: both are read as text.
WORK = (
    "id string, doi string, display_name string, publication_year int, cited_by_count long, fwci double, language string,"
    f"primary_topic struct<id:string,display_name:string,score:double,subfield:{_ref},field:{_ref},domain:{_ref}>,"
    "open_access struct<is_oa:boolean,oa_status:string,oa_url:string,any_repository_has_fulltext:boolean>,"
    "authorships array<struct<author_position:string,author:struct<id:string,display_name:string,orcid:string>,"
    "institutions:array<struct<id:string,display_name:string,ror:string,country_code:string,type:string,lineage:array<string>>>,"
    "countries:array<string>,is_corresponding:boolean,raw_author_name:string,raw_affiliation_strings:array<string>,raw_orcid:string,"
    "affiliations:array<struct<raw_affiliation_string:string,institution_ids:array<string>>>>>,"
    "abstract_inverted_index string, referenced_works array<string>, _seed_topic string, _hop string"
)

TOPIC = f"id string, display_name string, domain {_ref}, field {_ref}, subfield {_ref}, description string, keywords array<string>"

PROGRESS_STATES = ("not_started", "in_progress", "completed", "abandoned")
GOAL_STATES = ("active", "paused", "completed", "archived")


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _not_blank(column: str) -> str:
    return f"length(trim({column})) > 0"


#: Check constraints by table: name -> SQL predicate. As in SQL, unknown passes.
CONSTRAINTS: dict[str, dict[str, str]] = {
    "papers": {
        "work_id_present": "work_id IS NOT NULL",
        "title_present": "title IS NOT NULL",
        "title_not_blank": _not_blank("title"),
        "year_plausible": "publication_year IS NULL OR publication_year BETWEEN 1800 AND 2100",
    },
    "authors": {"author_id_present": "author_id IS NOT NULL", "display_name_present": "display_name IS NOT NULL"},
    "learning_goals": {"title_not_blank": _not_blank("title"), "status_known": _one_of("status", GOAL_STATES)},
    "collections": {"name_not_blank": _not_blank("name")},
    "reading_progress": {"status_known": _one_of("status", PROGRESS_STATES)},
    "notes": {"text_not_blank": _not_blank("note_text")},
}

TABLES: dict[str, str] = {
    "users": "user_id string, created_at timestamp",
    "learning_goals": "goal_id long, user_id string, title string, description string, status string, created_at timestamp, updated_at timestamp",
    "papers": (
        "work_id string, title string, doi string, publication_year int, primary_topic_domain string, primary_topic_field string, cited_by_count long, fwci double, "
        "foundational_score double, is_oa boolean, oa_url string, language string, seed_topic string, narrative_abstract string, payload string, synced_at timestamp, embedded_at timestamp"
    ),
    "authors": "author_id string, display_name string, orcid string",
    "paper_authors": "work_id string, author_id string, author_position int, is_corresponding boolean",
    "collections": "collection_id long, user_id string, goal_id long, name string, description string, created_at timestamp",
    "collection_papers": "collection_id long, work_id string, sequence_rank int, added_at timestamp",
    "reading_progress": "user_id string, work_id string, status string, started_at timestamp, completed_at timestamp, updated_at timestamp",
    "notes": "note_id long, user_id string, work_id string, collection_id long, note_text string, created_at timestamp, updated_at timestamp",
    "paper_embeddings": "embedding_id string, work_id string, chunk_index int, chunk_text string, embedding array<float>",
    "citation_edges": "citing_work_id string, cited_work_id string",
}
