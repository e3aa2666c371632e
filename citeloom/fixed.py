"""What results must agree on, stated once."""

# Messages.
CITES, READ_FIRST = " cites ", " -- read the latter first."
NO_EDGE = "No direct citation edge found between these two papers in this corpus."
NO_COLLECTION = "collection {} does not exist"
NOT_OWNER = "not authorized: this collection belongs to a different user"

# The default topics of a harvest, and the works a topic starts from.
TOPICS = (
    "retrieval augmented generation",
    "vector database",
    "vector embedding search",
    "data pipeline orchestration",
    "feature store machine learning",
    "graph neural network",
    "prompt engineering",
    "semantic search embeddings",
)
PER_TOPIC = 200

# Windows of a text, in characters, and rows of a batch sent out.
CHUNK_SIZE, CHUNK_OVERLAP = 1500, 100
SEND_ROWS = 1000

# Ids and rows of one call to a record service, its tries, and the seconds that each wait is longer.
CALL_IDS, CALL_ROWS = 100, 200
RETRIES, RETRY_SECONDS = 3, 1.5

# Column of a cleaned work -> path in its record.
WORK_PATHS = {
    "title": "display_name",
    "doi": "doi",
    "publication_year": "publication_year",
    "primary_topic_domain": "primary_topic.domain.display_name",
    "primary_topic_field": "primary_topic.field.display_name",
    "cited_by_count": "cited_by_count",
    "fwci": "fwci",
    "is_oa": "open_access.is_oa",
    "oa_url": "open_access.oa_url",
    "language": "language",
    "seed_topic": "_seed_topic",
    "_hop": "_hop",
}
WORK_DEFAULTS = {"cited_by_count": 0, "is_oa": False}
PAYLOAD = ("id", "display_name", "primary_topic", "open_access")
TOPIC_PATHS = {
    "display_name": "display_name",
    "domain": "domain.display_name",
    "field": "field.display_name",
    "subfield": "subfield.display_name",
    "description": "description",
    "keywords": "keywords",
}

# Hops in order of preference, bounds of the gates.
HOPS = ("seed", "cited", "citing")
LEAST_YEAR, ABSTRACT_OVER = 1800, 100
