"""Table schemas as DDL text."""

ENTITIES = (
    "file string, graph string, subject string, pos long, type string, "
    "predicate string, value_pos long, value string"
)
FAQ = (
    "id string, url string, scheme_host string, language string, "
    "confidence double, question string, answer string"
)
FLAGS = "id string, filter boolean, near_duplicate_similarity double"
CANDIDATES = (
    "scheme_host string, similarity double, languages array<string>, "
    "urls array<string>, questions array<string>, answers array<string>, "
    "topics array<string>, question_types array<string>"
)
SCORES = CANDIDATES + ", score int"
QUERIES = "query_id string, text string"
CORPUS = "doc_id string, title string, text string"
QRELS = "query_id string, doc_id string, score int"
