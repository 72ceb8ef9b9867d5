"""Schemas of the engine's tables. They are declared, never inferred."""

FILE_META = "path string, size bigint, mtime double, inode bigint"
FILE_RECORD = FILE_META + ", hash string"
CHANGES = "path string, change string, old_path string"
IGNORE_RULE = "dir string, ordinal int, pattern string, regex string, negated boolean, dir_only boolean"
SOURCE_FILE = "path string, content string"
CHUNK = "id string, content string, start_line int, end_line int, language string, file_path string, doc string, parent_chunk_id string, node_type string, node_key string, part_index int, parse_status string"
DEFINITION = "chunk_id string, language string, name string, owner string, file_path string"
CANDIDATE = "chunk_id string, language string, name string, kind string, owner string, file_path string"
POINT = CHUNK + ", code array<float>, doc_vec array<float>, relative_path string, indexed_at timestamp"
POSTING = "chunk_id string, field string, term string, tf int, doc_len int"
FILED_POSTING = POSTING + ", relative_path string, layer int, bucket int"
SEARCH_RESULT = "content string, doc string, relative_path string, start_line int, end_line int, language string, score double"
EDGE = "source_id string, target_id string, edge_type string"
NODE = "id string, content string, relative_path string, start_line int, end_line int, language string, doc string"
#: Of a file: its chunks with content, and with documentation.
TALLY = "path string, content bigint, doc bigint"
#: What a service said of a text: kind tells the service, key is the text's hash.
ANSWER = "kind string, key string, vector array<float>, answer string, bucket int"
