"""Schemas of the cache tables and results."""

FILE_CACHE = "model_name string, file_path string, last_modified string, file_size bigint, embedding array<float>, created_at string"
ARCHIVE_CACHE = "model_name string, archive_path string, page_count int, last_modified string, file_size bigint, pages array<array<float>>, created_at string"
COVER_CACHE = "model_name string, archive_path string, last_modified string, file_size bigint, embedding array<float>, created_at string"
PROBE = "file_path string, last_modified string, file_size bigint"
NOTE = "scope string, path string, message string"
#: Cache table -> (schema, key column).
TABLES = {"file_cache": (FILE_CACHE, "file_path"), "archive_cache": (ARCHIVE_CACHE, "archive_path"), "cover_cache": (COVER_CACHE, "archive_path")}
