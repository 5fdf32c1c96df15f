from .sinks import append_table, write_results
from .tables import (DOCUMENT_PATH_SQL, document_path, non_empty, read_documents, read_table, read_text_files,
                     table_path)

__all__ = ["append_table", "write_results", "DOCUMENT_PATH_SQL", "document_path", "non_empty", "read_documents",
           "read_table", "read_text_files", "table_path"]
