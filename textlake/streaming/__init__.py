from .ingest import fragment_stream, read_vectors, start_vector_ingest

__all__ = ["fragment_stream", "read_vectors", "start_vector_ingest"]
