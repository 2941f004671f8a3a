from calibra.sources.tables import (
    documents_labeled, encounters, read_table, vectors, TOXIC_SPEC, ENC_SPEC,
)

__all__ = ["documents_labeled", "encounters", "read_table", "vectors", "TOXIC_SPEC", "ENC_SPEC"]
