"""Structured Streaming entry points.

The reference is batch-only.  Its fitted transforms (imputation, one-hot,
hash split, standardisation, embedding, model scoring) are all narrow, so the
same parameter objects apply unchanged to a ``readStream`` DataFrame.
"""

from calibra.streaming.scoring import prepare_stream, run_available_now

__all__ = ["prepare_stream", "run_available_now"]
