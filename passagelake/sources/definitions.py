"""The search definitions that an index registers. Fixed values, but for the vector's length."""

from __future__ import annotations


def vector_definition(dimensions: int = 1024) -> dict:
    filters = [{"type": "filter", "path": p} for p in ("source", "unit", "content_type", "kind")]
    return {"fields": [{"type": "vector", "path": "embedding", "numDimensions": dimensions, "similarity": "cosine"}, *filters]}


def text_definition() -> dict:
    token = {"type": "token", "normalizer": "lowercase"}
    return {
        "analyzers": [{"name": "jargon_text", "tokenizer": {"type": "standard"}, "tokenFilters": [{"type": "lowercase"}]}],
        "mappings": {"dynamic": False, "fields": {"text": {"type": "string", "analyzer": "jargon_text", "searchAnalyzer": "jargon_text"}, "kind": token, "content_type": token}},
    }


DEFINITIONS = {"chunks_vector": ("vector", vector_definition()), "chunks_search": ("search", text_definition())}
