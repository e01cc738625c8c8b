"""The registered queries of this subpackage and their SQL forms, where SQL can express them."""

from __future__ import annotations

from pixelweave.llm import chat_format, context_mixing, conversation_repair, host_quality, image_copies, near_dedup, piece_codec, site_style, source_mixing, token_alignment, token_lengths, toxic_terms, warc_chunks

_MODULES = (host_quality, chat_format, warc_chunks, piece_codec, token_lengths, source_mixing, near_dedup, site_style, context_mixing, image_copies, token_alignment, toxic_terms, conversation_repair)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
