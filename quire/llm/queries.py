"""Queries of the operators for training text, and SQL where SQL can express them."""

from __future__ import annotations

from quire.llm import mixture, pairs, pieces, pii, scans, sentences, tokens, truncation
from quire.tables import table

QUERIES = {
    "p1_found": lambda s, d: pairs.found(table(s, d, "brackets"), table(s, d, "nodes")),
    "p3_found": lambda s, d: sentences.found(table(s, d, "sections"), table(s, d, "nodes"), table(s, d, "books")),
    "p4_found": lambda s, d: pieces.found(table(s, d, "sections"), table(s, d, "nodes"), table(s, d, "blocks"), table(s, d, "size_limits")),
    "p4_pieces": lambda s, d: pieces.pieces(table(s, d, "sections"), table(s, d, "nodes"), table(s, d, "blocks"), table(s, d, "size_limits")),
    "p4_cuts": lambda s, d: pieces.cut_kinds(table(s, d, "sections"), table(s, d, "nodes"), table(s, d, "blocks"), table(s, d, "size_limits")),
    "p5_found": lambda s, d: scans.cases(table(s, d, "blocks"), table(s, d, "books")),
    "p5_paragraphs": lambda s, d: scans.paragraphs(table(s, d, "blocks"), table(s, d, "books")),
    "p6_found": lambda s, d: truncation.found(table(s, d, "brackets"), table(s, d, "nodes")),
    "p6_shares": lambda s, d: truncation.shares(table(s, d, "brackets"), table(s, d, "nodes")),
    "p7_ids": lambda s, d: tokens.encode_documents(table(s, d, "documents")),
    "p8_mixture": lambda s, d: mixture.mixture(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p8_shares": lambda s, d: mixture.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p9_found": lambda s, d: pii.personal_spans(table(s, d, "documents")),
    "p9_redacted": lambda s, d: pii.redacted(table(s, d, "documents")),
}

SQL = {
    "p4_found": """
SELECT DISTINCT 'section' AS item_kind, s.rec_id FROM sections s, size_limits l
WHERE l.item_kind = 'section' AND length(s.raw_text) > l.max_chars
UNION ALL
SELECT DISTINCT 'leaf' AS item_kind, n.rec_id FROM nodes n, size_limits l
WHERE l.item_kind = 'leaf' AND n.is_leaf AND n.end_off - n.start_off > l.max_chars""",
}
