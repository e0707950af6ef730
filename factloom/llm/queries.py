"""Queries of the training-data operators: (spark, folder) -> DataFrame, and their SQL where SQL can state them."""

from __future__ import annotations

from ..common import table as t
from . import encode, handwritten, pack, pii, split, syntax, topn

QUERIES = {
    "p1_found": lambda s, d: handwritten.classify(t(s, d, "source_files"), t(s, d, "repos")).select("path"),
    "p1_methods": lambda s, d: handwritten.handwritten(t(s, d, "methods"), handwritten.classify(t(s, d, "source_files"), t(s, d, "repos"))).select("id", "file_path").distinct(),
    "p2_found": lambda s, d: split.oversized_items(t(s, d, "chunk_items"), t(s, d, "chunk_batches")),
    "p2_pieces": lambda s, d: split.split_items(t(s, d, "chunk_items"), t(s, d, "chunk_batches")),
    "p3_found": lambda s, d: syntax.check_files(t(s, d, "source_files")).where("edits > 0").select("path"),
    "p3_files": lambda s, d: syntax.check_files(t(s, d, "source_files")),
    "p3_rates": lambda s, d: syntax.invalid_rates(syntax.check_files(t(s, d, "source_files"))),
    "p5_found": lambda s, d: topn.best_paths(t(s, d, "candidate_paths"), t(s, d, "sinks")).select("path_id"),
    "p5_best": lambda s, d: topn.best_paths(t(s, d, "candidate_paths"), t(s, d, "sinks")).select("entry_id", "category", "path_id"),
    "p6_ids": lambda s, d: t(s, d, "documents").select("doc_id", encode.token_ids(s, "text").alias("ids")),
    "p7_found": lambda s, d: pack.oversized(t(s, d, "documents")),
    "p8_found": lambda s, d: pii.found(t(s, d, "documents")),
    "p8_clean": lambda s, d: pii.masked(t(s, d, "documents")),
    "p7_containers": lambda s, d: pack.pack(t(s, d, "documents")),
}

_P5 = r"""
WITH p AS (SELECT * FROM (SELECT path_id, entry_id, sink_id, upper(regexp_replace(static_confidence, '^\s+|\s+$', '', 'g')) AS c, call_depth,
        row_number() OVER (PARTITION BY path_id ORDER BY recorded_at DESC, entry_id DESC) AS rn FROM candidate_paths) WHERE rn = 1),
k AS (SELECT id, max(upper(regexp_replace(category, '^\s+|\s+$', '', 'g'))) AS category FROM sinks GROUP BY id),
r AS (SELECT p.*, k.category, row_number() OVER (PARTITION BY entry_id, k.category ORDER BY CASE c WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END,
        CASE WHEN call_depth >= 0 THEN call_depth ELSE 2147483648 END, path_id) AS place
      FROM p JOIN k ON k.id = p.sink_id WHERE k.category <> '' AND regexp_replace(entry_id, '^\s+|\s+$', '', 'g') <> '')
"""

ORACLES = {
    "p2_found": """SELECT DISTINCT i.item_id, l.list_name FROM chunk_items i JOIN
        (SELECT unnest(candidate_chunks) AS n, 'candidate' AS list_name FROM chunk_batches UNION SELECT unnest(stored_chunks), 'stored' FROM chunk_batches) l
        ON l.n = i.chunk_name WHERE strlen(i.payload) > 8192""",
    "p5_found": _P5 + "SELECT path_id FROM r WHERE place <= 3",
    "p5_best": _P5 + "SELECT entry_id, category, path_id FROM r WHERE place <= 3",
}
