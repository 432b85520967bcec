"""DuckDB SQL of the queries that have a SQL form."""

from __future__ import annotations

from casewright.llm import secretscan

SQL: dict[str, str] = {}


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text of ASCII characters."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    byte = "list_reduce(list_prepend(xor(crc, code), range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda crc, code: {byte}), 4294967295)"


def _value(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_value(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree(name: str, nodes: str) -> str:
    """(g, level, nodes): the levels of a Merkle tree for each group of ``nodes`` (g, pos, h)."""
    pair = "sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))"
    return f"""{name}(g, level, nodes) AS (
      SELECT g, 0, list(h ORDER BY pos) FROM {nodes} GROUP BY g
      UNION ALL
      SELECT g, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: {pair}) FROM {name} WHERE len(nodes) > 1
    )"""


_STEP = """CASE WHEN nodes[xor(spot >> level, 1) + 1] IS NULL THEN {'s': '-', 'h': ''}
      ELSE {'s': CASE WHEN (spot >> level) & 1 = 1 THEN 'L' ELSE 'R' END, 'h': nodes[xor(spot >> level, 1) + 1]} END"""

SQL["op11_merkle_manifest"] = f"""
    WITH RECURSIVE leaves AS (
      SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS h,
        CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS changed
      FROM documents
    ),
    placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves),
    {_tree("low", "placed")},
    subroots AS (SELECT g AS lang, '' AS g, nodes[1] AS h, row_number() OVER (ORDER BY g) - 1 AS pos FROM low WHERE len(nodes) = 1),
    {_tree("high", "subroots")},
    steps AS (
      SELECT placed.g, pos, 0 AS stage, level, pos AS spot, nodes FROM placed JOIN low USING (g) WHERE len(nodes) > 1
      UNION ALL
      SELECT placed.g, placed.pos, 1, level, subroots.pos, nodes FROM placed JOIN subroots ON placed.g = lang, high WHERE len(nodes) > 1
    ),
    paths AS (SELECT g, pos, list({_STEP} ORDER BY stage, level) AS path FROM steps GROUP BY g, pos),
    folded AS (
      SELECT doc_id, leaves.h AS leaf, subroots.h AS subroot, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root,
        sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x.h), '')) AS proof_sha256,
        list_reduce(
          list_prepend({{'s': '', 'h': coalesce(changed, leaves.h)}}, coalesce(path, [])),
          lambda a, x: {{'s': '', 'h': sha256(CASE WHEN x.s = 'L' THEN x.h || a.h ELSE a.h || x.h END)}}
        ).h AS folded_root
      FROM placed AS leaves JOIN subroots ON leaves.g = lang LEFT JOIN paths ON paths.g = leaves.g AND paths.pos = leaves.pos
    )
    SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

_SCORE = "list_sum(list_transform(list_zip(a.vec, r.vec), lambda x: coalesce(x[1], 0) * coalesce(x[2], 0)))"

SQL["op13_hard_negatives"] = f"""
    WITH kept AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
    ),
    one AS (SELECT DISTINCT ON (vec_id) * FROM kept ORDER BY vec_id, label, vec),
    scored AS (
      SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, coalesce({_SCORE}, 0)::BIGINT AS score
      FROM one a, one r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
    ),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    ),
    ranked AS (
      SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
      FROM positives JOIN scored USING (anchor_id)
      WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    )
    SELECT * FROM ranked WHERE rank <= 10
"""


def _matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """(row, rank, kind, start, stop) of one rule's matches, by the lengths of what stands between them."""
    quoted = pattern.replace("'", "''")
    return f"""
      SELECT row, {rank} AS rank, '{kind}' AS kind, s.start AS start, s.stop AS stop FROM (
        SELECT row, unnest(list_transform(range(len(m)), lambda i: {{
          'start': coalesce(list_sum(list_transform(pieces[1:i + 1], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0)::BIGINT,
          'stop': coalesce(list_sum(list_transform(pieces[1:i + 1], lambda x: length(x))), 0)::BIGINT + list_sum(list_transform(m[1:i + 1], lambda x: length(x)))::BIGINT,
          'long': length(g[i + 1])}})) AS s
        FROM (
          SELECT row, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {group}) AS g, string_split_regex(text, '{quoted}') AS pieces
          FROM texts WHERE regexp_matches(text, '{quoted}')
        )
      ) WHERE s.long >= {least}"""


def _secrets(rules, base: int) -> str:
    found = " UNION ALL ".join(_matches(k, r.kind, secretscan.compiled(r).pattern, r.group, r.least) for k, r in enumerate(rules))
    counts = ", ".join(f"count(*) FILTER (rank = {k}) AS n_{r.kind}" for k, r in enumerate(rules[:base]))
    one = "kind || ':' || start || ':' || stop"
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({found})
    SELECT doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' ORDER BY start, rank) FILTER (rank < {base}), '')) AS base_sha256,
      coalesce(string_agg({one}, ',' ORDER BY start, rank), '') AS spans
    FROM texts LEFT JOIN found USING (row) GROUP BY row, doc_id
    """


SQL["op12_trigram_secrets"] = _secrets(secretscan.RULES, len(secretscan.BASE))
