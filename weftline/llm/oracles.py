"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n, list(struct_pack(r := role, x := text) ORDER BY k) AS turns FROM t GROUP BY conv_id),
proper AS (
  SELECT DISTINCT list_slice(turns, 1, i) AS p FROM (SELECT turns, unnest(range(1, n)) AS i FROM c)),
content AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_equal, any_value(n) AS n FROM c GROUP BY turns),
kept AS (SELECT * FROM content ANTI JOIN proper ON content.turns = proper.p)
SELECT t.conv_id, CAST(floor(coalesce(t.turn, -1) / 1024) AS BIGINT) AS piece, any_value(kept.n) AS n_turns, any_value(kept.n_equal) AS n_equal,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS chat
FROM t JOIN kept USING (conv_id) GROUP BY 1, 2
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_formatting": _CHAT}
