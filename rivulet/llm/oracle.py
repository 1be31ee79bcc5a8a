"""DuckDB SQL for the queries that SQL can express."""

#: Escapes of the template, by control string: % first, then each one's first character. Lengths only, as sums over turns.
_CODED = "replace(replace(replace(replace(replace(replace(replace(replace({x}, '%', '%25'), '<|', '%3C|'), '<s>', '%3Cs>'), '</s>', '%3C/s>'), '[INST]', '%5BINST]'), '[/INST]', '%5B/INST]'), '<<SYS>>', '%3C<SYS>>'), '<</SYS>>', '%3C</SYS>>')"

OP2 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), a AS (
  SELECT conv_id, count(*) AS n,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS everything,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>') + length({_CODED.format(x="role")}) + 1 + length({_CODED.format(x="text")}) + length('<|im_end|>') + 1) AS chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n::BIGINT AS n_turns, sha256(everything) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM a
"""

OP3 = """
WITH RECURSIVE w AS (
  SELECT source, floor(sqrt(count(*)::DOUBLE))::BIGINT AS w FROM documents GROUP BY source
), p AS (
  SELECT source, w * 1000 // (SELECT sum(w)::BIGINT FROM w) AS share, w * 1000 % (SELECT sum(w)::BIGINT FROM w) AS rest FROM w
), n AS (
  SELECT source, greatest(1, share + (row_number() OVER (ORDER BY rest DESC, source) <= 1000 - (SELECT sum(share)::BIGINT FROM p))::BIGINT) AS n FROM p
), s AS (
  SELECT list(n ORDER BY source) AS ns, sum(n)::BIGINT AS q FROM n
), plan AS (
  SELECT -1::BIGINT AS t, list_transform(ns, lambda x: 0::BIGINT) AS given, 0::BIGINT AS pick, ns, q FROM s
  UNION ALL
  SELECT t + 1, list_transform(given, lambda g, i: g + (i = k)::BIGINT), k, ns, q
  FROM (
    SELECT t, given, ns, q, list_min(list_filter(list_transform(ns, lambda n, i: {'due': ((given[i] + 1) * q + n - 1) // n, 'i': i, 'r': given[i] * q // n}), lambda x: x.r <= t + 1)).i AS k
    FROM plan WHERE t + 1 < q
  )
), slots AS (
  SELECT pick, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM plan WHERE t >= 0
), d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r FROM documents
), b AS (
  SELECT doc_id, d.source, r // 32 AS block, r % 32 AS off, n, (SELECT q FROM s) AS q, k FROM d
  JOIN (SELECT source, n, row_number() OVER (ORDER BY source) AS k FROM n) USING (source)
)
SELECT doc_id, source, block::BIGINT AS block, (block // n * q + t)::BIGINT AS slot, off::BIGINT AS "offset"
FROM b JOIN slots ON pick = k AND j = block % n
"""

ORACLE = {"op2_chat": OP2, "op3_mixing": OP3}
