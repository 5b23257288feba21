"""DuckDB SQL of the queries that SQL can express."""


#: A-Z in lower case.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _draw(*parts: str) -> str:
    """A 60-bit number from the MD5 of a text."""
    return "CAST('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 15) AS BIGINT)"


def _mixing(block: int = 64, slots: int = 4096, rounds: int = 6) -> str:
    """The mix of op3: the same draws, blocks and permutations."""
    steps, last = [], "x0"
    for r in range(rounds):
        a = _draw("'mix'", "rank", "epoch", f"'{r}'")
        b = _draw("'mix'", "rank", "epoch", f"'{r}'", "greatest(x, y)")
        steps.append(f"y{r} AS (SELECT *, (({a} - x) % n + n) % n AS y FROM {last}),\nx{r + 1} AS (SELECT rank, n, epoch, CASE WHEN {b} % 2 = 1 THEN y ELSE x END AS x FROM y{r})")
        last = f"x{r + 1}"
    return rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, {_draw("'mix'", "'chunk'", "coalesce(CAST(doc_id AS VARCHAR), '')")} % 2048 AS chunk FROM documents
), src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM src),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(rank - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size / [5.0::DOUBLE, 2.0, 1.0][(rank - 1) % 3 + 1] AS full_at FROM ranked),
filled AS (SELECT *, row_number() OVER o AS nth, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed WINDOW o AS (ORDER BY full_at, rank)),
aimed AS (SELECT *, least(2.0::DOUBLE * source_size, coalesce((SELECT arg_min(level, nth) FROM filled WHERE level <= full_at), 'inf'::DOUBLE) * w) AS target, (source_size + {block - 1}) // {block} AS n FROM filled),
needs AS (SELECT *, CASE WHEN source_size > 0 THEN target * n / source_size ELSE 0 END AS need FROM aimed),
shares AS (SELECT *, CAST(round(sum(need) OVER ()) AS BIGINT) AS total, coalesce(need / nullif(sum(need) OVER (), 0), 0) AS p FROM needs),
kinds AS (SELECT *, unnest([{slots}, total % {slots}]) AS room, unnest([false, true]) AS short FROM shares),
wholes AS (SELECT *, CAST(floor(room * p) AS BIGINT) AS whole, room * p - floor(room * p) AS part FROM kinds),
drawn AS (SELECT *, room - sum(whole) OVER (PARTITION BY short) AS rest, coalesce(sum(part) OVER (PARTITION BY short ORDER BY rank ROWS UNBOUNDED PRECEDING) / nullif(sum(part) OVER (PARTITION BY short), 0), 0) AS hi FROM wholes),
ranges AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY short ORDER BY rank), 0) AS lo, (total + {slots - 1}) // {slots} AS shards FROM drawn),
rows_ AS (SELECT rank, n, unnest(range(0, shards)) AS shard, whole, rest, lo, hi, short, shards, total FROM ranges WHERE n > 0),
picked AS (SELECT rank, n, shard, whole, rest, lo, hi FROM rows_ WHERE short = (shard = shards - 1 AND total % {slots} > 0)),
draws AS (SELECT shard, j, {_draw("'mix'", "'shard'", "shard", "j")} / 1152921504606846976.0::DOUBLE AS u FROM (SELECT shard, unnest(range(1, CAST(max(rest) AS BIGINT) + 1)) AS j FROM picked GROUP BY shard)),
counts AS (SELECT k.rank, k.n, k.shard, k.whole + count(d.u) AS c FROM picked k LEFT JOIN draws d ON d.shard = k.shard AND d.u >= k.lo AND d.u < k.hi GROUP BY k.rank, k.n, k.shard, k.whole),
started AS (SELECT *, CAST(sum(c) OVER (PARTITION BY rank ORDER BY shard ROWS UNBOUNDED PRECEDING) - c AS BIGINT) AS start FROM counts),
slots AS (SELECT rank, n, unnest(range(start, start + CAST(c AS BIGINT))) AS k FROM started),
x0 AS (SELECT rank, n, k // n AS epoch, k % n AS x FROM slots WHERE k < 2 * n),
{(","+chr(10)).join(steps)},
blocks AS (SELECT rank, x AS b, count(*) AS times FROM {last} GROUP BY ALL),
docs AS (SELECT s.doc_id, s.size, a.rank, a.source_size, a.target, CAST(sum(s.size) OVER (PARTITION BY a.rank ORDER BY chunk, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS start FROM sizes s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
spread AS (SELECT doc_id, rank, start, size, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS b FROM docs WHERE size > 0),
sums AS (SELECT doc_id, CAST(sum(times * (least(start + size, (s.b + 1) * {block}) - greatest(start, s.b * {block}))) AS BIGINT) AS taken FROM spread s JOIN blocks USING (rank, b) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM docs LEFT JOIN sums USING (doc_id)
"""


SQL: dict[str, str] = {
    "op3_mix_sources": _mixing(),
    "op4_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
""",
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), over AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.last AS gone FROM keyed k LEFT JOIN over o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op8_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 3)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, y FROM reach JOIN ends ON b = x)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN reach ON a = doc_id GROUP BY doc_id
""",
    "op10_quality_rules": rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, array_to_string(regexp_extract_all({_LOWER.format("line")}, '[^\x20\x09-\x0D]+'), ' ') AS key
  FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
o AS (SELECT l.source, key, min(doc_id) AS first FROM l GROUP BY l.source, key HAVING count(DISTINCT doc_id) > 2),
x AS (SELECT doc_id, sum(words) AS n FROM l JOIN o ON l.source IS NOT DISTINCT FROM o.source AND l.key = o.key WHERE doc_id <> first GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS lost_words FROM w LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND lost_words <= 0.5 * n_words AS kept FROM b
""",
}
