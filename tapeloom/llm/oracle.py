"""Reference SQL (DuckDB) of the operators that SQL can express, built from the same parameters."""

from __future__ import annotations

from tapeloom.llm import mixing, warc

_NUMBER = "('0x' || substr({}, 1, 8))::BIGINT"

#: Seats are dealt by listing every quotient, which small tables allow; groups of shards do not occur there.
MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS skey,
    coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::BIGINT AS size,
    md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, {mixing.MAX_REPEAT} * source_size AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS pos,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
f AS (SELECT min(pos) AS first_pos FROM l WHERE level <= cap / w),
t AS (SELECT skey, source_size, least(cap::DOUBLE, (SELECT level FROM l, f WHERE pos = first_pos) * w) AS target FROM l),
n AS (SELECT floor(sum(source_size) / {mixing.BLOCK_WORDS} + 0.5)::BIGINT AS seats FROM t),
q AS (SELECT skey, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, skey, k) AS place
  FROM t, n, range(0, n.seats + 1) AS r(k) WHERE target > 0),
ss AS (SELECT t.*, (SELECT count(*) FROM q, n WHERE q.skey = t.skey AND place <= n.seats) AS seats,
    greatest(ceil(source_size / {mixing.SHARD_WORDS}), 1)::BIGINT AS shards FROM t),
p AS (SELECT d.*, source_size, target, seats, {_NUMBER.format('key')} % shards AS shard FROM d JOIN ss USING (skey)),
c AS (SELECT skey, shard, sum(size)::BIGINT AS cell_size, any_value(seats) AS seats FROM p GROUP BY skey, shard),
cq AS (SELECT skey, shard, seats, row_number() OVER (PARTITION BY skey ORDER BY cell_size / (2 * k + 1) DESC, shard, k) AS place
  FROM c, range(0, c.seats + 1) AS r(k) WHERE cell_size > 0),
cs AS (SELECT c.*, (SELECT count(*) FROM cq WHERE cq.skey = c.skey AND cq.shard = c.shard AND place <= cq.seats) AS won FROM c),
due AS (SELECT *, least(won * {mixing.BLOCK_WORDS}, {mixing.MAX_REPEAT} * cell_size) AS due,
    {_NUMBER.format(f"md5('{mixing.SEED}:' || skey || ':' || shard)")} % greatest(ceil(cell_size / {mixing.BLOCK_WORDS}), 1)::BIGINT
      * {mixing.BLOCK_WORDS} AS start FROM cs),
x AS (SELECT *, CASE WHEN cell_size > 0 THEN due // cell_size ELSE 0 END AS passes, CASE WHEN cell_size > 0 THEN due % cell_size ELSE 0 END AS rest FROM due),
line AS (SELECT p.*, cell_size, passes, rest, start,
    sum(size) OVER (PARTITION BY skey, shard ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM p JOIN x USING (skey, shard))
SELECT doc_id, size, source_size, target, (passes * size
  + greatest(0, least(upto, start + rest, cell_size) - greatest(upto - size, start))
  + greatest(0, least(upto, start + rest - cell_size) - greatest(upto - size, 0)))::BIGINT AS taken
FROM line
"""

_EOL = "chr(13) || chr(10)"
_HEAD = "'" + warc.HEAD.replace("\r\n", f"' || {_EOL} || '") + "'"

WARC = f"""
WITH r AS (
  SELECT page_id AS record_id, {_HEAD} || page_id || '>' || {_EOL} || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') || {_EOL}
    || 'Content-Type: text/html' || {_EOL} || 'Content-Length: ' || strlen(coalesce(html, '')) || {_EOL} || {_EOL}
    || coalesce(html, '') AS record,
    ('0x' || substr(md5('fixity-1:' || page_id), 1, 2))::INT AS draw
  FROM pages),
o AS (SELECT *, page_id // {warc.RECORDS_PER_ARCHIVE} AS archive, strlen(record)::BIGINT AS bytes FROM (SELECT *, record_id AS page_id FROM r)),
p AS (SELECT *, coalesce(sum(bytes + {len(warc.TAIL)}) OVER (PARTITION BY archive ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM o)
SELECT record_id, archive, "offset", bytes,
  CASE WHEN draw < 2 THEN bytes WHEN draw < 4 THEN strlen(left(record, length(record) - 9))
    WHEN draw < 6 THEN NULL ELSE 2 * bytes END::BIGINT AS replica_bytes,
  CASE WHEN draw BETWEEN 4 AND 5 THEN 'missing' ELSE 'changed' END AS kind
FROM p WHERE draw < 8
"""
