"""SQL twins of the training-data queries that SQL can express."""

from __future__ import annotations

#: More rounds than any source needs here; a round in which nothing fits changes nothing.
_MIX_ROUNDS = 16
_MIX_ROUND = """
r{n} AS (
  SELECT p.*, CASE WHEN p.extra = 0 AND p.size > 0 AND p.size <= o.gap THEN
      sum(CASE WHEN p.extra = 0 AND p.size > 0 AND p.size <= o.gap THEN p.size ELSE 0 END)
        OVER (PARTITION BY p.source_no ORDER BY p.key, p.doc_id, p.size ROWS UNBOUNDED PRECEDING) END AS run,
    o.gap AS gap
  FROM t{before} p JOIN o{before} o USING (source_no)
),
t{n} AS (
  SELECT doc_id, size, source_no, key, CASE WHEN run <= gap THEN 1 ELSE extra END AS extra FROM r{n}
),
o{n} AS (
  SELECT s.source_no, s.open - coalesce(u.used, 0) AS gap FROM s
  LEFT JOIN (SELECT source_no, sum(size) AS used FROM t{n} WHERE extra = 1 GROUP BY 1) u USING (source_no)
)"""

_MIX = """
WITH q AS (
  SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS quality
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1
),
base AS (
  SELECT d.doc_id, d.source,
    len(list_filter(regexp_split_to_array(coalesce(d.text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix-1:' || d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
      / coalesce(q.quality, 1.0::DOUBLE) AS key
  FROM documents d LEFT JOIN q USING (doc_id)
),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY 1),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM sums
),
weighted AS (SELECT *, (source_no - 1) % 3 + 1 AS weight, sum(source_size) OVER ()::BIGINT AS total FROM numbered),
-- The common level of all sources below their limit is the largest one that some set of
-- sources at the limit (those with the least room for their weight) leaves to the rest.
levels AS (
  SELECT a.source_no, a.source_size, a.weight,
    (a.total - (SELECT coalesce(sum(3 * b.source_size), 0) FROM weighted b
       WHERE (b.source_size::DOUBLE / b.weight, b.source_no) < (a.source_size::DOUBLE / a.weight, a.source_no)))::DOUBLE
    / (SELECT sum(b.weight) FROM weighted b
       WHERE (b.source_size::DOUBLE / b.weight, b.source_no) >= (a.source_size::DOUBLE / a.weight, a.source_no)) AS level
  FROM weighted a
),
common AS (SELECT max(level) AS level FROM levels WHERE level * weight <= 3 * source_size),
targets AS (
  SELECT w.source, w.source_no, w.source_size,
    least(3.0 * w.source_size::DOUBLE, coalesce(c.level * w.weight, 3.0 * w.source_size::DOUBLE)) AS target
  FROM weighted w, common c
),
s AS (
  SELECT *, (target - epochs * source_size)::DOUBLE AS rest,
    floor(target - epochs * source_size)::BIGINT AS open
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets)
),
t0 AS (
  SELECT b.doc_id, b.size, s.source_no, b.key, 0 AS extra
  FROM base b JOIN s ON b.source IS NOT DISTINCT FROM s.source
),
o0 AS (SELECT source_no, open AS gap FROM s),
{rounds}
SELECT t.doc_id, t.size, s.source_size, s.target,
  (CASE WHEN t.size > 0 THEN t.size * (s.epochs + t.extra) ELSE 0 END)::BIGINT AS taken
FROM t{last} t JOIN s USING (source_no)
"""


def _crc32(codes: str) -> str:
    """CRC-32 of a list of byte values: each byte enters, then eight shifts follow."""
    return f"""xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform({codes}, lambda code: [code::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda crc, code: xor(xor(crc, code) >> 1, 3988292384 * (xor(crc, code) & 1))))"""


_ID_CODES = "list_transform(string_split(doc_id::VARCHAR, ''), lambda sign: ord(sign))"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


_MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS row_no, doc_id, lang, leaf, shown,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY lang) AS size
  FROM (
    SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
      CASE WHEN {_crc32(_ID_CODES)} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE leaf END AS shown
    FROM documents
  )
),
nodes AS (
  SELECT 0 AS level, lang, place, size, leaf AS node FROM leaves
  UNION ALL
  SELECT level + 1, lang, place // 2, (size + 1) // 2, sha256(string_agg(node, '' ORDER BY place))
  FROM nodes WHERE size > 1 GROUP BY level, lang, place // 2, size
),
subroots AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS size
  FROM nodes WHERE size = 1
),
tops AS (
  SELECT 0 AS level, place, size, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (size + 1) // 2, sha256(string_agg(node, '' ORDER BY place))
  FROM tops WHERE size > 1 GROUP BY level, place // 2, size
),
steps AS (
  SELECT row_no, row_number() OVER (PARTITION BY row_no ORDER BY part, level) AS step, sibling, odd
  FROM (
    SELECT l.row_no, 0 AS part, own.level, other.node AS sibling, own.place % 2 = 1 AS odd
    FROM leaves l
    JOIN nodes own ON own.lang IS NOT DISTINCT FROM l.lang AND own.place = l.place >> own.level AND own.size > 1
    LEFT JOIN nodes other ON other.lang IS NOT DISTINCT FROM l.lang AND other.level = own.level
      AND other.place = xor(own.place, 1)
    UNION ALL
    SELECT l.row_no, 1, own.level, other.node, own.place % 2 = 1
    FROM leaves l
    JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
    JOIN tops own ON own.place = s.place >> own.level AND own.size > 1
    LEFT JOIN tops other ON other.level = own.level AND other.place = xor(own.place, 1)
  )
),
proofs AS (
  SELECT row_no, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256, count(step) AS steps
  FROM leaves LEFT JOIN steps USING (row_no) GROUP BY row_no
),
folded AS (
  SELECT row_no, 0::BIGINT AS step, shown AS node FROM leaves
  UNION ALL
  SELECT f.row_no, s.step, sha256(CASE WHEN s.odd THEN coalesce(s.sibling, '') || f.node ELSE f.node || coalesce(s.sibling, '') END)
  FROM folded f JOIN steps s ON s.row_no = f.row_no AND s.step = f.step + 1
)
SELECT l.doc_id, l.leaf, s.subroot, r.node AS root, p.proof_sha256, f.node AS folded_root, f.node = r.node AS verified
FROM leaves l
JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
JOIN proofs p USING (row_no)
JOIN folded f ON f.row_no = l.row_no AND f.step = p.steps
JOIN (SELECT node FROM tops WHERE size = 1) r ON TRUE
"""


# Letters here have one byte, or two of which the first is 195.
_RUN_CODES = """flatten(list_transform(string_split(doc_id || ':' || run, ''),
      lambda sign: CASE WHEN ord(sign) < 128 THEN [ord(sign)] ELSE [195, ord(sign) - 64] END))"""

_SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc_id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{5,}}')) AS run
    FROM documents
  ) GROUP BY doc_id, run
),
checked AS (SELECT run, times, {_crc32(_RUN_CODES)} AS h FROM runs),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM checked
  ) WHERE length(word) >= 5 GROUP BY word HAVING n >= 3
),
less AS (
  SELECT word, gap, substr(word, 1, gap - 1) || substr(word, gap + 1) AS rest
  FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS gap)
),
pairs AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.gap = b.gap AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest
),
judged AS (
  SELECT p.word, count(*) AS n_near, arg_min(p.near, (-b.n, p.near)) AS best, max(b.n) AS most
  FROM pairs p JOIN words b ON b.word = p.near GROUP BY p.word
),
formed AS (
  SELECT w.word, w.n, coalesce(j.n_near, 0) AS n_near,
    CASE WHEN j.most >= 2 * w.n THEN j.best END AS form, CASE WHEN j.most >= 2 * w.n THEN j.most END AS form_n
  FROM words w LEFT JOIN judged j USING (word)
),
ways AS (
  SELECT word, word AS last FROM words
  UNION ALL SELECT y.word, f.form FROM ways y JOIN formed f ON f.word = y.last WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, y.last AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN ways y USING (word) JOIN formed e ON e.word = y.last AND e.form IS NULL
"""


def statements() -> dict[str, str]:
    rounds = ",".join(_MIX_ROUND.format(n=n, before=n - 1) for n in range(1, _MIX_ROUNDS + 1))
    return {"op10_mixing": _MIX.format(rounds=rounds, last=_MIX_ROUNDS), "op12_merkle": _MERKLE, "op13_spelling": _SPELLING}
