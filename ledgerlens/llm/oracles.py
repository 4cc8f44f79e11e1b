"""SQL twins of the queries that SQL can express."""

# The word pattern of all text operators: runs of anything but space and 0x09-0x0D.
_WORDS = r"[^\x20\x09-\x0D]+"

ORACLES = {}

ORACLES["op9_substring_dedup"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word, len(ws) AS n FROM d
), windows AS (
  SELECT w.doc_id, w.i, md5(array_to_string(d.ws[w.i:w.i + 19], ' ')) AS h
  FROM words w JOIN d USING (doc_id) WHERE w.i + 19 <= w.n
), ranked AS (
  SELECT doc_id, i, (row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1)::INT AS again FROM windows
), covered AS (
  SELECT w.doc_id, w.i, w.word,
         sum(coalesce(r.again, 0)) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words w LEFT JOIN ranked r ON r.doc_id = w.doc_id AND r.i = w.i
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS text
  FROM covered GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

# The template's control strings, quoted for a pattern, and the lengths of its marks.
_CONTROL = r"<s>|</s>|<\|start\|>|<\|message\|>|<\|next\|>|<\|end\|>|\[INST\]|\[/INST\]"

ORACLES["op1_chat_formatting"] = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS i, coalesce(lag(role) OVER w = role, false) AS again FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), s AS (
  SELECT *, length(regexp_replace(text, '(\\*)({_CONTROL})', '\1\1\\\2', 'g')) AS n_text,
         length(regexp_replace(role, '(\\*)({_CONTROL})', '\1\1\\\2', 'g')) AS n_role FROM o
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + 5 + sum(n_text + CASE WHEN again THEN 9 ELSE 10 + 12 + 8 + n_role END))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

ORACLES["op10_temperature_mixing"] = rf"""
WITH RECURSIVE u AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(text, '')) AS key, count(*) AS copies,
         sum(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')))::BIGINT AS n_tokens
  FROM documents GROUP BY 1, 2, 3
), s AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM u GROUP BY 1
), p AS (SELECT source, total, total / sum(total) OVER () AS p FROM s WHERE total > 0
), halving AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN (low + high) / 2 ELSE low END, CASE WHEN good THEN high ELSE (low + high) / 2 END
  FROM (SELECT i, low, high, (SELECT ln(sum(pow(p, (low + high) / 2))) - (low + high) / 2 *
          sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) FROM p) >=
          0.95 * (SELECT ln(count(*)) FROM p) AS good
        FROM halving WHERE i < 30)
), a AS (
  SELECT CASE WHEN (SELECT -sum(p * ln(p)) FROM p) >= 0.95 * (SELECT ln(count(*)) FROM p) THEN 1.0
         ELSE (SELECT low FROM halving WHERE i = 30) END AS a
), q AS (
  SELECT p.*, pow(p, a) / sum(pow(p, a)) OVER () * sum(total) OVER () AS quota, sum(total) OVER () AS tokens FROM p, a
), f AS (
  SELECT s.source, s.total, coalesce(floor(round(quota / s.total, 9)), 1)::BIGINT AS full_,
         coalesce(round(quota - floor(round(quota / s.total, 9)) * s.total, 6), 0.0) AS rest,
         greatest(1, ceil(s.total / greatest(100000, ceil(coalesce(tokens, 0) / 65536))))::BIGINT AS blocks
  FROM s LEFT JOIN q USING (source)
), placed AS (
  SELECT u.*, total, full_, rest,
         ('0x' || substr(md5('1|' || coalesce(doc_id::VARCHAR, '') || '|' || key), 1, 8))::BIGINT % blocks AS block
  FROM u JOIN f USING (source)
), epochs AS (
  SELECT source, unnest(range(0, full_ + (rest > 0)::INT)) AS epoch FROM f
), sizes AS (SELECT source, block, sum(n_tokens) AS size FROM placed GROUP BY 1, 2
), offsets AS (
  SELECT source, block, epoch, coalesce(sum(size) OVER (PARTITION BY source, epoch
    ORDER BY md5('1|' || source || '|' || epoch || '|' || block), block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
  FROM sizes JOIN epochs USING (source)
), starts AS (
  SELECT d.*, epoch, before_ + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch, block
    ORDER BY md5('1|' || epoch || '|' || coalesce(doc_id::VARCHAR, '') || '|' || key), doc_id, key
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS within_
  FROM placed d JOIN offsets USING (source, block)
)
SELECT doc_id, source, copies::BIGINT AS copies, n_tokens, epoch::BIGINT AS epoch,
       (epoch * total + within_)::BIGINT AS start
FROM starts WHERE epoch < full_ OR within_ < rest
"""

ORACLES["op3_jaccard_join"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '{_WORDS}') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM d WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS label FROM d
  UNION SELECT l.v, r.label FROM reach r JOIN links l ON l.u = r.node WHERE r.label < l.v
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(label) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.node = d.doc_id GROUP BY d.doc_id, n
"""


def _counted(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_counted, (
        "doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"


# crc32 of an id, byte by byte and bit by bit, before its last inversion
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"""

ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN {_CRC} & 1 = 1 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS other
  FROM documents
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves
), up AS (
  SELECT src, 0 AS l, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT src, l + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
  FROM up WHERE n > 1 GROUP BY src, l, pos // 3, n
), subroots AS (
  SELECT src, h, count(*) OVER () AS n FROM up WHERE n = 1
), crown AS (
  SELECT 0 AS l, src AS pos, h, n FROM subroots
  UNION ALL
  SELECT l + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
  FROM crown WHERE n > 1 GROUP BY l, pos // 3, n
), nodes AS (
  SELECT src, l, pos, h, n FROM up WHERE n > 1
  UNION ALL SELECT -1, l, pos, h, n FROM crown WHERE n > 1
), sides AS (
  SELECT a.src, a.l, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM nodes a JOIN nodes b ON a.src = b.src AND a.l = b.l AND a.pos // 3 = b.pos // 3 GROUP BY a.src, a.l, a.pos
), steps AS (
  SELECT p.src, p.pos, s.l, s.before, s.after
  FROM placed p JOIN sides s ON s.src = p.src AND s.pos = p.pos // (3 ** s.l)::BIGINT
  UNION ALL
  SELECT p.src, p.pos, s.l + 1000, s.before, s.after
  FROM placed p JOIN sides s ON s.src = -1 AND s.pos = p.src // (3 ** s.l)::BIGINT
), ways AS (
  SELECT src, pos, string_agg(before || after, '' ORDER BY l) AS proof, list(before || '|' || after ORDER BY l) AS path
  FROM steps GROUP BY src, pos
), done AS (
  SELECT p.doc_id, p.leaf, r.h AS subroot, (SELECT h FROM crown WHERE n = 1) AS root,
         sha256(coalesce(w.proof, '')) AS proof_sha256,
         CASE WHEN w.path IS NULL THEN p.other ELSE list_reduce(list_prepend(p.other, w.path),
           lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) END AS folded_root
  FROM placed p JOIN subroots r USING (src) LEFT JOIN ways w USING (src, pos)
)
SELECT *, folded_root = root AS verified FROM done
"""
