"""DuckDB SQL for the operators that SQL can express, over whole tables."""

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT doc_id, source, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT *, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '{_SPACE}', ' ', 'g'), ' ') AS k
  FROM (SELECT doc_id, source, text, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORD}')),
freq AS (SELECT source, k FROM ln GROUP BY source, k HAVING count(DISTINCT text) > 20),
lost AS (SELECT doc_id, sum(len(regexp_extract_all(x, '{_WORD}'))) AS n FROM ln JOIN freq ON ln.source IS NOT DISTINCT FROM freq.source AND ln.k = freq.k GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM ln GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_frequent_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND NOT (n_frequent_words > 0 AND n_words - n_frequent_words < 10) AS kept FROM f
"""

TEMPLATES = rf"""
WITH lines AS (SELECT doc_id, text, line, place, regexp_extract_all(line, '{_WORD}') AS w
  FROM (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents)),
shaped AS (SELECT *, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS s FROM lines),
seen AS (SELECT DISTINCT s, len(s) AS n, s[1] AS a, s[2] AS b, text FROM shaped WHERE len(s) > 0),
leaves AS (SELECT n, a, b FROM seen GROUP BY n, a, b HAVING count(DISTINCT text) > 20),
shapes AS (SELECT s, n, a, b, count(*) AS docs FROM seen SEMI JOIN leaves ON seen.n = leaves.n AND seen.a = leaves.a AND seen.b IS NOT DISTINCT FROM leaves.b GROUP BY s, n, a, b),
places AS (SELECT s, n, a, b, docs, unnest(s) AS token, generate_subscripts(s, 1) AS place FROM shapes),
fixed AS (SELECT n, a, b, place, token FROM places WHERE token <> '<*>' GROUP BY n, a, b, place, token HAVING sum(docs) > 20),
parts AS (SELECT p.s, p.n, p.a, p.b, string_agg(p.place || ' ' || p.token, ' ' ORDER BY p.place) AS k FROM places p JOIN fixed f ON p.n = f.n AND p.a = f.a AND p.b IS NOT DISTINCT FROM f.b AND p.place = f.place AND p.token = f.token
  GROUP BY p.s, p.n, p.a, p.b HAVING count(*) >= 0.7 * p.n),
often AS (SELECT parts.n, parts.a, parts.b, k FROM parts JOIN seen ON parts.s = seen.s GROUP BY parts.n, parts.a, parts.b, k HAVING count(DISTINCT text) > 20),
drops AS (SELECT s FROM parts SEMI JOIN often ON parts.n = often.n AND parts.a = often.a AND parts.b IS NOT DISTINCT FROM often.b AND parts.k = often.k),
marked AS (SELECT shaped.*, drops.s IS NOT NULL AS dropped FROM shaped LEFT JOIN drops ON shaped.s = drops.s),
docs AS (SELECT doc_id, any_value(text) AS text, count(*) FILTER (len(w) > 0) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '') AS rest FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, md5(CASE WHEN n_dropped > 0 THEN rest ELSE text END) AS text_md5 FROM docs
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * both_n >= 90 * (x.n + y.n - both_n)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""

#: The table of crc32, made by its rule.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, i::BIGINT)) AS t)"
_HEX = "0123456789ABCDEF"


def _crc(x: str) -> str:
    byte = f"((instr('{_HEX}', hex({x})[2 * i + 1]) - 1) * 16 + instr('{_HEX}', hex({x})[2 * i + 2]) - 1)::BIGINT"
    return f"xor(list_reduce(list_transform(range(strlen({x})), lambda i: {byte}), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, k, {_crc("concat(id, ':', run)")} AS h FROM runs, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN concat(left(run, (h % length(run))::INT), substr(run, (h % length(run) + 2)::INT)) ELSE run END AS word, k FROM hashed),
w AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
short AS (SELECT word, n, i, concat(left(word, i::INT), substr(word, i::INT + 2)) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM short a JOIN short b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM short a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM short a JOIN w b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, min((-m, other)) AS best FROM pairs GROUP BY word),
form AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best[1] >= 10 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 10 * n THEN -best[1] END::BIGINT AS form_n FROM w LEFT JOIN near USING (word)),
steps AS (SELECT word, word AS root FROM form UNION ALL SELECT s.word, f.form FROM steps s JOIN form f ON s.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, root FROM steps WHERE root IN (SELECT word FROM form WHERE form IS NULL))
SELECT word, form, root, n, n_near, form_n FROM form JOIN roots USING (word)
"""

_SOLID = r"[^\x20\x09-\x0D]"


def _way(x: str, cost: str, letter: str, line: str | None) -> str:
    """A repair x = (c, a, t: cost, audit, lines) one edit further."""
    text = f"{x}.t" if line is None else f"CASE WHEN {x}.t IS NULL THEN {line} ELSE concat({x}.t, chr(10), {line}) END"
    return f"struct_pack(c := {x}.c + {cost}, a := concat({x}.a, '{letter}'), t := {text})"


def _repair_step() -> str:
    """Repairs by what may come next (n: nothing yet, s: after system, a: an assistant, u: a pair is done) after row r, without insertions."""
    fine, more, first = "r.fault NOT IN (1, 2)", "CASE WHEN r.fault = 3 THEN 5 ELSE 0 END", "left(r.role, 1)"
    own = "concat(r.role, ':', r.text)"
    none = "struct_pack(c := 1000000000::BIGINT, a := '', t := NULL::VARCHAR)"
    gone = {k: _way(f"z.{k}", "2", "D", None) for k in "nsau"}
    kept = lambda k, i: f"CASE WHEN {fine} AND {first} = '{i}' THEN {_way(f'z.{k}', more, 'K', own)} ELSE {none} END"
    other = lambda k, i, name: f"CASE WHEN {fine} AND {first} <> '{i}' THEN {_way(f'z.{k}', '1 + ' + more, 'R', f"""concat('{name}:', r.text)""")} ELSE {none} END"
    to_a = [gone["a"], *[x for k in "nsu" for x in (kept(k, "u"), other(k, "u", "user"))]]
    to_u = [gone["u"], kept("a", "a"), other("a", "a", "assistant")]
    return f"struct_pack(n := {gone['n']}, s := least({gone['s']}, {kept('n', 's')}), a := least({', '.join(to_a)}), u := least({', '.join(to_u)}))"


def _inserted(z: str) -> str:
    """The same with insertions of a user, then of an assistant."""
    user = ", ".join(["q.a", *[_way(f"q.{k}", "5", "I", "'user:'") for k in "nsu"]])
    assistant = _way("q.a", "5", "I", "'assistant:'")
    one = f"list_transform([{z}], lambda q: struct_pack(n := q.n, s := q.s, a := least({user}), u := q.u))"
    return f"list_transform({one}, lambda q: struct_pack(n := q.n, s := q.s, a := q.a, u := least(q.u, {assistant})))[1]"


_NO_WAY = "struct_pack(c := 1000000000::BIGINT, a := '', t := NULL::VARCHAR)"

REPAIR = rf"""
WITH {_CRC_TABLE},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, {_crc("k")} % 20 AS kind FROM keyed, crc),
made AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS place FROM made),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{_SOLID}') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
  concat(left(lag(role) OVER (PARTITION BY conv_id ORDER BY place), 1), left(role, 1)) NOT IN ('su', 'ua', 'au') AND place > 1 AS illegal FROM placed),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (illegal) AS illegal, list(struct_pack(role, text, fault) ORDER BY place) AS rows FROM judged GROUP BY conv_id),
everyone AS (SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(rows, []) AS rows
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told ON c.conv_id IS NOT DISTINCT FROM told.conv_id),
parsed AS (SELECT *, list_reduce(rows, lambda z, r: {_inserted(_repair_step())}, {_inserted(f"struct_pack(n := struct_pack(c := 0::BIGINT, a := '', t := NULL::VARCHAR), s := {_NO_WAY}, a := {_NO_WAY}, u := {_NO_WAY})")}) AS z FROM everyone),
best AS (SELECT *, least(z.n, z.u) AS b FROM parsed)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, b.c AS cost, b.a AS audit, sha256(coalesce(b.t, '')) AS repaired_sha256 FROM best
"""
