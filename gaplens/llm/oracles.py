"""DuckDB SQL for the queries that SQL can express, over the same tables.

Written apart from the operators: nothing here is computed by their code. Only the licence
templates, a parameter of operator 9, are shared.
"""

from __future__ import annotations

from gaplens.llm.licenses import TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def _lowered(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


OP2 = rf"""
WITH bodies AS (
  SELECT doc_id, text, regexp_extract(coalesce(text, ''), '^{_WS}*') AS lead FROM documents
), cut AS (
  SELECT doc_id, lead, list_filter(string_split(regexp_replace(substring(text, length(lead) + 1), '([.!?]{_WS}+|{_WS}*\n{_WS}*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts
  FROM bodies WHERE regexp_matches(coalesce(text, ''), '{_WORD}')
), sentences AS (
  SELECT doc_id, i, CASE WHEN i = 1 THEN lead || parts[i] ELSE parts[i] END AS part, regexp_extract_all({_lowered("parts[i]")}, '{_WORD}') AS words
  FROM cut, unnest(range(1, len(parts) + 1)) t(i)
), runs AS (
  SELECT doc_id, i, array_to_string(words, ' ') || ' ' || lead(array_to_string(words, ' ')) OVER w AS run, lead(i) OVER w AS next FROM sentences WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), copies AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS place FROM runs WHERE next IS NOT NULL) WHERE place > 1
), steps AS (
  SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) < 2 THEN 0 ELSE 1 END AS opens FROM copies
), stretches AS (
  SELECT doc_id, min(i) AS a, max(i) + 1 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM steps) GROUP BY doc_id, g
), long AS (
  SELECT s.doc_id, s.a, s.b FROM stretches s JOIN sentences t ON s.doc_id = t.doc_id AND t.i BETWEEN s.a AND s.b GROUP BY ALL HAVING sum(len(t.words)) >= 24
), marked AS (
  SELECT t.doc_id, t.i, t.part, bool_or(l.a IS NOT NULL) AS gone FROM sentences t LEFT JOIN long l ON t.doc_id = l.doc_id AND t.i BETWEEN l.a AND l.b GROUP BY ALL
), done AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS lost, string_agg(part, '' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id
)
SELECT b.doc_id, coalesce(d.n, 0) AS n_sentences, coalesce(d.lost, 0) AS n_removed,
  sha256(CASE WHEN coalesce(d.lost, 0) = 0 THEN coalesce(b.text, '') ELSE coalesce(d.kept, '') END) AS kept_sha256
FROM bodies b LEFT JOIN done d USING (doc_id)
"""


def _op3(flatten: float = 0.7, keep: float = 0.8, seed: int = 7, rounds: int = 25) -> str:
    dims = ("source", "lang", "topic")
    steps = []
    for k in range(rounds):
        for j, d in enumerate(dims):
            before = "cells" if not k + j else f"w{3 * k + j}"
            weight = "tokens::DOUBLE" if not k + j else "weight"
            steps.append(f"w{3 * k + j + 1} AS (SELECT c.* REPLACE (coalesce({weight} * s.share * total / nullif(sum({weight}) OVER (PARTITION BY {d}), 0), 0) AS weight) FROM {before} c JOIN share_{d} s USING ({d}))")
    shares = [f"share_{d} AS (SELECT {d}, x / sum(x) OVER () AS share FROM (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE, {flatten}) ELSE 0 END AS x FROM cells GROUP BY {d}))" for d in dims]
    symbols = "0123456789#*$%&|<>{}=_@"
    return rf"""
WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN coalesce(text, '') = '' THEN '' WHEN 100 * (length(text) - length(translate(text, '{symbols}', ''))) >= 3 * length(text) THEN 'technical'
      WHEN length(text) < 60 * (length(text) - length(replace(text, chr(10), '')) + 1) THEN 'listing' ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS tokens,
    ('0x' || substring(md5('{seed}|' || doc_id || '|' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin
  FROM documents
), cells AS (
  SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, sum(sum(tokens)) OVER ()::DOUBLE AS total, 0.0::DOUBLE AS weight FROM rows GROUP BY ALL
), {", ".join(shares)}, {", ".join(steps)}, raked AS (
  SELECT *, CASE WHEN tokens > 0 THEN weight / tokens END AS ratio FROM w{3 * rounds}
), scales AS (
  SELECT ({keep} * total - coalesce(sum(tokens) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale, ratio FROM raked WHERE tokens > 0 AND weight > 0
), chosen AS (
  SELECT greatest({keep}, min(scale)) AS scale FROM (SELECT scale FROM scales WHERE ratio * scale < 1 ORDER BY ratio DESC LIMIT 1)
), fitted AS (
  SELECT r.*, round(coalesce(least(1.0, ratio * scale), 1.0), 6) AS p6, round(coalesce(ratio * {keep}, 1.0), 4) AS copies4 FROM raked r, chosen
), given AS (
  SELECT *, round(tokens / sum(tokens) OVER (), 6) AS observed, round(weight / sum(weight) OVER (), 6) AS target, round(tokens * p6 / sum(tokens * p6) OVER (), 6) AS once_share FROM fitted
)
SELECT doc_id, source, lang, topic, r.tokens AS n_tokens, copies4 AS weight, floor(copies4)::BIGINT + (coin < copies4 - floor(copies4))::BIGINT AS copies,
  round(p6, 4) AS p, coin < p6 AS sampled, observed, target, once_share
FROM rows r JOIN given g USING (source, lang, topic)
"""


OP4 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_lowered("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), both_have AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM both_have JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), least_of AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON a = w.doc_id
"""

OP7 = r"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS t(i)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), counted AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, coalesce(c.keeper <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN counted c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_RULES = {
    "symbols": "least(100, coalesce(100 * n_symbols // nullif(word_chars, 0), 0))",
    "dup_lines": "least(100, coalesce(100 * n_dup_lines // nullif(n_word_lines, 0), 0))",
    "repeats": "least(100, coalesce(100 * n_repeat_words // nullif(n_words, 0), 0))",
    "word_length": "least(100, coalesce(word_chars // nullif(n_words, 0), 0))",
}


def _op8(risk: float = 0.02, error: float = 0.05, passes: int = 4) -> str:
    rules = len(_RULES)
    values = " UNION ALL ".join(f"SELECT doc_id, lang, good, '{k}' AS rule, {v} AS value FROM labelled" for k, v in _RULES.items())
    rounds = []
    for i in range(passes):
        done = "0" if not i else f"(SELECT count(*) FILTER (whole) FROM pass{i - 1})"
        rounds.append(
            f"pass{i} AS (SELECT grp, rule, min(CASE WHEN tail > level THEN NULL ELSE cutoff END) IS NOT NULL AND max(CASE WHEN tail > level THEN 1 ELSE 0 END) = 0 AS whole, "
            f"arg_max(cutoff, (round(value, 11), cutoff)) FILTER (tail <= level AND value > 1e-12) AS cutoff "
            f"FROM (SELECT *, {error} / greatest(1, (SELECT count(*) FROM (SELECT DISTINCT grp, rule FROM tails)) - {done}) AS level FROM tails) GROUP BY grp, rule)"
        )
    kept = " AND ".join(f"NOT coalesce({v} >= (SELECT c.cutoff FROM pass{passes - 1} c WHERE c.grp = s.grp AND c.rule = '{k}'), false)" for k, v in _RULES.items())
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM texts, unnest(range(1, len(w) - 1)) t(i)
), repeats AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM windows, unnest([0, 1, 2]) u(j) WHERE c > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS again FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id
), stats AS (
  SELECT t.doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(l.again, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_word_lines
  FROM texts t LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)
), labelled AS (
  SELECT s.*, good FROM stats s JOIN (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) USING (doc_id) WHERE n_words > 0
), strata AS (
  SELECT lang, sum(good) AS n_good FROM labelled GROUP BY lang
), groups AS (
  SELECT lang, CASE WHEN n_good >= ceil(ln({error} / ((SELECT count(*) FROM strata) * {rules})) / ln(1 - {risk})) THEN 'own ' || lang ELSE 'pooled' END AS grp FROM strata
), counts AS (
  SELECT grp, rule, value, sum(good) AS good, sum(1 - good) AS bad FROM ({values}) JOIN groups USING (lang) GROUP BY ALL
), sums AS (
  SELECT grp, rule, sum(good)::BIGINT AS n, sum(bad)::BIGINT AS n_bad FROM counts GROUP BY ALL
), cuts AS (
  SELECT s.grp, s.rule, s.n, s.n_bad, k AS cutoff, coalesce(sum(good), 0)::BIGINT AS lost, coalesce(sum(bad), 0)::BIGINT AS caught
  FROM sums s CROSS JOIN range(1, 101) t(k) LEFT JOIN counts c ON c.grp = s.grp AND c.rule = s.rule AND c.value >= k GROUP BY ALL
), tails AS (
  SELECT grp, rule, cutoff, caught / greatest(n_bad, 1) - 10 * lost / nullif(n, 0) AS value,
    CASE WHEN n = 0 THEN 2 ELSE list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) END AS tail
  FROM cuts
), {", ".join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_word_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {kept} AS kept
FROM (SELECT stats.*, grp FROM stats LEFT JOIN groups USING (lang)) s
"""


def _op9(least: float = 0.6, rare: float = 0.005) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))
    named = "(?i)licen[cs]e|copyright|spdx|permission is hereby|redistribution and use|all rights reserved"
    term = r"(?:spdx-license-identifier:\s*)?[a-z0-9]+(?:[.-][a-z0-9]+)*"
    terms = lambda text: rf"list_transform(regexp_extract_all(lower({text}), '{term}'), lambda t: regexp_replace(t, ':\s*', ':', 'g'))"
    return rf"""
WITH texts AS (
  SELECT doc_id, text, CASE WHEN doc_id // 20 % 10 = 0 THEN concat_ws('/', coalesce(source, ''), doc_id // 2000, 'LICENSE') ELSE concat_ws('/', coalesce(source, ''), doc_id // 2000, doc_id // 20 % 3, 'doc-' || doc_id || '.txt') END AS path FROM documents
), units AS (
  SELECT DISTINCT doc_id, u FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM texts
    UNION ALL SELECT doc_id, u FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r\f\x0B]*\n[ \t\n\r\f\x0B]*')) AS u FROM texts) WHERE contains(u, chr(10))
  ) WHERE regexp_matches(u, '{named}')
), tf AS (
  SELECT doc_id, u, term, count(*) AS tf FROM (SELECT doc_id, u, unnest({terms("u")}) AS term FROM units) GROUP BY ALL
), n AS (
  SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT doc_id, u FROM tf)
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), templates(k, name, body) AS (
  VALUES {rows}
), raw AS (
  SELECT k, name, term, (1 + ln(count(*))) * (1 - ln(greatest({rare}, coalesce(any_value(df), 0) / (SELECT greatest(1, n) FROM n)))) AS w
  FROM (SELECT k, name, unnest({terms("body")}) AS term FROM templates) LEFT JOIN df USING (term) GROUP BY k, name, term
), vectors AS (
  SELECT k, name, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS t FROM raw
), weighed AS (
  SELECT doc_id, u, term, (1 + ln(tf)) * (1 - ln(greatest({rare}, df / (SELECT n FROM n)))) AS w FROM tf JOIN df USING (term)
), norms AS (
  SELECT doc_id, u, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL
), scored AS (
  SELECT doc_id, name, round(sum(w * t) / any_value(norm), 6) AS score FROM weighed JOIN norms USING (doc_id, u) JOIN vectors USING (term) GROUP BY doc_id, u, k, name
), best AS (
  SELECT doc_id, arg_min(name, (-score, name)) AS own_license, max(score) AS own_score FROM scored GROUP BY doc_id HAVING max(score) >= {least}
), files AS (
  SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, ends_with(path, '/LICENSE') AS is_file, own_license, own_score FROM texts LEFT JOIN best USING (doc_id)
), given AS (
  SELECT dir, arg_min(own_license, (-own_score, own_license)) AS lic FROM files WHERE is_file AND own_license IS NOT NULL GROUP BY dir
), nearest AS (
  SELECT f.dir, arg_max(g.lic, length(g.dir)) AS lic, arg_max(g.dir, length(g.dir)) AS frm FROM (SELECT DISTINCT dir FROM files) f JOIN given g ON f.dir = g.dir OR starts_with(f.dir, g.dir || '/') GROUP BY f.dir
)
SELECT doc_id, path, own_license, own_score, lic AS inherited_license, frm AS inherited_from, coalesce(own_license, lic) AS license FROM files LEFT JOIN nearest USING (dir)
"""


#: What numpy writes before the 256 bytes of a 16 x 16 tile of 8-bit numbers: 128 bytes in all.
_NPY = r"\x93NUMPY\x01\x00v\x00{\x27descr\x27: \x27|u1\x27, \x27fortran_order\x27: False, \x27shape\x27: (16, 16), }" + " " * 56 + r"\x0A"

OP10 = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(0, 256) r(i)
), payloads AS (
  SELECT doc_id, octet_length(raw) AS n, greatest(1, (octet_length(raw) + 63) // 64) AS h, raw || repeat('\x00'::BLOB, (greatest(1, (octet_length(raw) + 63) // 64) * 64 - octet_length(raw))::BIGINT) AS payload
  FROM (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents)
), media AS (
  SELECT *, encode(concat('P5', chr(10), '64 ', h, chr(10), '255', chr(10))) || payload AS file, regexp_extract_all(hex(payload), '..') AS hexes FROM payloads
), numbers AS (
  SELECT doc_id, h, unnest(list_transform(hexes, lambda x: strpos('0123456789ABCDEF', x[1]) * 16 + strpos('0123456789ABCDEF', x[2]) - 17)) AS v, unnest(range(0, len(hexes))) AS p FROM media
), rows_of AS (
  SELECT doc_id, h, p // 64 AS r, p % 64 AS c, v FROM numbers
), eighths AS (
  SELECT doc_id, h, i, c, sum(v * (least(8 * r + 8, h * (i + 1)) - greatest(8 * r, h * i))) AS s
  FROM rows_of, unnest(range(8 * r // h, (8 * r + 7) // h + 1)) a(i) GROUP BY ALL
), boxes AS (
  SELECT doc_id, i, j, round(sum(s * (least(9 * c + 9, 64 * (j + 1)) - greatest(9 * c, 64 * j)))::DOUBLE / (h * 64), 6) AS m
  FROM eighths, unnest(range(9 * c // 64, (9 * c + 8) // 64 + 1)) b(j) GROUP BY doc_id, h, i, j
), bits AS (
  SELECT doc_id, i, string_agg(CASE WHEN after > m THEN '1' ELSE '0' END, '' ORDER BY j) AS b FROM (SELECT *, lead(m) OVER (PARTITION BY doc_id, i ORDER BY j) AS after FROM boxes) WHERE after IS NOT NULL GROUP BY ALL
), features AS (
  SELECT doc_id, string_agg(lower(printf('%02x', list_sum(list_transform(range(1, 9), lambda k: CASE WHEN b[k] = '1' THEN (1 << (8 - k)::INTEGER) ELSE 0 END))::BIGINT)), '' ORDER BY i) AS feature FROM bits GROUP BY doc_id
), sixteenths AS (
  SELECT doc_id, h, i, c // 4 AS j, sum(v * (least(16 * r + 16, h * (i + 1)) - greatest(16 * r, h * i))) AS s
  FROM rows_of, unnest(range(16 * r // h, (16 * r + 15) // h + 1)) a(i) GROUP BY ALL
), tiles AS (
  SELECT doc_id, unhex(string_agg(printf('%02X', round_even(round(s::DOUBLE / (4 * h), 6), 0)::BIGINT), '' ORDER BY i, j)) AS tile FROM sixteenths GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, h * 64 AS payload_bytes, sha256(payload) AS payload_sha256,
  xor(4294967295, list_reduce(list_transform(hexes[len(hexes) - 63 :], lambda x: (strpos('0123456789ABCDEF', x[1]) * 16 + strpos('0123456789ABCDEF', x[2]) - 17)::BIGINT), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295))::BIGINT AS tail_crc32,
  octet_length(file) AS media_bytes, sha256(file) AS media_sha256, feature, sha256('{_NPY}'::BLOB || tile) AS tile_sha256
FROM media JOIN features USING (doc_id) JOIN tiles USING (doc_id), crc_table
"""

OP11 = rf"""
WITH rows AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_lowered("coalesce(text, '')")} AS text FROM documents
), tokens AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows
), kept AS (
  SELECT lang, term FROM tokens GROUP BY ALL HAVING count(DISTINCT id) >= 30
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM rows) g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), whole AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM grid GROUP BY lang, term
), shares AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS p FROM grid WINDOW w AS (PARTITION BY lang, source)
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM (SELECT DISTINCT lang, source FROM rows) a JOIN (SELECT DISTINCT lang, source FROM rows) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), over_share AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM over_share)
QUALIFY part = 'pair' OR rank <= 50
"""

def _op12() -> str:
    far = "{'c': 1000000000::BIGINT, 'a': '', 'r': ''}"
    arc = lambda state, cost, letter, line="''": f"{{'c': ({state}.c + {cost})::BIGINT, 'a': {state}.a || '{letter}', 'r': {state}.r || {line}}}"
    may = lambda when, what: f"CASE WHEN {when} THEN {what} ELSE {far} END"
    least = lambda *found: f"list_sort([{', '.join(found)}])[1]"
    line = "chr(10) || o.role || ':' || o.text"
    as_role = lambda role: f"chr(10) || '{role}:' || o.text"
    empty = lambda role: f"chr(10) || '{role}:'"
    kept = lambda state, initial: may(f"NOT must AND initial = '{initial}'", arc(state, "more", "K", line))
    named = lambda state, role: may("NOT must", arc(state, "3 + more", "R", as_role(role)))
    user = [x for state in ("n", "s", "a") for x in (kept(state, "u"), named(state, "user"))]
    return rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(0, 256) r(i)
), drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295)) % 20 AS kind
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, role[1] AS initial FROM damaged
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM ordered
), counted AS (
  SELECT conv_id, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), steps AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS n, {far} AS s, {{'c': 3::BIGINT, 'a': 'I', 'r': chr(10) || 'user:'}} AS u, {{'c': 6::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS a
  FROM counted
  UNION ALL
  SELECT conv_id, i, n, s, u, {least("a", arc("u", 3, "I", empty("assistant")))} AS a FROM (
    SELECT conv_id, i, n, s, a, {least("u", *(arc(state, 3, "I", empty("user")) for state in ("n", "s", "a")))} AS u FROM (
      SELECT p.conv_id, o.i, {arc("n", 4, "D")} AS n, {least(arc("s", 4, "D"), kept("n", "s"))} AS s, {least(arc("u", 4, "D"), *user)} AS u, {least(arc("a", 4, "D"), kept("u", "a"), named("u", "assistant"))} AS a
      FROM steps p JOIN (SELECT conv_id, i, role, text, initial, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM faults) o
      ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.i = p.i + 1
    )
  )
), ends AS (
  SELECT p.conv_id, {least("n", "a")} AS e FROM steps p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = c.size
)
SELECT t.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(substring(e.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) t LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN ends d ON d.conv_id IS NOT DISTINCT FROM t.conv_id
"""


ORACLES: dict[str, str] = {
    "op2_substring_dedup": OP2,
    "op3_source_mixing": _op3(),
    "op4_ngram_join": OP4,
    "op7_line_dedup": OP7,
    "op8_quality_rules": _op8(),
    "op9_license_scan": _op9(),
    "op10_media_columns": OP10,
    "op11_source_divergence": OP11,
    "op12_conversation_repair": _op12(),
}
