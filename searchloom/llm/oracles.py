"""The same results as the registered queries, in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from searchloom.llm import chat, quality

_UPPER, _LOWER = quality.UPPER, quality.LOWER
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = "list_filter(string_split_regex(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _escaped(text: str) -> str:
    """The text as the chat template escapes it, with one character for each that escaping adds."""
    whole = f"replace({text}, chr(27), chr(27) || chr(27))"
    controls = "|".join("".join("\\" + c if c in "[]/" else c for c in s) for s in chat.Template().controls)
    return f"regexp_replace({whole}, '({controls})', '\\1' || chr(27), 'g')"


def _op2() -> str:
    template = chat.Template()
    marks = " ".join(f"WHEN '{role}' THEN {sum(map(len, pair))}" for role, pair in template.marks.items())
    other = len(template.other[0]) - len("{role}") + len(template.other[1])
    follows = " OR ".join(f"(before = '{a}' AND role = '{b}')" for a, bs in template.moves.items() for b in bs)
    ends = ", ".join(f"'{x}'" for x in template.final)
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
seen AS (SELECT *, coalesce(lag(role) OVER o, '') AS before, lead(role) OVER o IS NULL AS ended FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped('text')}) + CASE role {marks} ELSE {other} + length({_escaped('role')}) END)::BIGINT AS formatted_chars,
  bool_and(({follows}) AND (NOT ended OR role IN ({ends}))) AS valid
FROM seen GROUP BY conv_id"""


_OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY ALL"""


def _op4() -> str:
    number = lambda chars: f"length(solid) - length(translate(solid, '{chars.replace(chr(39), chr(39) * 2)}', ''))"
    groups = [quality.LOWER, quality.UPPER, quality.DIGITS, quality.PROSE, quality.SYMBOLS, quality.OTHER_ASCII]
    classes = [number(g) for g in groups] + ["length(solid) - (" + " + ".join(f"({number(g)})" for g in groups) + ")"]
    symbols = quality.SYMBOLS
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS.format('text')} AS w FROM documents),
low AS (SELECT doc_id, lang, unnest(list_transform(w, lambda x: translate(x, '{_UPPER}', '{_LOWER}'))) AS word FROM t),
listed AS (SELECT DISTINCT word FROM (SELECT lang, word, count(DISTINCT doc_id) AS n FROM low WHERE lang IS NOT NULL GROUP BY lang, word QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(DISTINCT doc_id) DESC, word) <= {quality.TOP_WORDS})),
said AS (SELECT doc_id, word, count(*) AS x FROM low JOIN listed USING (word) GROUP BY ALL),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS m FROM (
        SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)))
    WHERE m > 1) GROUP BY doc_id),
base AS (
  SELECT t.doc_id, lang, array_to_string(w, '') AS solid, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(translate(text, '{symbols}', '')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: trim(x, {_BLANKS}) <> '')) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x, {_BLANKS}) <> ''))) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed
  FROM t LEFT JOIN rep USING (doc_id)),
long AS (SELECT doc_id, 'classes' AS kind, unnest(range({len(classes)}))::VARCHAR AS i, unnest([{', '.join(classes)}])::DOUBLE AS x, word_chars::DOUBLE AS total FROM base
  UNION ALL SELECT base.doc_id, 'common', word, coalesce(x, 0)::DOUBLE, n_words::DOUBLE FROM base JOIN listed ON true LEFT JOIN said USING (doc_id, word)
  UNION ALL SELECT doc_id, 'common', '', (n_words - coalesce(n, 0))::DOUBLE, n_words::DOUBLE FROM base LEFT JOIN (SELECT doc_id, sum(x) AS n FROM said GROUP BY doc_id) USING (doc_id)),
refs AS (SELECT lang, kind, i, sum(x) / sum(sum(x)) OVER (PARTITION BY lang, kind) AS q FROM long JOIN base USING (doc_id)
  WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang, kind, i),
bits AS (SELECT doc_id, lang, kind, sum(CASE WHEN x > 0 THEN x / total * log2(x / total / ((x / total + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((x / total + q) / 2)) ELSE 0 END) / 2 AS js
  FROM long JOIN refs USING (kind, i) WHERE total > 0 GROUP BY doc_id, lang, kind),
near AS (SELECT doc_id, min(d) AS d FROM (SELECT doc_id, lang, avg(sqrt(greatest(js, 0))) AS d FROM bits GROUP BY doc_id, lang) GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {quality.MIN_WORDS} OR coalesce(d <= {quality.MAX_DISTANCE}, true)) AS kept
FROM base LEFT JOIN near USING (doc_id)"""


_OP7 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY v ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
kept AS (SELECT s.doc_id, string_agg(s.x, ' ' ORDER BY s.p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM w) s ANTI JOIN gone ON s.doc_id = gone.doc_id AND s.p = gone.p GROUP BY s.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

_OP8 = f"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id"""

_DIGITS = " || ".join(f"to_base(('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT, 32, 4)" for i in range(8))
_OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, translate(upper({_DIGITS}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d"""


_OP12 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, string_split(t, chr(10)) AS l, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
n AS (SELECT *, (len(l) - 1 + CASE WHEN l[-1] <> '' THEN 1 ELSE 0 END)::BIGINT AS n,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS k1, greatest(h1 % (n + 1), h2 % (n + 1)) AS k2 FROM n),
c AS (SELECT *, CASE WHEN k1 >= n THEN length(t) ELSE length(array_to_string(l[1:k1], chr(10))) + least(k1, 1) END AS a,
  CASE WHEN k2 >= n THEN length(t) ELSE length(array_to_string(l[1:k2], chr(10))) + least(k2, 1) END AS b FROM k),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": _op2(), "op3_ngram_jaccard": _OP3, "op4_quality_divergence": _op4(), "op7_substring_dedup": _OP7, "op8_line_dedup": _OP8, "op10_warc": _OP10, "op12_fill_in_middle": _OP12}
