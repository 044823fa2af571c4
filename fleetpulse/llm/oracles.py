"""DuckDB SQL for the queries whose results SQL can state on whole tables."""

from __future__ import annotations

from fleetpulse.llm.licenses import TEMPLATES
from fleetpulse.llm.quality import BASE_RULES, RULES, STOP_WORDS, WINDOW
from fleetpulse.llm.repeats import LEAST

QUOTED_STOP_WORDS = ", ".join(f"'{w}'" for s in STOP_WORDS for w in dict.fromkeys((s, s.capitalize())))


def _rule_sql(rule) -> str:
    size = rule.denominator or "1"
    parts = []
    if rule.low is not None:
        parts.append(f"100 * {rule.numerator} >= {rule.low} * {size}")
    if rule.high is not None:
        parts.append(f"100 * {rule.numerator} <= {rule.high} * {size}")
    return " AND ".join(parts)


def _all_hold(rules) -> str:
    return " AND ".join(f"({_rule_sql(r)})" for r in rules)


OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
places AS (SELECT doc_id, words, unnest(range(0, len(words) - {WINDOW - 1})) AS place FROM w),
windows AS (SELECT doc_id, place, list_slice(words, place + 1, place + {WINDOW}) AS gram FROM places),
twice AS (SELECT doc_id, place FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT word) AS n FROM
            (SELECT doc_id, unnest(range(place, place + {WINDOW})) AS word FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
             len(lines) AS n_lines,
             len(list_filter(words, lambda x: x IN ({QUOTED_STOP_WORDS}))) AS n_stop_words,
             len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
      FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       ({_all_hold(BASE_RULES + RULES)}) AS kept
FROM m
"""


def _template_rows() -> str:
    rows = []
    for t in TEMPLATES:
        words, key = (", ".join(f"'{w}'" for w in part) for part in (t.words, t.key_words))
        rows.append(f"('{t.label}', [{words}], [{key}], {t.key_at}, {t.base})")
    return ",\n".join(rows)


OP1 = rf"""
WITH templates(label, words, phrase, key_at, base) AS (VALUES {_template_rows()}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
vocabulary AS (SELECT DISTINCT unnest(words) AS word FROM templates),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY word),
idf AS (SELECT v.word, round(ln(((SELECT count(*) FROM d) + 1) / (coalesce(df.n, 0) + 1)) + 1, 9) AS idf
        FROM vocabulary v LEFT JOIN df ON df.word = v.word),
firsts AS (SELECT DISTINCT phrase[1] AS word FROM templates),
spots AS (SELECT doc_id, words, unnest(range(0, len(words))) AS start FROM d
       WHERE list_has_any(words, (SELECT list(word) FROM firsts))),
places AS (SELECT s.doc_id, s.words, start, label, t.words AS notice, key_at, base FROM spots s JOIN templates t
           ON s.words[start + 1] = t.phrase[1] AND list_slice(s.words, start + 1, start + len(phrase)) = phrase),
parts AS (SELECT doc_id, label, start, words, notice, key_at, unnest(range(0, len(notice))) AS i FROM places),
shares AS (SELECT doc_id, label, start,
           round(sum(CASE WHEN start + i - key_at >= 0 AND words[start + i - key_at + 1] = notice[i + 1] THEN idf ELSE 0 END)
                 / sum(idf), 6) AS share
           FROM parts JOIN idf ON idf.word = notice[i + 1] GROUP BY ALL),
best AS (SELECT doc_id, max(share) AS score FROM shares GROUP BY doc_id),
labels AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
           max(start) FILTER (base) AS last_word,
           coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN labels ON labels.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id
"""


_WORDS = r"""d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents)"""

OP4 = rf"""
WITH RECURSIVE {_WORDS},
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN
        list_transform(range(0, len(words) - 4), lambda i: array_to_string(list_slice(words, i + 1, i + 5), ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
           GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
pairs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, b.y FROM reach r JOIN pairs b ON r.other = b.x),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON least.doc_id = d.doc_id
"""

OP9 = rf"""
WITH {_WORDS},
w AS (SELECT doc_id, words, unnest(range(0, len(words) - {LEAST - 1})) AS s FROM d),
h AS (SELECT doc_id, s, md5(array_to_string(list_slice(words, s + 1, s + {LEAST}), ' ')) AS window_hash FROM w),
g AS (SELECT window_hash, min({{'a': doc_id, 'b': s}}) AS first_at FROM h GROUP BY window_hash HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, s, first_at <> {{'a': doc_id, 'b': s}} AS again FROM h JOIN g ON g.window_hash = h.window_hash),
i AS (SELECT *, sum(CASE WHEN s <= before + {LEAST} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS span
      FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM r)),
spans AS (SELECT doc_id, span, min(s) AS start_word, max(s) + {LEAST} AS end_word FROM i GROUP BY doc_id, span),
covered AS (SELECT doc_id, span, count(DISTINCT word) AS n FROM
            (SELECT doc_id, span, unnest(range(s, s + {LEAST})) AS word FROM i WHERE again) GROUP BY doc_id, span)
SELECT p.doc_id, CAST(start_word AS BIGINT) AS start_word, CAST(end_word AS BIGINT) AS end_word,
       CAST(coalesce(n, 0) AS BIGINT) AS cut_words
FROM spans p LEFT JOIN covered c ON c.doc_id = p.doc_id AND c.span = p.span
"""


OP11 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
      FROM q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

# The checksum's table of 256 values is built by its rule, then folded over the bytes of each distinct text.
OP12 = r"""
WITH RECURSIVE steps(i, c, k) AS (SELECT i, CAST(i AS BIGINT), 0 FROM range(256) t(i) UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS rule FROM steps WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
         FROM documents),
low AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
        FROM runs WHERE len(run) >= 6 GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(id || ':' || run)) AS h FROM low),
summed AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
               list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
               lambda c, b: xor(c >> 8, rule[xor(c & 255, b) + 1])), 4294967295) AS h FROM hexed, crc),
typed AS (SELECT n, CASE WHEN h % 199 = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word FROM summed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM v),
masked AS (SELECT word, i, word[1:i - 1] AS head, word[i + 1:] AS tail FROM holes),
near AS (SELECT a.word, b.word AS other FROM masked a JOIN masked b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
         UNION SELECT m.word, v.word FROM masked m JOIN v ON v.word = m.head || m.tail
         UNION SELECT v.word, m.word FROM masked m JOIN v ON v.word = m.head || m.tail),
ranked AS (SELECT near.word, other, b.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near
           FROM near JOIN v b ON b.word = other
           QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY b.n DESC, other) = 1),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form,
                 CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n FROM v LEFT JOIN ranked r ON r.word = v.word),
chain AS (SELECT word, word AS root, form AS next FROM forms UNION ALL
          SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""

OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
starts AS (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS s FROM w, range(1, 6) t(m)),
f AS (SELECT lang, m, array_to_string(words[s:s + m - 1], ' ') AS phrase, count(*) AS f FROM starts GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE m >= 2 AND f >= 100),
cuts AS (SELECT *, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail
         FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, a, l.f AS l, r.f AS r, n, k,
                  CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
           FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = tail
           JOIN total ON total.lang = cuts.lang
           QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, a, m, words, size, unnest(range(1, m - size + 2)) AS s FROM c, range(2, 5) t(size) WHERE size < m),
dropped AS (SELECT DISTINCT i.lang, c.phrase FROM inner_parts i JOIN c ON c.lang = i.lang AND
            c.phrase = array_to_string(i.words[s:s + size - 1], ' ') AND 100 * i.a >= 100 * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, score
FROM scored ANTI JOIN dropped USING (lang, phrase) QUALIFY rank <= 2000
"""
