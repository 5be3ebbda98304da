"""DuckDB SQL with the rows of those operators' queries that SQL can express."""

from __future__ import annotations

from quillmesh.llm.url_markov import ALPHABET, DECIMALS, DEPTH, HELD_BELOW, LEAST, MIX, SIZE

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_UPPER.lower()}')"


JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_lower("coalesce(text, '')")}, '[ \\t\\n\\x0B\\x0C\\r]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT l.b, r.other FROM reach r JOIN links l ON r.node = l.a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s JOIN (SELECT node AS doc_id, min(other) AS component_id FROM reach GROUP BY node) USING (doc_id)
"""

#: Five hexadecimal digits make four digits to base 32.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM q JOIN f USING (payload_digest)
"""

_WORDS = f"list_filter(string_split_regex({_lower('text')}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

LEAKS = f"""
WITH it AS (SELECT item_id, w, len(w) AS m, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
ish AS (SELECT item_id, m, k, array_to_string(w[i:i + k - 1], ' ') AS h FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM it)),
dsh AS (SELECT doc_id, n, k, i AS pos, array_to_string(w[i:i + k - 1], ' ') AS h FROM (SELECT doc_id, w, len(w) AS n, k, unnest(range(1, len(w) - k + 2)) AS i
  FROM (SELECT doc_id, {_WORDS} AS w FROM documents), (SELECT DISTINCT k FROM it))),
starts AS (SELECT DISTINCT doc_id, item_id, m, k, unnest(range(greatest(1, pos - m + k), least(pos, greatest(1, n - m + 1)) + 1)) AS st
  FROM (SELECT DISTINCT item_id, m, k, h FROM ish) JOIN dsh USING (k, h)),
win AS (SELECT s.doc_id, s.item_id, s.st, d.h, count(*) AS c, any_value(length(replace(d.h, ' ', ''))) AS wt FROM starts s JOIN dsh d ON s.doc_id = d.doc_id AND s.k = d.k AND d.pos BETWEEN s.st AND s.st + s.m - s.k GROUP BY ALL),
own AS (SELECT item_id, h, count(*) AS ci, any_value(length(replace(h, ' ', ''))) AS wt FROM ish GROUP BY ALL),
total AS (SELECT item_id, sum(ci * wt) AS t FROM own GROUP BY ALL),
sims AS (SELECT w.doc_id, w.item_id, w.st, sum(CASE WHEN o.h IS NOT NULL THEN least(w.c, o.ci) * w.wt ELSE 0 END)::BIGINT AS shared, greatest(sum(w.c * w.wt), any_value(t))::BIGINT AS most
  FROM win w JOIN total USING (item_id) LEFT JOIN own o ON o.item_id = w.item_id AND o.h = w.h GROUP BY ALL),
hit AS (SELECT *, round(shared / most, 6) AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY round(shared / most, 6) DESC, st) AS rn FROM sims WHERE 100 * shared >= 80 * most)
SELECT doc_id, item_id, similarity, (st - 1)::INTEGER AS start FROM hit WHERE rn = 1
"""


def url_sql(rules: list[tuple[str, str, bool]]) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p, _ in ordered]
    case = lambda values: "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in zip(fits, values, strict=True)) + " END"
    name, allow = case([f"'{h}{p}'" for h, p, _ in ordered]), case([str(a).lower() for _, _, a in ordered])
    letters = ALPHABET.replace("'", "''")
    code = " + ".join(f"x[i + {j}]::BIGINT * {SIZE ** (DEPTH - j)}" for j in range(DEPTH + 1))
    powers = ", ".join(str(SIZE**k) for k in range(1, DEPTH + 2))

    def estimate(side: str) -> str:
        p = f"((l0.{side} + 0.5::DOUBLE) / (l0.all_{side} + {0.5 * SIZE}::DOUBLE))"
        for k in range(1, DEPTH + 1):
            p = f"(CASE WHEN coalesce(c{k}.all_{side}, 0) >= {LEAST} THEN (coalesce(l{k}.{side}, 0) + {MIX}::DOUBLE * {p}) / (c{k}.all_{side} + {MIX}::DOUBLE) ELSE {p} END)"
        return p

    joins = "\n".join(
        f"LEFT JOIN seen l{k} ON l{k}.k = {k} AND l{k}.key = u.g % {SIZE ** (k + 1)} LEFT JOIN contexts c{k} ON c{k}.k = {k} AND c{k}.context = (u.g // {SIZE}) % {SIZE**k}" for k in range(1, DEPTH + 1)
    )
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u0 AS (SELECT page_id, {_lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
urls AS (SELECT *, {name} AS rule, {allow} AS allow FROM u0),
dist AS (SELECT host, path, allow, count(*) AS copies, allow IS NOT NULL AND NOT md5(host || path)[1] < '{HELD_BELOW}' AS trains FROM urls WHERE length(host) + length(path) > 0 GROUP BY ALL),
codes AS (SELECT *, list_concat([{", ".join("1" * DEPTH)}], list_transform(string_split(host || path, ''), lambda c: CASE WHEN instr('{letters}', c) > 0 THEN instr('{letters}', c) + 1 ELSE 0 END)) AS x FROM dist),
grams AS (SELECT host, path, allow, copies, trains, unnest(list_transform(range(1, len(x) - {DEPTH - 1}), lambda i: {code})) AS g FROM codes),
counts AS (SELECT g, sum(CASE WHEN allow THEN copies ELSE 0 END) AS good, sum(CASE WHEN NOT allow THEN copies ELSE 0 END) AS bad FROM grams WHERE trains GROUP BY ALL),
seen AS (SELECT k, g % ([{powers}])[k + 1] AS key, sum(good) AS good, sum(bad) AS bad FROM counts, range({DEPTH + 1}) t(k) GROUP BY ALL),
contexts AS (SELECT k, key // {SIZE} AS context, sum(good) AS all_good, sum(bad) AS all_bad FROM seen GROUP BY ALL),
firsts AS (SELECT g, coalesce(s.good, 0) AS good, coalesce(s.bad, 0) AS bad, all_good, all_bad FROM (SELECT DISTINCT g FROM grams WHERE NOT trains) LEFT JOIN seen s ON s.k = 0 AND s.key = g % {SIZE}, (SELECT coalesce(sum(good), 0) AS all_good, coalesce(sum(bad), 0) AS all_bad FROM counts)),
ratios AS (SELECT u.g, ln({estimate("good").replace("l0", "u")}) - ln({estimate("bad").replace("l0", "u")}) AS ratio FROM firsts u
{joins}),
scores AS (SELECT host, path, allow, copies, round(avg(ratio), 9) AS score FROM grams JOIN ratios USING (g) WHERE NOT trains GROUP BY ALL),
steps AS (SELECT round(score, {DECIMALS}) AS s, sum(CASE WHEN allow THEN copies ELSE 0 END) AS good, sum(CASE WHEN allow THEN 0 ELSE copies END) AS bad FROM scores WHERE allow IS NOT NULL GROUP BY ALL),
shares AS (SELECT s, lag(s) OVER (ORDER BY s) AS below, sum(good) OVER () AS g, sum(bad) OVER () AS b,
  round(1 - coalesce(sum(good) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (sum(good) OVER ())::DOUBLE + coalesce(sum(bad) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (sum(bad) OVER ())::DOUBLE, 9) AS j FROM steps),
edge AS (SELECT coalesce(max(e), 0) AS e FROM (SELECT CASE WHEN below IS NULL THEN s ELSE (below + s) / 2 END AS e FROM shares WHERE g > 0 AND b > 0 ORDER BY j DESC, s LIMIT 1)),
usable AS (SELECT CASE WHEN sum(good) > 0 AND sum(bad) > 0 THEN (SELECT e FROM edge) END AS e FROM counts)
SELECT page_id, urls.host, urls.path, rule, CASE WHEN urls.allow THEN 'allow' WHEN NOT urls.allow THEN 'block' WHEN s.score < e THEN 'block' ELSE 'allow' END AS verdict
FROM urls LEFT JOIN scores s ON s.host = urls.host AND s.path = urls.path AND s.allow IS NULL AND urls.allow IS NULL, usable
"""


#: The checksum of each run with its document goes byte by byte through the usual table of 256 remainders.
SPELLING = f"""
WITH RECURSIVE steps AS (SELECT i::BIGINT AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, {_lower('r')} AS r, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS r FROM documents) GROUP BY ALL),
hexes AS (SELECT r, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM runs),
sums AS (SELECT r, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS h FROM hexes, tab),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % length(r))::INTEGER) || substr(r, (h % length(r))::INTEGER + 2) ELSE r END AS word, c FROM sums),
words AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM words, range(0, 64) t(i) WHERE i < length(word)),
near AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.v = b.word),
best AS (SELECT a AS word, count(*) AS n_near, max(n) AS top FROM near GROUP BY a),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 10 * w.n THEN top END::BIGINT AS form_n, CASE WHEN top >= 10 * w.n THEN (SELECT min(b) FROM near WHERE a = w.word AND near.n = top) END AS form
  FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM judged UNION SELECT walk.word, form FROM walk JOIN judged j ON walk.at = j.word WHERE form IS NOT NULL)
SELECT j.word, j.form, walk.at AS root, j.n, j.n_near, j.form_n FROM judged j JOIN walk ON walk.word = j.word JOIN judged e ON e.word = walk.at AND e.form IS NULL
"""

COLLOCATIONS = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_lower("coalesce(text, '')")}, '[.,;:!?\\n\\x0B\\x0C\\r]')) AS p FROM documents),
ws AS (SELECT lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ws, (VALUES (1), (2), (3)) t(k)))
  GROUP BY ALL HAVING count(*) >= 10),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM cand WHERE k = 3) GROUP BY ALL),
best AS (SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) WHERE rank <= 2000
"""
