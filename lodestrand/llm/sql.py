"""SQL for the registered corpus queries, where SQL can express them.

Token counts (1), passages (2), licence templates (4), shards (9) and the classifiers (10, 13) have none:
they are tested against brute force, round trips and held-out accuracy.
"""

from __future__ import annotations

from lodestrand.llm.mixing import WEIGHTS
from lodestrand.llm.quality import RULES, STOP_WORDS, SYMBOLS

BLANK = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, blank: str = BLANK) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{blank}+'), lambda x: x <> '')"


_STOP = ", ".join(f"'{x}'" for words in STOP_WORDS.values() for w in sorted(words.split()) for x in (w, w.capitalize()))

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_words("text")} AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM w) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM r) GROUP BY 1),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
  len(list_filter(ws, lambda x: x IN ({_STOP}))) AS n_stop, len(list_filter(lines, lambda x: regexp_matches(x, '(?:\.\.\.|…){BLANK}*$'))) AS ell,
  len(list_filter(lines, lambda x: regexp_matches(x, '^{BLANK}*[-*•]\x20'))) AS bul FROM d LEFT JOIN c USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN {RULES["mean_word_chars"][0]} AND {RULES["mean_word_chars"][1]} AND n_symbols / n_words <= {RULES["symbol_ratio"][1]}
  AND n_stop / n_words >= {RULES["stop_word_ratio"][0]} AND n_dup_lines / n_lines <= {RULES["dup_line_ratio"][1]} AND ell / n_lines <= {RULES["ellipsis_line_ratio"][1]}
  AND bul / n_lines <= {RULES["bullet_line_ratio"][1]} AS kept FROM v"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(f"translate(text, '{UPPER}', '{LOWER}')")} AS ws FROM documents),
s AS (SELECT doc_id, ws, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM d),
k AS (SELECT min(doc_id) AS rep, list_sort(sh) AS key, any_value(sh) AS sh, len(any_value(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY 2),
e AS (SELECT rep, n, unnest(sh) AS g FROM k),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (nx + ny - c)),
r AS (SELECT rep AS node, rep AS seen FROM k UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.seen),
comp AS (SELECT node, min(seen) AS comp FROM r GROUP BY 1)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(comp, s.doc_id) AS component_id, s.doc_id = coalesce(comp, s.doc_id) AS kept
FROM s LEFT JOIN k ON list_sort(s.sh) = k.key LEFT JOIN comp ON comp.node = k.rep"""

_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words(f"translate(text, '{UPPER}', '{LOWER}')", _ALNUM)} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(f"translate(text, '{UPPER}', '{LOWER}')", _ALNUM)} AS ws FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS g FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
x AS (SELECT rid, p, n, array_to_string(ws[p:p + n - 1], ' ') AS g FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM w))),
h AS (SELECT rid, p, x.n, item FROM x JOIN w USING (n, g)),
c AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM h)) GROUP BY 1),
t AS (SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS items FROM h GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""


def _weight(*path: str) -> str:
    cases = " ".join(
        f"WHEN {' AND '.join(f'{c} = {chr(39)}{v}{chr(39)}' for c, v in zip(path, key))} THEN {w}" for key, w in WEIGHTS.items() if len(key) == len(path)
    )
    return f"CASE {cases} ELSE 1 END" if cases else "1"


def _share(name: str, parent: str, node: str, given: str) -> str:
    """Budgets of one level: a node is full if its capacity is at most its part of what fuller ones leave."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"{by} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    join = f"JOIN {given} USING ({parent})" if parent else f"CROSS JOIN {given}"
    path = f"{parent}, {name}" if parent else name
    weight = _weight(*path.split(", "))
    return f"""{node}a AS (SELECT {path}, sum(tokens) * 4 AS capacity, {weight} AS weight FROM leaf GROUP BY {path}),
{node}b AS (SELECT *, coalesce(sum(capacity) OVER ({order}), 0) AS taken, sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({order}), 0) AS weights FROM {node}a {join}),
{node}c AS (SELECT *, capacity * weights <= weight * (available - taken) AS isfull FROM {node}b),
{node} AS (SELECT {path}, CASE WHEN isfull THEN capacity ELSE weight * (available - coalesce(sum(capacity) FILTER (isfull) OVER ({by}), 0)) // sum(weight) FILTER (NOT isfull) OVER ({by}) END AS available FROM {node}c)"""


OP7 = rf"""
WITH tok AS (SELECT doc_id, 'd' || (('0x' || substr(md5(source), 1, 4))::INT % 4) AS domain, lang, source, len({_words("text")}) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM tok GROUP BY ALL HAVING sum(n_tokens) > 0),
root AS (SELECT sum(tokens) * 60 // 100 AS available FROM leaf),
{_share("domain", "", "l1", "root")},
{_share("lang", "domain", "l2", "l1")},
{_share("source", "domain, lang", "l3", "l2")},
plan AS (SELECT domain, lang, source, (available // tokens)::BIGINT AS epochs, (available % tokens)::BIGINT AS rest FROM leaf JOIN l3 USING (domain, lang, source)),
k AS (SELECT *, md5('mix-' || epochs || '-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM tok JOIN plan USING (domain, lang, source) WHERE n_tokens > 0),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM k)
SELECT doc_id, domain, lang, source, n_tokens, unnest(list_concat(range(0, epochs), CASE WHEN upto <= rest THEN [epochs] ELSE [] END)) AS epoch FROM u"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP8 = f"""
WITH p AS (SELECT row_number() OVER (ORDER BY page_id, url) AS rid, page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) AS hex, strlen(html) AS n, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, rid) AS r, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST, rid) AS first FROM p)
SELECT page_id, n AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('{_B32}', ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN first END AS refers_to FROM h"""



def _codebooks() -> str:
    """Two rounds of assignment and floored means over 16 parts of four components, then codes and errors."""
    xs, cs = ("x0", "x1", "x2", "x3"), ("c0", "c1", "c2", "c3")
    far = " + ".join(f"({x} - {c}) ** 2" for x, c in zip(xs, cs, strict=True))
    out = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, label, p, {", ".join(f"v[4 * p + {i + 1}] AS {x}" for i, x in enumerate(xs))} FROM kept, range(16) r(p)),
b0 AS (SELECT p, e, {", ".join(f"{x} AS {c}" for x, c in zip(xs, cs, strict=True))} FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM part) WHERE e < 64),"""
    for r in range(3):
        out += f"""
a{r} AS (SELECT vec_id, label, p, {", ".join(xs)}, arg_min(e, far * 64 + e) AS e, min(far) AS far FROM (SELECT *, {far} AS far FROM part JOIN b{r} USING (p)) GROUP BY ALL),"""
        if r < 2:
            means = ", ".join(f"coalesce(m{i}, c{i}) AS c{i}" for i in range(4))
            sums = ", ".join(f"CAST(floor(sum(x{i}) / count(*)) AS BIGINT) AS m{i}" for i in range(4))
            out += f"""
b{r + 1} AS (SELECT p, e, {means} FROM b{r} LEFT JOIN (SELECT p, e, {sums} FROM a{r} GROUP BY p, e) USING (p, e)),"""
    return out + """
c AS (SELECT vec_id, label, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(c0 || ',' || c1 || ',' || c2 || ',' || c3, ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM c"""


OP11 = _codebooks()

OP12 = rf"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
seq AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || md5(coalesce(text, '')))) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT conv_id, s, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 4 AS h FROM seq, tab),
reb AS (SELECT h.conv_id, coalesce(b.s, [])[1:h.h] || h.s[h.h + 1:] AS s FROM h LEFT JOIN seq b ON b.conv_id = h.conv_id - h.conv_id % 20),
pre AS (SELECT conv_id, d, s[1:d] AS k, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM reb)),
node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends) AS ends FROM pre GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
own AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * len({_words("node.k[-1].text")}) END AS saved FROM node LEFT JOIN kids ON node.d = kids.d AND node.k = kids.k),
total AS (SELECT k[1:a] AS k, a AS d, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS a FROM own) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM own n JOIN total t ON n.d = t.d AND n.k = t.k LEFT JOIN node p ON n.d > 0 AND p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]"""

ORACLE: dict[str, str] = {"op3_quality_rules": OP3, "op5_minhash_near_dedup": OP5, "op6_benchmark_decontamination": OP6, "op7_mixing": OP7, "op8_warc": OP8, "op11_vector_code_compression": OP11, "op12_conversation_prefix_trie": OP12}
