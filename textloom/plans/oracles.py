"""DuckDB SQL for the queries that SQL can state, over the same tables."""

from __future__ import annotations

from textloom.functions import fixed
from textloom.plans.queries import NOW, QUERIES, QUERY


def _chars(*points: int) -> str:
    return "[" + "".join(map(chr, points)) + "]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STRIP = "regexp_replace(regexp_replace({0}, '^[\\s\\x0b]+', ''), '[\\s\\x0b]+$', '')"

# documents hold no blank lines, so a chunk is the text, or 600 characters of it
CHUNKS = f"""
chunks AS (
  SELECT doc_id, 0::BIGINT AS chunk_no, t AS text FROM (SELECT doc_id, {STRIP.format('text')} AS t FROM documents) WHERE length(t) BETWEEN 1 AND 1200
  UNION ALL
  SELECT doc_id, i::BIGINT, substr(t, 600 * i + 1, 600) FROM (SELECT doc_id, t, unnest(range(0, (length(t) + 599) // 600)) AS i FROM (SELECT doc_id, {STRIP.format('text')} AS t FROM documents) WHERE length(t) > 1200)
)"""

BM25 = f"""
{CHUNKS},
w AS (SELECT doc_id, chunk_no, text, regexp_extract_all(lower(text), '[a-z0-9]{{2,}}') AS words FROM chunks),
s AS (SELECT count(*) AS n, avg(len(words)) AS avg_words FROM w),
asked AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]{{2,}}')) AS term FROM asks),
held AS (SELECT doc_id, chunk_no, len(words) AS dl, unnest(words) AS term FROM w),
tf AS (SELECT doc_id, chunk_no, dl, term, count(*) AS f FROM held WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT query_id, doc_id, chunk_no, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * f * {fixed.K1 + 1} / (f + {fixed.K1} * ({1 - fixed.B} + {fixed.B} * dl / avg_words))) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term) CROSS JOIN s GROUP BY ALL
)"""

ONE = f"WITH asks AS (SELECT 1 AS query_id, {_quoted(QUERY)} AS query),"
SEVERAL = f"WITH asks AS (SELECT * FROM (VALUES {', '.join(f'({i}, {_quoted(q)})' for i, q in QUERIES)}) AS a(query_id, query)),"

LEDGER = """
ledger AS (
  SELECT ts, event_type AS tool, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'p' || (user_id % 5) END AS provider, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'm' || (user_id % 7) END AS model,
    b AS before, b - b % 7 AS after, b % 7 AS saved, 1 AS blocks, floor(value)::BIGINT AS output_tokens, user_id % 3 - 1 AS shaped
  FROM (SELECT *, floor(value * 10)::BIGINT AS b FROM events)
)"""
SUMS = "coalesce(sum(before), 0)::BIGINT AS tokens_before, coalesce(sum(after), 0)::BIGINT AS tokens_after, coalesce(sum(saved), 0)::BIGINT AS tokens_saved"


def _label(d: str) -> str:
    if d == "tool":
        return "CASE WHEN tool = '' THEN 'unknown' ELSE tool END"
    return f"CASE WHEN {d} = '' AND tool <> '' THEN 'n/a (' || tool || ')' WHEN {d} = '' THEN 'unknown' ELSE {d} END"


def _breakdown(d: str) -> str:
    return f"SELECT {_label(d)} AS key, {SUMS}, count(*) AS requests FROM ledger GROUP BY 1 HAVING sum(saved) > 0"


LOGS = """
log_blocks AS (
  SELECT user_id AS block, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' ' || event_type
    || CASE WHEN event_type = 'purchase' THEN chr(10) || '    at step ' || event_id ELSE '' END, chr(10) ORDER BY ts, event_id) AS text
  FROM events GROUP BY user_id
)"""

LOG_TRIAGE = f"""
WITH {LOGS},
l AS (SELECT block, p, string_split(text, chr(10))[p + 1] AS line, n FROM (SELECT block, text, len(string_split(text, chr(10))) AS n, unnest(range(0, len(string_split(text, chr(10))))) AS p FROM log_blocks)),
f AS (SELECT *, regexp_matches(line, {_quoted(fixed.LOG_IMPORTANT + '|' + fixed.LOG_SUMMARY)}, 'i') AS hit, regexp_matches(line, {_quoted(fixed.LOG_BLOCK)}) AS blk FROM l),
g AS (SELECT *, max(CASE WHEN hit THEN p END) OVER prev AS ph, min(CASE WHEN hit THEN p END) OVER foll AS nh, max(CASE WHEN NOT blk THEN p END) OVER upto AS pb, min(CASE WHEN NOT blk THEN p END) OVER onward AS nb FROM f
  WINDOW prev AS (PARTITION BY block ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), foll AS (PARTITION BY block ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
    upto AS (PARTITION BY block ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), onward AS (PARTITION BY block ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, n < 10 OR p < 3 OR p >= n - 3 OR hit OR coalesce(p - ph <= 2 AND trim(line) <> '', false) OR coalesce(nh - p <= 40 AND (nb IS NULL OR nb >= nh), false) OR coalesce(p - ph <= 40 AND (pb IS NULL OR pb <= ph), false) AS keep FROM g),
r AS (SELECT *, p - row_number() OVER (PARTITION BY block, keep ORDER BY p) AS run FROM k),
shown AS (SELECT block, n, p, line FROM r WHERE keep UNION ALL SELECT block, n, min(p), '… ' || count(*) || ' lines omitted …' FROM r WHERE NOT keep GROUP BY block, n, run),
norm AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(line, {_quoted(fixed.LOG_SAME[0][0])}, '<ts>', 'g'), {_quoted(fixed.LOG_SAME[1][0])}, '<hex>', 'g'), {_quoted(fixed.LOG_SAME[2][0])}, '<n>', 'g')) AS same FROM shown),
b AS (SELECT *, CASE WHEN n >= 10 AND same <> '' AND same = lag(same) OVER (PARTITION BY block ORDER BY p) THEN 0 ELSE 1 END AS starts FROM norm),
i AS (SELECT *, sum(starts) OVER (PARTITION BY block ORDER BY p) AS island FROM b),
o AS (SELECT block, island, arg_min(line, p) || CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ')' ELSE '' END AS line FROM i GROUP BY block, island),
t AS (SELECT block, string_agg(line, chr(10) ORDER BY island) AS text FROM o GROUP BY block)
SELECT block, md5(text) AS digest, length(text)::BIGINT AS n_chars FROM t
"""

CODE = """
code_blocks AS (
  SELECT p_brand AS block, 'import os\nimport sys\nimport json\nimport re\n\n# parts of a brand\n' || string_agg('def part_' || p_partkey || '():  # ' || p_type || chr(10) || '    return ' || p_size || chr(10), chr(10) ORDER BY p_partkey) AS text
  FROM part GROUP BY p_brand
)""".replace("\\n", "\n")

JSON = """
json_blocks AS (
  SELECT o_custkey AS block, list({'k': o_orderkey, 's': o_orderstatus, 'p': o_orderpriority} ORDER BY o_orderkey) AS items FROM orders GROUP BY o_custkey
)"""


ITEMS = "'[' || array_to_string(list_transform(items, lambda x: '{\"o_orderkey\":' || x.k || ',\"o_orderstatus\":\"' || x.s || '\",\"o_orderpriority\":\"' || x.p || '\"}'), ',') || ']'"


def _field(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[,\"\\n\\r]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"


JSON_TABLE = f"""
WITH {JSON},
c AS (SELECT block, items, len(list_distinct(list_transform(items, lambda x: x.p))) = 1 AS cp, len(list_distinct(list_transform(items, lambda x: x.s))) = 1 AS cs, items[1].p AS p1, items[1].s AS s1 FROM json_blocks)
SELECT block, CASE WHEN len(items) < 3 THEN {ITEMS} ELSE '@csv' || CASE WHEN cp OR cs THEN ' const(' || array_to_string(list_filter([CASE WHEN cp THEN 'o_orderpriority=' || {_field('p1')} END, CASE WHEN cs THEN 'o_orderstatus=' || {_field('s1')} END], lambda x: x IS NOT NULL), ',') || ')' ELSE '' END
  || ' cols=o_orderkey' || CASE WHEN cp THEN '' ELSE ',o_orderpriority' END || CASE WHEN cs THEN '' ELSE ',o_orderstatus' END || chr(10)
  || array_to_string(list_transform(items, lambda x: x.k::VARCHAR || CASE WHEN cp THEN '' ELSE ',' || {_field('x.p')} END || CASE WHEN cs THEN '' ELSE ',' || {_field('x.s')} END), chr(10)) END AS text
FROM c
"""

BLOCKS = f"""
WITH {LOGS}, {CODE}, {JSON},
blocks AS (
  SELECT 'text/' || doc_id AS id, text FROM documents UNION ALL SELECT 'logs/' || block, text FROM log_blocks UNION ALL SELECT 'code/' || block, text FROM code_blocks
  UNION ALL SELECT 'json/' || block, '[' || array_to_string(list_transform(items, lambda x: '{{"o_orderkey":' || x.k || ',"o_orderstatus":"' || x.s || '","o_orderpriority":"' || x.p || '"}}'), ',') || ']' FROM json_blocks
),
lines AS (SELECT id, text, string_split(text, chr(10)) AS parts FROM blocks),
r AS (SELECT id,
  len(list_filter(parts[1:80], lambda s: regexp_matches(s, {_quoted(fixed.LOG_LEVEL)}) OR regexp_matches(s, {_quoted(fixed.LOG_LINE_START)}))) AS hits, len(parts) AS n, len(parts[1:80]) AS sample,
  starts_with({STRIP.format('text')}, '```') OR len(list_filter(parts[1:20], lambda s: regexp_matches(s, {_quoted(fixed.STRONG_CODE)}))) > 0 OR len(list_filter(parts[1:20], lambda s: regexp_matches(s, {_quoted(fixed.WEAK_CODE)}))) >= 2 AS is_code FROM lines)
"""

VOLATILE = "t"
for _p in fixed.VOLATILE:
    VOLATILE = f"regexp_replace({VOLATILE}, {_quoted(_p)}, '', 'gi')"

CONV = "coalesce(text, '')"
KEY = "'sk' || '-' || md5(doc_id::VARCHAR)"
SECRET = f"(SELECT doc_id, text || ' key ' || {KEY} || ' mail a.b@example.org host 10.0.0.1' AS text FROM documents)"
_redacted, _counts = "text", []
for _name, _pattern in (*fixed.SECRETS, *fixed.PII):
    _counts.append((_name, f"len(regexp_extract_all({_redacted}, {_quoted(_pattern)}))"))
    _redacted = f"regexp_replace({_redacted}, {_quoted(_pattern)}, '[REDACTED:{_name}]', 'g')"

HIDDEN = "('a' || chr(8203) || 'b' || chr(8238) || 'c' || chr(160) || 'd' || chr(65025) || 'e' || text || chr(8288))"


def _count(p: str) -> str:
    return f"len(regexp_extract_all(t, '{p}'))::BIGINT"


_SMUGGLED = "[" + chr(0xE0001) + chr(0xE0020) + "-" + chr(0xE007F) + chr(0xFE00) + "-" + chr(0xFE0D) + chr(0xE0100) + "-" + chr(0xE01EF) + "]"

ORIGINALS = "(SELECT conv_id || '/' || turn AS id, coalesce(text, '') AS original, substr(coalesce(text, ''), 1, 40) AS compressed, 1700000000 + turn * 20000 AS stored_at FROM conversations)"
LIVE = "1700100000 - stored_at <= 86400"

REQUESTS = "(SELECT event_id, ['curl/8.1', 'Cursor/1.2 (x)', 'python-httpx/0.28', 'MyTool/2.0 linux', ''][event_id % 5 + 1] AS agent, 'Model-' || event_type AS model, props AS text FROM events)"
_client = "split_part(split_part(agent, ' ', 1), '/', 1)"
for _part, _name in reversed(fixed.CLIENTS):
    _client = f"CASE WHEN contains(lower(agent), '{_part}') THEN '{_name}' ELSE {_client} END"

ROUTED = f"""
{BLOCKS}, k AS (SELECT id, split_part(id, '/', 1) AS made_as, CASE WHEN made_as = 'json' THEN 'json' WHEN n >= 8 AND hits >= greatest(4, sample // 4) THEN 'logs' WHEN is_code THEN 'code' ELSE 'text' END AS type FROM r)
"""

WORDS = r"'[\pL\pM\pN_]+|[^\pL\pM\pN_\s]'"

PAIRS = f"""
w AS (SELECT *, lag(role) OVER o AS before, lag({CONV}) OVER o AS prompt, row_number() OVER o AS place FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, place, prompt, {CONV} AS response, conv_id || '/' || turn AS key FROM w WHERE role = 'assistant' AND before = 'user')"""


def _draw(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}/' || {key}), 1, 8))::BIGINT"


def _short(t: str) -> str:
    """The prompt's lines stripped, blank ones dropped, those that look like JSON cut."""
    lines = f"list_filter(list_transform(string_split({STRIP.format(t)}, chr(10)), lambda s: {STRIP.format('s')}), lambda s: s <> '')"
    return f"array_to_string(list_transform({lines}, lambda s: CASE WHEN s[1] IN ('[', '{{') THEN s[1:200] || '...' ELSE s END), chr(10))"


_HEAD, _TAIL = (_quoted(x) for x in fixed.REFERENCE_EXAMPLE)
AUGMENTED = f"""
WITH {PAIRS}, plain AS (SELECT conv_id, turn, key, 'plain' AS kind, chr(10) || chr(10) || prompt AS content FROM pairs),
short AS (SELECT conv_id, turn, key, 'compressed' AS kind, {_short('content')} AS content FROM plain WHERE {_draw('key', 42)} % 1000000 < 200000 AND {_short('content')} <> content),
base AS (SELECT * FROM plain UNION ALL SELECT * FROM short),
told AS (SELECT conv_id, turn, key, 'reference' AS kind, {_HEAD} || content || {_TAIL} AS content FROM base WHERE {_draw("key || '/' || kind", 43)} % 1000000 < 150000)
SELECT conv_id, turn, kind, md5(content) AS digest FROM (SELECT * FROM base UNION ALL SELECT * FROM told)
"""

FORMATTED = f"""
WITH {PAIRS}, h AS (SELECT p.conv_id, p.turn, p.response, string_agg('<|' || w.role || '|>' || chr(10) || coalesce(w.text, ''), chr(10) ORDER BY w.turn) FILTER (w.role IN ('system', 'user', 'assistant')) AS history
  FROM pairs p JOIN w ON w.conv_id = p.conv_id AND w.place < p.place GROUP BY ALL)
SELECT conv_id, turn, md5(history || chr(10) || '<|assistant|>' || chr(10) || response) AS digest FROM h
"""


def _one_of(words: tuple[str, ...], part: int) -> str:
    return f"[{', '.join(map(_quoted, words))}][{_draw('id', 42 + part)} % {len(words)} + 1]"


def _chance(share: float, part: int) -> str:
    return f"{_draw('id', 42 + part)} % 1000000 < {int(share * 1_000_000)}"


def _synth(n: int) -> str:
    filler = _one_of(fixed.SYNTH_FILLERS, 1)
    return f"""SELECT id, concat_ws(' ', CASE WHEN {_chance(0.8, 2)} THEN upper({filler}[1]) || {filler}[2:] || ',' END, {_one_of(fixed.SYNTH_VERBOSE, 3)}, {_one_of(fixed.SYNTH_CONTENT, 4)},
  CASE WHEN {_chance(0.5, 5)} THEN 'and ' || {_one_of(fixed.SYNTH_VERBOSE, 6)} || ' ' || {_one_of(fixed.SYNTH_CONTENT, 7)} END) || '.' AS text FROM (SELECT unnest(range({n})) AS id)"""


# a user's events in turn: the times that were accepted within the window decide on the next
RATE_LIMIT = """
WITH RECURSIVE o AS (SELECT user_id AS client, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT client, event_id, t, n, true AS allowed, [t] AS taken, 0 AS wait FROM o WHERE n = 1
  UNION ALL
  SELECT client, event_id, t, n, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, CASE WHEN len(live) < 3 THEN 0 ELSE greatest(1, trunc(86400 - (t - live[1]))::BIGINT + 1) END
  FROM (SELECT o.*, list_filter(r.taken, lambda x: o.t - x < 86400) AS live FROM r JOIN o ON o.client = r.client AND o.n = r.n + 1))
SELECT client::VARCHAR AS client, event_id, allowed, wait::INTEGER AS retry_after FROM r
"""

# pages of the tables have targets below their own root, other hosts' and fragments
PAGE_LINKS = """
WITH h AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract_all(html, '(?i)href=["\'']([^"\'']+)["\'']', 1) AS targets FROM pages),
f AS (SELECT page_id, host, list_transform(targets, lambda x: split_part(CASE WHEN regexp_matches(x, '^https?://') THEN x WHEN starts_with(x, '//') THEN scheme || ':' || x WHEN starts_with(x, '/') THEN scheme || '://' || host || x END, '#', 1)) AS targets FROM h),
k AS (SELECT page_id, list_filter(targets, lambda x: regexp_extract(x, '^https?://([^/?#]*)', 1) = host) AS links FROM f)
SELECT page_id, i::BIGINT AS position, links[i + 1] AS link FROM (SELECT page_id, links, unnest(range(len(links))) AS i FROM k)
"""


def _dropped(x: str) -> str:
    for tag in fixed.DROPPED.split("|"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return x


def _unescaped(x: str) -> str:
    """The references that the tables' pages hold."""
    for name, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", chr(0xA0)), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def _gsub(x: str, *rules: tuple[str, str]) -> str:
    for pattern, by in rules:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


_lines = _gsub(_dropped("html"), ("(?s)<!--.*?-->", " "), ("(?i)<br\\s*/?>", "\n"), (f"(?i)</({fixed.LINE_ENDS})>", "\n"), ("<[^>]+>", " "))
MAIN_TEXT = STRIP.format(_gsub(_unescaped(_lines), ("[ \\t]+", " "), (" *\\n *", "\n"), ("\\n{3,}", "\n\n")))
_all = _gsub("html", ("(?is)<script[^>]*>.*?</script>", " "), ("(?is)<style[^>]*>.*?</style>", " "), ("<[^>]+>", " "))
PLAIN_TEXT = f"trim(regexp_replace({_unescaped(_all)}, '[\\s\\x0b\u00a0]+', ' ', 'g'))"

_TOKENS = "greatest(1, length({0}) // 4)"
_TS = "1700000000 + turn * 60 + conv_id"
TITLES = f"""titled AS (SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN '{fixed.NEW_TITLE}' ELSE coalesce(arg_min(text, turn) FILTER (role = 'user'), '') END AS said, min({_TS}) AS created_at, max({_TS}) AS updated_at, count(*) AS n_messages FROM conversations GROUP BY conv_id),
named AS (SELECT *, CASE WHEN length(said) > {fixed.TITLE_CHARS} THEN said[1:{fixed.TITLE_CHARS}] || '…' ELSE said END AS title FROM titled)"""

# the table that an array of three orders or more becomes, and the same inside a tool result
BLOCK_REQUESTS = f"""
WITH t AS ({JSON_TABLE}), j AS (SELECT o_custkey AS block, list({{'k': o_orderkey, 's': o_orderstatus, 'p': o_orderpriority}} ORDER BY o_orderkey) AS items FROM orders GROUP BY o_custkey),
x AS (SELECT j.block, {ITEMS} AS own, t.text FROM j JOIN t USING (block) WHERE len(items) >= 3), n AS (SELECT *, length(own) >= {fixed.MIN_BLOCK} AS able, {_TOKENS.format('own')} AS b, {_TOKENS.format('text')} AS a FROM x)
SELECT block, CASE WHEN able THEN b ELSE 0 END::BIGINT AS tokens_before, CASE WHEN able THEN a ELSE 0 END::BIGINT AS tokens_after, CASE WHEN able THEN greatest(0, b - a) ELSE 0 END::BIGINT AS tokens_saved, able::BIGINT AS blocks,
  CASE WHEN able THEN round(a / b, 4) ELSE 1 END::DOUBLE AS ratio, able AS compressed, CASE WHEN able THEN text ELSE own END AS inner, repeat('x', 200) AS image, 'hi' AS short FROM n
"""

_COST = max(1, len(fixed.INSTRUCTION) // 4)

SQL: dict[str, str] = {
    "bm25_topk": f"{ONE} {BM25} SELECT doc_id, chunk_no, round(score, 4) AS score FROM (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, doc_id, chunk_no LIMIT 10)",
    "bm25_batch": f"{SEVERAL} {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS place FROM scored) SELECT query_id, place, round(score, 4) AS score FROM r WHERE place <= 5",
    "rag_chunks": f"WITH {CHUNKS} SELECT doc_id, chunk_no, md5(text) AS digest, length(text)::BIGINT AS n_chars FROM chunks",
    "list_documents": f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id",
    "replace_document": f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_chunks FROM chunks WHERE doc_id % 10 <> 0 GROUP BY doc_id UNION ALL SELECT DISTINCT doc_id, 1 FROM documents WHERE doc_id % 10 = 0",
    "rag_context": f"{ONE} {BM25}, top AS (SELECT * FROM scored ORDER BY score DESC, doc_id, chunk_no LIMIT 3), t AS (SELECT string_agg('[' || doc_id || '] ' || text, chr(10) || chr(10) ORDER BY score DESC, doc_id, chunk_no) AS c FROM top JOIN chunks USING (doc_id, chunk_no)) SELECT md5(c) AS digest, length(c)::BIGINT AS n_chars FROM t",
    "cosine_topk": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 10)",
    "hybrid_topk": f"""{ONE} {BM25}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
x AS (SELECT c.doc_id, c.chunk_no, coalesce(list_cosine_similarity(embedding::DOUBLE[], q), 0) AS cos, coalesce(score, 0) AS bm FROM chunks c LEFT JOIN embeddings ON vec_id = c.doc_id LEFT JOIN scored s ON s.doc_id = c.doc_id AND s.chunk_no = c.chunk_no CROSS JOIN q),
m AS (SELECT max(cos) AS mc, max(bm) AS mb FROM x), y AS (SELECT doc_id, chunk_no, 0.5 * CASE WHEN mc > 0 THEN cos / mc ELSE 0 END + 0.5 * CASE WHEN mb > 0 THEN bm / mb ELSE 0 END AS score FROM x, m)
SELECT doc_id, chunk_no, round(score, 4) AS score FROM (SELECT * FROM y WHERE score > 0 ORDER BY score DESC, doc_id, chunk_no LIMIT 10)""",
    "search_fallback": f"{ONE} {BM25} SELECT doc_id, chunk_no, round(score, 4) AS score FROM (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, doc_id, chunk_no LIMIT 10)",
    "grep_lines": f"SELECT doc_id, i::BIGINT AS line_no, substr({STRIP.format('string_split(text, chr(10))[i]')}, 1, 160) AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE contains(lower(string_split(text, chr(10))[i]), 'license') ORDER BY doc_id, line_no LIMIT 50",
    "ledger_totals": f"WITH {LEDGER} SELECT count(*) AS requests, {SUMS}, coalesce(sum(blocks), 0)::BIGINT AS blocks FROM ledger WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'",
    "ledger_daily": f"WITH {LEDGER}, d AS (SELECT unnest(generate_series(DATE '2024-02-02' - 39, DATE '2024-02-02', INTERVAL 1 DAY))::DATE AS day), a AS (SELECT ts::DATE AS day, {SUMS}, count(*) AS requests FROM ledger GROUP BY 1) SELECT d.day::VARCHAR AS day, coalesce(tokens_before, 0)::BIGINT AS tokens_before, coalesce(tokens_after, 0)::BIGINT AS tokens_after, coalesce(tokens_saved, 0)::BIGINT AS tokens_saved, coalesce(requests, 0)::BIGINT AS requests FROM d LEFT JOIN a USING (day)",
    **{f"ledger_by_{d}": f"WITH {LEDGER} {_breakdown(d)} ORDER BY tokens_saved DESC, key LIMIT 12" for d in ("tool", "provider", "model")},
    "ledger_breakdowns": f"WITH {LEDGER} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, * FROM ({_breakdown(d)})" for d in ("tool", "provider", "model")),
    "ledger_prune": f"WITH {LEDGER} SELECT count(*) AS n, sum(saved)::BIGINT AS tokens_saved FROM ledger WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 15 DAY",
    "output_effect": f"""WITH {LEDGER}, a AS (SELECT count(*) FILTER (shaped = 1) AS n_s, count(*) FILTER (shaped = 0) AS n_c, avg(output_tokens) FILTER (shaped = 1) AS mean_s, avg(output_tokens) FILTER (shaped = 0) AS mean_c,
  var_samp(output_tokens) FILTER (shaped = 1) AS v_s, var_samp(output_tokens) FILTER (shaped = 0) AS v_c FROM ledger WHERE output_tokens > 0), b AS (SELECT *, mean_c - mean_s AS difference, {fixed.Z95} * sqrt(v_s / n_s + v_c / n_c) AS margin FROM a)
SELECT n_s, n_c, round(mean_s, 4) AS mean_s, round(mean_c, 4) AS mean_c, round(difference, 4) AS difference, round(margin, 4) AS margin,
  CASE WHEN n_s < 30 OR n_c < 30 THEN 'not enough data yet' WHEN difference - margin > 0 THEN 'shorter answers' WHEN difference + margin < 0 THEN 'longer answers' ELSE 'no measurable difference' END AS verdict FROM b""",
    "late_output_tokens": "SELECT event_id AS request_id, CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT ELSE 0 END AS output_tokens FROM events",
    "token_estimate": "SELECT lang, sum(greatest(1, length(text) // 4))::BIGINT AS n_tokens, count(*) AS n FROM documents GROUP BY lang",
    "log_code_rules": f"{BLOCKS} SELECT id, n >= 8 AND hits >= greatest(4, sample // 4) AS is_logs, is_code FROM r",
    "type_counts": f"{ROUTED} SELECT made_as, type, count(*) AS n FROM k GROUP BY ALL",
    "code_language": f"WITH {CODE}, l AS (SELECT block, string_split(text, chr(10))[1:30] AS lines FROM code_blocks) SELECT block, CASE " + " ".join(f"WHEN len(list_filter(lines, lambda s: regexp_matches(s, {_quoted(a)}) OR regexp_matches(s, {_quoted(b)}))) >= 2 THEN '{name}'" for name, (a, b) in fixed.LANGUAGE_PATTERNS.items()) + " ELSE 'unknown' END AS language FROM l",
    "log_triage": LOG_TRIAGE,
    "json_csv_schema": JSON_TABLE,
    "dedupe_lines": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), l AS (SELECT r, doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT r, doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
k AS (SELECT *, {STRIP.format('line')} AS key FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY r, key ORDER BY i) AS nth FROM k), t AS (SELECT r, doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM n WHERE length(key) <= 20 OR nth = 1 GROUP BY r, doc_id)
SELECT doc_id, md5(text) AS digest, length(text)::BIGINT AS n_chars FROM t""",
    "invisible_clean": f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{_chars(*fixed.INVISIBLE)}', '', 'g'), '{_chars(*fixed.BIDI)}', '', 'g'), '{_SMUGGLED}', '', 'g'), '{_chars(*fixed.NBSP)}', ' ', 'g')) AS digest,
  {_count(_chars(*fixed.INVISIBLE))} AS invisible, {_count(_chars(*fixed.BIDI))} AS bidi, {_count(_SMUGGLED)} AS smuggled, {_count(_chars(*fixed.NBSP))} AS nbsp FROM (SELECT doc_id, {HIDDEN} AS t FROM documents)""",
    "align_messages": f"""WITH m AS (SELECT *, coalesce(role = 'system', false) AS sys, CASE WHEN role = 'system' THEN md5({CONV}) ELSE '' END AS d, {CONV} AS t FROM conversations), s AS (SELECT *, {STRIP.format(f"CASE WHEN sys THEN {VOLATILE} ELSE t END")} AS clean FROM m)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY NOT sys, d, turn) - 1 AS position, md5(clean) AS digest FROM s WHERE NOT sys OR clean <> ''""",
    "shape_last_user": f"WITH l AS (SELECT *, role = 'user' AND turn = max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS s FROM conversations) SELECT conv_id, turn, coalesce(s, false) AS shaped, greatest(1, length(text || CASE WHEN coalesce(s, false) THEN chr(10) || chr(10) || {_quoted(fixed.INSTRUCTION)} ELSE '' END) // 4)::BIGINT AS n_tokens FROM l",
    "ccr_stats": f"SELECT count(*) AS total, count(*) FILTER ({LIVE}) AS active, sum(length(original))::BIGINT AS original_chars, sum(length(compressed))::BIGINT AS compressed_chars, sum(length(original) - length(compressed))::BIGINT AS saved_chars FROM {ORIGINALS}",
    "ccr_cleanup": f"SELECT id FROM {ORIGINALS} WHERE {LIVE}",
    "ccr_retrieve": f"SELECT id, length(original)::BIGINT AS n_chars FROM {ORIGINALS} WHERE {LIVE} AND (id LIKE '%/0' OR id LIKE '%/3')",
    "redact_counts": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS category, sum({c})::BIGINT AS n FROM {SECRET}" for n, c in _counts) + ") WHERE n > 0",
    "redact_text": f"SELECT doc_id, md5({_redacted}) AS digest FROM {SECRET}",
    "policy_check": f"""SELECT CASE WHEN contains(lower(model), 'error') THEN 'model: error' WHEN contains(lower(model), 'signup') THEN 'model: signup' WHEN regexp_matches(text, '"k": 9', 'i') THEN 'pattern: "k": 9' WHEN regexp_matches(text, '"k": 1[0-4]', 'i') THEN 'pattern: "k": 1[0-4]' END AS reason, count(*) AS n FROM {REQUESTS} GROUP BY 1""",
    "client_names": f"SELECT {_client} AS client, count(*) AS n FROM {REQUESTS} GROUP BY 1",
    "session_islands": """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 86400000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM g) SELECT user_id, session_no::BIGINT AS session_no, min(epoch_us(ts)) AS started, max(epoch_us(ts)) AS last_active, count(*) AS n_events FROM s GROUP BY user_id, session_no""",
    "audit_trim": f"SELECT event_id FROM events WHERE epoch(ts) >= epoch(TIMESTAMP '{NOW}') - 10 * 86400",
    "audit_tail": "SELECT event_id AS line_no, json_extract_string(props, '$.k') AS k FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 100) WHERE event_id % 10 <> 0",
    "html_tables": "SELECT n_regionkey::BIGINT AS page_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row_no, n_nationkey::VARCHAR AS key, n_name AS name FROM nation",
    "robots": "SELECT page_id AS host, unnest(['/d' || (page_id % 11), '/p/' || page_id]) AS path FROM pages WHERE page_id % 3 < 2",
    "watch_changes": """WITH v AS (SELECT page_id, v AS version, page_id % 3 > 0 AND v > page_id % 3 + 1 AS changed FROM pages, (SELECT unnest([1, 2, 3]) AS v)), l AS (SELECT *, lag(changed) OVER (PARTITION BY page_id ORDER BY version) AS before FROM v)
SELECT page_id, (version * 1000)::BIGINT AS at, CASE WHEN before IS NULL THEN 'baseline' WHEN before = changed THEN 'same' ELSE 'changed' END AS status FROM l""",
    "bfs_depth": """WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier), e AS (SELECT s_suppkey AS src, (s_suppkey * k + 1) % n AS dst FROM supplier, n, (SELECT unnest([2, 3, 5]) AS k)),
b AS (SELECT s_suppkey AS node, 0 AS depth FROM supplier WHERE s_suppkey = 1 UNION SELECT dst, depth + 1 FROM b JOIN e ON src = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM b GROUP BY node""",
    "training_pairs": "WITH w AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n_before FROM conversations) SELECT conv_id, turn, n_before, length(coalesce(text, ''))::BIGINT AS n_chars FROM w WHERE role = 'assistant' AND before = 'user'",
    "prompt_text": f"""SELECT conv_id, turn, md5(array_to_string(list_transform(list_filter(list_transform(string_split({STRIP.format("(chr(10) || ' [1] x ' || chr(10) || chr(10) || text)")}, chr(10)), lambda s: {STRIP.format('s')}), lambda s: s <> ''), lambda s: CASE WHEN s[1] IN ('[', '{{') THEN s[1:200] || '...' ELSE s END), chr(10))) AS digest FROM conversations""",
    "label_words": f"""WITH b AS (SELECT item_id AS doc_id, text, regexp_replace(text, '(^|\\n)[^ \\n]+ ', '\\1', 'g') AS c FROM benchmark), o AS (SELECT doc_id, w, i FROM (SELECT doc_id, unnest(regexp_extract_all(text, {WORDS})) AS w, generate_subscripts(regexp_extract_all(text, {WORDS}), 1) AS i FROM b)),
k AS (SELECT doc_id, lower(w) AS key, count(*) AS kept FROM (SELECT doc_id, unnest(regexp_extract_all(c, {WORDS})) AS w FROM b) GROUP BY ALL), n AS (SELECT *, lower(w) AS key, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) AS nth FROM o),
l AS (SELECT n.doc_id, i, CASE WHEN nth <= coalesce(kept, 0) THEN 1 ELSE 0 END AS label FROM n LEFT JOIN k ON n.doc_id = k.doc_id AND n.key = k.key)
SELECT doc_id, count(*) AS n_words, sum(label)::BIGINT AS n_kept, md5(string_agg(label::VARCHAR, '' ORDER BY i)) AS labels FROM l GROUP BY doc_id""",
    "fact_retention": "WITH c AS (SELECT item_id AS case_id, trim(regexp_replace(regexp_replace(text, '(^|\\n)[^ \\n]+ ', '\\1', 'g'), '\\s+', ' ', 'g')) AS c, list_transform(range(1, greatest(1, length(text)) + 1, 50), lambda i: trim(regexp_replace(substr(text, i, 30), '\\s+', ' ', 'g'))) AS facts FROM benchmark) SELECT case_id, len(facts)::BIGINT AS n_facts, len(list_filter(facts, lambda f: contains(c, f)))::BIGINT AS n_kept FROM c",
    "json_shrink": """SELECT event_id AS block, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","inner":{"props":"' || replace(props, '"', '\\"') || '"}}' AS text FROM events""",
    "code_compress": f"""WITH p AS (SELECT p_brand AS block, string_agg('def part_' || p_partkey || '():' || chr(10) || '    return ' || p_size, chr(10) ORDER BY p_partkey) AS body FROM part GROUP BY p_brand)
SELECT block, '# 4 imports collapsed' || chr(10) || 'import os' || chr(10) || 'import sys' || chr(10) || '# ... +2 more' || chr(10) || body AS text FROM p""",
    "mixed_script": f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all('p{chr(0x430)}ypal and {chr(0xAA)}1 ' || text, '\\pL{{2,}}'), lambda w: regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '\\p{{Cyrillic}}|\\p{{Greek}}'))[1:10], ' ') AS words FROM documents",
    "rate_limit_log": RATE_LIMIT,
    "page_links": PAGE_LINKS,
    "html_main_text": f"SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (SELECT page_id, {MAIN_TEXT} AS t FROM pages)",
    "page_plain_text": f"SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (SELECT page_id, {PLAIN_TEXT} AS t FROM pages)",
    "training_augmented": AUGMENTED,
    "training_formatted": FORMATTED,
    "training_split": f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (ORDER BY {_draw('key', 42)}, key) AS nth, count(*) OVER () AS n FROM pairs) SELECT conv_id, turn, CASE WHEN nth <= greatest(1, floor(n * 0.1)) THEN 'eval' ELSE 'train' END AS part FROM r",
    "synth_sentences": _synth(500),
    "token_accuracy": "WITH l AS (SELECT coalesce(quality, 0) AS p1, coalesce(toxic, 0) AS p2, coalesce(toxic, -100) AS l1, coalesce(quality, -100) AS l2 FROM labels) SELECT round(sum((l1 <> -100 AND p1 = l1)::INT + (l2 <> -100 AND p2 = l2)::INT) / sum((l1 <> -100)::INT + (l2 <> -100)::INT), 9) AS token_accuracy FROM l",
    "label_drop_rate": f"""WITH b AS (SELECT item_id AS doc_id, text, CASE WHEN item_id % 2 = 0 THEN text ELSE regexp_replace(text, '(^|\\n)[^ \\n]+ ', '\\1', 'g') END AS c FROM benchmark), o AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, {WORDS}))) AS key FROM b), k AS (SELECT doc_id, lower(unnest(regexp_extract_all(c, {WORDS}))) AS key FROM b),
n AS (SELECT doc_id, key, count(*) AS n FROM o GROUP BY ALL), m AS (SELECT doc_id, key, count(*) AS m FROM k GROUP BY ALL), t AS (SELECT n.doc_id, sum(n) AS n, sum(least(n, coalesce(m, 0))) AS kept FROM n LEFT JOIN m ON n.doc_id = m.doc_id AND n.key = m.key GROUP BY n.doc_id) SELECT doc_id, round(1 - kept / n, 6) AS dropped FROM t WHERE kept < n""",
    "compress_block_requests": BLOCK_REQUESTS,
    "instruction_cost": f"SELECT event_id, b AS tokens_before, b // 2 + {_COST} AS tokens_after, b - b // 2 - {_COST} AS tokens_saved, CASE WHEN b > 0 THEN round((b // 2 + {_COST}) / b, 4) ELSE 1 END::DOUBLE AS ratio, {_COST}::BIGINT AS instruction_tokens FROM (SELECT event_id, floor(value)::BIGINT AS b FROM events)",
    "completion_tokens": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN floor(value) ELSE 0 END::BIGINT AS output_tokens FROM events",
    "redact_payload": f"SELECT doc_id, 'model-' || doc_id AS model, md5({_redacted}) AS digest, {dict(_counts)['openai_key']}::BIGINT AS keys, {dict(_counts)['email']}::BIGINT AS mails FROM {SECRET}",
    "invisible_overhead": f"""WITH c AS (SELECT t, regexp_replace(regexp_replace(regexp_replace(t, '{_chars(*fixed.INVISIBLE, *fixed.JOINERS)}', '', 'g'), '{_chars(*fixed.BIDI)}', '', 'g'), '{_SMUGGLED}', '', 'g') AS clean FROM (SELECT {HIDDEN} AS t FROM documents)),
n AS (SELECT sum({_TOKENS.format('t')})::BIGINT AS tokens_pasted, sum({_TOKENS.format('clean')})::BIGINT AS tokens_clean FROM c) SELECT *, round((tokens_pasted - tokens_clean) / tokens_clean * 100, 1) AS overhead_percent FROM n""",
    "invisible_scan": f"SELECT doc_id, {_count(_chars(*fixed.INVISIBLE, *fixed.JOINERS))} AS invisible, {_count(_chars(*fixed.BIDI))} AS bidi, {_count(_chars(*fixed.NBSP))} AS nbsp, CASE WHEN doc_id % 2 = 0 THEN lang || '{chr(0x430)}' ELSE '' END AS mixed FROM (SELECT doc_id, lang, {HIDDEN} AS t FROM documents)",
    "conversation_titles": f"WITH {TITLES} SELECT conv_id, title, created_at, updated_at, n_messages FROM named WHERE conv_id % 7 <> 0",
    "recent_conversations": f"WITH {TITLES} SELECT conv_id, title FROM (SELECT * FROM named ORDER BY updated_at DESC, conv_id LIMIT 10)",
    "dashboard": f"""WITH {LEDGER}, b AS ({' UNION ALL '.join(f"SELECT 'by_{d}' AS section, count(*) AS items FROM (SELECT * FROM ({_breakdown(d)}) ORDER BY tokens_saved DESC, key LIMIT 12)" for d in ('tool', 'provider', 'model'))})
SELECT 'session' AS section, count(*) AS requests, sum(saved)::BIGINT AS tokens_saved, NULL::BIGINT AS n_s, NULL::BIGINT AS items FROM ledger WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' UNION ALL SELECT 'lifetime', count(*), sum(saved)::BIGINT, NULL, NULL FROM ledger
UNION ALL SELECT 'daily', NULL, NULL, NULL, 5 UNION ALL SELECT 'output_effect', NULL, NULL, count(*) FILTER (shaped = 1 AND output_tokens > 0), NULL FROM ledger UNION ALL SELECT section, NULL, NULL, NULL, items FROM b""",
    "purge_expired": f"""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 86400000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g), a AS (SELECT max(ts) AS last FROM s GROUP BY user_id, n), e AS (SELECT epoch(TIMESTAMP '{NOW}') AS now)
SELECT 'originals' AS kind, count(*) FILTER (now - stored_at - 6572000 > 86400) AS removed, count(*) FILTER (now - stored_at - 6572000 <= 86400) AS kept FROM {ORIGINALS}, e
UNION ALL SELECT 'sessions', count(*) FILTER (now - epoch(last) > 86400), count(*) FILTER (now - epoch(last) <= 86400) FROM a, e UNION ALL SELECT 'audit', count(*) FILTER (now - epoch(ts) > 864000), count(*) FILTER (now - epoch(ts) <= 864000) FROM events, e""",
    "limiter_stats": "SELECT count(DISTINCT user_id) AS tracked_clients, 60 AS max_requests, 3600.0::DOUBLE AS window_seconds FROM events WHERE epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(ts) >= 0 AND epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(ts) < 3600",
    "limiter_reset": "WITH f AS (SELECT user_id, min(ts) + INTERVAL 5 DAY AS at_ FROM events WHERE user_id % 2 = 0 GROUP BY user_id) SELECT e.user_id AS client, count(*) AS n FROM events e LEFT JOIN f USING (user_id) WHERE at_ IS NULL OR ts >= at_ GROUP BY 1",
    "encryption_round_trip": "SELECT doc_id, md5(text) AS digest FROM documents",
    "json_in_text": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events",
    "holdout_arms": f"SELECT {_draw('event_id', 0)} % 10000 >= 1000 AS shaped, count(*) AS n FROM events GROUP BY 1",
    "store_info": f"SELECT id, stored_at::BIGINT AS stored_at, length(original)::BIGINT AS original_chars, length(compressed)::BIGINT AS compressed_chars FROM {ORIGINALS}",
    "model_fit_rank": "WITH p AS (SELECT p_name || '-' || p_partkey AS name, (p_size * 500)::BIGINT AS size_mb FROM part), f AS (SELECT *, CASE WHEN size_mb IS NULL OR size_mb = 0 THEN 'unknown' WHEN size_mb <= 11200 THEN 'comfortable' WHEN size_mb <= 16000 THEN 'tight' ELSE 'too_large' END AS fit FROM p) SELECT name, size_mb, fit FROM f ORDER BY list_position(['comfortable', 'tight', 'unknown', 'too_large'], fit), size_mb DESC, name LIMIT 20",
}
