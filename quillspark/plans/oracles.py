"""DuckDB SQL of the registered queries, written against the same tables."""

from __future__ import annotations

from ..functions import text as tx
from ..operators import compression, filtering, history, output, ranking, sanitize
from . import noise
from .queries import NOW, QUERY


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


MIXED = f"(SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id - 1, text FROM ({noise.SQL}))"
NOISE = f"({noise.SQL})"


def lines(x: str) -> str:
    return f"(CASE WHEN coalesce({x}, '') = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(regexp_replace({x}, '\\r?\\n\\z', ''), '\\r?\\n') END)"


def sub(x: str, p: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(p)}, {q(to)}, 'g')"


def trim(x: str) -> str:
    return sub(x, rf"^[{tx.WS}]+|[{tx.WS}]+\z")


def trim_end(x: str) -> str:
    return sub(x, rf"[{tx.WS}]+\z")


def low(x: str) -> str:
    return f"translate({x}, '{tx.UPPER}', '{tx.LOWER}')"


def has(x: str, p: str) -> str:
    return f"regexp_matches({x}, {q(p)})"


def tokens_of(x: str) -> str:
    return f"(CASE WHEN coalesce({x}, '') = '' THEN 0 ELSE greatest(CAST(ceil(length({x}) / 4.0) AS BIGINT), (13 * len(regexp_extract_all({x}, {q(tx.WORD)})) + 9) // 10, 1) END)"


def prefix(x: str, n: int) -> str:
    """Whole characters within n bytes, from running byte lengths."""
    return f"(CASE WHEN strlen({x}) <= {n} THEN {x} ELSE coalesce((SELECT string_agg(c, '' ORDER BY i) FROM (SELECT c, i, sum(strlen(c)) OVER (ORDER BY i) AS b FROM (SELECT unnest(string_split(left({x}, {n}), '')) AS c, unnest(range({n})) AS i)) WHERE b <= {n}), '') END)"


def joined(a: str, sep: str = "chr(10)") -> str:
    return f"coalesce(array_to_string({a}, {sep}), '')"


def boiler(x: str) -> str:
    return f"({x} <> '' AND ({trim(x)} IN ({', '.join(map(q, filtering.SPINNERS))}) OR {has(x, filtering.RULE_LINE)} OR {has(x, filtering.NPM_NOISE)}))"


def over(source: str, **columns: str) -> str:
    return f"SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source}"


def picked(test: str, trimmed: bool = False) -> str:
    """Noisy documents, those of their lines that pass a test on x."""
    a = lines("text") if not trimmed else f"list_transform({lines('text')}, lambda x: {trim('x')})"
    return over(NOISE, content=joined(f"list_filter({a}, lambda x: {test})"))


def filtered(source: str, extra: str = "", removed: bool = True) -> str:
    kept = f"SELECT doc_id, i, {trim_end('line')} AS x FROM (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM (SELECT doc_id, {lines(sub('text', filtering.ANSI))} AS a FROM {source}))"
    rows = f"SELECT doc_id, i, {sub('x', f'[{tx.WS}]+', ' ')} AS x FROM ({kept}) WHERE NOT {boiler('x')} {extra}"
    capped = f"SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM ({rows})"
    body = f"SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS c FROM ({capped}) WHERE x <> '' OR p IS NULL OR p <> '' GROUP BY doc_id"
    content = "coalesce(c, '')"
    gone = f", CAST(greatest(0, len({lines('s.text')}) - len({lines(content)})) AS BIGINT) AS lines_removed" if removed else ""
    return f"SELECT s.doc_id, {content} AS content{gone}{{more}} FROM {source} s LEFT JOIN ({body}) b ON b.doc_id = s.doc_id"


def scrubbed(x: str) -> tuple[str, list[str]]:
    """Text after all rules as nested queries, and the count of each rule's matches."""
    counts = []
    sql = f"SELECT doc_id, coalesce(text, '') AS t FROM {x}"
    for i, (_, _, p, to) in enumerate(sanitize.RULES):
        keep = ", ".join(counts)
        sql = f"SELECT doc_id, {sub('t', p, to.replace('$1', chr(92) + '1'))} AS t, len(regexp_extract_all(t, {q(p)})) AS n{i}{', ' + keep if keep else ''} FROM ({sql})"
        counts.append(f"n{i}")
    return sql, counts


def rank_tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, {q(ranking.TOKEN)}), lambda w: {low('w')}), lambda w: strlen(w) >= 2 AND w NOT IN ({', '.join(map(q, ranking.STOP))}))"


def technical(x: str) -> str:
    return f"({x} IN ({', '.join(map(q, ranking.STATUS + ranking.SIGNALS))}) OR {' OR '.join(has(x, p) for p in ranking.TECH)})"


def bm25() -> str:
    terms = ranking.query_terms(QUERY)
    df = ", ".join(f"count(*) FILTER (list_contains(tok, {q(t)})) AS df{i}" for i, t in enumerate(terms))
    norm = "(1.2 * (1 - 0.75 + 0.75 * len(tok) / avgdl))"
    parts = []
    for i, t in enumerate(terms):
        idf = lambda d: f"ln((n - {d} + 0.5) / ({d} + 0.5) + 1)"
        f, soft = f"len(list_filter(tok, lambda w: w = {q(t)}))", f"len(list_filter(tok, lambda w: contains(w, {q(t)}) OR contains({q(t)}, w)))"
        parts.append(f"CASE WHEN {f} > 0 THEN {idf(f'df{i}')} * ({f} * 2.2) / ({f} + {norm}) WHEN {soft} > 0 THEN {idf(f'(CASE WHEN df{i} > 0 THEN df{i} ELSE 1 END)')} * ({soft} * 2.2) / ({soft} + {norm}) * 0.5 ELSE 0 END")
    same = f"len(list_filter(tok, lambda w: {technical('w')} AND w IN ({', '.join(map(q, terms))})))"
    near = f"len(list_filter(tok, lambda w: {technical('w')} AND ({' OR '.join(f'contains(w, {q(t)}) OR contains({q(t)}, w)' for t in terms)})))"
    alarm = " OR ".join(f"contains(translate(text, '{tx.LOWER}', '{tx.UPPER}'), '{w}')" for w in ("ERROR", "WARN", "FAIL", "PANIC"))
    return f"""SELECT doc_id, s + CASE WHEN s > 0 AND ({alarm}) THEN 0.35 ELSE 0 END AS score FROM (
SELECT doc_id, text, CASE WHEN len(tok) > 0 THEN {' + '.join(parts)} ELSE 0 END + CASE WHEN {same} > 0 THEN 1.5 * {same} ELSE 0.15 * least({near}, 3) END AS s
FROM (SELECT doc_id, coalesce(text, '') AS text, {rank_tokens("coalesce(text, '')")} AS tok FROM documents),
(SELECT count(*) AS n, avg(len(tok)) AS avgdl, {df} FROM (SELECT {rank_tokens("coalesce(text, '')")} AS tok FROM documents)))"""


def cos(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
    return f"greatest(-1.0, least(1.0, {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))))"


def starts(x: str, *heads: str) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(h)})" for h in heads) + ")"


def entities() -> str:
    """Candidates of every pattern in order; the first ones that are new, up to each cap."""
    safe = f"regexp_replace(text, '[À-ÖØ-öø-ÿœŒ]', '_', 'g')"  # noqa: F541
    sql = f"SELECT doc_id, text, CAST([] AS VARCHAR[]) AS e FROM {MIXED}"
    for i, (p, cap) in enumerate(compression.ENTITIES):
        found = f"list_filter(list_transform(regexp_extract_all({safe if i == 2 else 'text'}, {q(p)}), lambda x: {sub('x', r'^[,;.)]+|[,;.)]+$')}), lambda x: strlen(x) >= 3)"
        uniq = "list_transform(list_filter(list_zip(f, range(len(f))), lambda p: list_position(f, p[1]) = p[2] + 1), lambda p: p[1])"
        sql = f"SELECT doc_id, text, list_concat(e, list_filter({uniq}, lambda x: NOT list_contains(e, x))[1:{cap}]) AS e FROM (SELECT *, {found} AS f FROM ({sql}))"
    return f"SELECT doc_id, {joined('e[1:24]', q('·'))} AS entities FROM ({sql})"


def detect_domain() -> str:
    c = lambda *xs: "(" + " OR ".join(f"contains(l, {q(x)})" for x in xs) + ")"
    return f"""SELECT doc_id, CASE WHEN regexp_matches(h, '^[{{\\[]') AND json_valid(h) THEN 'json' WHEN {c("compiling ")} AND {c("cargo", "finished `")} THEN 'cargo'
WHEN {c("error[e", " --> src/")} THEN 'rustc' WHEN {c("diff --git", "git status")} OR starts_with(l, 'commit ') THEN 'git' WHEN {c("npm warn")} OR ({c("added ")} AND {c("packages")}) THEN 'npm'
WHEN {c("digest:", "pulling fs layer", "sha256:")} THEN 'docker' WHEN {c("kubectl", "namespace/", "pod/")} THEN 'kubectl' WHEN {c("===== test session", "passed in")} THEN 'pytest'
WHEN {c("gcc ", "collect2:")} THEN 'gcc' ELSE 'generic' END AS domain FROM (SELECT doc_id, {low("left(text, 4000)")} AS l, {trim("left(text, 4000)")} AS h FROM {MIXED})"""


def detect_type() -> str:
    code = starts(sub("x", rf"^[{tx.WS}]+"), *compression.CODE_STARTS)
    log = "contains(x, ' ERROR ') OR contains(x, ' WARN ') OR contains(x, ' INFO ') OR (starts_with(x, '[') AND contains(x, ']') AND (contains(x, 'error') OR contains(x, 'warn') OR contains(x, 'info')))"
    return f"""SELECT doc_id, CASE WHEN regexp_matches(h, '^[{{\\[]') AND json_valid(h) THEN 'json' WHEN len(list_filter(a[1:20], lambda x: {log})) >= 3 THEN 'log'
WHEN len(list_filter(a, lambda x: {code})) > 0 THEN 'code' WHEN contains(text, 'user:') OR contains(text, 'assistant:') OR contains(text, '```') THEN 'conversation' ELSE 'text' END AS kind
FROM (SELECT doc_id, text, {lines("text")} AS a, {sub("text", rf"^[{tx.WS}]+")} AS h FROM {MIXED})"""


def exploded(source: str, expr: str = "x") -> str:
    return f"SELECT doc_id, i, {expr} AS x FROM (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i FROM (SELECT doc_id, {lines('text')} AS a FROM {source}))"


def whole(rows: str) -> str:
    """Documents of noisy rows (doc_id, i, x); those without rows are empty."""
    return f"SELECT s.doc_id, coalesce(c, '') AS content FROM {NOISE} s LEFT JOIN (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS c FROM ({rows}) GROUP BY doc_id) b ON b.doc_id = s.doc_id"


def sentence(x: str, n: int) -> str:
    flat = f"replace({x}, chr(10), ' ')"
    cut = prefix(f"regexp_extract({flat}, '^[^.!?]*[.!?]?', 0)", n)
    return f"{trim(cut)} || CASE WHEN strlen({flat}) > strlen({cut}) THEN '…' ELSE '' END"


_said = "CASE WHEN turn % 3 = 1 THEN ['ok', ' Thanks! ', 'ok?', 'okra'][conv_id % 4 + 1] ELSE text END"
_fill = f"(x = '' OR x IN ({', '.join(map(q, history.FILLERS))}) OR (length(x) <= 12 AND NOT contains(x, '?') AND {starts('x', *history.FILLERS)}))"
_calls = "(SELECT event_id, event_type AS action, event_id * 37 % 1000 + 10 AS a, event_id * 53 % 900 AS b, event_id % 977 / 8.0 AS ms FROM events)"
_sums = "count(*) AS calls, CAST(sum(a) AS BIGINT) AS original_tokens, CAST(sum(b) AS BIGINT) AS result_tokens, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS tokens_saved, round(sum(greatest(a - b, 0)) / sum(a), 6) AS saved_ratio"
_scrub, _ns = scrubbed(MIXED)
_head = "len(a) > 6"

ORACLE_SQL = {
    "count_tokens": over("documents", tokens=tokens_of("text"), chars="length(text)", bytes="strlen(text)"),
    "token_totals_by_lang": f"SELECT lang, count(*) AS n, CAST(sum({tokens_of('text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang",
    "signal_bypass": over("documents", bypassed="length(text) < 1000"),
    "lines_explode": f"SELECT doc_id, i AS line_no, x AS line FROM ({exploded(MIXED)})",
    "filter_documents": filtered("documents").replace("{more}", f", {tokens_of('s.text')} AS original_tokens, {tokens_of('c')} AS result_tokens"),
    "filter_noise": filtered(NOISE).replace("{more}", ""),
    "filter_keep_drop": filtered(MIXED, "AND NOT (regexp_matches(x, '^see') OR regexp_matches(x, 'tion')) AND regexp_matches(x, 'the')", False).replace("{more}", ""),
    "filter_collapse_ws": over(MIXED, content=joined(f"list_transform({lines('text')}, lambda x: {sub('x', f'[{tx.WS}]+', ' ')})")),
    "filter_blank_runs": f"SELECT s.doc_id, coalesce(c, '') AS content FROM {MIXED} s LEFT JOIN (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS c FROM (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM ({exploded(MIXED, trim_end('x'))})) WHERE x <> '' OR p IS NULL OR p <> '' GROUP BY doc_id) b ON b.doc_id = s.doc_id",
    "entities_top": f"SELECT entity, count(*) AS n FROM (SELECT unnest(string_split(entities, '·')) AS entity FROM ({entities()}) WHERE entities <> '') GROUP BY entity ORDER BY n DESC, entity LIMIT 20",
    "filter_boilerplate": f"SELECT event_id, {boiler('x')} AS noise FROM (SELECT event_id, {trim_end(noise.LINE)} AS x FROM events)",
    "filter_truncate": over("documents", content=f"CASE WHEN {tokens_of('text')} <= 100 THEN text ELSE {prefix('text', 400)} || chr(10) || '…[truncated]' END"),
    "densify_json": "SELECT event_id, CAST(CAST(props AS JSON) AS VARCHAR) AS content FROM (SELECT event_id, replace(props, ' ', '') AS props FROM events)",
    "sanitize_text": f"SELECT doc_id, t AS content, CAST({' + '.join(_ns)} AS BIGINT) AS redacted_count FROM ({_scrub})",
    "sanitize_findings": " UNION ALL ".join(f"SELECT '{k}' AS kind, '{lb}' AS label, CAST(sum(n{i}) AS BIGINT) AS n, count(*) AS docs FROM ({_scrub}) WHERE n{i} > 0 HAVING count(*) > 0" for i, (k, lb, _, _) in enumerate(sanitize.RULES)),
    "entities_extract": entities(),
    "dedupe_consecutive": whole(f"SELECT * FROM (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM ({exploded(NOISE, trim('x'))}) WHERE x <> '') WHERE p IS NULL OR p <> x"),
    "log_group": whole(f"SELECT doc_id, min(i) AS i, CASE WHEN count(*) > 1 THEN '×' || count(*) || ' ' ELSE '' END || x AS x FROM ({exploded(NOISE, trim(sub('x', compression.LOG_PREFIX)).replace(chr(39) + 'g' + chr(39), chr(39) + 'g' + chr(39)))}) WHERE x <> '' GROUP BY doc_id, x"),
    "detect_type": detect_type(),
    "detect_domain": detect_domain(),
    "head_tail": f"SELECT doc_id, CASE WHEN {_head} THEN {joined('a[1:3]')} || chr(10) || '…[' || (len(a) - 5) || ' lines omitted]…' || chr(10) || {joined('a[-2:]')} || chr(10) ELSE text END AS content FROM (SELECT doc_id, text, {lines('text')} AS a FROM {MIXED})",
    "git_context": whole(f"SELECT * FROM (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM ({exploded(NOISE)})) WHERE {starts('x', *output.GIT_HEADS)} OR NOT starts_with(x, ' ') OR starts_with(p, '@@')"),
    "cargo_collapse": whole(f"SELECT doc_id, i, x FROM (SELECT *, count(*) FILTER (c) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, starts_with(t, 'Compiling ') AS c FROM (SELECT *, ltrim(x) AS t FROM ({exploded(NOISE)})))) WHERE CASE WHEN c THEN k <= 3 OR contains(x, 'error') ELSE NOT {starts('t', 'Downloading ', 'Downloaded ', 'Checking ')} END UNION ALL SELECT doc_id, -1, '…[' || count(*) || ' Compiling lines collapsed]' FROM ({exploded(NOISE)}) WHERE starts_with(ltrim(x), 'Compiling ') GROUP BY doc_id HAVING count(*) > 3"),
    "npm_drop": picked(f"NOT {starts(low('x'), 'npm warn', 'npm notice', 'deprecated ')}"),
    "docker_drop": picked(f"NOT {has('x', output.DOCKER_PROGRESS)}"),
    "kubectl_columns": over(NOISE, content=joined(f"list_transform({lines('text')}, lambda x: CASE WHEN len(regexp_split_to_array({trim('x')}, '\\s+')) >= 3 AND regexp_split_to_array({trim('x')}, '\\s+')[1] <> 'NAME' THEN array_to_string(regexp_split_to_array({trim('x')}, '\\s+')[1:3], ' ') ELSE x END)")),
    "rustc_drop": picked(f"NOT {starts('ltrim(x)', '= note: `#[warn', '= help: consider')}"),
    "pytest_drop": picked(f"NOT (ends_with({trim('x')}, ' PASSED') AND NOT contains(x, 'FAILED'))"),
    "gcc_drop": picked(f"contains({low('x')}, 'error') OR contains({low('x')}, 'warning') OR contains({low('x')}, 'undefined') OR NOT contains({low('x')}, 'in function')"),
    "first_sentence": over(MIXED, sentence=sentence("text", 140)),
    "key_phrases": f"SELECT s.doc_id, coalesce(c, '') AS phrases FROM {MIXED} s LEFT JOIN (SELECT doc_id, string_agg(y, chr(10) ORDER BY i) AS c FROM (SELECT doc_id, i, {sentence('x', 120)} AS y FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM ({exploded(MIXED, trim('x'))}) WHERE strlen(x) > 20) WHERE k <= 6) GROUP BY doc_id) b ON b.doc_id = s.doc_id",
    "detect_mode": over(MIXED, mode=f"CASE WHEN len(list_filter({lines('text')}, lambda x: contains(x, '/') AND (contains(x, '.') OR ends_with({trim('x')}, '/') OR {starts(trim('x'), '├', '│', '└', '- ')}))) >= 5 THEN 'filetree' WHEN len(list_filter({lines('text')}, lambda x: {starts(low('x'), 'user:', 'assistant:', 'system:', '**user**', '**assistant**')})) >= 2 THEN 'conversation' ELSE 'outline' END"),
    "code_squeeze": whole(f"SELECT doc_id, i, x FROM (SELECT *, last_value(CASE WHEN contains(x, '*/') THEN 0 WHEN starts_with(x, '/*') THEN 1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM ({exploded(NOISE, trim('x'))})) WHERE coalesce(inside, 0) = 0 AND NOT starts_with(x, '/*') AND CASE WHEN starts_with(x, '//') OR (starts_with(x, '#') AND NOT starts_with(x, '#!')) THEN {' OR '.join(f"contains(x, {q(n)})" for n in compression.NOTES)} OR {starts('x', '///', '//!')} ELSE x NOT IN ({', '.join(map(q, compression.LONE_BRACKETS))}) END"),
    "filetree_ext_counts": "SELECT lower(regexp_extract(url, '\\.([^./]+)$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1",
    "outline_sections": f"SELECT doc_id, i AS line_no, CASE WHEN k BETWEEN 1 AND 6 THEN k ELSE 1 END AS level, {sub(trim(sub('x', '^#+')), ':+$')} AS title FROM (SELECT *, length(regexp_extract(x, '^#*', 0)) AS k FROM ({exploded(MIXED, trim('x'))})) WHERE k BETWEEN 1 AND 6 OR (strlen(x) < 60 AND regexp_matches(x, '\\p{{L}}') AND NOT regexp_matches(x, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]'))",
    "prune_remove": f"SELECT conv_id, turn, role, text FROM (SELECT conv_id, turn, role, text, {low(trim('text'))} AS x FROM (SELECT conv_id, turn, role, {_said} AS text FROM conversations)) WHERE NOT {_fill}",
    "prune_hybrid": f"WITH b AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS a FROM (SELECT conv_id, turn, role, {low(trim('text'))} AS x FROM (SELECT conv_id, turn, role, {_said} AS text FROM conversations)) WHERE NOT {_fill}) SELECT conv_id, turn, role, 'critical' AS tier FROM b WHERE a <= 4 UNION ALL SELECT conv_id, min(turn), 'system', 'thematic' FROM b WHERE a > 4 GROUP BY conv_id",
    "prune_afm_tiers": "SELECT conv_id, tier, count(*) AS n, min(turn) AS first FROM (SELECT *, CASE WHEN a <= 2 THEN 'critical' WHEN a <= 5 THEN 'thematic' ELSE 'distant' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS a FROM conversations)) GROUP BY conv_id, tier",
    "prune_budget": f"SELECT conv_id, turn FROM (SELECT *, sum(k) OVER w AS s, row_number() OVER w AS a FROM (SELECT *, {tokens_of(chr(40) + 'role || ' + q(': ') + ' || ' + trim('text') + ' || chr(10))')} AS k FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE s <= 120 OR a = 1",
    "bm25_rank": f"SELECT doc_id, round(score, 6) AS score FROM ({bm25()})",
    "bm25_topk": f"SELECT doc_id, round(score, 6) AS score FROM ({bm25()}) ORDER BY 2 DESC, 1 LIMIT 25",
    "technical_tokens": over(MIXED, n=f"len(list_filter({rank_tokens('text')}, lambda w: {technical('w')}))"),
    "cosine_topk": f"SELECT v.vec_id, round({cos('v.embedding', 'o.embedding')}, 6) AS cosine FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) o ORDER BY 2 DESC, 1 LIMIT 20",
    "minmax_norm": "SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 9) AS scaled FROM events",
    "hybrid_rerank": f"SELECT doc_id, round(0.55 * b + 0.45 * ({cos('v.embedding', 'o.embedding')} + 1) / 2, 6) AS score FROM (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS b FROM ({bm25()})) JOIN embeddings v ON doc_id = vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) o ORDER BY 2 DESC, 1 LIMIT 50",
    "chunk_fixed": "SELECT doc_id, k AS idx, k * 1792 AS start, substring(text, k * 1792 + 1, 2048) AS content FROM (SELECT doc_id, text, unnest(range(greatest(CAST(ceil((length(text) - 256) / 1792.0) AS BIGINT), 1))) AS k FROM documents WHERE length(text) > 0)",
    "resolve_chunk": None,
    "cache_ttl_get": "WITH c AS (SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS m, arg_max(props, event_id) AS content FROM events GROUP BY 1) SELECT k.key, c.content, c.content IS NOT NULL AS hit FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) || unnest(['', 'x']) AS key FROM events) k LEFT JOIN c ON c.key = k.key AND m + CASE WHEN CAST(c.key AS BIGINT) % 3 = 0 THEN 0 ELSE 5000 END > 12000",
    "session_stats": f"SELECT {_sums} FROM {_calls}",
    "stats_by_action": f"SELECT action, {_sums} FROM {_calls} GROUP BY action",
    "latency_percentiles": "SELECT action, len(v) AS n, " + ", ".join(f"round(v[CAST(floor((len(v) - 1) * {p} + 0.5) AS BIGINT) + 1], 3) AS {n}" for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + f" FROM (SELECT action, list_sort(list(ms)) AS v FROM {_calls} GROUP BY action)",
    "mtime_boost": f"SELECT event_id, round(greatest(0.35 * (1 - least(greatest({NOW} - CAST(floor(epoch(ts)) AS BIGINT), 0) / 86400.0 / 90.0, 1.0)), 0.0), 12) AS boost FROM events",
    "stale_median": "WITH f AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS mtime, event_type FROM events), m AS (SELECT list_sort(list(mtime)) AS v FROM f WHERE event_type = 'view') SELECT event_id, mtime FROM f, m WHERE event_type = 'click' AND mtime + 604800 <= v[len(v) // 2 + 1]",
    "per_source_cap": "SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 2",
    "pack_unpack": "SELECT doc_id // 20 AS archive_id, 'd/' || doc_id || '.txt' AS path, strlen(text) AS bytes FROM documents",
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
