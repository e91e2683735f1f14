"""DuckDB SQL for the queries that SQL can express. Both sides state their method apart from each other."""

from __future__ import annotations

from collections.abc import Iterable

from packetloom.llm import line_dedup, quality


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_filter(rules: Iterable[tuple[str, str]], listed: Iterable[str]) -> str:
    values = ", ".join(f"({quoted(e.partition('/')[0])}, {quoted('/' + e.partition('/')[2])}, {quoted(v)})" for v, e in rules)
    urls = ", ".join(f"({quoted(u if '://' in u else 'x://' + u)})" for u in listed)
    # the same for pages and listed URLs: what stands after the scheme, the host, the path, and both in canonical form
    split = """SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {0})"""
    parts = """SELECT *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM ({0})"""
    clean = """SELECT *, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS c_host, array_to_string(list_transform(string_split(path, '%'), lambda p, i:
      CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^([46][1-9A-Fa-f]|[57][0-9Aa]|3[0-9]|2[DdEe]|5[Ff]|7[Ee])') THEN chr(CAST('0x' || left(p, 2) AS INTEGER)) || substr(p, 3) ELSE '%' || p END), '') AS c_path FROM ({0})"""
    whole = lambda source: clean.format(parts.format(split.format(source)))
    return f"""WITH p AS ({whole('(SELECT page_id, row_number() OVER () AS n, url FROM pages)')}),
      u(url) AS (VALUES {urls}), l AS (SELECT DISTINCT c_host AS l_host, rtrim(c_path, '/') AS l_path FROM ({whole('u')}) WHERE c_host <> ''),
      e(e_host, e_path, verdict) AS (VALUES {values}),
      m AS (SELECT n, max_by((e_host, e_path, verdict), (length(e_host) + length(e_path), length(e_host))) AS best
        FROM p JOIN e ON (host = e_host OR ends_with(host, '.' || e_host)) AND starts_with(path, e_path) GROUP BY n),
      b AS (SELECT DISTINCT n FROM p JOIN l ON (c_host = l_host OR ends_with(c_host, '.' || l_host)) AND (l_path = '' OR c_path = l_path OR starts_with(c_path, l_path || '/')))
      SELECT page_id, host, path, best[1] || best[2] AS rule, CASE WHEN best IS NOT NULL THEN best[3] WHEN b.n IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM p LEFT JOIN m USING (n) LEFT JOIN b USING (n)"""


#: Kinds of secret, their patterns as the SQL engine reads them, and which group must have how many characters.
SECRETS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[ \t\r\n]|\\r|\\n)*(?:[A-Z][A-Za-z-]*: [^\n\\]*|[A-Za-z0-9+/=]{16,}))*(?:(?:[ \t\r\n]|\\r|\\n)*[A-Za-z0-9+/=]*(?:[ \t\r\n]|\\r|\\n)*-----END [A-Z ]*PRIVATE KEY-----)?", 0, 0),
    ("github", "gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)


def secrets() -> str:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(SECRETS):
        parts.append(f"SELECT n, '{kind}' AS kind, {rank} AS rank, {least} AS least, string_split_regex(t, {quoted(pattern)}) AS gaps, regexp_extract_all(t, {quoted(pattern)}, 0) AS found, regexp_extract_all(t, {quoted(pattern)}, {group}) AS value FROM d")
    base = ", ".join(quoted(k) for k in ("assign", "access", "hex"))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents), k AS ({' UNION ALL '.join(parts)}),
      s AS (SELECT n, kind, rank, least, gaps, found, value, unnest(range(1, len(found) + 1)) AS i FROM k),
      p AS (SELECT n, kind, rank, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start, length(found[i]) AS width FROM s WHERE length(value[i]) >= least),
      a AS (SELECT n, {counts}, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + width AS BIGINT), ',' ORDER BY start, rank) AS spans,
        string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + width AS BIGINT), ',' ORDER BY start, rank) FILTER (WHERE kind IN ({base})) AS base FROM p GROUP BY n)
      SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in ("assign", "access", "hex"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (n)"""


def lines() -> str:
    return f"""WITH pages_of AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL), totals AS (SELECT source, count(*) AS pages FROM pages_of GROUP BY source),
      l AS (SELECT DISTINCT source, text, unnest(string_split(text, chr(10))) AS line FROM pages_of),
      f AS (SELECT l.source, line FROM l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source WHERE regexp_matches(line, {quoted(line_dedup.HAS_WORD)})
        GROUP BY l.source, line, pages HAVING count(*) >= {line_dedup.LEAST_PAGES} AND count(*) > CAST({line_dedup.RATIO} AS DOUBLE) * pages),
      g AS (SELECT source, list(line) AS dropped FROM f GROUP BY source),
      d AS (SELECT doc_id, documents.source, text, string_split(text, chr(10)) AS own, coalesce(dropped, []) AS dropped FROM documents LEFT JOIN g ON documents.source IS NOT DISTINCT FROM g.source),
      k AS (SELECT *, list_filter(own, lambda x: NOT list_contains(dropped, x)) AS kept FROM d)
      SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL WHEN len(kept) = len(own) THEN text ELSE array_to_string(kept, chr(10)) END AS text, coalesce(len(own), 0) AS n_lines, coalesce(len(own) - len(kept), 0) AS n_dropped FROM k"""


def quality_rules() -> str:
    white = quoted(quality.WHITE + "+")
    listed = lambda words: "[" + ", ".join(map(quoted, words)) + "]"
    own = "CASE lang " + " ".join(f"WHEN '{lang}' THEN {listed(words)}" for lang, words in quality.COMMON_WORDS.items()) + " END"
    n_class, n_common = len(quality.CLASSES) + 2, 1 + len(quality.COMMON_WORDS["en"])
    classes = ", ".join(f"len(regexp_extract_all(t, {quoted(p)}))" for p in quality.CLASSES.values())
    mean = lambda name, n: "[" + ", ".join(f"avg({name}[{i}])" for i in range(1, n + 1)) + "]"
    share = lambda h: f"list_transform({h}, lambda x: CASE WHEN list_sum({h}) > 0 THEN x / list_sum({h}) ELSE 0 END)"

    def distance(p: str, q: str) -> str:
        part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p}[i] + {q}[i]) / 2)) ELSE 0 END"
        return f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(f'{p}[i]')} + {part(f'{q}[i]')})) / 2, 0))"

    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
      w AS (SELECT *, list_filter(string_split_regex(t, {white}), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {quoted(quality.WORD_CHAR)})) AS lines, {own} AS own FROM d),
      c AS (SELECT doc_id, n, lang, t, words, own, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
      i AS (SELECT n, words, unnest(range(1, n_words - {quality.WINDOW - 2})) AS pos FROM c WHERE n_words >= {quality.WINDOW}),
      v AS (SELECT n, pos, array_to_string(words[pos:pos + {quality.WINDOW - 1}], ' ') AS win FROM i),
      r AS (SELECT n, pos FROM (SELECT n, pos, count(*) OVER (PARTITION BY n, win) AS times FROM v) WHERE times > 1),
      m AS (SELECT n, count(DISTINCT pos + o) AS n_repeat_words FROM r, (SELECT unnest(range({quality.WINDOW})) AS o) GROUP BY n),
      x AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, [{classes}] AS counted, list_transform(own, lambda o: len(list_filter(words, lambda y: lower(y) = o))) AS hits FROM c LEFT JOIN m USING (n)),
      y AS (SELECT *, list_concat(list_transform(counted, lambda z: CAST(z AS DOUBLE)), [CAST(length(t) - word_chars AS DOUBLE), CAST(word_chars - list_sum(counted) AS DOUBLE)]) AS classes, CASE WHEN own IS NOT NULL THEN list_concat(list_transform(hits, lambda z: CAST(z AS DOUBLE)), [CAST(n_words - list_sum(hits) AS DOUBLE)]) END AS common FROM x),
      s AS (SELECT *, {share('classes')} AS p, CASE WHEN common IS NOT NULL THEN {share('common')} END AS q FROM y),
      f AS (SELECT lang, {mean('p', n_class)} AS rp, {mean('q', n_common)} AS rq FROM s WHERE n_words >= {quality.GUARD_WORDS} GROUP BY lang),
      j AS (SELECT s.*, CASE WHEN n_words >= {quality.GUARD_WORDS} THEN {distance('p', 'rp')} END AS dp, CASE WHEN n_words >= {quality.GUARD_WORDS} AND q IS NOT NULL THEN {distance('q', 'rq')} END AS dq,
        n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEATED_SHARE} * n_words AS base_failed FROM s LEFT JOIN f USING (lang))
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(dp <= {quality.CLASS_LIMIT}, true) AND coalesce(dq <= {quality.COMMON_LIMIT}, true) AS kept,
        round(dp, 6) AS class_distance, round(dq, 6) AS common_distance FROM j"""
