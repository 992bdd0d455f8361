"""DuckDB SQL for the rows of op3: matches and the gaps between them give the positions; checksums are folded over lists.

It differs from the operator only where one checksummed token's text holds the keyword of another.
"""

from __future__ import annotations

from . import secrets

_any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_words = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
#: By kind in listed order: the pattern, and whether its match m with group g, followed by a, is kept.
_crc = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, 31), lambda i: list_concat([CAST(ascii(substr(g, CAST(i AS INTEGER), 1)) AS BIGINT)], list_transform(range(8), lambda z: CAST(-1 AS BIGINT)))))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, CASE WHEN s & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END) END), CAST(4294967295 AS BIGINT))"""
_number = f"list_reduce(list_concat([CAST(0 AS BIGINT)], list_transform(range(31, 37), lambda i: CAST(strpos('{secrets.BASE62.decode()}', substr(g, CAST(i AS INTEGER), 1)) - 1 AS BIGINT))), lambda s, x: s * 62 + x)"
_checked = f"NOT regexp_matches(a, '^[0-9A-Za-z]') AND {_crc} = {_number}"
_KINDS = {
    "assign": (rf"""(?:{_words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 6"),
    "access": ("(AKIA[A-Z0-9]+)", "length(g) >= 20"),
    "hex": ("([0-9a-f]+)", "length(g) >= 24"),
    "github": ("gh[pousr]_([0-9A-Za-z]{36})", _checked),
    "npm": ("npm_([0-9A-Za-z]{36})", _checked),
}
_sum = lambda parts: f"coalesce(list_sum(list_transform({parts}, lambda x: length(x))), 0)"


def _kind(k: int, kind: str) -> str:
    pattern, keep = _KINDS[kind]
    return f"""SELECT rid, '{kind}' AS kind, {k} AS k, i, CAST({_sum('gaps[1:i]')} + {_sum('found[1:i - 1]')} AS BIGINT) AS st, found[i] AS m, groups[i] AS g, gaps[i + 1] AS a
        FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', 1) AS groups, string_split_regex(t, '{pattern}') AS gaps FROM d)) AS p{k}"""


_parts = ",\n".join(f"m{k} AS ({_kind(k, kind)}), k{k} AS (SELECT rid, kind, k, st, st + length(m) AS e FROM m{k} WHERE {_KINDS[kind][1]})" for k, kind in enumerate(secrets.KINDS))
_joined = lambda where: f"coalesce(string_agg(kind || ':' || st || ':' || e, ',' ORDER BY st, k) FILTER ({where}), '')"
_counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)

ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_parts},
spans AS ({' UNION ALL '.join(f'SELECT * FROM k{k}' for k in range(len(secrets.KINDS)))})
SELECT any_value(d.doc_id) AS doc_id, {_counts}, sha256({_joined('k < 3')}) AS base_sha256, {_joined('k >= 0')} AS spans
FROM d LEFT JOIN spans ON spans.rid = d.rid GROUP BY d.rid"""
