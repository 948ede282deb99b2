"""The URL filter as one SQL text for DuckDB, level by level, for comparison."""

from __future__ import annotations

from .url_filter import LOWER, RULES, UPPER, rule_condition


def judge_sql(rules=RULES, max_depth: int = 8, fanout: int = 40, alpha: float = 4.0, prior: float = 0.8, threshold: float = 0.5, z: float = 1.96) -> str:
    levels = range(1, max_depth + 2)
    verdicts = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for verdict, rule in rules)
    digits = r"regexp_replace(regexp_replace(lower(s), '^[0-9a-f]{8,}(-[0-9a-f]+)*$', CASE WHEN regexp_matches(lower(s), '[0-9]') AND regexp_matches(lower(s), '^[0-9a-f]{8,}(-[0-9a-f]+)*$') THEN '{h}' ELSE lower(s) END), '[0-9]+', '{n}', 'g')"
    out = [
        f"""u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE NULL END AS rest FROM pages)""",
        f"""p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)""",
        f"r AS (SELECT *, {rule_condition(rules)} AS rule, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM p)",
        f"""q AS (SELECT page_id, host, path, rule, CASE rule {verdicts} END AS ruled,
            list_concat(list_transform(parts[1:{max_depth}], lambda s: {digits}),
                CASE WHEN len(parts) > {max_depth} THEN [array_to_string(list_transform(parts[{max_depth + 1}:], lambda s: {digits}), '/')] ELSE [] END) AS segs FROM r)""",
        "l0 AS (SELECT host, array_to_string(segs, '/') AS leaf, segs, count(*) AS n, count(ruled) AS m, count(*) FILTER (ruled = 'allow') AS good FROM q GROUP BY host, segs)",
    ]
    for k in levels:
        before, parent = f"l{k - 1}", f"array_to_string(segs[1:{k - 1}], '/')" if k > 1 else "''"
        head = f"segs[1:{k - 1}]" if k > 1 else "[]::VARCHAR[]"
        out += [
            f"h{k} AS (SELECT *, {parent} AS parent, segs[{k}] AS child FROM {before})",
            f"k{k} AS (SELECT host, parent, child, sum(n) AS kn, count(*) OVER (PARTITION BY host, parent) AS kids, sum(sum(n)) OVER (PARTITION BY host, parent) AS pn FROM h{k} WHERE child IS NOT NULL GROUP BY host, parent, child)",
            f"""l{k} AS (SELECT h.host, h.leaf, CASE WHEN t.child IS NOT NULL THEN list_concat(list_concat({head.replace('segs', 'h.segs')}, ['*']), h.segs[{k + 1}:]) ELSE h.segs END AS segs, h.n, h.m, h.good
            FROM h{k} h LEFT JOIN (SELECT * FROM k{k} WHERE kids > {fanout} AND kn * 10 < pn) t ON h.host = t.host AND h.parent = t.parent AND h.child = t.child)""",
        ]
    last = f"l{levels[-1]}"
    out += [
        f"""w AS (SELECT host, leaf, m, good, lev, array_to_string(segs[1:lev], '/') AS node, CASE WHEN lev > 1 THEN array_to_string(segs[1:lev - 1], '/') ELSE '' END AS up
            FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS lev FROM {last}))""",
        "n0 AS (SELECT host, lev, node, up, sum(m) AS m, sum(good) AS good FROM w GROUP BY ALL)",
        "n1 AS (SELECT *, sum(m) OVER f AS pm, sum(good) OVER f AS pg FROM n0 WINDOW f AS (PARTITION BY host, lev, up))",
        f"n2 AS (SELECT *, (pg + 0.5) / (pm + 1) AS share, m > 0 AND abs(good - m * ((pg + 0.5) / (pm + 1))) / sqrt(m * ((pg + 0.5) / (pm + 1)) * (1 - (pg + 0.5) / (pm + 1))) <= {z} AS alike FROM n1)",
        """n3 AS (SELECT host, lev, node, CASE WHEN alike THEN sum(m) FILTER (alike) OVER f ELSE m END AS m, CASE WHEN alike THEN sum(good) FILTER (alike) OVER f ELSE good END AS good
            FROM n2 WINDOW f AS (PARTITION BY host, lev, up))""",
        "c0 AS (SELECT DISTINCT host, leaf, " + f"{prior}::DOUBLE AS purity, NULL::VARCHAR AS template FROM w)",
    ]
    for k in levels:
        out.append(
            f"""c{k} AS (SELECT c.host, c.leaf, CASE WHEN n.node IS NULL THEN c.purity ELSE (n.good + {alpha}::DOUBLE * c.purity) / (n.m + {alpha}::DOUBLE) END AS purity,
            coalesce(n.node, c.template) AS template FROM c{k - 1} c LEFT JOIN w ON w.host = c.host AND w.leaf = c.leaf AND w.lev = {k}
            LEFT JOIN n3 n ON n.host = w.host AND n.lev = w.lev AND n.node = w.node)"""
        )
    return "WITH " + ",\n".join(out) + f"""
        SELECT page_id, q.host, q.path, q.rule, coalesce(q.ruled, CASE WHEN c.purity < {threshold} THEN 'block' ELSE 'allow' END) AS verdict, c.template, round(c.purity, 9) AS purity
        FROM q LEFT JOIN c{levels[-1]} c ON c.host = q.host AND c.leaf = array_to_string(q.segs, '/')"""
