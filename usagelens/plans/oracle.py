"""The same results in SQL, for the queries that SQL can express.

Written from the definitions, not from the Spark code: joins where that aggregates by pair, and
engine percentiles and windows where that cuts groups into slices.
"""

from __future__ import annotations

_JOINED = ("FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
           "JOIN part p ON l.l_partkey = p.p_partkey")

_CTES = {
    "a": f"""SELECT o.o_custkey AS user_id, p.p_name AS item, 'purchase' AS behavior,
        CAST(1.0 AS DOUBLE) AS hours {_JOINED}
        UNION ALL SELECT o.o_custkey, p.p_name, 'play', l.l_quantity {_JOINED} WHERE l.l_returnflag <> 'R'""",
    "b": """SELECT user_id, props->>'k' AS item,
        CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'play' END AS behavior, value AS hours
        FROM events WHERE event_type IN ('purchase', 'view', 'click')""",
    "rawcat": """SELECT CASE p_partkey % 3 WHEN 0 THEN concat('  ', upper(p_name), ' ')
            WHEN 1 THEN concat(p_name, '™') ELSE p_name END AS title,
        p_type AS genre, p_brand AS developer,
        CASE WHEN p_partkey % 10 = 0 THEN 'tbd' ELSE CAST(p_size * 2 AS VARCHAR) END AS metascore,
        replace(CAST(p_size / CAST(5.0 AS DOUBLE) AS VARCHAR), '.', ',') AS userscore,
        concat('Released ', CAST(1990 + p_partkey % 30 AS VARCHAR)) AS release_date FROM part""",
    "cat": """SELECT title, replace(regexp_replace(lower(trim(title)), '\\s+', ' ', 'g'), '™', '') AS title_clean,
        genre, developer, try_cast(metascore AS DOUBLE) AS metascore,
        try_cast(replace(userscore, ',', '.') AS DOUBLE) AS userscore,
        CAST(regexp_extract(release_date, '[0-9]{4}') AS INTEGER) AS release_year FROM rawcat""",
    "means": "SELECT item, avg(hours) AS avg_hours, lower(trim(item)) AS item_clean FROM a WHERE behavior = 'play' GROUP BY item",
    "joined": "SELECT * FROM means JOIN cat ON item_clean = title_clean",
    "scored": """SELECT *, least(greatest(coalesce(metascore, 0), 0), 100) / 100 * ln(1 + greatest(avg_hours, 0)) AS engagement_score,
        0.6 * (least(greatest(coalesce(metascore, 0), 0), 100) / 100)
        + 0.4 * (least(greatest(coalesce(userscore, 0), 0), 10) / 10) AS quality_score FROM joined""",
    "report": """SELECT title, item, round(avg_hours, 6) AS avg_hours, round(metascore, 6) AS metascore,
        round(userscore, 6) AS userscore, release_year, genre, round(engagement_score, 6) AS engagement_score,
        round(quality_score, 6) AS quality_score FROM scored""",
    "owned": "SELECT DISTINCT user_id, item FROM a WHERE behavior = 'purchase'",
    "played": """SELECT user_id, item, sum(hours) AS hours FROM a WHERE behavior = 'play' AND hours > 0
        GROUP BY user_id, item""",
    "ownhours": """SELECT owned.user_id, owned.item, coalesce(played.hours, 0) AS hours FROM owned
        LEFT JOIN played ON owned.user_id = played.user_id AND owned.item = played.item""",
    "eng": """SELECT item, count(DISTINCT user_id) AS owners,
        CAST(sum(CASE WHEN hours > 0 THEN 1 ELSE 0 END) AS BIGINT) AS players,
        avg(CASE WHEN hours > 0 THEN 1.0 ELSE 0.0 END) AS share_played,
        avg(CASE WHEN hours >= 2 THEN 1.0 ELSE 0.0 END) AS share_played_ge_2h,
        avg(CASE WHEN hours >= 3 THEN 1.0 ELSE 0.0 END) AS share_played_ge_3h,
        avg(hours) AS avg_hours_per_owner, median(hours) AS median_hours_per_owner, sum(hours) AS total_hours,
        count(DISTINCT user_id) / CAST((SELECT count(DISTINCT user_id) FROM a) AS DOUBLE) AS ownership_rate,
        sum(CASE WHEN hours > 0 THEN 1 ELSE 0 END) / CAST((SELECT count(DISTINCT user_id) FROM a) AS DOUBLE) AS player_rate,
        sum(CASE WHEN hours > 0 THEN 1 ELSE 0 END) / CAST(count(DISTINCT user_id) AS DOUBLE) AS play_rate
        FROM ownhours GROUP BY item""",
    "usage": """SELECT p.item, count(DISTINCT p.user_id) AS players, sum(p.hours) AS total_hours,
        sum(p.hours) / count(DISTINCT p.user_id) AS avg_hours_per_player, any_value(coalesce(q.purchasers, 0)) AS purchasers
        FROM a p LEFT JOIN (SELECT item, count(DISTINCT user_id) AS purchasers FROM a WHERE behavior = 'purchase'
        GROUP BY item) q ON p.item = q.item WHERE p.behavior = 'play' GROUP BY p.item""",
    "usagegenre": "SELECT u.*, lower(trim(u.item)) AS key, c.genre FROM usage u LEFT JOIN cat c ON lower(trim(u.item)) = lower(trim(c.title))",
    "genres": """SELECT genre, CAST(sum(players) AS BIGINT) AS total_players, sum(total_hours) AS total_hours,
        count(DISTINCT item) AS items, CAST(sum(purchasers) AS BIGINT) AS total_purchasers,
        sum(total_hours) / sum(players) AS avg_hours_per_player,
        CAST(sum(purchasers) AS DOUBLE) / sum(players) AS purchase_ratio FROM usagegenre WHERE genre IS NOT NULL GROUP BY genre""",
    "ret": """SELECT b.item, buyers, coalesce(players, 0) AS players,
        CAST(coalesce(players, 0) AS DOUBLE) / buyers * 100 AS retention_rate, coalesce(avg_playtime, 0) AS avg_playtime
        FROM (SELECT item, count(DISTINCT user_id) AS buyers FROM a WHERE behavior = 'purchase' GROUP BY item) b
        LEFT JOIN (SELECT item, count(DISTINCT user_id) AS players, avg(hours) AS avg_playtime FROM a
        WHERE behavior = 'play' GROUP BY item) p ON b.item = p.item WHERE buyers >= 100""",
    "quads": """SELECT ret.*, CASE WHEN retention_rate >= mr AND avg_playtime >= mp THEN 'Oben Rechts'
        WHEN retention_rate >= mr THEN 'Oben Links' WHEN avg_playtime >= mp THEN 'Unten Rechts' ELSE 'Unten Links' END AS quadrant
        FROM ret, (SELECT median(retention_rate) AS mr, median(avg_playtime) AS mp FROM ret)""",
    "pmax": "SELECT user_id, item, max(hours) AS hours FROM a WHERE behavior = 'play' GROUP BY user_id, item",
    "bmax": "SELECT user_id, item, max(hours) AS hours FROM b WHERE behavior = 'play' GROUP BY user_id, item",
    "bplays": "SELECT user_id, item, hours FROM b WHERE behavior = 'play'",
    "busers": "SELECT user_id, sum(hours) AS total_hours FROM b WHERE behavior = 'play' AND hours > 0 GROUP BY user_id",
    "feat": """SELECT item, count(DISTINCT user_id) AS num_players, avg(hours) AS avg_hours, sum(hours) AS total_hours
        FROM a WHERE behavior = 'play' GROUP BY item""",
    "split": """SELECT item, count(*) FILTER (WHERE hours > 3) AS stayers, count(*) FILTER (WHERE hours <= 3) AS testers,
        count(*) AS total FROM a WHERE behavior = 'play' GROUP BY item""",
    "textparts": """SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS code,
        concat(CAST(p_size AS VARCHAR), ',', CAST(p_partkey % 10 AS VARCHAR)) AS measure,
        CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS even_size,
        CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_name END AS mixed, '' AS empty FROM part""",
    "missp": """SELECT title, CASE WHEN title_clean[1] IN ('s', 'r')
        THEN regexp_replace(title_clean, ' (.)', ' \\1\\1') ELSE title_clean END AS title_clean,
        genre, developer, metascore, userscore, release_year FROM cat""",
    "cells": """SELECT user_id, item, avg(CASE WHEN behavior = 'play' THEN hours ELSE 0 END) AS hours FROM b
        GROUP BY user_id, item""",
    "dense": """SELECT u.user_id, i.item, coalesce(c.hours, 0) AS hours FROM (SELECT DISTINCT user_id FROM b) u
        CROSS JOIN (SELECT DISTINCT item FROM b) i LEFT JOIN cells c ON c.user_id = u.user_id AND c.item = i.item""",
    "z": """SELECT user_id, item, CASE WHEN stddev_pop(hours) OVER w > 0
        THEN (hours - avg(hours) OVER w) / stddev_pop(hours) OVER w ELSE 0 END AS z FROM dense
        WINDOW w AS (PARTITION BY item)""",
    "near": """SELECT o.user_id AS neighbor_id,
        round(coalesce(sum(o.z * q.z) / nullif(sqrt(sum(o.z * o.z) * sum(q.z * q.z)), 0), 0), 9) AS similarity
        FROM z o JOIN z q ON o.item = q.item AND q.user_id = (SELECT min(user_id) FROM b) AND o.user_id <> q.user_id
        GROUP BY o.user_id ORDER BY similarity DESC, neighbor_id LIMIT 4""",
}

_NEEDS = {
    "cat": ["rawcat"], "means": ["a"], "joined": ["means", "cat"], "scored": ["joined"], "report": ["scored"],
    "owned": ["a"], "played": ["a"], "ownhours": ["owned", "played"], "eng": ["a", "ownhours"], "usage": ["a"],
    "usagegenre": ["usage", "cat"], "genres": ["usagegenre"], "ret": ["a"], "quads": ["ret"], "pmax": ["a"],
    "bmax": ["b"], "bplays": ["b"], "busers": ["b"], "feat": ["a"], "split": ["a"], "missp": ["cat"],
    "cells": ["b"], "dense": ["b", "cells"], "z": ["dense"], "near": ["z", "b"],
}


def _with(names: list[str], body: str) -> str:
    chain: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in chain:
            chain.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n]})" for n in chain) + "\n" + body if chain else body


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _box(source: str, value: str, outliers: bool) -> str:
    """Box plot numbers of the 20 items with most users in a table of rows."""
    return f"""SELECT item, entries, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
        round(least(coalesce(min({value}) FILTER (WHERE {value} >= q1 - 1.5 * (q3 - q1)), q1), q1), 6) AS whisker_low,
        round(greatest(coalesce(max({value}) FILTER (WHERE {value} <= q3 + 1.5 * (q3 - q1)), q3), q3), 6) AS whisker_high
        {f", count(*) FILTER (WHERE {value} < q1 - 1.5 * (q3 - q1) OR {value} > q3 + 1.5 * (q3 - q1)) AS outliers" if outliers else ""}
        FROM {source} JOIN (SELECT item, count(*) AS entries, quantile_cont({value}, 0.25) AS q1,
        quantile_cont({value}, 0.5) AS med, quantile_cont({value}, 0.75) AS q3 FROM {source} GROUP BY item
        ORDER BY count(DISTINCT user_id) DESC, item LIMIT 20) USING (item) GROUP BY item, entries, q1, med, q3"""


def _stats(source: str, least: int) -> str:
    return f"""SELECT item, count(*) AS players, avg(hours) AS mean_hours, median(hours) AS median_hours,
        quantile_cont(hours, 0.25) AS q25, quantile_cont(hours, 0.75) AS q75, stddev_samp(hours) AS std_hours,
        quantile_cont(hours, 0.75) - quantile_cont(hours, 0.25) AS iqr, avg(hours) - median(hours) AS diff_mean_median,
        avg(hours) / nullif(median(hours), 0) AS ratio_mean_median, stddev_samp(hours) / nullif(avg(hours), 0) AS cov
        FROM {source} GROUP BY item HAVING count(*) >= {least}"""


_STATS_COLUMNS = ("mean_hours", "median_hours", "q25", "q75", "std_hours", "iqr", "diff_mean_median",
                  "ratio_mean_median", "cov")

_GINI = """SELECT item, count(*) AS players,
    CASE WHEN sum(hours) = 0 THEN 0 ELSE (count(*) + 1 - 2 * sum(running) / sum(hours)) / count(*) END AS gini
    FROM (SELECT item, hours, sum(hours) OVER (PARTITION BY item ORDER BY hours, user_id
    ROWS UNBOUNDED PRECEDING) AS running FROM bmax) GROUP BY item"""


def _usage() -> dict[str, str]:
    play, buy = "behavior = 'play'", "behavior = 'purchase'"
    return {
        "plays": _with(["a"], f"SELECT * FROM a WHERE {play}"),
        "purchases": _with(["a"], f"SELECT * FROM a WHERE {buy}"),
        "active_plays": _with(["b"], f"SELECT user_id, item, behavior, round(hours, 6) AS hours FROM b WHERE {play} AND hours > 0"),
        "clean_play_hours": _with(["a"], f"SELECT * FROM a WHERE {play} AND user_id % 7 NOT IN (0, 1, 3)"),
        "interactions_for_item": _with(["a"], "SELECT * FROM a WHERE item = 'small ring'"),
        "effective_hours": _with(["a"], f"SELECT *, CASE WHEN {play} THEN hours ELSE CAST(0 AS DOUBLE) END AS hours_clean FROM a"),
        "total_hours_by_item": _with(["a"], f"SELECT item, round(sum(hours), 6) AS total_hours FROM a WHERE {play} GROUP BY item"),
        "players_by_item": _with(["a"], f"SELECT item, count(DISTINCT user_id) AS players FROM a WHERE {play} GROUP BY item"),
        "avg_hours_by_item": _with(["a"], f"SELECT item, round(avg(hours), 6) AS avg_hours FROM a WHERE {play} GROUP BY item"),
        "hours_by_user": _with(["a"], f"SELECT user_id, round(sum(hours), 6) AS total_hours FROM a WHERE {play} GROUP BY user_id"),
        "avg_hours_per_user": _with(["a"], f"""SELECT round(avg(total), 6) AS avg_hours_per_user FROM
            (SELECT user_id, sum(hours) AS total FROM a WHERE {play} GROUP BY user_id)"""),
        "user_item_hours_max": _with(["pmax"], "SELECT * FROM pmax"),
        "user_item_hours_sum": _with(["a"], f"SELECT user_id, item, sum(hours) AS hours FROM a WHERE {play} GROUP BY user_id, item"),
        "item_usage": _with(["usage"], f"SELECT item, players, {_r('total_hours', 'avg_hours_per_player')}, purchasers FROM usage"),
        "owners_by_item": _with(["a"], f"SELECT item, count(DISTINCT user_id) AS owners FROM a WHERE {buy} GROUP BY item"),
        "entries_by_item": _with(["a"], "SELECT item, count(*) AS entries FROM a GROUP BY item"),
        "item_feature_table": _with(["feat"], f"SELECT item, num_players, {_r('avg_hours', 'total_hours')} FROM feat"),
        "owner_pairs": _with(["owned"], "SELECT * FROM owned"),
        "user_collector_stats": _with(["owned", "played"], """SELECT user_id, coalesce(o.n, 0) AS owned_items,
            coalesce(p.h, 0) AS total_hours FROM (SELECT user_id, count(*) AS n FROM owned GROUP BY user_id) o
            FULL JOIN (SELECT user_id, sum(hours) AS h FROM played GROUP BY user_id) p USING (user_id)"""),
        "top_items_by_players": _with(["a"], f"""SELECT item, count(DISTINCT user_id) AS players FROM a WHERE {play}
            GROUP BY item ORDER BY players DESC, item LIMIT 20"""),
        "top_items_by_hours": _with(["a"], f"""SELECT item, sum(hours) AS total_hours FROM a WHERE {play}
            GROUP BY item ORDER BY total_hours DESC, item LIMIT 20"""),
    }


def _segments() -> dict[str, str]:
    def top_split(n: int) -> str:
        return _with(["split"], f"""SELECT item, stayers, testers, total,
            round(CAST(stayers AS DOUBLE) / total, 6) AS stayers_share, round(CAST(testers AS DOUBLE) / total, 6) AS testers_share
            FROM (SELECT * FROM split ORDER BY total DESC, item LIMIT {n})""")

    def strict(source: str) -> str:
        return _with([source], f"""SELECT item, over_ AS "over", under, over_ + under AS total,
            round(CAST(over_ AS DOUBLE) / (over_ + under), 6) AS over_share,
            round(CAST(under AS DOUBLE) / (over_ + under), 6) AS under_share FROM (
            SELECT item, count(*) FILTER (WHERE hours > 100) AS over_, count(*) FILTER (WHERE hours < 100) AS under
            FROM {source} WHERE behavior = 'play' AND hours <> 100 GROUP BY item ORDER BY over_ DESC, under DESC, item LIMIT 20)""")

    return {
        "tester_stayer_all_rows": _with(["a"], """SELECT item, stayer, tester, stayer + tester AS total,
            round(CAST(stayer AS DOUBLE) / (stayer + tester) * 100, 6) AS stayer_percent FROM (
            SELECT item, count(*) FILTER (WHERE hours >= 3 OR hours IS NULL) AS stayer,
            count(*) FILTER (WHERE hours < 3) AS tester FROM a GROUP BY item)
            ORDER BY CAST(stayer AS DOUBLE) / (stayer + tester) * 100 DESC, item LIMIT 20"""),
        "tester_stayer_3h": top_split(20),
        "tester_stayer_3h_top30": top_split(30),
        "bucket_share_strict": strict("b"),
        "bucket_share_strict_empty_side": strict("a"),
        "bucket_share_min_entries": _with(["a"], """SELECT item, at_or_over, under, at_or_over + under AS total,
            round(CAST(at_or_over AS DOUBLE) / (at_or_over + under), 6) AS at_or_over_share,
            round(CAST(under AS DOUBLE) / (at_or_over + under), 6) AS under_share FROM (
            SELECT item, count(*) FILTER (WHERE hours >= 10) AS at_or_over, count(*) FILTER (WHERE hours < 10) AS under
            FROM a WHERE behavior = 'play' GROUP BY item HAVING count(*) >= 150
            ORDER BY at_or_over DESC, under DESC, item LIMIT 20)"""),
        "success_score_stayers": _with(["split"], """SELECT item, stayers, testers, total,
            round(CAST(stayers AS DOUBLE) / total, 6) AS stayer_ratio,
            round(total * (CAST(stayers AS DOUBLE) / total), 6) AS success_score FROM split
            ORDER BY total * (CAST(stayers AS DOUBLE) / total) DESC, item LIMIT 20"""),
        "ownership_ratio_item": _with(["a"], """SELECT owners, users - owners AS non_owners,
            CAST(floor(owners * 100 / nullif(CAST(users - owners AS DOUBLE), 0)) AS BIGINT) AS ratio_percent FROM (
            SELECT count(DISTINCT user_id) AS users,
            count(DISTINCT user_id) FILTER (WHERE behavior = 'purchase' AND item = 'small ring') AS owners FROM a)"""),
        "ownership_rate_all_users": _with(["a"], """SELECT item, count(*) AS purchase_rows,
            round(count(*) / CAST((SELECT count(DISTINCT user_id) FROM a) AS DOUBLE) * 100, 6) AS ownership_rate
            FROM a WHERE behavior = 'purchase' GROUP BY item ORDER BY purchase_rows DESC, item LIMIT 20"""),
        "ownership_rate_vs_non_owners": _with(["owned", "a"], """SELECT item, owners, users - owners AS non_owners,
            round(owners / nullif(CAST(users - owners AS DOUBLE), 0) * 100, 6) AS ownership_rate FROM (
            SELECT item, count(*) AS owners, (SELECT count(DISTINCT user_id) FROM a) AS users FROM owned GROUP BY item)"""),
        "non_owners": _with(["a", "owned"], """SELECT DISTINCT user_id FROM a WHERE user_id NOT IN
            (SELECT user_id FROM owned WHERE item = 'small ring')"""),
        "owner_hours": _with(["ownhours"], "SELECT * FROM ownhours"),
        "owner_engagement": _with(["eng"], f"""SELECT item, owners, players, {_r('share_played', 'share_played_ge_2h',
            'share_played_ge_3h', 'avg_hours_per_owner', 'median_hours_per_owner', 'total_hours', 'ownership_rate',
            'player_rate', 'play_rate')} FROM eng"""),
        "owner_success_score": _with(["eng"], """, pct AS (SELECT *,
            (rank() OVER (ORDER BY r1) + (count(*) OVER (PARTITION BY r1) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS p1,
            (rank() OVER (ORDER BY r2) + (count(*) OVER (PARTITION BY r2) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS p2,
            (rank() OVER (ORDER BY r3) + (count(*) OVER (PARTITION BY r3) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS p3
            FROM (SELECT *, round(ownership_rate, 9) AS r1, round(avg_hours_per_owner, 9) AS r2,
            round(share_played_ge_2h, 9) AS r3 FROM eng))
            SELECT item, owners, round_even(ownership_rate, 4) AS ownership_rate, players,
            round_even(player_rate, 4) AS player_rate, round_even(avg_hours_per_owner, 2) AS avg_hours_per_owner,
            round_even(share_played_ge_2h, 2) AS share_played_ge_2h, round_even(share_played_ge_3h, 2) AS share_played_ge_3h,
            round(success_score, 6) AS success_score FROM (SELECT *, round(CAST(0.4 AS DOUBLE) * p1 + CAST(0.3 AS DOUBLE) * p2
            + CAST(0.3 AS DOUBLE) * p3, 9) AS success_score FROM pct)
            WHERE owners >= 20 ORDER BY success_score DESC, item LIMIT 15"""),
        "top_items_by_activation": _with(["eng"], """SELECT item, owners, players,
            round(CAST(players AS DOUBLE) / owners, 6) AS share_played FROM eng WHERE owners >= 20
            ORDER BY CAST(players AS DOUBLE) / owners DESC, item LIMIT 20"""),
        "bubble_points": _with(["eng"], """SELECT item AS label, owners AS x, round(avg_hours_per_owner, 6) AS y,
            round(400 * share_played_ge_2h, 6) AS size FROM eng WHERE owners >= 20"""),
    }


def _retention() -> dict[str, str]:
    columns = f"item, buyers, players, {_r('retention_rate', 'avg_playtime')}"

    def category(high: int) -> str:
        return _with(["ret"], f"""SELECT {columns}, CASE WHEN retention_rate < 40 THEN 'Niedrig (<40%)'
            WHEN retention_rate <= {high} THEN 'Mittel (40-{high}%)' ELSE 'Hoch (>{high}%)' END AS retention_category FROM ret""")

    return {
        "retention_by_item": _with(["ret"], f"SELECT {columns} FROM ret"),
        "retention_category": category(80),
        "retention_category_90": category(90),
        "retention_medians": _with(["ret"], """SELECT round(median(retention_rate), 6) AS median_retention,
            round(median(avg_playtime), 6) AS median_playtime FROM ret"""),
        "retention_trend": _with(["ret"], f"""SELECT item, {_r('avg_playtime', 'retention_rate')},
            round(slope * avg_playtime + intercept, 6) AS fitted_retention FROM ret,
            (SELECT regr_slope(retention_rate, avg_playtime) AS slope, regr_intercept(retention_rate, avg_playtime) AS intercept FROM ret)"""),
        "retention_quadrants": _with(["quads"], """SELECT q AS quadrant, count(quads.item) AS items FROM
            (VALUES ('Oben Rechts'), ('Oben Links'), ('Unten Rechts'), ('Unten Links')) v(q)
            LEFT JOIN quads ON quadrant = q GROUP BY q"""),
        "retention_quadrants_by_item": _with(["quads"], f"SELECT {columns}, quadrant FROM quads"),
        "high_playtime_items": _with(["b"], f"""SELECT {columns} FROM (SELECT item, count(DISTINCT user_id) FILTER (WHERE behavior = 'purchase') AS buyers,
            count(DISTINCT user_id) FILTER (WHERE behavior = 'play') AS players,
            count(DISTINCT user_id) FILTER (WHERE behavior = 'play') * CAST(100 AS DOUBLE)
            / count(DISTINCT user_id) FILTER (WHERE behavior = 'purchase') AS retention_rate,
            avg(hours) FILTER (WHERE behavior = 'play') AS avg_playtime FROM b GROUP BY item)
            WHERE buyers >= 5 AND avg_playtime > 50"""),
        "bubble_points_retention": _with(["ret"], """SELECT item AS label, round(avg_playtime, 6) AS x,
            round(retention_rate, 6) AS y, round(buyers / CAST(50 AS DOUBLE), 6) AS size FROM ret"""),
    }


def _distribution() -> dict[str, str]:
    tails = ("p25", "p50", "p75", "p90", "p95")
    percents = ", ".join(f"quantile_cont(hours, 0.{p[1:]}) AS {p}" for p in tails)
    return {
        "mean_vs_median_by_item": _with(["pmax"], f"SELECT item, players, {_r(*_STATS_COLUMNS)} FROM ({_stats('pmax', 50)})"),
        "mean_vs_median_by_item_events": _with(["bmax"], f"SELECT item, players, {_r(*_STATS_COLUMNS)} FROM ({_stats('bmax', 5)})"),
        "top_mean_median_gap": _with(["pmax"], f"""SELECT item, players, {_r(*_STATS_COLUMNS)} FROM (
            SELECT * FROM ({_stats('pmax', 50)}) ORDER BY diff_mean_median DESC, item LIMIT 20)"""),
        "bubble_points_mean_median": _with(["pmax"], f"""SELECT item AS label, round(median_hours, 6) AS x,
            round(mean_hours, 6) AS y, round(log10(players + 1) * 30, 6) AS size FROM ({_stats('pmax', 50)})"""),
        "tail_percentiles_by_item": _with(["bmax"], f"""SELECT item, players, {_r(*tails)}, round(mean_hours, 6) AS mean_hours,
            round(gini, 6) AS gini, round(p90 / nullif(p50, 0), 6) AS ratio_p90_p50, round(p75 / nullif(p25, 0), 6) AS ratio_p75_p25
            FROM (SELECT item, count(*) AS players, {percents}, avg(hours) AS mean_hours FROM bmax GROUP BY item HAVING count(*) >= 5)
            JOIN (SELECT item, gini FROM ({_GINI})) USING (item)"""),
        "gini_by_item": _with(["bmax"], f"SELECT item, players, round(gini, 6) AS gini FROM ({_GINI})"),
        "gini_users": _with(["busers"], """, pts AS (SELECT row_number() OVER o / CAST(count(*) OVER () AS DOUBLE) AS x,
            sum(total_hours) OVER (o ROWS UNBOUNDED PRECEDING) / sum(total_hours) OVER () AS y,
            sum(total_hours) OVER (o ROWS UNBOUNDED PRECEDING) AS running, total_hours
            FROM busers WINDOW o AS (ORDER BY total_hours, user_id))
            SELECT round((SELECT 1 - 2 * sum((x - px) * (y + py) / 2) FROM (SELECT x, y, lag(x) OVER (ORDER BY x) AS px,
            lag(y) OVER (ORDER BY x) AS py FROM pts)), 6) AS gini,
            round((count(*) + 1 - 2 * sum(running) / sum(total_hours)) / count(*), 6) AS gini_exact FROM pts"""),
        "lorenz_top_items": _with(["bmax"], """SELECT item, row_number() OVER o AS rank,
            round(coalesce((row_number() OVER o - 1) / nullif(CAST(count(*) OVER (PARTITION BY item) - 1 AS DOUBLE), 0), 0), 6) AS user_share,
            round(sum(hours) OVER (o ROWS UNBOUNDED PRECEDING) / sum(hours) OVER (PARTITION BY item), 6) AS hours_share
            FROM bmax WHERE item IN (SELECT item FROM bmax GROUP BY item ORDER BY count(*) DESC, item LIMIT 5)
            WINDOW o AS (PARTITION BY item ORDER BY hours, user_id)"""),
        "lorenz_users": _with(["busers"], """SELECT user_id, row_number() OVER o AS rank,
            round(row_number() OVER o / CAST(count(*) OVER () AS DOUBLE), 6) AS user_share,
            round(sum(total_hours) OVER (o ROWS UNBOUNDED PRECEDING) / sum(total_hours) OVER (), 6) AS hours_share
            FROM busers WINDOW o AS (ORDER BY total_hours, user_id)"""),
        "hours_histogram_by_item": _with(["bplays"], """, lim AS (SELECT item, quantile_cont(hours, 0.95) AS top FROM bplays
            GROUP BY item ORDER BY count(DISTINCT user_id) DESC, item LIMIT 20),
            bins AS (SELECT item, top, CAST(i AS INTEGER) AS bin, i * (top / 20) AS lo, (i + 1) * (top / 20) AS hi FROM lim, range(20) r(i))
            SELECT bins.item, bin, round(lo, 6) AS bin_start, round(hi, 6) AS bin_end, count(hours) AS entries
            FROM bins LEFT JOIN bplays ON bins.item = bplays.item AND hours <= top AND hours >= lo AND (hours < hi OR bin = 19)
            GROUP BY bins.item, bin, lo, hi"""),
        "hours_histogram_users": _with(["busers"], """, lim AS (SELECT min(total_hours) AS low, max(total_hours) AS top FROM busers),
            bins AS (SELECT CAST(i AS INTEGER) AS bin, low + i * ((top - low) / 50) AS lo, low + (i + 1) * ((top - low) / 50) AS hi FROM lim, range(50) r(i))
            SELECT bin, round(lo, 6) AS bin_start, round(hi, 6) AS bin_end, count(total_hours) AS entries
            FROM bins LEFT JOIN busers ON total_hours >= lo AND (total_hours < hi OR bin = 49) GROUP BY bin, lo, hi"""),
        "hours_boxstats_by_item": _with(["bplays"], _box("bplays", "hours", True)),
        "log_hours_boxstats_by_item": _with(["bmax"], """, logs AS (SELECT user_id, item, log10(hours + 1) AS log_hours FROM bmax)
            """ + _box("logs", "log_hours", False)),
    }


def _catalog() -> dict[str, str]:
    scores = "item, title, genre, release_year, round(metascore, 6) AS metascore, round(userscore, 6) AS userscore"
    genre_columns = f"genre, total_players, round(total_hours, 6) AS total_hours, items, total_purchasers, {_r('avg_hours_per_player', 'purchase_ratio')}"
    joined = "item, round(avg_hours, 6) AS avg_hours, item_clean, title, title_clean, genre, developer, metascore, round(userscore, 6) AS userscore, release_year"

    def raw_rows(join: str) -> str:
        return _with(["a", "cat"], f"""SELECT count(*) AS entries, count(genre) AS matched, CAST(sum(CAST(concat('0x', substr(md5(concat_ws('|',
            user_id, item, behavior, CAST(round(hours * 100) AS BIGINT), coalesce(genre, '-'), coalesce(developer, '-'))), 1, 8)) AS BIGINT))
            AS BIGINT) AS checksum FROM a {join} cat ON item = title""")

    def raw_profile(join: str) -> str:
        types = {"item": "string", "user_id": "bigint", "behavior": "string", "hours": "double",
                 "genre": "string", "developer": "string"}
        return _with(["a", "cat"], f", j AS (SELECT a.*, genre, developer FROM a {join} cat ON item = title) " + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null FROM j" for c, t in types.items()))

    def best(score: str) -> str:
        rest = [c for c in ("title", "item", "avg_hours", "metascore", "userscore", "release_year", "genre",
                            "engagement_score", "quality_score") if c != score]
        return _with(["scored"], f"""SELECT title, item, genre, release_year, {_r('avg_hours', 'metascore', 'userscore',
            'engagement_score', 'quality_score')} FROM (SELECT * REPLACE (round({score}, 9) AS {score}) FROM scored)
            ORDER BY {score} DESC NULLS LAST, {', '.join(c + ' NULLS FIRST' for c in rest)} LIMIT 20""")

    def genre_list(measure: str) -> str:
        return _with(["genres"], f"SELECT {genre_columns} FROM (SELECT * FROM genres ORDER BY {measure} DESC, genre LIMIT 15)")

    def best_json(score: str) -> str:
        fields = ", ".join(f"'{c}': {c}" for c in ("title", "item", "avg_hours", "metascore", "userscore", "release_year",
                                                    "genre", "engagement_score", "quality_score"))
        rest = ", ".join(c for c in ("title", "item", "avg_hours", "metascore", "userscore", "release_year", "genre",
                                     "engagement_score", "quality_score") if c != score)
        return f"""(SELECT CAST(to_json(list({{{fields}}} ORDER BY {score} DESC, {rest})) AS VARCHAR) FROM
            (SELECT * FROM report ORDER BY {score} DESC, {rest} LIMIT 5))"""

    return {
        "clean_titles": _with(["rawcat"], """SELECT title, trim(replace(lower(trim(title)), '™', '')) AS title_clean,
            replace(lower(trim(title)), '™', '') AS title_strict FROM rawcat"""),
        "coerce_rating": _with(["rawcat"], """SELECT title, try_cast(metascore AS DOUBLE) AS metascore,
            try_cast(replace(userscore, ',', '.') AS DOUBLE) AS userscore FROM rawcat"""),
        "release_year": _with(["rawcat"], "SELECT title, CAST(right(release_date, 4) AS INTEGER) AS release_year FROM rawcat"),
        "detect_title_column": _with(["rawcat"], """SELECT column_name, distinct_values FROM (
            SELECT 'label' AS column_name, count(DISTINCT title) AS distinct_values, 0 AS p FROM rawcat
            UNION ALL SELECT 'genre', count(DISTINCT genre), 1 FROM rawcat UNION ALL SELECT 'developer', count(DISTINCT developer), 2 FROM rawcat
            UNION ALL SELECT 'metascore', count(DISTINCT metascore), 3 FROM rawcat UNION ALL SELECT 'userscore', count(DISTINCT userscore), 4 FROM rawcat
            UNION ALL SELECT 'release_date', count(DISTINCT release_date), 5 FROM rawcat) ORDER BY distinct_values DESC, p LIMIT 1"""),
        "detect_title_column_named": "SELECT DISTINCT 'title' AS column_name FROM part",
        "join_catalog_exact": _with(["joined"], f"SELECT {joined} FROM joined"),
        "join_catalog_left": _with(["usagegenre"], f"SELECT key, item, players, {_r('total_hours', 'avg_hours_per_player')}, purchasers, genre FROM usagegenre"),
        "join_catalog_raw": raw_profile("JOIN"),
        "join_catalog_raw_left": raw_profile("LEFT JOIN"),
        "join_catalog_raw_rows": raw_rows("JOIN"),
        "join_catalog_raw_left_rows": raw_rows("LEFT JOIN"),
        "join_catalog_raw_groups": _with(["a", "cat"], """SELECT item, behavior, genre, developer, count(*) AS entries, sum(hours) AS hours
            FROM a JOIN cat ON item = title GROUP BY item, behavior, genre, developer"""),
        "unmatched_items": _with(["means", "missp"], """SELECT item, round(avg_hours, 6) AS avg_hours, item_clean FROM means
            WHERE item_clean NOT IN (SELECT title_clean FROM missp)"""),
        # Titles here have at most 12 characters: at similarity 0.93 they differ by one inserted letter.
        "join_catalog_fuzzy": _with(["means", "missp"], f""", pairs AS (SELECT item_clean AS k, item_clean AS t FROM means
            UNION ALL SELECT i.item_clean, t.title_clean FROM (SELECT item_clean FROM means WHERE item_clean NOT IN (SELECT title_clean FROM missp)) i
            JOIN (SELECT DISTINCT title_clean FROM missp) t ON abs(length(i.item_clean) - length(t.title_clean)) = 1
            AND levenshtein(i.item_clean, t.title_clean) = 1)
            SELECT {joined} FROM (SELECT means.*, missp.*, row_number() OVER (PARTITION BY item_clean ORDER BY item, avg_hours, title, title_clean,
            genre, developer, metascore NULLS FIRST, userscore, release_year) AS rn FROM means JOIN pairs ON item_clean = k
            JOIN missp ON title_clean = t) WHERE rn = 1"""),
        "engagement_score": _with(["scored"], f"SELECT {scores}, {_r('avg_hours', 'engagement_score')} FROM scored"),
        "quality_score": _with(["scored"], f"SELECT {scores}, round(quality_score, 6) AS quality_score FROM scored"),
        "top_engagement": best("engagement_score"),
        "top_quality": best("quality_score"),
        "genre_scores": _with(["scored"], """SELECT genre, round(avg(metascore), 6) AS metascore_mean, round(avg(userscore), 6) AS userscore_mean,
            round(avg(avg_hours), 6) AS playtime_mean, round(avg(engagement_score), 6) AS engagement_mean FROM scored
            GROUP BY genre ORDER BY avg(engagement_score) DESC, genre LIMIT 15"""),
        "scores_by_year": _with(["scored"], """SELECT release_year, round(avg(metascore), 6) AS metascore_mean,
            round(avg(userscore), 6) AS userscore_mean, round(avg(avg_hours), 6) AS playtime_mean FROM scored GROUP BY release_year"""),
        "genre_usage": _with(["genres"], f"SELECT {genre_columns} FROM genres"),
        "genre_usage_by_players": genre_list("total_players"),
        "genre_usage_by_hours_per_player": genre_list("avg_hours_per_player"),
        "genre_usage_by_purchase_ratio": genre_list("purchase_ratio"),
        "bubble_points_usage": _with(["usage"], "SELECT item AS label, players AS x, round(avg_hours_per_player, 6) AS y FROM usage"),
        "insights_summary": _with(["report"], f"""SELECT count(*) AS joined_items, {best_json('engagement_score')} AS top_engagement,
            {best_json('quality_score')} AS top_quality, '[]' AS notes FROM report"""),
    }


def _sources() -> dict[str, str]:
    typed = """SELECT CAST(code AS BIGINT) AS code, CAST(replace(measure, ',', '.') AS DOUBLE) AS measure,
        CAST(nullif(even_size, '') AS BIGINT) AS even_size, mixed, CAST(NULL AS BIGINT) AS empty FROM textparts"""
    return {
        "scan_interactions": _with(["a"], "SELECT * FROM a"),
        "scan_catalog": _with(["rawcat"], "SELECT title, genre, developer FROM rawcat"),
        "scan_catalog_line_breaks": _with(["rawcat"], "SELECT concat(title, chr(10), genre) AS title, developer FROM rawcat"),
        "preview": "SELECT p_partkey, p_name, p_brand, p_type, p_size, round(p_retailprice, 6) AS p_retailprice FROM part ORDER BY p_partkey LIMIT 5",
        "read_csv_tolerant": _with(["rawcat"], """SELECT title, genre, developer, metascore AS meta_score, userscore AS userscore,
            release_date AS released_num FROM rawcat"""),
        "write_report_csv": _usage()["top_items_by_hours"],
        "write_batches": _with(["textparts"], typed),
        "normalize_column_names": """SELECT p_partkey AS part_key, p_name AS name_num, p_size AS size_pct, p_brand AS brandname,
            p_type AS type, round(p_retailprice, 6) AS retail_price FROM part""",
        "sanitize_column_names": """SELECT p_partkey AS part_key, p_name AS part_key_2, p_size AS _9_size, p_brand AS col,
            p_type AS type, round(p_retailprice, 6) AS price FROM part""",
        "infer_column_types": _with(["textparts"], """, cells AS (UNPIVOT (SELECT code, measure, even_size, mixed, empty FROM textparts)
            ON code, measure, even_size, mixed, empty INTO NAME column_name VALUE cell)
            SELECT column_name, CASE WHEN count(*) FILTER (WHERE cell <> '' AND NOT regexp_full_match(replace(cell, ',', '.'), '[+-]?([0-9]+|[0-9]+[.][0-9]*|[.][0-9]+)')) > 0 THEN 'TEXT'
            WHEN count(*) FILTER (WHERE contains(cell, ',')) > 0 THEN 'REAL' ELSE 'INTEGER' END AS column_type FROM cells GROUP BY column_name"""),
        "cast_inferred_types": _with(["textparts"], typed),
        "pad_ragged_rows": """SELECT CAST(p_partkey AS VARCHAR) AS col1, concat('a "', p_name, '", b') AS col2, '' AS col3,
            CASE WHEN p_partkey % 3 = 2 THEN p_brand ELSE '' END AS col4 FROM part""",
        "positional_table": "SELECT CAST(p_partkey AS VARCHAR) AS col1, p_name AS col2, CAST(p_size AS VARCHAR) AS col3 FROM part",
    }


def _profile() -> dict[str, str]:
    types = {"title": "string", "title_clean": "string", "genre": "string", "developer": "string",
             "metascore": "double", "userscore": "double", "release_year": "int"}

    def describe(column: str) -> str:
        v = f"CAST({column} AS DOUBLE)"
        return f"""SELECT '{column}' AS column_name, count({column}) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std,
            round(min({v}), 6) AS min, round(quantile_cont({v}, 0.25), 6) AS p25, round(quantile_cont({v}, 0.5), 6) AS p50,
            round(quantile_cont({v}, 0.75), 6) AS p75, round(max({v}), 6) AS max FROM a"""

    def correlations(source: str, columns: list[str], constant: tuple[str, ...] = ()) -> str:
        def cell(x: str, y: str) -> str:
            if x in constant or y in constant:
                return f"SELECT '{x}', '{y}', CAST(NULL AS DOUBLE)"
            return f"SELECT '{x}' AS column_a, '{y}' AS column_b, round(corr({x}, {y}), 6) AS correlation FROM {source}"

        return _with([source], " UNION ALL ".join(cell(x, y) for x in columns for y in columns))

    return {
        "profile_columns": _with(["cat"], " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null FROM cat" for c, t in types.items())),
        "describe_numeric": _with(["a"], describe("user_id") + " UNION ALL " + describe("hours")),
        "null_counts": _with(["cat"], " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM cat" for c in types)),
        "distinct_counts": _with(["a"], "SELECT count(DISTINCT user_id) AS users, count(DISTINCT item) AS items FROM a"),
        "distinct_items": _with(["a"], "SELECT DISTINCT item FROM a"),
        "behavior_counts": _with(["a"], """SELECT count(*) FILTER (WHERE behavior = 'purchase') AS purchases,
            count(*) FILTER (WHERE behavior = 'play') AS plays FROM a"""),
        "correlation_matrix": correlations("a", ["user_id", "hours", "extra"], ("extra",)),
        "correlation_matrix_scores": correlations("scored", ["avg_hours", "metascore", "userscore", "release_year",
                                                             "engagement_score", "quality_score"]),
    }


def _models() -> dict[str, str]:
    names = ("num_players", "avg_hours", "total_hours")

    def robust(columns: tuple[str, ...]) -> str:
        logs = ", ".join(f"ln(1 + {c}) AS {c}" for c in columns)
        mids = ", ".join(f"median({c}) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_s" for c in columns)
        scaled = ", ".join(f"round(({c} - {c}_m) / CASE WHEN {c}_s = 0 THEN 1 ELSE {c}_s END, 6) AS {c}" for c in columns)
        return _with(["feat"], f", logs AS (SELECT item, {logs} FROM feat) SELECT item, {scaled} FROM logs, (SELECT {mids} FROM logs)")

    scaled = ", ".join(f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 6) AS {c}" for c in names)
    return {
        "encode_items": _with(["a"], """SELECT item, row_number() OVER (ORDER BY item) - 1 AS item_code
            FROM (SELECT DISTINCT item FROM a)"""),
        "user_item_matrix": _with(["a"], """SELECT user_id, item, round(avg(CASE WHEN behavior = 'play' THEN hours ELSE 0 END), 6) AS hours
            FROM a GROUP BY user_id, item"""),
        "zscore_features": _with(["feat"], f"SELECT item, {scaled} FROM feat"),
        "robust_scaled_features": robust(names),
        "robust_scaled_features_two": robust(names[:2]),
        "similar_users": _with(["near"], "SELECT neighbor_id, round(similarity, 6) AS similarity FROM near"),
        "recommend_items": _with(["near"], """SELECT DISTINCT item FROM cells WHERE hours > 0
            AND user_id IN (SELECT neighbor_id FROM near) AND item NOT IN (SELECT item FROM cells WHERE hours > 0
            AND user_id = (SELECT min(user_id) FROM b))"""),
    }


def _silhouettes() -> dict[str, str]:
    names = ("num_players", "avg_hours", "total_hours")
    scaled = ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS {c}" for c in names)
    squares = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in names)
    points = f""", points AS MATERIALIZED (SELECT *, CASE WHEN num_players < -0.5 THEN 0 WHEN num_players < 0.5 THEN 1 ELSE 2 END AS cluster
            FROM (SELECT item, {scaled} FROM feat)),
        ends AS (SELECT p.item, p.cluster AS own, q.cluster AS other, avg(sqrt({squares})) AS mean
            FROM points p JOIN points q ON p.item <> q.item GROUP BY p.item, p.cluster, q.cluster),
        judged AS (SELECT item, max(mean) FILTER (WHERE own = other) AS a, min(mean) FILTER (WHERE own <> other) AS b
            FROM ends GROUP BY item),
        valued AS (SELECT cluster, CASE WHEN b IS NULL THEN NULL WHEN a IS NULL OR greatest(a, b) = 0 THEN 0
            ELSE (b - a) / greatest(a, b) END AS s FROM points LEFT JOIN judged USING (item))"""
    settled = "SELECT count(*) AS points, least({k}, count(*)) AS clusters, CAST(0 AS BIGINT) AS off_centre FROM feat"
    return {
        "silhouette_score": _with(["feat"], points + " SELECT count(*) AS points, round(avg(s), 6) AS silhouette FROM valued"),
        "silhouette_by_cluster": _with(["feat"], points + """
            SELECT cluster, count(*) AS members, round(avg(s), 6) AS silhouette FROM valued GROUP BY cluster"""),
        "item_clusters_settled": _with(["feat"], settled.format(k=4)),
        "item_clusters_zscore_settled": _with(["feat"], settled.format(k=10)),
    }


def _leading(number: int, gram: str) -> str:
    """Tables `top<number>` (c, w) and `size<number>` (value): the leading eigenvector of a matrix (i, j, v), from its powers.

    Squared again and again, with its trace kept at 1, the matrix turns into w wᵀ.
    """
    share = "v / sum(CASE WHEN i = j THEN v ELSE 0 END) OVER ()"
    return f"""power{number}(n, i, j, v) AS (SELECT 0, i, j, {share} FROM {gram} UNION ALL SELECT n + 1, i, j, {share} FROM (
            SELECT p.n AS n, p.i AS i, q.j AS j, sum(p.v * q.v) AS v FROM power{number} p JOIN power{number} q ON p.j = q.i
            WHERE p.n < 15 GROUP BY p.n, p.i, q.j)),
        outer{number} AS MATERIALIZED (SELECT i, j, v FROM power{number} WHERE n = 15),
        top{number} AS MATERIALIZED (SELECT i AS c, v / sqrt((SELECT max(v) FROM outer{number} WHERE i = j)) AS w FROM outer{number}
            WHERE j = (SELECT i FROM outer{number} WHERE i = j ORDER BY v DESC, i LIMIT 1)),
        size{number} AS MATERIALIZED (SELECT sum(p.w * g.v * q.w) AS value FROM {gram} g JOIN top{number} p ON g.i = p.c
            JOIN top{number} q ON g.j = q.c)"""


def _components(names: list[str], x: str, result: str) -> str:
    """`result` over the tables `x` (r, c, v), whose columns have mean 0, and `loading` (component, c, w): two components."""
    body = f""", x AS MATERIALIZED ({x}),
        gram1 AS MATERIALIZED (SELECT p.c AS i, q.c AS j, sum(p.v * q.v) AS v FROM x p JOIN x q ON p.r = q.r GROUP BY p.c, q.c),
        {_leading(1, "gram1")},
        gram2 AS MATERIALIZED (SELECT i, j, v - value * p.w * q.w AS v FROM gram1 JOIN top1 p ON i = p.c JOIN top1 q ON j = q.c, size1),
        {_leading(2, "gram2")},
        signed AS (SELECT 1 AS component, c, w FROM top1 UNION ALL SELECT 2, c, w FROM top2),
        loading AS MATERIALIZED (SELECT component, c, w * CASE WHEN max_by(w, abs(w)) OVER (PARTITION BY component) >= 0 THEN 1 ELSE -1 END AS w
            FROM signed)
        {result}"""
    return _with(names, body).replace("WITH ", "WITH RECURSIVE ", 1)


def _projections() -> dict[str, str]:
    names = ("num_players", "avg_hours", "total_hours")

    def stacked(scaled: str) -> str:
        one = " UNION ALL ".join(f"SELECT item AS r, '{n}' AS c, {n} - avg({n}) OVER () AS v FROM scaled" for n in names)
        return f"WITH scaled AS ({scaled}) {one}"

    quartiles = ", ".join(f"median(ln(1 + {n})) AS {n}_m, quantile_cont(ln(1 + {n}), 0.75) - quantile_cont(ln(1 + {n}), 0.25) AS {n}_s"
                          for n in names)
    robust = ", ".join(f"(ln(1 + {n}) - {n}_m) / CASE WHEN {n}_s = 0 THEN 1 ELSE {n}_s END AS {n}" for n in names)
    standard = ", ".join(f"coalesce(({n} - avg({n}) OVER ()) / nullif(stddev_pop({n}) OVER (), 0), 0) AS {n}" for n in names)
    places = """SELECT r AS {key}, round(sum(v * w) FILTER (WHERE component = 1), 6) AS pca1,
        round(sum(v * w) FILTER (WHERE component = 2), 6) AS pca2 FROM x JOIN loading USING (c) GROUP BY r"""
    return {
        "item_pca": _components(["feat"], stacked(f"SELECT item, {robust} FROM feat, (SELECT {quartiles} FROM feat)"),
                                places.format(key="item")),
        "item_pca_components": _components(["feat"], stacked(f"SELECT item, {standard} FROM feat"), """
            SELECT component, c AS feature, round(w, 6) AS loading,
            round(CASE component WHEN 1 THEN (SELECT value FROM size1) ELSE (SELECT value FROM size2) END
                  / (SELECT sum(v) FROM gram1 WHERE i = j), 6) AS explained_ratio FROM loading"""),
        "user_pca": _components(["z"], "SELECT user_id AS r, item AS c, z AS v FROM z", places.format(key="user_id")),
    }


def _settled(sql: str) -> str:
    """Turn `round(x, 6)` into `round(round(x, 9), 6)`.

    Means of values with few decimals often end in a 5 right after the sixth place; the first rounding
    takes away the summation noise that would decide such a tie by chance.
    """
    parts, start = [], 0
    while (at := sql.find("round(", start)) >= 0:
        depth, end = 1, at + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = _settled(sql[at + len("round("):end - 1])
        if inner.endswith(", 6"):
            inner = f"round({inner[:-3]}, 9), 6"
        parts.append(sql[start:at] + f"round({inner})")
        start = end
    return "".join(parts) + sql[start:]


def oracle_sql() -> dict[str, str]:
    groups = (_usage(), _segments(), _retention(), _distribution(), _catalog(), _sources(), _profile(), _models(), _silhouettes(), _projections())
    queries = {name: sql for group in groups for name, sql in group.items()}
    for name in ("similar_users", "recommend_items"):
        queries[f"{name}_given"] = queries[name].replace("SELECT min(user_id) FROM b", "SELECT max(user_id) FROM b")
    queries["decode_items"] = queries["encode_items"]
    return {name: _settled(sql) for name, sql in queries.items()}
