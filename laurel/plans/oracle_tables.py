"""Shared table expressions of the oracle SQL (DuckDB dialect)."""

from __future__ import annotations

_NOMS = """
SELECT period, category, CASE WHEN category < '4' THEN 'acting' ELSE 'series' END AS cat_group,
       person, work, CASE WHEN category < '4' THEN person ELSE work END AS candidate,
       CAST(v AS DOUBLE) AS score,
       CAST(CASE WHEN {level} = max({level}) OVER (PARTITION BY period, category) THEN 1 ELSE 0 END AS INT) AS won
FROM t_base
"""

_HIST = """
SELECT *, CAST(prev_noms - prev_wins AS BIGINT) AS prev_losses,
       CAST(CASE WHEN prev_wins = 0 THEN prev_noms ELSE 0 END AS BIGINT) AS prev_noms_without_win
FROM (
  SELECT *, row_number() OVER w - 1 AS prev_noms,
         CAST(coalesce(sum(won) OVER (PARTITION BY cat_group, candidate, {scope}
           ORDER BY period, category, score DESC, person, work
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prev_wins
  FROM {source}
  WINDOW w AS (PARTITION BY cat_group, candidate, {scope}
               ORDER BY period, category, score DESC, person, work)
)
"""

_SHORT = """
SELECT contest, period, category, person, work, line, part_id, supp_id,
       CASE WHEN category < '4' THEN 'acting' ELSE 'series' END AS cat_group,
       CASE WHEN category < '4' THEN person ELSE work END AS candidate,
       CAST(CASE WHEN {level} = max({level}) OVER (PARTITION BY contest) THEN 1 ELSE 0 END AS INT) AS won,
       CAST(v AS DOUBLE) AS score
FROM t_lines
"""

_CAND_SCOPE = "CASE WHEN cat_group = 'series' THEN category ELSE '' END"
_PAIR_SCOPE = "CASE WHEN cat_group = 'series' THEN '' ELSE work END"

TABLES: dict[str, str] = {
    "t_lines": """
SELECT l_orderkey AS contest,
       CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS period,
       o_orderpriority AS category,
       CASE WHEN o_orderpriority < '4' THEN p_name ELSE '' END AS person, p_brand AS work,
       l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supp_id,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS v
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
""",
    "t_base": "SELECT period, category, person, work, sum(v) AS v FROM t_lines GROUP BY 1, 2, 3, 4",
    "t_noms": _NOMS.format(level="v"),
    "t_ties": _NOMS.format(level="floor(v / 50000)"),
    "t_pos": """
SELECT *, row_number() OVER (PARTITION BY period, category ORDER BY score DESC, person, work) AS pos
FROM t_noms
""",
    "t_ties_pos": """
SELECT *, row_number() OVER (PARTITION BY period, category ORDER BY score DESC, person, work) AS pos
FROM t_ties
""",
    "t_short": _SHORT.format(level="v"),
    "t_short_ties": _SHORT.format(level="floor(v / 20000)"),
    "t_hist": _HIST.format(scope=_CAND_SCOPE, source="t_noms"),
    "t_hist_pair": _HIST.format(scope=_PAIR_SCOPE, source="t_noms"),
    "t_ratings": """
SELECT work, season, season_start, num_eps, q / num_eps / 5.07 AS av_rating, v / num_eps AS av_num_votes
FROM (
  SELECT p_brand AS work,
         CAST(floor((m - 1) / 12.0) * 2 + 1 + l_linenumber % 2 AS INT) AS season,
         m AS season_start, count(*) AS num_eps,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v
  FROM (SELECT *, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT) AS m
        FROM lineitem)
  JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3)
""",
    "t_seasons": """
SELECT work, season_start, min(season) AS season,
       round_even(sum(av_rating * num_eps) / sum(num_eps), 2) AS av_rating,
       round_even(sum(av_num_votes * num_eps) / sum(num_eps), 0) AS av_num_votes,
       CAST(sum(num_eps) AS BIGINT) AS num_eps
FROM t_ratings GROUP BY 1, 2
""",
    "t_lagged": """
SELECT h.*, (coalesce(x.av_rating, y.av_rating) + coalesce(y.av_rating, x.av_rating)) / 2 AS av_rating,
       (coalesce(x.av_num_votes, y.av_num_votes) + coalesce(y.av_num_votes, x.av_num_votes)) / 2 AS av_num_votes,
       coalesce(y.season, x.season) AS earlier_season, coalesce(x.season, y.season) AS later_season
FROM t_hist h
LEFT JOIN t_seasons x ON h.work = x.work AND h.period - 1 = x.season_start
LEFT JOIN t_seasons y ON h.work = y.work AND h.period - 2 = y.season_start
""",
    "t_external": """
SELECT category, period, candidate AS winner
FROM (SELECT *, row_number() OVER (PARTITION BY period, category ORDER BY score DESC, person, work) AS r
      FROM t_noms WHERE won = 0)
WHERE r = 1
""",
    "t_feat": """
SELECT l.*,
       l.av_rating - avg(l.av_rating) OVER (PARTITION BY l.category, l.period) AS rel_rating,
       CAST(CASE WHEN cat_group = 'acting' THEN CASE WHEN s.work IS NULL THEN 0 ELSE 1 END END AS INT) AS also_nominated,
       count(*) OVER (PARTITION BY l.period, l.work) AS total_noms,
       w.candidate IS NOT NULL AS won_last_period,
       coalesce(e.winner = l.work OR e.winner = l.person, false) AS won_external
FROM t_lagged l
LEFT JOIN (SELECT DISTINCT period, work FROM t_noms WHERE cat_group = 'series') s
  ON l.period = s.period AND l.work = s.work
LEFT JOIN (SELECT DISTINCT category, period + 1 AS period, candidate FROM t_noms WHERE won = 1) w
  ON l.category = w.category AND l.period = w.period AND l.candidate = w.candidate
LEFT JOIN t_external e ON l.category = e.category AND l.period = e.period + 1
""",
    "t_model": """
SELECT *, prev_wins = 1 AS one_prev_win, alph_pos IN (1, 5) AS alph_pos_1or5,
       name_length_pos IN (2, 3, 4) AS name_length_pos_234,
       name_length_pos IN (1, 5) AS name_length_pos_1or5
FROM (
  SELECT * REPLACE (coalesce(av_rating, 7.9) AS av_rating, coalesce(av_num_votes, 0) AS av_num_votes),
         CAST(least(row_number() OVER (PARTITION BY period, category
           ORDER BY split_part(person, ' ', -1), score DESC, person, work), 5) AS INT) AS alph_pos,
         CAST(least(row_number() OVER (PARTITION BY period, category
           ORDER BY length(candidate), score DESC, person, work), 5) AS INT) AS name_length_pos
  FROM (SELECT *, sum(won) OVER (PARTITION BY period, category) AS n_won FROM t_feat)
  WHERE n_won = 1
) WHERE later_season IS NOT NULL
""",
    "t_runs": "SELECT work, min(period) AS s, max(period) AS e FROM t_noms GROUP BY 1",
    "t_bounds": """
SELECT n, min(k) FILTER (WHERE cdf >= 0.05) AS q05, min(k) FILTER (WHERE cdf >= 0.95) AS q95
FROM (
  SELECT n, k, sum(exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)
                       + k * ln(0.2) + (n - k) * ln(0.8)))
               OVER (PARTITION BY n ORDER BY k) AS cdf
  FROM (SELECT n, unnest(range(0, n + 1)) AS k FROM (SELECT DISTINCT n FROM t_sizes)))
GROUP BY n
""",
}
