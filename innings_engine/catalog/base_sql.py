"""Named SQL subqueries shared by the oracle texts (plain SQL, naive methods)."""
from .registry import cte

ORD = ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, "
       "l_tax, l_returnflag, l_linestatus, l_shipdate")

cte("fx0", f"""
SELECT {ORD}, CAST(date_trunc('month', l_shipdate) AS DATE) AS d,
  (l_orderkey*31 + l_partkey*7 + l_suppkey*3 + l_linenumber) % 100 AS h,
  CAST(floor(l_quantity) AS INT) % 8 AS q
FROM lineitem""")
cte("fx1", f"""
SELECT *, coalesce(sum(CASE WHEN h > 3 THEN 1 ELSE 0 END) OVER w, 0) AS clb, row_number() OVER r AS rn
FROM fx0
WINDOW w AS (PARTITION BY d ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
       r AS (PARTITION BY d ORDER BY {ORD})""")
cte("fx2", """
SELECT *, CAST(floor(clb/240) AS BIGINT) AS mno, year(d)*12 + month(d) AS mi,
  CAST(floor((clb % 240)/120) AS INT) + 1 AS innings,
  CAST(floor((clb % 120)/6) AS INT) + 1 AS over_number
FROM fx1""")
cte("fx3", """
SELECT *, CAST(d AS VARCHAR) || '-' || CAST(mno AS VARCHAR) AS match_id,
  CAST(row_number() OVER w AS INT) AS ball_number, first_value(l_suppkey) OVER w AS fs,
  'B' || CAST(l_partkey % 40 AS VARCHAR) AS batter,
  'B' || CAST((l_partkey % 40 + 1 + l_linenumber) % 40 AS VARCHAR) AS non_striker,
  CASE WHEN h < 3 THEN 1 ELSE 0 END AS wides, CASE WHEN h = 3 THEN 1 ELSE 0 END AS noballs,
  CASE WHEN h IN (4,5) THEN 1 ELSE 0 END AS legbyes, CASE WHEN h = 6 THEN 1 ELSE 0 END AS byes,
  CASE WHEN h BETWEEN 10 AND 14 THEN 1 ELSE 0 END AS wicket,
  CASE WHEN h BETWEEN 10 AND 13 THEN 1 ELSE 0 END AS bowler_wicket,
  CASE WHEN h < 3 OR h IN (4,5,6) OR h BETWEEN 10 AND 14 OR q IN (5,7) THEN 0 ELSE q END AS runs_batter
FROM fx2 WINDOW w AS (PARTITION BY d, mno, innings, over_number ORDER BY rn)""")
cte("fx", """
SELECT match_id, d AS date, CAST(year(d) AS INT) AS season, innings, over_number, ball_number,
  'V' || CAST((mi + mno*5) % 12 AS VARCHAR) AS venue,
  'T' || CAST(CASE WHEN innings = 1 THEN (mi+mno) % 8 ELSE (mi+mno+1+mno%7) % 8 END AS VARCHAR) AS team_batting,
  'T' || CAST(CASE WHEN innings = 2 THEN (mi+mno) % 8 ELSE (mi+mno+1+mno%7) % 8 END AS VARCHAR) AS team_bowling,
  batter, non_striker, 'P' || CAST(fs % 30 AS VARCHAR) AS bowler,
  wides, noballs, legbyes, byes, wicket, bowler_wicket,
  CASE WHEN bowler_wicket = 1 THEN batter WHEN h = 14 THEN non_striker ELSE '' END AS dismissed_player,
  CASE h WHEN 10 THEN 'bowled' WHEN 11 THEN 'caught' WHEN 12 THEN 'lbw' WHEN 13 THEN 'stumped'
         WHEN 14 THEN 'run out' ELSE '' END AS dismissal_type,
  runs_batter, 1 - wides - noballs AS legal, 1 - wides AS batter_ball,
  wides + noballs + byes + legbyes AS runs_extras,
  runs_batter + wides + noballs + byes + legbyes AS runs_total,
  runs_batter + wides + noballs AS bowler_conceded,
  CASE WHEN runs_batter IN (4,6) THEN 1 ELSE 0 END AS boundary,
  CASE WHEN runs_batter = 6 THEN 1 ELSE 0 END AS six,
  CASE WHEN over_number <= 6 THEN 'powerplay' WHEN over_number <= 15 THEN 'middle' ELSE 'death' END AS phase
FROM fx3""")
# fx with the state before each ball, and the chase target
cte("st", """
SELECT *, CAST(coalesce(sum(runs_total) OVER w, 0) AS BIGINT) AS current_score,
  CAST(coalesce(sum(wicket) OVER w, 0) AS BIGINT) AS current_wickets,
  CAST(coalesce(sum(legal) OVER w, 0) AS BIGINT) AS legal_balls_before,
  CAST(CASE WHEN innings = 2 THEN 1 + coalesce(sum(CASE WHEN innings = 1 THEN runs_total END)
       OVER (PARTITION BY match_id), 0) ELSE 0 END AS BIGINT) AS target
FROM fx WINDOW w AS (PARTITION BY match_id, innings ORDER BY over_number, ball_number
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
