-- Gaps between segments per label: long ones counted, short ones averaged, from sums per measurement.
WITH per AS (
    SELECT measurement_id,
           MAX(gap_before_s) AS widest,
           COUNT(*) FILTER (WHERE gap_before_s > 0.5) AS wide,
           COUNT(*) FILTER (WHERE gap_before_s <= 0.5) AS n,
           SUM(gap_before_s) FILTER (WHERE gap_before_s <= 0.5) AS seconds
    FROM segments GROUP BY measurement_id
)
SELECT label,
       COUNT(*) AS measurements,
       CAST(SUM(wide) AS BIGINT) AS gaps_over_0_5s,
       ROUND(MAX(widest), 6) AS max_gap_s,
       ROUND(SUM(seconds) / NULLIF(CAST(SUM(n) AS DOUBLE), 0), 6) AS typical_dt_s
FROM measurements JOIN per USING (measurement_id)
GROUP BY label ORDER BY gaps_over_0_5s DESC, label
