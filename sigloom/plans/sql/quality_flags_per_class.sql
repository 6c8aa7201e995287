-- Flagged segments per label: truncated edges, integrity rules (count and per cent), weak signals, gaps in time.
WITH flagged AS (
    SELECT label,
           COUNT(*) AS n,
           COUNT(*) FILTER (WHERE edge_flag <> 0) AS edges,
           COUNT(*) FILTER (WHERE rule_flags <> 0) AS ruled,
           COUNT(*) FILTER (WHERE low_snr <> 0) AS weak,
           COUNT(*) FILTER (WHERE time_gap <> 0) AS gaps
    FROM segments GROUP BY label
)
SELECT label, n AS n_segments, edges AS edge_truncated, ruled AS any_rule_flag,
       ROUND(CAST(100 * ruled AS DOUBLE) / n, 6) AS rule_flag_pct,
       weak AS low_snr, gaps AS time_gap_before
FROM flagged ORDER BY n DESC, label
