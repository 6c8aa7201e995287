-- The twenty largest measurements with their rate and range; only their segments are aggregated.
WITH largest AS (
    SELECT measurement_id, label, n_segments, duration_s, split_grouped
    FROM measurements ORDER BY n_segments DESC, measurement_id LIMIT 20
), ranges AS (
    SELECT measurement_id, MIN(range_m) AS nearest, MAX(range_m) AS farthest
    FROM segments WHERE measurement_id IN (SELECT measurement_id FROM largest) GROUP BY measurement_id
)
SELECT measurement_id, label, n_segments,
       ROUND(duration_s, 6) AS duration_s,
       ROUND(n_segments / NULLIF(duration_s, 0), 9) AS segments_per_s,
       nearest AS range_min_m, farthest AS range_max_m, split_grouped
FROM largest JOIN ranges USING (measurement_id)
ORDER BY n_segments DESC, measurement_id
