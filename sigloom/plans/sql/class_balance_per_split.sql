-- Segments per class group under either split: counted per measurement, then added up.
WITH per AS (
    SELECT measurement_id,
           COUNT(*) AS n,
           COUNT(*) FILTER (WHERE paper_split = 1) AS p1, COUNT(*) FILTER (WHERE paper_split = 2) AS p2, COUNT(*) FILTER (WHERE paper_split = 3) AS p3,
           COUNT(*) FILTER (WHERE split_grouped = 1) AS g1, COUNT(*) FILTER (WHERE split_grouped = 2) AS g2, COUNT(*) FILTER (WHERE split_grouped = 3) AS g3
    FROM segments GROUP BY measurement_id
), added AS (
    SELECT class_group, SUM(p1) AS p1, SUM(p2) AS p2, SUM(p3) AS p3, SUM(g1) AS g1, SUM(g2) AS g2, SUM(g3) AS g3, SUM(n) AS n
    FROM per JOIN measurements USING (measurement_id) GROUP BY class_group
)
SELECT class_group,
       CAST(p1 AS BIGINT) AS paper_train, CAST(p2 AS BIGINT) AS paper_val, CAST(p3 AS BIGINT) AS paper_test,
       CAST(g1 AS BIGINT) AS grouped_train, CAST(g2 AS BIGINT) AS grouped_val, CAST(g3 AS BIGINT) AS grouped_test,
       CAST(n AS BIGINT) AS total
FROM added ORDER BY n DESC, class_group
