-- Measurements whose segments lie in more than one split, for both splits from one pass.
WITH per AS (
    SELECT measurement_id, MIN(paper_split) < MAX(paper_split) AS paper, MIN(split_grouped) < MAX(split_grouped) AS grouped
    FROM segments GROUP BY measurement_id
), found AS (
    SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE paper) AS paper, COUNT(*) FILTER (WHERE grouped) AS grouped FROM per
)
SELECT 'paper_split' AS split_kind, paper AS measurements_in_multiple_splits, n AS measurements FROM found
UNION ALL
SELECT 'split_grouped', grouped, n FROM found
