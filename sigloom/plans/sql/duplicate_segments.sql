-- Equal segments per pair of measurements: counts, copies across splits, conflicting labels.
SELECT p.meas_a,
       a.label AS label_a,
       p.meas_b,
       b.label AS label_b,
       p.duplicate_pairs,
       p.pairs_across_paper_splits,
       CAST(a.label <> b.label AS INT) AS label_conflict
FROM duplicate_pairs p
JOIN measurements a ON a.measurement_id = p.meas_a
JOIN measurements b ON b.measurement_id = p.meas_b
ORDER BY p.duplicate_pairs DESC, p.meas_a, p.meas_b
