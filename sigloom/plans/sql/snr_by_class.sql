-- Signal over noise, Doppler spread and bandwidth per label.
SELECT s.label,
       MIN(s.class_group) AS class_group,
       COUNT(*) AS n,
       ROUND(AVG(s.snr_db), 6) AS snr_db_mean,
       ROUND(MIN(s.snr_db), 6) AS snr_db_min,
       ROUND(MAX(s.snr_db), 6) AS snr_db_max,
       ROUND(AVG(s.doppler_spread_hz), 4) AS doppler_spread_hz_mean,
       ROUND(AVG(s.md_bandwidth_hz), 4) AS md_bandwidth_hz_mean
FROM segments s
GROUP BY s.label
ORDER BY snr_db_mean DESC, s.label
