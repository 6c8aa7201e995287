"""DuckDB SQL for the registered queries: adapters as common table expressions, then one statement each."""

from __future__ import annotations

from sigloom.config import FAULTS, INTEGRITY_RULES
from sigloom.config import FEATURES as FEATURE_NAMES
from sigloom.plans.sqlrun import text_of


def _split(key: str) -> str:
    return f"case when {key} % 10 < 6 then 1 when {key} % 10 < 8 then 2 else 3 end"


def _group(label: str) -> str:
    return f"case when regexp_full_match({label}, 'D[0-9]+') then 'drone' when {label} like 'human%' then 'human' when {label} = 'CR' then 'reflector' else 'bird' end"


_SEQUENCE = """row_number() over (partition by measurement_id order by time_s, segment_id) - 1 as idx_in_measurement,
    time_s - lag(time_s) over (partition by measurement_id order by time_s, segment_id) as gap_before_s"""

CATALOG = f"""
    raw as (select o_orderkey as segment_id, o_custkey as measurement_id, epoch_us(o_orderdate) / 1e6 as time_s, o_totalprice as range_m,
        cast(o_orderstatus = 'F' as int) as edge_flag, {_split('o_orderkey')} as paper_split, {_split('o_custkey')} as split_grouped,
        sha1(strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority || '|' || o_orderstatus) as sha1 from orders),
    segments as (select *, {_SEQUENCE} from raw),
    labels_ as (select c_custkey as measurement_id, case c_mktsegment when 'AUTOMOBILE' then 'D1' when 'BUILDING' then 'D2' when 'FURNITURE' then 'human_walk'
        when 'MACHINERY' then 'CR' else 'seagull' end as label from customer),
    measurements as (select measurement_id, label, {_group('label')} as class_group, count(*) as n_segments, max(time_s) - min(time_s) as duration_s,
        min(split_grouped) as split_grouped from segments join labels_ using (measurement_id) group by measurement_id, label)"""

DOCS = f"""docs as (select doc_id as segment_id, source as measurement_id, lang as label, {_split('doc_id')} as paper_split, sha1(text) as sha1 from documents)"""

SCORES = f"""scores as (select doc_id as segment_id, cast(n_chars as double) as score, length(text) / (len(string_split(text, ' ')) + 1.0) as word_score, toxic = 1 as positive,
        quality = 1 as clean, {_split('doc_id')} as split_grouped, lang as label from documents join labels using (doc_id))"""

EVENTS = f"""raw as (select event_id as segment_id, user_id as measurement_id, epoch_us(ts) / 1e6 as time_s, event_type as label, value from events),
    segments as (select *, {_SEQUENCE} from raw)"""

SIGNALS = f"""
    whole as (select vec_id // 10 as segment_id from embeddings group by 1 having count(*) = 10),
    sig as materialized (select a.vec_id // 10 as segment_id, (a.vec_id % 10) // 2 as c, t, cast(a.embedding[t + 1] as double) as re, cast(b.embedding[t + 1] as double) as im
        from embeddings a join embeddings b on b.vec_id = a.vec_id + 1, range(64) r(t) where a.vec_id % 2 = 0 and a.vec_id // 10 in (select segment_id from whole)),
    meta0 as (select vec_id // 10 as segment_id, cast(2 * label + (vec_id // 10) % 2 as bigint) as measurement_id,
        list_value('D1', 'D2', 'D3', 'D4', 'D5', 'D6', 'seagull', 'human_walk', 'CR', 'heron')[label + 1] as label, 0.1::double * (vec_id // 10) + 2.0 * floor((vec_id // 10) / 20) as time_s,
        cast((vec_id // 10) % 11 = 0 as int) as edge_flag, {_split('(vec_id // 10)')} as paper_split, {_split('(2 * label + (vec_id // 10) % 2)')} as split_grouped
        from embeddings where vec_id % 10 = 0 and vec_id // 10 in (select segment_id from whole)),
    meta as (select *, {_SEQUENCE} from meta0)"""

SPECTRUM = """
    rd as materialized (select segment_id, c, case when k >= 32 then k - 64 else k end as b,
        (pow(sum(h * (re * cos(a) + im * sin(a))), 2) + pow(sum(h * (im * cos(a) - re * sin(a))), 2)) / 1024.0 as p
        from (select sig.*, k, pow(sin(pi() * t / 64), 2) as h, 2 * pi() * k * t / 64 as a from sig, range(64) r(k)) group by segment_id, c, k),
    nf as (select segment_id, median(p) / ln(2) as nf from rd group by 1),
    ctr as materialized (select rd.segment_id, b, p, b * 17000.0::double / 64 as f, nf, greatest(p - nf, 0) as s from rd join nf using (segment_id) where c = 2),
    cfar as (select x.segment_id, x.b, x.p, 32 * (pow(1e-4, -1 / 32.0::double) - 1) * sum(o.p) / 32 as thr from ctr x join ctr o on x.segment_id = o.segment_id
        and least(abs(x.b - o.b), 64 - abs(x.b - o.b)) between 5 and 20 group by 1, 2, 3),
    stft as materialized (select segment_id, m, case when k >= 8 then k - 16 else k end as b,
        (pow(sum(h * (re * cos(a) + im * sin(a))), 2) + pow(sum(h * (im * cos(a) - re * sin(a))), 2)) / 64.0 as p
        from (select segment_id, m, k, re, im, pow(sin(pi() * (t - 4 * m) / 16), 2) as h, 2 * pi() * k * (t - 4 * m) / 16 as a
            from sig, range(13) q(m), range(16) r(k) where c = 2 and t between 4 * m and 4 * m + 15) group by segment_id, m, k)"""

FEATURES = """
    peak as (select segment_id, 10 * log10(greatest(max(p), 1e-20)) - 10 * log10(greatest(any_value(nf), 1e-20)) as snr_db, arg_max(f, p) as peak_doppler_hz,
        sum(s * f) / (sum(s) + 1e-20) as doppler_centroid_hz, sum(p) as whole, sum(s) + 1e-20 as weight, sum(case when abs(b) <= 2 then p end) / (sum(p) + 1e-20) as zero_doppler_ratio,
        10 * log10(greatest(any_value(nf), 1e-20)) as noise_floor_db from ctr group by 1),
    spread as (select segment_id, sqrt(greatest(sum(s * pow(f - doppler_centroid_hz, 2)) / any_value(weight), 0)) as doppler_spread_hz,
        -sum(p / whole * ln(greatest(p / whole, 1e-30))) / ln(64) as spectral_entropy from ctr join peak using (segment_id) group by 1),
    det as (select segment_id, cast(sum(cast(p > thr as int)) as double) as n_cfar from cfar group by 1),
    cells as (select segment_id, sum(case when c = 2 then p end) / (sum(p) + 1e-20) as centre_power_frac from rd group by 1),
    snf as (select segment_id, median(p) / ln(2) as snf from stft group by 1),
    width as (select segment_id, m, coalesce(max(case when p > snf * 10 then b end) - min(case when p > snf * 10 then b end) + 1, 0) * 17000.0::double / 16 as w
        from stft join snf using (segment_id) group by 1, 2),
    md as (select segment_id, avg(w) as md_bandwidth_hz from width group by 1),
    amp as materialized (select segment_id, c, t, re, im, sqrt(re * re + im * im) as a, lead(re) over w as re1, lead(im) over w as im1 from sig window w as (partition by segment_id, c order by t)),
    mean as (select segment_id, avg(a) as m, avg(a * a) as pw from amp group by 1),
    env as (select segment_id, stddev_pop(a) filter (c = 2) / (avg(a) filter (c = 2) + 1e-20) as envelope_cv,
        avg(pow(a - m, 4)) / (pow(avg(pow(a - m, 2)), 2) + 1e-30) as amp_kurtosis, 20 * log10(max(a) / (sqrt(any_value(pw)) + 1e-20) + 1e-20) as crest_factor_db,
        sqrt(pow(avg(re1 * re + im1 * im), 2) + pow(avg(im1 * re - re1 * im), 2)) / (any_value(pw) + 1e-20) as lag1_coherence,
        avg(abs(sqrt(re1 * re1 + im1 * im1) - a)) / (any_value(m) + 1e-20) as envelope_roughness,
        10 * log10((avg(re * re) + 1e-20) / (avg(im * im) + 1e-20)) as iq_power_ratio_db from amp join mean using (segment_id) group by 1),
    features as (select * exclude (whole, weight) from peak join spread using (segment_id) join det using (segment_id) join cells using (segment_id) join md using (segment_id) join env using (segment_id))"""

RULES = """
    pw as materialized (select *, re * re + im * im as p, lag(re) over w as re0, lag(im) over w as im0, lead(re) over w as re1, lead(im) over w as im1 from sig
        window w as (partition by segment_id, c order by t)),
    basic as (select segment_id, cast(sum(cast(not (isfinite(re) and isfinite(im)) as int)) as double) as nonfinite,
        (pow(avg(re), 2) + pow(avg(im), 2)) / (quantile_cont(p, 0.25) / 0.2877 + 1e-20) as dc_offset, max(abs(re)) as rre, max(abs(im)) as rim from pw group by 1),
    clip as (select segment_id, cast(sum(cast(abs(re) >= rre * (1 - 1e-6) as int) + cast(abs(im) >= rim * (1 - 1e-6) as int)) as double) as clipping from pw join basic using (segment_id) group by 1),
    steady as (select segment_id, t, bool_and(sqrt(p) < 1e-9) as dead, coalesce(bool_and(re = re0 and im = im0), false) as same from pw group by 1, 2),
    islands as (select *, t - row_number() over (partition by segment_id, dead order by t) as gd, t - row_number() over (partition by segment_id, same order by t) as gs from steady),
    dead as (select segment_id, cast(coalesce(max(n) filter (dead), 0) as double) as dead_block from (select segment_id, dead, gd, count(*) as n from islands group by all) group by 1),
    frozen as (select segment_id, cast(coalesce(max(n) filter (same) + 1, 0) as double) as frozen_block from (select segment_id, same, gs, count(*) as n from islands group by all) group by 1),
    bend as (select segment_id, c, t, sqrt(pow(re - (re0 + re1) / 2, 2) + pow(im - (im0 + im1) / 2, 2)) as d from pw where t between 1 and 62),
    mad as (select segment_id, c, median(d) + 1e-20 as mad from bend group by 1, 2),
    jump as (select segment_id, max(j) as spike from (select segment_id, t, median(d / mad) as j from bend join mad using (segment_id, c) group by 1, 2) group by 1),
    cellp as (select segment_id, c, sum(p) as p from pw group by 1, 2),
    off as (select segment_id, max(p) filter (c <> 2) / (max(p) filter (c = 2) + 1e-20) as off_centre from cellp group by 1),
    inner_ as (select segment_id, t, sum(p) as p from pw where c between 1 and 3 group by 1, 2),
    slide as (select segment_id, t, avg(p) over (partition by segment_id order by t rows between current row and 7 following) as m from inner_ qualify t <= 56),
    fall as (select segment_id, m / (max(m) over (partition by segment_id order by t rows between 8 following and unbounded following) + 1e-20) as r,
        m / (max(m) over (partition by segment_id order by t rows between unbounded preceding and 8 preceding) + 1e-20) as l from slide),
    cliff as (select segment_id, log10(greatest(max(r), max(l), 1e-20)) as edge_cliff from fall group by 1),
    hashes as (select segment_id, string_agg(cast(re as float) || ',' || cast(im as float), ';' order by c, t) as h from sig group by 1),
    dup as (select segment_id, cast(row_number() over (partition by h order by segment_id) > 1 as double) as duplicate from hashes),
    stats as materialized (select segment_id, nonfinite, dead_block, frozen_block, clipping, duplicate, dc_offset, spike, off_centre, edge_cliff
        from basic join clip using (segment_id) join dead using (segment_id) join frozen using (segment_id) join jump using (segment_id) join off using (segment_id)
        join cliff using (segment_id) join dup using (segment_id)),
    thr as (select quantile_cont(dc_offset, 0.999) as dc, quantile_cont(spike, 0.999) as sp, quantile_cont(off_centre, 0.999) as oc, quantile_cont(edge_cliff, 0.999) as ec
        from stats join meta using (segment_id) where edge_flag = 0 and split_grouped = 1),
    flags as (select segment_id, nonfinite >= 1 as b0, dead_block >= 16 as b1, frozen_block >= 8 as b2, clipping >= 6 as b3, duplicate >= 1 as b4, dc_offset >= dc as b5, spike >= sp as b6,
        off_centre >= oc as b7, edge_cliff >= ec as b8, dc_offset / dc as s5, spike / sp as s6, off_centre / oc as s7, pow(10, edge_cliff - ec) as s8 from stats, thr),
    ruled as (select segment_id, cast(b0::int + 2 * b1::int + 4 * b2::int + 8 * b3::int + 16 * b4::int + 32 * b5::int + 64 * b6::int + 128 * b7::int + 256 * b8::int as bigint) as rule_flags,
        greatest(case when b0 or b1 or b2 or b3 or b4 then 1e6 else 0 end, s5, s6, s7, s8) as rule_score from flags)"""


def _with(*parts: str, then: str) -> str:
    """``then`` after the common table expressions ``parts``; it may begin with comment lines and expressions of its own."""
    body = "\n".join(x for x in then.splitlines() if not x.startswith("--")).strip()
    own = body[:5].lower() == "with "
    return f"with {', '.join(parts)}{', ' if own else ' '}{body[5:] if own else body}"


def digits(name: str) -> int:
    """Decimals that engines agree on whatever the order of summation."""
    return 3 if name.endswith("_hz") else 6


def _rounded(names, of: str = "{}") -> str:
    return ", ".join(f"round({of.format(n)}, {digits(n)}) + 0.0::double as {n}" for n in names)


ORACLE: dict[str, str] = {
    # the seven catalogue queries
    "class_balance_per_split": _with(CATALOG, then=text_of("class_balance_per_split")),
    "segments_per_measurement": _with(CATALOG, then=text_of("segments_per_measurement")),
    "split_leakage": _with(CATALOG, then=text_of("split_leakage")),
    "time_gaps": _with(CATALOG, then=text_of("time_gaps")),
    "snr_by_class": _with(SIGNALS, SPECTRUM, FEATURES, f"segments as (select *, {_group('label')} as class_group from meta join features using (segment_id))", then=text_of("snr_by_class")),
    "quality_flags_per_class": _with(
        SIGNALS, SPECTRUM, FEATURES, RULES,
        """segments as (select meta.*, rule_flags, cast(snr_db < 6 as int) as low_snr, cast(coalesce(gap_before_s, 0) > 0.5 as int) as time_gap
            from meta join features using (segment_id) join ruled using (segment_id))""",
        then=text_of("quality_flags_per_class"),
    ),
    "duplicate_segments": _with(
        DOCS,
        "names as (select measurement_id, min(label) as label from docs group by 1)",
        then="""select a.measurement_id as meas_a, any_value(na.label) as label_a, b.measurement_id as meas_b, any_value(nb.label) as label_b, count(*) as duplicate_pairs,
            cast(sum(cast(a.paper_split <> b.paper_split as int)) as bigint) as pairs_across_paper_splits, cast(any_value(na.label) <> any_value(nb.label) as int) as label_conflict
            from docs a join docs b on a.sha1 = b.sha1 and a.segment_id < b.segment_id join names na on na.measurement_id = a.measurement_id
            join names nb on nb.measurement_id = b.measurement_id group by a.measurement_id, b.measurement_id""",
    ),
    # ingest
    "gap_before": _with(CATALOG, then="select segment_id, measurement_id, cast(idx_in_measurement as int) as idx_in_measurement, round(gap_before_s, 6) as gap_before_s from segments"),
    "event_gaps": _with(
        EVENTS,
        then="""select measurement_id, count(*) as n, round(median(gap_before_s), 6) as gap_median, round(quantile_cont(gap_before_s, 0.1), 6) as gap_p10,
            round(quantile_cont(gap_before_s, 0.9), 6) as gap_p90, cast(sum(cast(gap_before_s > 3600 as int)) as bigint) as long_gaps from segments group by 1""",
    ),
    "measurement_summary": _with(CATALOG, then="select measurement_id, label, class_group, n_segments, round(duration_s, 6) as duration_s, split_grouped from measurements"),
    "first_seen_duplicates": _with(DOCS, then="select segment_id, sha1, cast(row_number() over (partition by sha1 order by segment_id) > 1 as int) as duplicate from docs"),
    "duplicate_links": _with(
        DOCS, then="""select distinct first as a, measurement_id as b from (select measurement_id, min(measurement_id) over (partition by sha1) as first from docs) where first <> measurement_id"""
    ),
    "components": "with recursive "
    + DOCS
    + """, links as (select distinct min(measurement_id) over (partition by sha1) as a, measurement_id as b from docs),
        both_ as (select a, b from links union select b, a from links),
        reach(node, other) as (select a, b from both_ union select r.node, b.b from reach r join both_ b on r.other = b.a)
        select node as measurement_id, min(other) as root from reach group by 1""",
    "segments_per_label": _with(CATALOG, then="select m.label, count(*) as n_segments, count(distinct measurement_id) as n_measurements from segments join measurements m using (measurement_id) group by 1"),
    "split_counts": _with(
        CATALOG,
        then="""select 'paper_split' as split_kind, paper_split as split, count(*) as n, count(distinct measurement_id) as measurements from segments group by 2
            union all select 'split_grouped', split_grouped, count(*), count(distinct measurement_id) from segments group by 2""",
    ),
    "label_encoding": _with(
        CATALOG,
        f"vocab as (select label, row_number() over (order by label) - 1 as y_label from (select distinct label from measurements))",
        then=f"""select measurement_id, label, cast(list_position(['drone', 'bird', 'human', 'reflector'], {_group('label')}) - 1 as int) as y_group, cast(y_label as int) as y_label,
            cast(coalesce(list_position(['D1', 'D2', 'D3', 'D4', 'D5', 'D6'], label), 0) - 1 as int) as y_drone from measurements join vocab using (label)""",
    ),
    "dataset_filter_clean": _with(CATALOG, then="select segment_id, measurement_id, paper_split, split_grouped from segments where edge_flag = 0 and split_grouped = 1"),
    "dataset_filter_all": _with(CATALOG, then="select segment_id, measurement_id, paper_split, split_grouped from segments"),
    "manifest_counts": _with(
        CATALOG,
        then="""select s.split_grouped as split, m.class_group, count(*) as n from segments s join measurements m using (measurement_id) where edge_flag = 0 group by 1, 2""",
    ),
    # metrics
    "score_percentiles": _with(
        SCORES, then="select label, round(quantile_cont(score, 0.1), 6) as p10, round(median(score), 6) as p50, round(quantile_cont(score, 0.9), 6) as p90 from scores group by 1"
    ),
    "recall_at_fa": _with(
        SCORES, "t as (select quantile_cont(score, 0.99) as threshold from scores where not positive)",
        then="select round(any_value(threshold), 6) as threshold, round(avg(cast(score > threshold as double)), 9) as recall from scores, t where positive",
    ),
    "roc_auc": _with(
        SCORES,
        "r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as k from scores)",
        then="""select count(*) filter (positive) as n_pos, count(*) filter (not positive) as n_neg,
            round((sum(k) filter (positive) - count(*) filter (positive) * (count(*) filter (positive) + 1) / 2.0::double) / (count(*) filter (positive) * count(*) filter (not positive)), 9) as roc_auc from r""",
    ),
    "score_histogram": _with(
        SCORES,
        "v as (select positive, log10(least(greatest(score, 1e-6), 1e30)) as v from scores)",
        "q as (select quantile_cont(v, 0.005) as lo, quantile_cont(v, 0.995) as hi from v)",
        then="""select positive, cast(least(floor((least(greatest(v, lo), hi) - lo) / ((hi - lo) / 40)), 39) as int) as bin, count(*) as n from v, q group by 1, 2""",
    ),
    "false_alarm_rate": _with(
        SCORES,
        "t as (select quantile_cont(score, 0.99) as threshold from scores where clean and split_grouped = 1)",
        then="""select split_grouped as split, count(*) as n, round(avg(cast(score > threshold as double)), 9) as false_alarm_rate from scores, t where clean group by 1""",
    ),
    "confusion_matrix": _with(
        SCORES, "t as (select median(word_score) as m from scores)",
        then="select positive as label, word_score > m as predicted, count(*) as n from scores, t group by 1, 2",
    ),
    "macro_f1": _with(
        SCORES, "t as (select median(word_score) as m from scores)", "p as (select positive as l, word_score > m as p from scores, t)",
        "f as (select l, 2.0 * sum(cast(p = l as int)) / (count(*) + (select count(*) from p q where q.p = p1.l)) as f1 from p p1 group by l)",
        then="select round((select avg(cast(p = l as double)) from p), 9) as accuracy, round(avg(f1), 9) as macro_f1 from f",
    ),
    "class_weights": _with(
        CATALOG, "c as (select label, count(*) as n, 1 / sqrt(count(*)) as raw from measurements group by 1)",
        then="select label, n, round(raw / (select avg(raw) from c), 9) as weight from c",
    ),
    # array kernels
    "dft_power": _with(SIGNALS, SPECTRUM, then="select segment_id, cast(c as int) as cell, cast(b as int) as bin, round(b * 17000.0::double / 64, 6) as doppler_hz, round(p, 9) as power from rd"),
    "noise_floor": _with(SIGNALS, SPECTRUM, then="select segment_id, round(nf, 9) as noise_floor from nf"),
    "cfar_detections": _with(SIGNALS, SPECTRUM, then="select segment_id, cast(sum(cast(p > thr as int)) as bigint) as detections, round(sum(thr), 6) as threshold_sum from cfar group by 1"),
    "stft_power": _with(SIGNALS, SPECTRUM, then="select segment_id, cast(m as int) as frame, cast(b as int) as bin, round(p, 9) as power from stft"),
    "segment_features": _with(SIGNALS, SPECTRUM, FEATURES, then=f"select segment_id, {_rounded(FEATURE_NAMES)} from features"),
    "feature_medians": _with(
        SIGNALS, SPECTRUM, FEATURES,
        then=f"select {_group('label')} as class_group, {_rounded(FEATURE_NAMES, 'median({})')} from meta join features using (segment_id) group by 1",
    ),
    "rd_normalise": _with(
        SIGNALS, SPECTRUM,
        then="""select segment_id, round(avg(least(greatest(10 * log10(greatest(p, 1e-20)) - 10 * log10(greatest(nf, 1e-20)), -5), 60) / 30), 6) as mean_level from rd join nf using (segment_id) group by 1""",
    ),
    "signed_log_scale": _with(
        EVENTS, "v as (select label, sign(value) * ln(1 + abs(value)) as x from raw)", "m as (select label, avg(x) as mu, stddev_pop(x) as sd from v group by 1)",
        then="select label, count(*) as n, round(min((x - mu) / sd), 6) as low, round(max((x - mu) / sd), 6) as high from v join m using (label) group by 1",
    ),
    "run_length": _with(
        EVENTS,
        """marked as (select measurement_id, value > 10 as big, idx_in_measurement - row_number() over (partition by measurement_id, value > 10 order by idx_in_measurement) as g from segments)""",
        then="""select measurement_id, coalesce(max(n) filter (big), 0) as longest_run from (select measurement_id, big, g, count(*) as n from marked group by all) group by 1""",
    ),
    # rules
    "rule_statistics": _with(SIGNALS, RULES, then=f"select segment_id, {_rounded(INTEGRITY_RULES)} from stats"),
    "rule_calibration": _with(
        SIGNALS, RULES, then="select round(dc, 6) as dc_offset, round(sp, 6) as spike, round(oc, 6) as off_centre, round(ec, 6) as edge_cliff from thr"
    ),
    "rule_flags_bits": _with(SIGNALS, RULES, then="select segment_id, rule_flags from ruled"),
    "rule_score": _with(SIGNALS, RULES, then="select segment_id, round(rule_score, 6) as rule_score from ruled"),
    "rule_flags_by_class": _with(
        SIGNALS, RULES,
        f"""long as (unpivot (select segment_id, b0 as nonfinite, b1 as dead_block, b2 as frozen_block, b3 as clipping, b4 as duplicate, b5 as dc_offset, b6 as spike, b7 as off_centre,
            b8 as edge_cliff from flags) on {", ".join(INTEGRITY_RULES)} into name rule value fired)""",
        then=f"select rule, {_group('label')} as class_group, cast(sum(cast(fired as int)) as bigint) as n_flagged, count(*) as n from long join meta using (segment_id) group by 1, 2",
    ),
    "group_exemplar": _with(
        SIGNALS, SPECTRUM, FEATURES, f"g as (select segment_id, {_group('label')} as class_group, snr_db from meta join features using (segment_id))",
        "m as (select class_group, median(snr_db) as median from g group by 1)",
        then="""select class_group, segment_id from g join m using (class_group)
            qualify row_number() over (partition by class_group order by round(abs(snr_db - median), 6), segment_id) = 1""",
    ),
}

_RAIL = """rail as (select segment_id, 0.3::double * max(greatest(abs(re), abs(im))) as r from sig group by 1)"""
_CHANGED = """select o.segment_id, round(sum(pow(cast(f.re as float)::double, 2) + pow(cast(f.im as float)::double, 2)), 3) as energy,
    count(*) filter (cast(f.re as float) <> cast(o.re as float) or cast(f.im as float) <> cast(o.im as float)) as n_changed, count(*) filter (f.re = 0 and f.im = 0) as n_zero,
    round(cast(max(greatest(abs(cast(f.re as float)), abs(cast(f.im as float)))) as double), 5) as peak from sig o join f using (segment_id, c, t) group by 1"""

ORACLE |= {
    # faults without a draw, and what an export has to hold
    "inject_adc_clipping": _with(
        SIGNALS, _RAIL, "f as (select segment_id, c, t, least(greatest(re, -r), r) as re, least(greatest(im, -r), r) as im from sig join rail using (segment_id))", then=_CHANGED
    ),
    "inject_duplicate_segment": _with(
        SIGNALS, "f as (select o.segment_id, c, t, coalesce(b.re, o.re) as re, coalesce(b.im, o.im) as im from sig o left join (select segment_id + 1 as segment_id, c, t, re, im from sig) b using (segment_id, c, t))",
        then=_CHANGED,
    ),
    "export_digest": _with(
        SIGNALS,
        then=f"""select cast(list_position(['drone', 'bird', 'human', 'reflector'], {_group('label')}) - 1 as int) as y, count(*) as n, min(segment_id) as first, max(segment_id) as last,
            true as verified from meta where edge_flag = 0 group by 1""",
    ),
}

_WORD = 2**64
_STEP = 0x9E3779B97F4A7C15


def _let(value: str, body: str) -> str:
    """``body`` with ``v`` for ``value``."""
    return f"list_transform([{value}], lambda v: {body})[1]"


def _times(value: str, factor: int) -> str:
    return f"(({value})::uhugeint * {factor}::uhugeint % {_WORD}::uhugeint)::ubigint"


def _plus(value: str, more: str) -> str:
    return f"((({value})::uhugeint + ({more})::uhugeint) % {_WORD}::uhugeint)::ubigint"


def _mixed(value: str) -> str:
    """The mixing of 64-bit words that the draws are made by."""
    first = _let(value, _times("xor(v, v >> 30)", 0xBF58476D1CE4E5B9))
    return _let(_let(first, _times("xor(v, v >> 27)", 0x94D049BB133111EB)), "xor(v, v >> 31)")


def _draws(name: str, fault: str, n: int, salt: int) -> str:
    """Table ``name`` (segment_id, i, u): draw i, counted from 0, of each segment."""
    key = f"(segment_id * {len(FAULTS)} + {FAULTS.index(fault)})"
    salted = _mixed(f"xor({_mixed(_plus(key, str(_STEP)))}, {_mixed(str((salt + 1) * _STEP % _WORD) + '::ubigint')})")
    drawn = _mixed(_plus("state", f"(i + 1)::uhugeint * {_STEP}::uhugeint"))
    return f"""{name} as materialized (select segment_id, i, (({drawn}) >> 11)::double * pow(2::double, -53) as u
        from (select segment_id, {salted} as state from whole), range({n}) r(i))"""


def _drawn(fault: str, *parts: str) -> str:
    """The evidence of a fault made of the segments ``sig`` and the draws u0, u1, u2 of each."""
    wide = "d as materialized (select segment_id, max(u) filter (i = 0) as u0, max(u) filter (i = 1) as u1, max(u) filter (i = 2) as u2 from u group by 1)"
    return _with(SIGNALS, _draws("u", fault, 3, 0), wide, *parts, then=_CHANGED)


_LEVEL = "level as (select segment_id, sqrt(quantile_cont(re * re + im * im, 0.25) / 0.2877) as level from sig group by 1)"
_BURSTS = """starts as (select segment_id, i as k, cast(floor(u * 62) as bigint) as start from u),
    noise as (select a.segment_id, a.i // 10 as k, (a.i // 2) % 5 as c, a.i % 2 as j, sqrt(-2 * ln(1 - a.u)) * cos(2 * pi() * b.u) / sqrt(2) as re,
        sqrt(-2 * ln(1 - a.u)) * sin(2 * pi() * b.u) / sqrt(2) as im from n a join n b on a.segment_id = b.segment_id and b.i = a.i + 30),
    added as (select segment_id, c, start + j as t, 10 * level * sum(re) as re, 10 * level * sum(im) as im from noise join starts using (segment_id, k) join level using (segment_id)
        group by segment_id, c, start + j, level),
    f as (select segment_id, c, t, sig.re + coalesce(added.re, 0) as re, sig.im + coalesce(added.im, 0) as im from sig left join added using (segment_id, c, t))"""

ORACLE |= {
    # faults with draws: the same words are mixed in SQL
    "inject_dropped_block": _drawn(
        "dropped_block",
        """f as (select segment_id, c, t, case when t - floor(u0 * 32) between 0 and 31 then 0 else re end as re, case when t - floor(u0 * 32) between 0 and 31 then 0 else im end as im
            from sig join d using (segment_id))""",
    ),
    "inject_interference_burst": _drawn("interference_burst", _draws("n", "interference_burst", 60, 1), _LEVEL, _BURSTS),
    "inject_dc_leakage": _drawn(
        "dc_leakage", _LEVEL,
        """f as (select segment_id, c, t, re + 3 * level * cos(2 * pi() * u0) as re, im + 3 * level * sin(2 * pi() * u0) as im from sig join d using (segment_id) join level using (segment_id))""",
    ),
    "inject_phase_jump": _drawn(
        "phase_jump",
        """turned as (select segment_id, c, t, re, im, case when t >= 16 + floor(u2 * 32) then pi() / 2 * (1 + u0) * case when u1 < 0.5 then -1 else 1 end else 0 end as a from sig join d using (segment_id)),
            f as (select segment_id, c, t, re * cos(a) - im * sin(a) as re, re * sin(a) + im * cos(a) as im from turned)""",
    ),
    "inject_range_offset": _drawn(
        "range_offset",
        """f as (select segment_id, (c + list_value(-2, -1, 1, 2)[cast(floor(u0 * 4) as int) + 1] + 5) % 5 as c, t, re, im from sig join d using (segment_id))""",
    ),
    "inject_frozen_block": _drawn(
        "frozen_block",
        """f as (select o.segment_id, o.c, o.t, h.re, h.im from sig o join d using (segment_id) join sig h on h.segment_id = o.segment_id and h.c = o.c
            and h.t = case when o.t - floor(u0 * 32) between 0 and 31 then cast(floor(u0 * 32) as bigint) else o.t end)""",
    ),
    "inject_gain_drift": _drawn(
        "gain_drift",
        """f as (select segment_id, c, t, re * g as re, im * g as im from (select *, pow(10, t * 10.0::double / 63 * case when u0 < 0.5 then -1 else 1 end / 20) as g from sig join d using (segment_id)))""",
    ),
}

ORACLE["grouped_split"] = f"""with recursive {CATALOG},
    alike as (select measurement_id, sha1(sha1 || '|' || cast(cast(floor(range_m / 2000) as bigint) as varchar)) as h from segments),
    links as (select distinct min(measurement_id) over (partition by h) as a, measurement_id as b from alike),
    both_ as materialized (select a, b from links where a <> b union select b, a from links where a <> b),
    reach(node, other) as (select a, b from both_ union select r.node, b.b from reach r join both_ b on r.other = b.a),
    roots as (select node, least(node, min(other)) as root from reach group by 1),
    grouped as materialized (select measurement_id, label, n_segments, coalesce(root, measurement_id) as group_id from measurements left join roots on node = measurement_id),
    sums as (select group_id, arg_max(label, row(n_segments, sha1(cast(measurement_id as varchar)))) as label, sum(n_segments) as size from grouped group by 1),
    ranked as materialized (select *, row_number() over (partition by label order by size desc, sha1('0:' || group_id)) as rank, count(*) over (partition by label) as n,
        sum(size) over (partition by label) as total from sums),
    ends as (select label, max(size) filter (rank = n) as smallest, max(size) filter (rank = n - 1) as second from ranked group by 1),
    pick(label, rank, split, a, b, c) as (
        select label, 0::bigint, 0, 6000 * max(total), 2000 * max(total) - 10000 * max(second), 2000 * max(total) - 10000 * max(smallest)
            from ranked join ends using (label) where n > 2 group by label
        union all
        select label, rank, s, a - 10000 * size * (s = 1)::int, b - 10000 * size * (s = 2)::int, c - 10000 * size * (s = 3)::int
            from (select p.label, r.rank, r.size, a, b, c, case when a >= b and a >= c then 1 when b >= c then 2 else 3 end as s
                from pick p join ranked r on r.label = p.label and r.rank = p.rank + 1 where r.rank <= r.n - 2)),
    placed as (select group_id, case when n = 1 or (n = 2 and rank = 1) then 1 when rank = n then 3 when rank = n - 1 then 2 else split end as split_grouped
        from ranked left join pick using (label, rank))
    select measurement_id, group_id, cast(split_grouped as int) as split_grouped from grouped join placed using (group_id)"""

#: Columns of ``documents`` that the tree of digests covers, with their types.
_MERKLE_TYPES = {"text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
MERKLE_COLUMNS = tuple(_MERKLE_TYPES)


def _merkle(fan: int = 256, most: int = 4) -> str:
    """A level per common table expression; the root stands over the first level that has no node but -1, 0 and null."""
    each = lambda f: ", ".join(f"{f(c)} as {c}" for c in _MERKLE_TYPES)
    row = lambda c: f"sha256(coalesce(cast(doc_id as varchar), '') || ':' || coalesce('=' || cast({c} as varchar), '-'))"
    part = lambda c, k: f"cast(sum(cast('0x' || substr({c}, {1 + 12 * k}, 12) as ubigint)) as varchar)"
    added = lambda c: f"sha256(cast(count(*) as varchar) || {' || '.join(f'chr(58) || {part(c, k)}' for k in range(4))})"
    listed = lambda c: f"sha256(string_agg(coalesce(cast(node as varchar), '-9223372036854775808') || ':' || {c}, ',' order by node nulls first))"
    up = f"cast(floor(node / {fan}.0::double) as bigint)"
    ctes = [f"rows_ as (select doc_id as node, {each(row)} from documents)", f"b0 as (select node, cast(count(*) as bigint) as n, {each(added)} from rows_ group by node)"]
    ctes += [f"b{k + 1} as materialized (select {up} as node, cast(sum(n) as bigint) as n, {each(listed)} from b{k} group by 1)" for k in range(most)]
    levels = " union all ".join(f"select {k} as level, * from b{k + 1}" for k in range(most))
    ctes += [f"all_ as materialized ({levels})", "top_ as (select min(level) as top from (select level from all_ group by level having count(*) filter (node not in (-1, 0)) = 0))"]
    whole = f"whole as (select sum(n) as n, {each(listed)} from all_ where level = (select top from top_))"
    seal = ", ".join(f"sha256('{t}:' || cast(coalesce(n, 0) as varchar) || ':' || coalesce({c}, '')) as {c}" for c, t in _MERKLE_TYPES.items())
    return f"""with {', '.join(ctes)}, {whole}
        select cast(level as int) as level, cast(node as varchar) as node, n, {', '.join(_MERKLE_TYPES)} from all_ where level <= (select top from top_)
        union all select cast((select top from top_) + 1 as int), null, cast(coalesce(n, 0) as bigint), {seal} from whole"""


ORACLE["merkle_tree"] = _merkle()
