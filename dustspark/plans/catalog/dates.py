"""Queries whose results hold dates; they are shown as ISO text, on both sides of a comparison."""

DATED: dict[str, tuple[str, ...]] = {}
DATED |= dict.fromkeys("""
    s2_daily_payload_scan s3_chunk_union s3_latest_chunk_wins k1_csv_round_trip k5_staged_pulls
    p3_complete_spine p4_usable_rows p8_default_imputation p9_rolling_fill p14_unit_conversions
    p15_prediction_clamps j1_left_assembly j2_inner_assembly j3_priority_join j4_missing_days
    j16_sites_by_calendar x17_backfill_ratios a1_rollup_serving a1_rollup_null_as_zero a2_rollup_training
    a3_rollup_harvest a3_local_day_rollup w1_rolling_features w2_rolling_with_gaps w11_segmented_mass
    w5_training_samples w14_trimmed_rows w7_strict_rolling w12_mean_dust_factor m20_as_of_rows t3_first_days
    t5_worst_horizon f3_schedule_projection f1_mass_balance f2_day_counters x1_day_angles
    x2_deposition_and_loss x5_specific_yield x7_loss_mass_marginal x11_energy x13_risk_labels
    x14_storm_levels x16_balance_kernel x21_batch_economics x22_confidence m7_standardise q2_dust_outlook
    m0_training_table r1_daily_stream r2_deduplicated_stream r3_site_state_stream
""".split(), ('date',))
DATED |= dict.fromkeys("""
    s4_fetch_windows
""".split(), ('window_start', 'window_end'))
DATED |= dict.fromkeys("""
    p1_numeric_sanitiser u4_duplicate_day_keys
""".split(), ('day',))
DATED |= dict.fromkeys("""
    j12_newest_imagery
""".split(), ('date', 'effective_date'))
DATED |= dict.fromkeys("""
    w19_feasible_dates
""".split(), ('date', 'feasible'))
DATED |= dict.fromkeys("""
    a10_site_profile
""".split(), ('first_date', 'last_date'))
DATED |= dict.fromkeys("""
    m2_date_quantile_split
""".split(), ('first_date',))
