"""Double columns of the checked queries. Both sides round them, so that the order in which floating-point
sums are added up does not show."""

DIGITS = 6

DOUBLES: dict[str, str] = {
    "msm_saturated": "estimate std_error",
    "ipw_weights_saturated": "ipweight cmlipweight largest",
    "matching_rounds_success": "pct",
    "latest_value": "last_value",
    "cleaned_measurement": "bmi",
    "flowchart": "pct_exclude pct_all pct_step",
    "flowchart_rounded": "pct_exclude pct_all pct_step",
    "km_rounded": "surv surv_se surv_ll surv_ul risk risk_se risk_ll risk_ul",
    "km_unrounded": "surv surv_se surv_ll surv_ul risk risk_se risk_ll risk_ul",
    "sequential_trial_km": "surv surv_se surv_ll surv_ul risk risk_se risk_ll risk_ul",
    "km_contrasts": (
        "inc_0 inc_1 inc2_0 inc2_1 surv_0 surv_1 surv_se_0 surv_se_1 surv_ll_0 surv_ll_1 surv_ul_0 surv_ul_1 "
        "risk_0 risk_1 risk_se_0 risk_se_1 risk_ll_0 risk_ll_1 risk_ul_0 risk_ul_1 cml_rate_0 cml_rate_1 irr "
        "irr_ln_se irr2 irr2_ln_se cmlirr cmlirr_ln_se sr sr_ln_se rr rr_ln_se rd rd_se irr_ll irr_ul irr2_ll "
        "irr2_ul cmlirr_ll cmlirr_ul sr_ll sr_ul rr_ll rr_ul rd_ll rd_ul"
    ),
    "life_table": (
        "summand surv surv_ll surv_ul surv_se haz_km cml_haz_km se_haz_km haz_ac cml_haz_ac se_haz_ac llsurv "
        "se_llsurv"
    ),
    "match_success": "pct",
    "dose_status_by_date": "n_per_10000",
    "incidence_summary": "rate_death rate_postest incidencerate_death incidencerate_postest",
    "separation_check": "event0_pct event1_pct",
    "cumulative_weights": "ipweight_a cmlipweight_a ipweight cmlipweight top",
    "locf_nocb": "value down up",
    "dense_grid_fill": "value step decay",
    "share_of_total": "per_10000",
    "pivot_wide_values": "top_urgent top_low",
    "top_rows_per_group": "value",
    "sample_weights": "sample_weight",
    "numeric_summary": "mean sd min max pct_nonmiss pct_miss p10 p25 p50 p75 p90",
    "date_summary": "pct_nonmiss pct_miss sd",
    "cat_summary": "pct pct_nonmiss",
    "catcat_summary": "pct pct_nonmiss",
    "skim_completeness": "complete_rate",
    "skim": "complete_rate mean sd min max p10 p25 p50 p75 p90",
    "level_counts": "percent",
    "table1": "median p25 p75 p p_miss p_nonmiss",
    "spline_knots": "prob quantile",
    "meta_analysis": "loghr loghr_se hr statistic conf_low conf_high",
    "effect_table_from_estimates": "term_left term_right term_midpoint ve ve_ll ve_ul diff diff_se z",
    "weight_histogram_from_values": "bin_start",
}
