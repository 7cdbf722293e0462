from stratum.functions.columns import (  # noqa: F401
    blank_to_null,
    bytes_to_mb,
    capitalize,
    clamp_nonneg,
    classify_category,
    dataset_name_from_file,
    engagement_rate,
    file_name,
    fill_zero,
    half_month_period,
    mask_nonneg,
    month_name,
    month_number,
    parse_date,
    parse_date_strict,
    period_end_date,
    ratio,
    replace_negative,
    round_half_even_long,
    try_cast,
)
