"""Row-level column expressions and statistical scalar functions."""

from retentio.functions.expr import (  # noqa: F401
    blank_to_null, cut, cut_ordinal, effect_size_label, lifecycle_stage, ltv_bin_labels,
    mean_of, money_double, rate, risk_band, round_half_away, round_half_even, tenure_bucket,
    tenure_bucket_order, to_snake, yes_flag,
)
from retentio.functions.stats import erfc_nonneg, normal_quantile, two_sided_p  # noqa: F401
