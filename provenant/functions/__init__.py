from .scalars import (  # noqa: F401
    after_fill,
    differs_keeping_null,
    double_sum,
    epoch_seconds,
    lower_columns,
    mean_of,
    safe_divide,
    strip_whitespace,
    to_native_units,
)
