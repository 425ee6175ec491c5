from sitepulse.functions.scalars import (  # noqa: F401
    code_label,
    datetime_text,
    day_text,
    key_is_valid,
    mask_key,
    month_bounds,
    percent_text,
    recode_status,
    safe_number,
    split_key,
    status_label,
    validate_choice,
    validate_range,
    word,
)
