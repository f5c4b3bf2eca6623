from tidemark.functions.measures import (
    count_when,
    days,
    distinct_when,
    elapsed_seconds,
    hours,
    money,
    month_of,
    date_key,
    rate,
    share,
    sum_when,
)
from tidemark.functions.prefix import ordered_prefix

__all__ = [
    "count_when",
    "date_key",
    "days",
    "distinct_when",
    "elapsed_seconds",
    "hours",
    "money",
    "month_of",
    "ordered_prefix",
    "rate",
    "share",
    "sum_when",
]
