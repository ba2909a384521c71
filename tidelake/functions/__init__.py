"""Column functions: time, aggregation, text and JSON.  All are built-in expressions."""

from tidelake.functions.agg import distinct_count_with, first, last, ordered_array_agg, sum_exact, sum_plus
from tidelake.functions.json import contains_all, extract_leaf, json_path, json_text
from tidelake.functions.text import replace_first, similar_to
from tidelake.functions.time import age_at_least, date_trunc, epoch, extract, from_epoch, micros_to_timestamp, seconds_between, time_bucket

__all__ = [
    "age_at_least", "contains_all", "date_trunc", "distinct_count_with", "epoch", "extract", "extract_leaf", "first", "from_epoch", "json_path", "json_text",
    "last", "micros_to_timestamp", "ordered_array_agg", "replace_first", "seconds_between", "similar_to", "sum_exact", "sum_plus", "time_bucket",
]
