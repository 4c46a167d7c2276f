from tidemark.core.draws import hash_bucket, hash_index, hash_key, hash_sign
from tidemark.core.intervals import interval_join, interval_rollup
from tidemark.core.ordering import exact_median, ordinal, running_growth, top_by
from tidemark.core.pointintime import asof_join

__all__ = [
    "asof_join",
    "exact_median",
    "hash_bucket",
    "hash_index",
    "hash_key",
    "hash_sign",
    "interval_join",
    "interval_rollup",
    "ordinal",
    "running_growth",
    "top_by",
]
