"""Column functions: built-in Spark expressions only (no Python per row)."""

from convprep.functions.arrays import (  # noqa: F401
    concat_ids,
    dedupe,
    distinct_elements,
    flatten_ids,
    format_id_list,
    ids_text,
    map_lookup_or_self,
    pad_sequence,
    parse_id_list,
    prefix_vector,
    reverse_array,
    size_of,
    take_last,
    topic_field,
    truncate_sequence,
)
from convprep.functions.random import lit_key, md5_key, uniform, uniform_sql  # noqa: F401
from convprep.functions.text import (  # noqa: F401
    BLANK_PATTERN,
    WORD_PATTERN,
    clean_decoded,
    prefix_prompt,
    prepend_text,
    pretokenize,
    strip_sentiment,
    truncate_at_stop,
)
