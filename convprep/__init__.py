"""convprep: conversational text preparation as Spark DataFrame operators.

Every operator is a function from DataFrame (and parameters) to DataFrame;
Catalyst plans the whole chain. The names below are the public surface; see
README.md for the map from the survey's operator IDs to these functions.
"""

__version__ = "0.1.0"

from convprep.functions import (  # noqa: F401,E402
    clean_decoded,
    concat_ids,
    dedupe,
    distinct_elements,
    flatten_ids,
    map_lookup_or_self,
    md5_key,
    pad_sequence,
    parse_id_list,
    prefix_prompt,
    prefix_vector,
    prepend_text,
    pretokenize,
    reverse_array,
    size_of,
    strip_sentiment,
    take_last,
    topic_field,
    truncate_at_stop,
    truncate_sequence,
    uniform,
)
from convprep.operators.corpus import concat_corpus, concat_corpus_shards  # noqa: F401,E402
from convprep.operators.examples import (  # noqa: F401,E402
    apply_batch,
    bag_of_words_examples,
    format_examples,
    max_len_per_batch,
    next_token_pairs,
    pad_batches,
    prepend_control_examples,
    previous_token_pairs,
    stored_sequences,
    token_pairs,
)
from convprep.operators.index import assign_batches, dense_index, shuffle_rows  # noqa: F401,E402
from convprep.operators.keywords import non_empty_elements, prepare_keywords, translate_keywords  # noqa: F401,E402
from convprep.operators.rows import (  # noqa: F401,E402
    count_rows,
    drop_columns,
    drop_missing_text,
    drop_short_sequences,
    filter_message_type,
    filter_sender,
    find_empty_sequences,
    length_stats,
    limit_rows,
    lookup_row,
    project_schema,
    rename_text,
)
from convprep.operators.scores import (  # noqa: F401,E402
    argmax_by_group,
    cross_entropy,
    cumulative_share,
    epoch_rollup,
    mean_cross_entropy,
    sample_by_group,
    sample_candidates,
    softmax_by_group,
    sort_scores,
    top_k_filter,
    top_p_filter,
)
from convprep.operators.tokens import (  # noqa: F401,E402
    apply_tokenizer,
    decode,
    decode_by_vocabulary,
    encode,
    encode_by_vocabulary,
    encode_subwords,
    fit_subword_merges,
    fit_vocabulary,
    subword_pieces,
    tokenize,
    tokenize_dataset,
)
from convprep.operators.vectors import (  # noqa: F401,E402
    control_vectors,
    lookup_embeddings,
    mean_vector,
    prefix_control,
    random_vector,
)
from convprep.plans.keyword_set import prepare_keyword_dataset  # noqa: F401,E402
from convprep.plans.training_set import sender_training_set  # noqa: F401,E402
from convprep.sources.messages import (  # noqa: F401,E402
    from_table,
    load_comments,
    read_keyed_records,
    read_message_export,
    read_records,
    select_source,
    union_exports,
)
from convprep.sources.sinks import (  # noqa: F401,E402
    dataset,
    register_dataset,
    run_manifest,
    write_csv_table,
    write_dataset,
    write_metric_history,
    write_per_sender,
    write_run_manifest,
)
from convprep.sources.tables import chunk_text, read_csv_table  # noqa: F401,E402
