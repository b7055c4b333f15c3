"""Oversampling of imbalanced classification tables as Spark DataFrame plans."""

from rebalance.functions import distance, euclidean, interpolate, manhattan
from rebalance.operators.encode import (
    attribute_profile,
    category_dictionary,
    decode_label,
    encode_labeled,
    encode_rows,
    explode_features,
    normalize_declared,
    numeric_columns,
    numeric_view,
)
from rebalance.operators.neighbors import knn_join, knn_self, merge_topk, topk_per_key
from rebalance.operators.profile import (
    balance_report,
    class_distribution,
    num_classes,
    partition_profile,
    sampling_plan,
)
from rebalance.operators.ranking import global_rank, with_row_id
from rebalance.operators.scaling import (
    Ranges,
    collect_ranges,
    minmax_fit,
    minmax_inverse,
    minmax_transform,
)
from rebalance.operators.synth import allocate_copies, minority, pick_neighbor, smote
from rebalance.plans.balance import balance
from rebalance.sources import (
    KeelSchema,
    format_rows,
    read_keel,
    read_keel_header,
    read_keel_rejects,
    rejects,
    well_formed,
    write_balanced,
)
from rebalance.staging import drop_staged, staging_run

__all__ = [
    "KeelSchema",
    "Ranges",
    "allocate_copies",
    "attribute_profile",
    "balance",
    "balance_report",
    "category_dictionary",
    "class_distribution",
    "collect_ranges",
    "decode_label",
    "distance",
    "drop_staged",
    "encode_labeled",
    "encode_rows",
    "euclidean",
    "explode_features",
    "format_rows",
    "global_rank",
    "interpolate",
    "knn_join",
    "knn_self",
    "manhattan",
    "merge_topk",
    "minmax_fit",
    "minmax_inverse",
    "minmax_transform",
    "minority",
    "normalize_declared",
    "num_classes",
    "numeric_columns",
    "numeric_view",
    "partition_profile",
    "pick_neighbor",
    "read_keel",
    "read_keel_header",
    "read_keel_rejects",
    "rejects",
    "sampling_plan",
    "smote",
    "staging_run",
    "topk_per_key",
    "well_formed",
    "with_row_id",
    "write_balanced",
]
