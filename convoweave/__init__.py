"""Post-training data for chat language models as Spark DataFrame plans."""

from .functions.chat import assistant_spans, invalid_messages, render_chat
from .functions.encoders import FileTokenizer, OffsetTokenizer, token_decoder
from .functions.permutation import Permutation
from .functions.tokens import (
    token_count,
    token_counter,
    token_lister,
    token_mask,
    tokenize,
    truncate_tokens,
)
from .operators.conversations import (
    assemble_messages,
    render_turns,
    split_invalid_turns,
    turn_spans,
)
from .operators.copies import with_content_key
from .operators.exact_cut import exact_sample, train_test_split
from .operators.nested_union import concat_nested
from .operators.numbering import number_rows, sample_rows, shuffle_rows
from .operators.packing import pack, pack_blocks, pack_segments
from .operators.projection import (
    concat_members,
    drop_empty_conversations,
    drop_messages,
    rename_sequential,
    select_columns,
)
from .operators.run_tables import keep_by_path
from .operators.transform import apply_transform
from .operators.weighted_sample import weighted_sample
from .operators.whole_rows import pack_whole, plan_slots, whole_blocks
from .plans.mixture import MixturePlan, build_mixture, load_training_data, plan_mixture
from .plans.run_catalogue import run_status
from .plans.training_text import packed_text, preference_text, render_pairs, sft_text
from .sources.contracts import check_contract, task_columns
from .sources.listing import scan_configs
from .sources.sinks import save_metrics, split_counts, write_metrics, write_splits
from .sources.tables import load_dataset, load_member
from .spec import ArrowColumn, BatchTransform, ColumnTransform, Member, Mixture, RowTransform

__all__ = [
    "ArrowColumn",
    "BatchTransform",
    "ColumnTransform",
    "FileTokenizer",
    "Member",
    "Mixture",
    "MixturePlan",
    "OffsetTokenizer",
    "Permutation",
    "RowTransform",
    "apply_transform",
    "assemble_messages",
    "assistant_spans",
    "build_mixture",
    "check_contract",
    "concat_members",
    "concat_nested",
    "drop_empty_conversations",
    "drop_messages",
    "exact_sample",
    "invalid_messages",
    "keep_by_path",
    "load_dataset",
    "load_member",
    "load_training_data",
    "number_rows",
    "pack",
    "pack_blocks",
    "pack_segments",
    "pack_whole",
    "packed_text",
    "plan_mixture",
    "plan_slots",
    "preference_text",
    "rename_sequential",
    "render_chat",
    "render_pairs",
    "render_turns",
    "run_status",
    "sample_rows",
    "save_metrics",
    "scan_configs",
    "select_columns",
    "sft_text",
    "shuffle_rows",
    "split_counts",
    "split_invalid_turns",
    "task_columns",
    "token_count",
    "token_counter",
    "token_decoder",
    "token_lister",
    "token_mask",
    "tokenize",
    "train_test_split",
    "truncate_tokens",
    "turn_spans",
    "weighted_sample",
    "whole_blocks",
    "with_content_key",
    "write_metrics",
    "write_splits",
]
