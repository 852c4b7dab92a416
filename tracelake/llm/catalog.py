"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import crosssplit, history, leaks, mixing, neighbours, packing, runs, spans, sql, subjects, subset
from tracelake.llm.common import table

SUBJECTS = ("documents", "subject_labels", "subject_areas", "eval_items")
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: spans.shared_spans(table(s, d, "segments")),
        "p1_segments": lambda s, d: spans.shared_per_segment(table(s, d, "segments")),
        "p2_found": lambda s, d: crosssplit.found(table(s, d, "segments")),
        "p2_by_source": lambda s, d: crosssplit.by_source(table(s, d, "segments")),
        "p3_pack": lambda s, d: packing.placed(table(s, d, "episodes"), table(s, d, "shard_targets")),
        "p3_shards": lambda s, d: packing.shards(table(s, d, "episodes"), table(s, d, "shard_targets")),
        "p3_invariants": lambda s, d: packing.invariants(table(s, d, "episodes"), table(s, d, "shard_targets")),
        "p4_found": lambda s, d: runs.long_presses(table(s, d, "segments")),
        "p4_collapsed": lambda s, d: runs.collapse_presses(table(s, d, "segments")),
        "p5_found": lambda s, d: history.found(table(s, d, "episodes"), table(s, d, "shard_episodes")),
        "p5_batches": lambda s, d: history.batches(table(s, d, "episodes"), table(s, d, "shard_episodes")),
        "p6_subset": lambda s, d: subset.chosen(table(s, d, "diversity_features"), table(s, d, "subset_requests")),
        "p6_coverage": lambda s, d: subset.coverage(table(s, d, "diversity_features"), table(s, d, "subset_requests")),
        "p6_sizes": lambda s, d: subset.sizes(table(s, d, "diversity_features"), table(s, d, "subset_requests")),
        "p7_found": lambda s, d: neighbours.found(table(s, d, "diversity_features"), table(s, d, "frame_tokens"), table(s, d, "encoders")),
        "p7_neighbours": lambda s, d: neighbours.listed(table(s, d, "diversity_features"), table(s, d, "frame_tokens"), table(s, d, "encoders")),
        "p8_found": lambda s, d: leaks.found(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_reparameterised": lambda s, d: leaks.reparameterised(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_leaked_items": lambda s, d: leaks.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_mixture": lambda s, d: mixing.mixture(table(s, d, "documents"), table(s, d, "source_targets")),
        "p9_uses": lambda s, d: mixing.document_uses(table(s, d, "documents"), table(s, d, "source_targets")),
        "p9_shares": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "source_targets")),
        "p9_within": lambda s, d: mixing.within(table(s, d, "documents"), table(s, d, "source_targets")),
        "p10_found": lambda s, d: subjects.found(*(table(s, d, t) for t in SUBJECTS)),
        "p10_make_up": lambda s, d: subjects.make_up(*(table(s, d, t) for t in SUBJECTS)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": sql.P1_FOUND, "p2_found": sql.P2_FOUND, "p4_found": sql.P4_FOUND, "p4_collapsed": sql.P4_COLLAPSED, "p5_found": sql.P5_FOUND,
        "p1_segments": sql.P1_SEGMENTS, "p2_by_source": sql.P2_BY_SOURCE, "p3_invariants": sql.P3_INVARIANTS, "p5_batches": sql.P5_BATCHES, "p6_sizes": sql.P6_SIZES, "p9_within": sql.P9_WITHIN,
        "p7_found": sql.P7_FOUND, "p8_found": sql.P8_FOUND, "p8_leaked_items": sql.P8_LEAKED_ITEMS,
    }
