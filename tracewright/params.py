"""Default parameters of an evaluation run."""

from dataclasses import dataclass


@dataclass(frozen=True)
class EvalParams:
    # Defaults an existing user's results depend on.
    prefix_fraction: float = 0.25
    test_fraction: float = 0.2
    seed: int = 42
    pass_at_k: tuple[int, ...] = (1,)
    difficulty_bins: int = 5
    min_w_wrong_samples: int = 30
    min_shared_cell: int = 20
    min_auc_over_baseline: float = 0.05
    min_cell_size: int = 10
    ci_resamples: int = 10_000
    pass_threshold: float = 0.5
    emergence_gap: float = 1.0
    lock_factor: float = 0.5
    suspicious_rate: float = 0.1
    trace_cap: int = 0  # 0: all traces; a number checks a seeded sample
    theiler_window: int = 5
    long_range_lag: float = 0.25
    settle_cosine: float = 0.9
    pair_out_c: float = 0.01
    pair_out_rows: int = 4096  # labelled rows of a leave-pair-out cell, for callers that refuse larger ones
    min_document_frequency: int = 3
    cv_folds: int = 5
    cv_seed: int = 3407
    cv_c: float = 1.0


DEFAULTS = EvalParams()
