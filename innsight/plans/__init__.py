"""Physical-plan helpers: size-checked broadcast joins, reliable lineage cuts, plan text."""

from innsight.plans.joins import DEFAULT_MAX_BROADCAST_BYTES, join_bounded, measured_bytes
from innsight.plans.lineage import Cuts, checkpoint_dir, cut_lineage, job_cuts, scratch_path

__all__ = [
    "DEFAULT_MAX_BROADCAST_BYTES",
    "Cuts",
    "checkpoint_dir",
    "cut_lineage",
    "job_cuts",
    "join_bounded",
    "measured_bytes",
    "scratch_path",
]
