"""Per-sample tables of the proximity index and the data behind its plots."""

from __future__ import annotations

from ..functions.dialect import Dialect, d
from ..operators.relations import Steps


def per_sample(q: Dialect) -> Steps:
    """``per_sample`` from ``dist``: ratio, margin, flags and competition ranks, 1 the riskiest."""
    ratio = f"d_syn / (d_real + {d(1e-12)})"
    return {
        "measured": f"select 'HO_' || {q.text('sample_idx')} as sample, sample_idx, d_syn, d_real, {ratio} as ratio, d_real - d_syn as margin, greatest({d(0.0)}, least({d(1.0)}, 1 - {ratio})) as s_ratio, d_syn < d_real as ap_flag from dist",
        "per_sample": "select *, rank() over (order by s_ratio desc) as rank_s_ratio, rank() over (order by margin desc) as rank_margin from measured",
    }


SORTS = {"margin": "margin desc", "ratio": "ratio", "rank": "rank_s_ratio", "index": "sample_idx"}


def plot_rows(sort_by: str = "margin", top_k: int = 20) -> str:
    """The first rows of ``per_sample`` in a plot's order, ties by sample."""
    if sort_by not in SORTS:
        raise ValueError(f"sort_by is one of {', '.join(SORTS)}")
    return f"select sample, d_syn, d_real, ratio, margin, rank_s_ratio from per_sample order by {SORTS[sort_by]}, sample_idx limit {top_k}"


def driver() -> Steps:
    """``pli_driver``: which of the two sub-risks sets the index."""
    return {"pli_driver": "select pli, r_p, r_a, case when r_p >= r_a then 'ratio_tail' else 'adv_proximity' end as driver from pli"}


def scatter(top_k: int = 10) -> Steps:
    """``scatter``: every sample's point, whether it lies below the diagonal, whether it is one of the riskiest to be named, and the share below."""
    return {"scatter": f"select sample, d_syn, d_real, ap_flag as below, row_number() over (order by rank_s_ratio, sample_idx) <= {top_k} as labelled, avg(case when ap_flag then {d(1.0)} else {d(0.0)} end) over () as frac from per_sample"}
