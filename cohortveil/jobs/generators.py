"""Cohorts made from real genotypes: a safe one from frequencies alone, and leaky ones from copies.

All draws come from md5 of a key that names the draw, so reruns and retried
tasks give the same cohort.
"""

from __future__ import annotations

from ..functions.dialect import Dialect, d
from ..operators.relations import Steps


def safe(q: Dialect, samples: int, floor_maf: float = 0.0, name: str = "safe_geno") -> Steps:
    """``name``: independent Hardy-Weinberg draws at TRAIN frequencies (``af``); rare sites may be raised to a floor."""
    p = "a.p" if not floor_maf else f"case when least(a.p, 1 - a.p) >= {d(floor_maf)} then a.p when a.p < {d(0.5)} then {d(floor_maf)} else {d(1 - floor_maf)} end"
    draw = lambda side: f"(case when {q.uniform(f"'s:{side}:' || {q.text('n.sample_idx')} || ':' || {q.text('a.variant_idx')}")} < {p} then 1 else 0 end)"
    return {name: f"select n.sample_idx, a.variant_idx, v.chrom, v.pos, cast({draw('a')} + {draw('b')} as double) as dosage from {q.series('sample_idx', 0, samples - 1)} n cross join af a join (select distinct variant_idx, chrom, pos from geno) v on v.variant_idx = a.variant_idx"}


def copycat(q: Dialect, samples: int, copy: float = 0.60, near: float = 0.30, flip_near: float = 0.01, flip_random: float = 0.05, name: str = "leaky_geno", tag: str = "l") -> Steps:
    """``name``: copies of real samples; after the exact ones, near copies and random ones with flipped dosages.  Ultra-rare sites (``ultra``) and missing calls stay."""
    n_copy, n_near = round(copy * samples), round(near * samples)
    cell = f"{q.text('b.sample_idx')} || ':' || {q.text('g.variant_idx')}"
    return {
        f"{name}_real": "select cohort, sample_idx, row_number() over (order by sample_idx, cohort) - 1 as idx, count(*) over () as n from (select distinct cohort, sample_idx from geno where cohort in ('TR', 'HO')) s",
        f"{name}_base": f"select d.sample_idx, r.cohort as src_cohort, r.sample_idx as src, case when d.sample_idx < {n_copy} then {d(0.0)} when d.sample_idx < {n_copy + n_near} then {d(flip_near)} else {d(flip_random)} end as rate from (select s.sample_idx, {q.draw(f"'{tag}:' || {q.text('s.sample_idx')}")} % c.n as pick from {q.series('sample_idx', 0, samples - 1)} s cross join (select max(n) as n from {name}_real) c) d join {name}_real r on r.idx = d.pick",
        name: f"""select b.sample_idx, g.variant_idx, g.chrom, g.pos, case when g.dosage is not null and u.variant_idx is null and {q.uniform(f"'{tag}f:' || {cell}")} < b.rate
      then greatest({d(0.0)}, least({d(2.0)}, g.dosage + case when {q.uniform(f"'{tag}s:' || {cell}")} < {d(0.5)} then -1 else 1 end)) else g.dosage end as dosage
    from {name}_base b join geno g on g.sample_idx = b.src and g.cohort = b.src_cohort left join ultra u on u.variant_idx = g.variant_idx""",
    }


def kindoped(q: Dialect, samples: int, pairs: float = 0.20, sib_flip: float = 0.008) -> Steps:
    """``kin_geno``: a copycat cohort of which chosen rows are flipped once more, rare sites too."""
    cell = f"{q.text('l.sample_idx')} || ':' || {q.text('l.variant_idx')}"
    return copycat(q, samples, 0.50, 0.40, 0.008, 0.03, "dope_geno", "d") | {
        "doped": f"select sample_idx from (select sample_idx, row_number() over (order by {q.draw(f"'dk:' || {q.text('sample_idx')}")}, sample_idx) as rn from dope_geno_base) t where rn <= {round(pairs * samples)}",
        "kin_geno": f"""select l.sample_idx, l.variant_idx, l.chrom, l.pos, case when k.sample_idx is not null and l.dosage is not null and {q.uniform(f"'dr:' || {cell}")} < {d(sib_flip)}
      then greatest({d(0.0)}, least({d(2.0)}, l.dosage + case when {q.uniform(f"'dt:' || {cell}")} < {d(0.5)} then -1 else 1 end)) else l.dosage end as dosage
    from dope_geno l left join doped k on k.sample_idx = l.sample_idx""",
    }
