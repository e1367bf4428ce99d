"""Operators over ``geno(cohort, sample_idx, variant_idx, chrom, pos, dosage)`` as relational text.

Each function gives named steps; a plan is a chain of steps in which later ones
read earlier ones by name.  All work on variants and samples is grouped
aggregates, windows and equi-joins; pairs of samples come from the tiled kernels
(``kin``: pairs at or above the least threshold, and each sample with itself, or
``kin_n``, the same counted by value; ``l1``: nearest burdens).  Every cohort that is neither TR nor HO is a synthetic
one with results of its own.
"""

from __future__ import annotations

from ..functions.dialect import Dialect, d
from ..functions.scalars import clamp01, excess

Steps = dict[str, str]


def allele_frequency() -> Steps:
    """``af``: TRAIN frequency of each variant, clipped away from 0 and 1; all missing counts as 0."""
    return {"af": f"""select variant_idx, greatest({d(1e-6)}, least(1 - {d(1e-6)}, coalesce(avg(dosage), {d(0.0)}) / 2)) as p
    from geno where cohort = 'TR' group by variant_idx"""}


def standardised() -> Steps:
    """``std``: dosages centred and scaled by TRAIN frequencies; missing ones sit at the centre."""
    return {"std": f"""select g.cohort, g.sample_idx, g.variant_idx, (coalesce(g.dosage, 2 * a.p) - 2 * a.p) / (sqrt(2 * a.p * (1 - a.p)) + {d(1e-6)}) as x
    from geno g join af a on g.variant_idx = a.variant_idx"""}


def polymorphic(tol: float = 1e-8) -> Steps:
    """``poly``: variants whose standardised TRAIN values vary."""
    return {"poly": f"select variant_idx from std where cohort = 'TR' group by variant_idx having var_pop(x) > {d(tol)}"}


def train_maf(alpha: float) -> Steps:
    """``maf``: smoothed TRAIN frequency, minor frequency and number of calls of each variant."""
    if alpha > 0:
        p = f"(coalesce(sum(dosage), {d(0.0)}) + {d(alpha)}) / (2 * count(dosage) + {d(2 * alpha)})"
    else:
        p = f"coalesce(sum(dosage) / nullif(2 * count(dosage), 0), {d(0.0)})"
    clipped = f"greatest({d(1e-12)}, least(1 - {d(1e-12)}, {p}))"
    return {"maf": f"select variant_idx, p, least(p, 1 - p) as maf, nobs from (select variant_idx, {clipped} as p, count(dosage) as nobs from geno where cohort = 'TR' group by variant_idx) t"}


def ultra_rare(limit: float) -> Steps:
    """``ultra``: variants whose minor frequency over the real cohorts is below the limit."""
    p = f"coalesce(avg(dosage), {d(0.0)}) / 2"
    return {"ultra": f"select variant_idx from geno where cohort in ('TR', 'HO') group by variant_idx having least({p}, 1 - {p}) + {d(1e-9)} < {d(limit)}"}


def counted() -> Steps:
    """``kin_n``: ``kin`` by value; ``kernels.kinship_cells`` counts pairs by the edges they reach instead, which is all that tails and histograms look at."""
    return {"kin_n": "select cohort, i = j as own, k, cast(1 as bigint) as n from kin"}


def edges(thetas: tuple[float, ...], theta: float = 0.125, upper: float = 0.5, bins: int = 25) -> list[float]:
    """All values that tails and histograms compare a kinship with."""
    return sorted({*thetas, theta, upper, *(theta + t * ((upper - theta) / bins) for t in range(bins + 1))})


def tails(thetas: tuple[float, ...]) -> Steps:
    """``tail``: share of a cohort's pairs at or above each theta; the number of pairs follows from the samples in ``kin``."""
    counts = ", ".join(f"sum(case when not own and k >= {d(t)} then n else 0 end) as c{n}" for n, t in enumerate(thetas))
    parts = " union all ".join(f"select cohort, {d(t)} as theta, coalesce(c{n} / nullif(pairs, 0), {d(0.0)}) as frac from tail_count" for n, t in enumerate(thetas))
    own = "sum(case when own then n else 0 end)"
    return counted() | {"tail_count": f"select cohort, {own} * ({own} - 1) / {d(2.0)} as pairs, {counts} from kin_n group by cohort", "tail": parts}


def _edge(t: str, theta: float, upper: float, bins: int) -> str:
    return f"({d(theta)} + {t} * {d((upper - theta) / bins)})"


def histogram(q: Dialect, theta: float = 0.125, upper: float = 0.5, bins: int = 25) -> Steps:
    """``hist``: counts of tail pairs in equal bins; values above the last edge fall in the last bin, which is closed."""
    return counted() | {
        "bin": f"select t, {_edge('t', theta, upper, bins)} as lo, {_edge('(t + 1)', theta, upper, bins)} as hi from {q.series('t', 0, bins - 1)} s",
        "hist": f"""select c.cohort, b.t, cast(coalesce(sum(h.w), 0) as bigint) as n from bin b cross join (select distinct cohort from kin_n) c
    left join (select cohort, least(k, {d(upper)}) as k, sum(n) as w from kin_n where not own and k >= {d(theta)} group by cohort, least(k, {d(upper)})) h
      on h.cohort = c.cohort and ((h.k >= b.lo and h.k < b.hi) or (b.t = {bins - 1} and h.k >= b.hi)) group by c.cohort, b.t""",
    }


def js_similarity(source: str, keys: tuple[str, ...], name: str) -> Steps:
    """``name(keys, m)``: 1 - JS / ln 2 of two histograms ``p`` and ``q`` in ``source(keys, t, p, q)``; 0 if either is empty."""
    by = ", ".join(keys)
    part = f"partition by {by}" if keys else ""
    lead = f"{by}, " if keys else ""
    eps = d(1e-12)
    kl = lambda a: f"sum(case when {a} > 0 then {a} * ln(({a} + {eps}) / ((pp + qq) / 2 + {eps})) else {d(0.0)} end)"
    return {
        f"{name}_norm": f"select {lead}p / (sum(p) over ({part}) + {eps}) as pp, q / (sum(q) over ({part}) + {eps}) as qq, sum(p) over ({part}) as np, sum(q) over ({part}) as nq from {source}",
        name: f"select {lead}case when min(np) <= 0 or min(nq) <= 0 then {d(0.0)} else {clamp01(f'1 - ({kl("pp")} + {kl("qq")}) / 2 / ln({d(2.0)})')} end as m from {name}_norm" + (f" group by {by}" if keys else ""),
    }


def haplotypes(q: Dialect, k: int = 8, stride: int = 4, min_poly: int = 6) -> Steps:
    """``hap_rate``: share of colliding sample pairs in each window of k variants of a chromosome, by order of appearance.

    Only windows with enough polymorphic variants count; missing dosages take
    the variant's most frequent value, the smallest of equals.
    """
    return {
        "autosome": f"select cohort, sample_idx, variant_idx, chrom, dosage from geno where {q.to_int('chrom')} between 1 and 22",
        "place": "select variant_idx, chrom, row_number() over (partition by chrom order by variant_idx) - 1 as r, count(*) over (partition by chrom) as len from (select distinct variant_idx, chrom from autosome) v",
        "in_window": f"""select variant_idx, chrom, wid, r - wid * {stride} as c from (select p.*, {q.int_div('p.r', str(stride))} - s.back as wid from place p cross join {q.series('back', 0, (k - 1) // stride)} s) t
    where wid >= 0 and r < wid * {stride} + {k} and wid * {stride} + {k} <= len""",
        "value_count": "select cohort, variant_idx, dosage, count(*) as n from autosome where dosage is not null group by cohort, variant_idx, dosage",
        "usual": "select cohort, variant_idx, dosage from (select *, row_number() over (partition by cohort, variant_idx order by n desc, dosage) as rn from value_count) t where rn = 1",
        "varies": "select cohort, variant_idx, case when count(*) >= 2 then 1 else 0 end as poly from value_count group by cohort, variant_idx",
        "good_window": f"select v.cohort, w.chrom, w.wid from in_window w join varies v on v.variant_idx = w.variant_idx group by v.cohort, w.chrom, w.wid having sum(v.poly) >= {min_poly}",
        "hap": f"""select a.cohort, w.chrom, w.wid, a.sample_idx, {q.joined("cast(coalesce(a.dosage, u.dosage, 0) as int)", "w.c")} as hap
    from autosome a join in_window w on a.variant_idx = w.variant_idx join good_window g on g.cohort = a.cohort and g.chrom = w.chrom and g.wid = w.wid
    left join usual u on u.cohort = a.cohort and u.variant_idx = a.variant_idx group by a.cohort, w.chrom, w.wid, a.sample_idx""",
        "hap_rate": f"""select h.cohort, h.chrom, h.wid, sum(h.n * (h.n - 1) / 2) / nullif(max(s.n * (s.n - 1) / 2), 0) as rho
    from (select cohort, chrom, wid, hap, cast(count(*) as double) as n from hap group by cohort, chrom, wid, hap) h
    join (select cohort, cast(count(distinct sample_idx) as double) as n from geno group by cohort) s on s.cohort = h.cohort group by h.cohort, h.chrom, h.wid""",
        "hap_collision": f"select c.cohort, coalesce(avg(h.rho), {d(0.0)}) as mean_rho, coalesce(max(h.rho), {d(0.0)}) as max_rho from (select distinct cohort from geno) c left join hap_rate h on h.cohort = c.cohort group by c.cohort",
    }


def rare(maf_limit: float) -> Steps:
    """``rare``: variants whose TRAIN minor frequency is below the limit, or below that of one allele in all."""
    return {"rare": f"select variant_idx from maf where maf < greatest({d(maf_limit)}, (select {d(0.5)} / greatest(count(distinct sample_idx), 1) from geno where cohort = 'TR'))"}


def rare_burden(q: Dialect, maf_limit: float) -> Steps:
    """``burden``: each sample's dosage sum over rare variants (``rare``), by autosome and in all.

    Calls are summed by chromosome before features are dealt out, so only sums
    meet the list of features.
    """
    return rare(maf_limit) | {
        "rare_sum": f"select g.cohort, g.sample_idx, g.chrom, sum(coalesce(g.dosage, {d(0.0)})) as s from geno g join rare r on r.variant_idx = g.variant_idx group by g.cohort, g.sample_idx, g.chrom",
        "feature": f"select 'global' as feature union all select chrom from (select variant_idx, min(chrom) as chrom from geno group by variant_idx) v where {q.to_int('chrom')} between 1 and 22 group by chrom",
        "burden": f"""select p.cohort, p.sample_idx, f.feature, coalesce(sum(case when f.feature = 'global' or f.feature = s.chrom then s.s end), {d(0.0)}) as value
    from (select distinct cohort, sample_idx from geno) p cross join feature f left join rare_sum s on s.cohort = p.cohort and s.sample_idx = p.sample_idx group by p.cohort, p.sample_idx, f.feature""",
    }


def membership() -> Steps:
    """``mia``: for each synthetic cohort ``name``, from ``l1(name, cohort, sample_idx, dist)``, the AUC by mid-ranks, and its risk; only distinct distances are ordered."""
    return {
        "tied": "select name, dist, count(*) as n, sum(case when cohort = 'TR' then 1 else 0 end) as t, sum(case when cohort = 'HO' then 1 else 0 end) as h from l1 group by name, dist",
        "ranked": f"select name, t, h, sum(n) over (partition by name order by dist desc) - n + (n + 1) / {d(2.0)} as mid from tied",
        "mia": f"""select name, auc, {clamp01('2 * (auc - ' + d(0.5) + ')')} as r_mia from (select name, (s - t * (t + 1) / 2) / nullif(t * h, 0) as auc from (select name, sum(t * mid) as s, cast(sum(t) as double) as t, cast(sum(h) as double) as h from ranked group by name) x) y""",
    }


def rare_carriers(maf_limit: float, k_minor: int = 1, min_calls: float = 0.8) -> Steps:
    """``uniq``: for each synthetic cohort ``name``, the share of rare variants with two or more carriers, that expected, and the risk."""
    n = "(select count(distinct sample_idx) from geno where cohort = 'TR')"
    calls = f"greatest(1, cast(floor({d(min_calls)} * {n}) as bigint))"
    return {
        "carrier": f"""select g.cohort as name, g.variant_idx, count(g.dosage) as n_eff, sum(case when g.dosage > 0 then 1 else 0 end) as x, max(m.p) as p from geno g join maf m on m.variant_idx = g.variant_idx
    join rare r on r.variant_idx = m.variant_idx
    where g.cohort not in ('TR', 'HO') and m.nobs >= {calls} and m.maf < greatest({d(maf_limit)}, {k_minor} / (2 * cast(greatest(m.nobs, 1) as double))) group by g.cohort, g.variant_idx having count(g.dosage) >= 2""",
        "uniq": f"""select name, n_used, u, u0, {excess('u', 'u0')} as r_uniq from (select k.name, count(c.variant_idx) as n_used, coalesce(avg(case when c.x >= 2 then {d(1.0)} when c.x is not null then {d(0.0)} end), {d(0.0)}) as u,
      coalesce(avg(1 - pow(1 - c.qq, c.n_eff) - c.n_eff * c.qq * pow(1 - c.qq, c.n_eff - 1)), {d(0.0)}) as u0
    from (select distinct cohort as name from geno where cohort not in ('TR', 'HO')) k left join (select *, 1 - pow(1 - p, 2) as qq from carrier) c on c.name = k.name group by k.name) t""",
    }


def proximity(q: Dialect, quantile: float = 0.01) -> Steps:
    """``pli``: quantile ratio and adversarial share of ``dist(sample_idx, d_syn, d_real)``."""
    return {
        "pli_q": f"select {q.percentile('d_syn', quantile)} as q_syn, {q.percentile('d_real', quantile)} as q_real, avg(case when d_real < d_syn then {d(1.0)} else {d(0.0)} end) as a from dist",
        "pli": f"select rho, r_p, a, r_a, greatest(r_p, r_a) as pli from (select q_syn / greatest(q_real, {d(1e-12)}) as rho, {clamp01(f'1 - q_syn / greatest(q_real, {d(1e-12)})')} as r_p, a, greatest({d(0.0)}, {d(0.5)} - a) / {d(0.5)} as r_a from pli_q) t",
    }


def resamples(q: Dialect, draws: int, source: str = "select distinct sample_idx from geno where cohort = 'HO'") -> Steps:
    """``mult``: how often each individual stands in each draw with replacement; one table serves all bootstraps."""
    return {
        "person": f"select sample_idx, row_number() over (order by sample_idx) - 1 as idx, count(*) over () as n from ({source}) s",
        "mult": f"""select d.b, p.sample_idx, count(*) as c from (select b.b, s.idx, {q.draw(f"'k:' || {q.text('b.b')} || ':' || {q.text('s.idx')}")} % s.n as pick from {q.series('b', 0, draws - 1)} b cross join person s) d
    join person p on p.idx = d.pick group by d.b, p.sample_idx""",
    }


def resampled_kin() -> Steps:
    """``kin_b``: pairs of each draw by value, with multiplicity; two copies of one person pair with each other.

    A draw has as many pairs as there are pairs of people, whatever it holds, so
    only pairs in ``kin`` (those above the least threshold) are needed.
    """
    return {
        "kin_b": """select a.b, k.k, cast(case when k.i = k.j then a.c * (a.c - 1) / 2 else a.c * b.c end as double) as w
    from kin k join mult a on a.sample_idx = k.i join mult b on b.sample_idx = k.j and b.b = a.b where k.cohort = 'HO' and (k.i < k.j or a.c > 1)""",
        "pairs_b": f"select b, sum(c) * (sum(c) - 1) / {d(2.0)} as pairs from mult group by b",
    }


def kinship_excess(thetas: tuple[float, ...], draws: int) -> Steps:
    """``ike``: by synthetic cohort and theta, the tail share, its mean over draws of real people, and the risk (1 without draws)."""
    if not draws:
        return {"ike": f"select t.cohort as name, t.theta, t.frac, cast(null as double) as f0, {clamp01('cast(null as double)')} as r from tail t where t.cohort not in ('TR', 'HO')"}
    counts = ", ".join(f"sum(case when k >= {d(t)} then w else 0 end) as s{n}" for n, t in enumerate(thetas))
    null = " union all ".join(f"select {d(t)} as theta, avg(coalesce(s.s{n}, 0) / p.pairs) as f0 from pairs_b p left join tail_b s on s.b = p.b where p.pairs > 0" for n, t in enumerate(thetas))
    return {
        "tail_b": f"select b, {counts} from kin_b group by b",
        "ike_null": null,
        "ike": f"select t.cohort as name, t.theta, t.frac, n.f0, {excess('t.frac', 'n.f0')} as r from tail t join ike_null n on n.theta = t.theta where t.cohort not in ('TR', 'HO')",
    }


def _observed() -> Steps:
    return {
        "tails_both": "select s.cohort as name, s.t, cast(h.n as double) as p, cast(s.n as double) as q from hist s join hist h on h.t = s.t and h.cohort = 'HO' where s.cohort <> 'HO'",
        **js_similarity("tails_both", ("name",), "m_obs"),
        "close": "select name, cast(sum(p) as bigint) as n_real_close, cast(sum(q) as bigint) as n_syn_close from tails_both group by name",
    }


def replay(draws: int, theta: float = 0.125, upper: float = 0.5, bins: int = 25) -> Steps:
    """``replay``: by synthetic cohort, similarity of the tails' histograms, its mean and deviation over draws, the risk, and the tails' sizes.

    Without draws the similarity is its own base and the risk is the similarity.
    """
    told = f"c.n_real_close, c.n_syn_close, {bins} as n_bins, {d(upper)} as upper"
    if not draws:
        return _observed() | {"replay": f"select o.name, o.m as obs, o.m as base, {d(0.0)} as sd, {clamp01('o.m')} as r_replay, {told} from m_obs o join close c on c.name = o.name"}
    return _observed() | {
        "hist_b": f"select k.b, b.t, sum(k.w) as n from (select b, least(k, {d(upper)}) as k, w from kin_b where k >= {d(theta)}) k join bin b on (k.k >= b.lo and k.k < b.hi) or (b.t = {bins - 1} and k.k >= b.hi) group by k.b, b.t",
        "both_b": "select h.cohort as name, m.b, h.t, coalesce(x.n, 0) as p, cast(h.n as double) as q from (select distinct b from mult) m cross join (select cohort, t, n from hist where cohort <> 'HO') h left join hist_b x on x.b = m.b and x.t = h.t",
        **js_similarity("both_b", ("name", "b"), "m_b"),
        "replay": f"select o.name, o.m as obs, n.base, n.sd, {excess('o.m', 'n.base')} as r_replay, {told} from m_obs o join (select name, avg(m) as base, coalesce(stddev_samp(m), 0) as sd from m_b group by name) n on n.name = o.name join close c on c.name = o.name",
    }


#: Values that are drawn from one row, and tasks that draws are dealt to.
_SLOTS, _DRAW_TASKS = 1 << 16, 96


def value_draws(q: Dialect, draws: int, thetas: tuple[float, ...], theta: float = 0.125, upper: float = 0.5, bins: int = 25) -> Steps:
    """``value_null``: where no people can be drawn, pairs' values are: by synthetic cohort, the mean similarity and mean tail shares over draws.

    ``replay`` draws the synthetic cohort's values, ``excess`` the real one's, as
    many as the synthetic cohort has.  A value matters by its cell alone (the
    histogram's bin and the thetas it reaches), so a draw picks a place in the
    running counts of cells, and pairs are never numbered.  Draws are made in runs of
    ``_SLOTS``, dealt to all tasks.
    """
    edges = sorted({*thetas, theta, *(theta + t * ((upper - theta) / bins) for t in range(bins))})
    cell = " + ".join(f"(case when k >= {d(e)} then 1 else 0 end)" for e in edges)
    lowest = " union all ".join(f"select {n} as cell, {d(e)} as low" for n, e in enumerate([-1e300, *edges]))
    return {
        "cell": f"select cohort, cell, cast(sum(n) as bigint) as n from (select cohort, {cell} as cell, n from kin_n where not own and k >= {d(min(edges))}) t group by cohort, cell",
        "cell_all": "select cohort, cell, n from cell union all select t.cohort, 0 as cell, cast(max(t.pairs) - coalesce(max(c.n), 0) as bigint) as n from tail_count t left join (select cohort, sum(n) as n from cell where cell > 0 group by cohort) c on c.cohort = t.cohort group by t.cohort",
        "cell_sum": "select cohort, cell, sum(n) as n from cell_all group by cohort, cell",
        "ladder": "select cohort, cell, cast(sum(n) over (partition by cohort order by cell) - n as bigint) as lo, cast(sum(n) over (partition by cohort order by cell) as bigint) as hi from cell_sum where n > 0",
        "total": "select cohort, max(hi) as n from ladder group by cohort",
        "wanted": "select s.cohort as name, s.n as size, 'replay' as kind, s.cohort as source, s.n as have from total s where s.cohort <> 'HO' union all select s.cohort, s.n, 'excess', 'HO', h.n from total s cross join (select n from total where cohort = 'HO') h where s.cohort <> 'HO'",
        "chunk": f"select /*+ REPARTITION({_DRAW_TASKS}) */ w.name, w.kind, w.source, w.size, w.have, d.b, l.at * {_SLOTS} as first from wanted w cross join {q.series('b', 0, draws - 1)} d cross join lateral (select {q.unnest_range(q.int_div(f'(w.size + {_SLOTS - 1})', str(_SLOTS)))} as at) l",
        "pick": f"select c.name, c.kind, c.source, c.size, c.b, {q.draw(f"'v:' || c.kind || ':' || {q.text('c.b')} || ':' || {q.text('(c.first + l.slot)')}")} % c.have as at from chunk c cross join lateral (select {q.unnest_range(f'least({_SLOTS}, c.size - c.first)')} as slot) l",
        "cell_b": "select /*+ BROADCAST(l) */ p.name, p.kind, p.b, l.cell, cast(count(*) as double) as n, max(p.size) as size from pick p join ladder l on l.cohort = p.source and p.at >= l.lo and p.at < l.hi group by p.name, p.kind, p.b, l.cell",
        "low": lowest,
        "bin_v": f"select c.name, c.b, b.t, sum(c.n) as n from cell_b c join low l on l.cell = c.cell join bin b on (least(l.low, {d(upper)}) + {d(1e-9)} >= b.lo and least(l.low, {d(upper)}) + {d(1e-9)} < b.hi) or (b.t = {bins - 1} and l.low + {d(1e-9)} >= b.hi) where c.kind = 'replay' and l.low + {d(1e-9)} >= {d(theta)} group by c.name, c.b, b.t",
        "both_v": f"select w.name, d.b, h.t, cast(h.n as double) as p, coalesce(x.n, {d(0.0)}) as q from (select distinct name from wanted) w cross join {q.series('b', 0, draws - 1)} d cross join (select t, n from hist where cohort = 'HO') h left join bin_v x on x.name = w.name and x.b = d.b and x.t = h.t",
        **js_similarity("both_v", ("name", "b"), "m_v"),
        "value_null": "select name, 'replay' as kind, cast(null as double) as theta, avg(m) as base from m_v group by name union all "
        + " union all ".join(f"select name, 'excess', {d(t)}, avg(f) from (select c.name, c.b, sum(case when l.low + {d(1e-9)} >= {d(t)} then c.n else 0 end) / max(c.size) as f from cell_b c join low l on l.cell = c.cell where c.kind = 'excess' group by c.name, c.b) t group by name" for t in thetas),
    }


def value_runs() -> Steps:
    """``run``: the runs of :func:`value_draws` with their source's cells and where these end in its running counts."""
    return {
        "rungs": "select cohort, array_sort(collect_list(named_struct('hi', hi, 'cell', cell))) as r from ladder group by cohort",
        "run": f"select /*+ BROADCAST(l) */ c.name, c.kind, c.b, c.size, c.have, c.first, least({_SLOTS}, c.size - c.first) as slots, transform(l.r, x -> x.cell) as cells, transform(l.r, x -> x.hi) as edges from chunk c join rungs l on l.cohort = c.source",
    }


def haplotype_risk(draws: int, min_poly: int = 6, k: int = 8) -> Steps:
    """``hap_risk``: by synthetic cohort, the collision rate against its mean over draws of real people (1 without draws, 0 with one person).

    A haplotype's code is worked out once a person and window from the calls that
    are there; a draw's windows count by its own variety, and only missing calls
    take the draw's own most frequent value.  Codes are then grouped with
    multiplicities.  ``k`` is the windows' width: up to 8 places of 6 bits are whole
    numbers that a double holds exactly.
    """
    if k > 8:
        raise ValueError("windows are at most 8 variants wide here")
    risk = f"case when h.cohort is null then {d(0.0)} when mean_rho <= c0 or max_rho <= c0 + {d(1e-12)} then {d(0.0)} else {clamp01(f'(mean_rho - c0) / (max_rho - c0 + {d(1e-12)})')} end"
    people = "(select case when count(distinct sample_idx) > 1 then 'HO' end as cohort from geno where cohort = 'HO') h"
    if not draws:
        return {"hap_risk": f"select c.cohort as name, mean_rho as obs, cast(null as double) as base, max_rho as cmax, case when h.cohort is null then {d(0.0)} else {clamp01('cast(null as double)')} end as r_hap from hap_collision c cross join {people} where c.cohort not in ('TR', 'HO')"}
    return {
        "real_cell": "select sample_idx, variant_idx, dosage from autosome where cohort = 'HO'",
        "value_b": "select m.b, a.variant_idx, a.dosage, sum(m.c) as n from real_cell a join mult m on m.sample_idx = a.sample_idx where a.dosage is not null group by m.b, a.variant_idx, a.dosage",
        "usual_b": "select b, variant_idx, min_by(dosage, struct(-n, dosage)) as dosage, count(*) as kinds from value_b group by b, variant_idx",
        "window_b": f"select u.b, w.chrom, w.wid from usual_b u join in_window w on w.variant_idx = u.variant_idx group by u.b, w.chrom, w.wid having sum(case when u.kinds >= 2 then 1 else 0 end) >= {min_poly}",
        "code": "select w.chrom, w.wid, a.sample_idx, sum(coalesce(a.dosage, 0) * pow(64, w.c)) as code from real_cell a join in_window w on w.variant_idx = a.variant_idx group by w.chrom, w.wid, a.sample_idx",
        "gap": "select w.chrom, w.wid, w.c, a.sample_idx, a.variant_idx from real_cell a join in_window w on w.variant_idx = a.variant_idx where a.dosage is null",
        "fill_b": "select m.b, g.chrom, g.wid, g.sample_idx, sum(u.dosage * pow(64, g.c)) as more from gap g join mult m on m.sample_idx = g.sample_idx join usual_b u on u.b = m.b and u.variant_idx = g.variant_idx group by m.b, g.chrom, g.wid, g.sample_idx",
        "hap_b": """select m.b, k.chrom, k.wid, k.code + coalesce(f.more, 0) as code, sum(m.c) as n from code k join mult m on m.sample_idx = k.sample_idx
    left join fill_b f on f.b = m.b and f.chrom = k.chrom and f.wid = k.wid and f.sample_idx = k.sample_idx group by m.b, k.chrom, k.wid, k.code + coalesce(f.more, 0)""",
        "rate_b": "select r.b, r.chrom, r.wid, sum(r.n * (r.n - 1) / 2) / max(p.pairs) as rho from hap_b r join window_b g on g.b = r.b and g.chrom = r.chrom and g.wid = r.wid join pairs_b p on p.b = r.b group by r.b, r.chrom, r.wid",
        "null_b": f"select avg(c) as c0 from (select m.b, coalesce(avg(r.rho), {d(0.0)}) as c from (select distinct b from mult) m left join rate_b r on r.b = m.b group by m.b) t",
        "hap_risk": f"select c.cohort as name, mean_rho as obs, c0 as base, max_rho as cmax, {risk} as r_hap from hap_collision c cross join null_b cross join {people} where c.cohort not in ('TR', 'HO')",
    }


def proximity_draws(q: Dialect, quantile: float = 0.01) -> Steps:
    """``pli_b``: the proximity figures of each draw of the real samples' distances."""
    copies = "explode(sequence(1, cast(m.c as int)))" if q.spark else "unnest(range(0, m.c))"
    spread = f"select m.b, x.d_syn, x.d_real, {copies} as nth from mult m join dist x on x.sample_idx = m.sample_idx"
    one = d(1.0)
    return {
        "dist_b": spread,
        "pli_b": f"""select b, rho, r_p, a, r_a, greatest(r_p, r_a) as pli from (select b, rho, {clamp01('1 - rho')} as r_p, a, greatest({d(0.0)}, {d(0.5)} - a) / {d(0.5)} as r_a from (
      select b, {q.percentile('d_syn', quantile)} / greatest({q.percentile('d_real', quantile)}, {d(1e-12)}) as rho, avg(case when d_real < d_syn then {one} else {d(0.0)} end) as a from dist_b group by b) t) r""",
    }
