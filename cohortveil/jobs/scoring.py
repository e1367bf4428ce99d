"""From a table of component risks to calibrated scores, their uncertainty and the choice of targets.

``scores(name, role, ord, pli, kri, tli)`` has candidates and two anchors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import Dialect, d
from ..functions.scalars import calibrate, clamp01, noisy_or
from ..operators.relations import Steps

R = ("pli", "kri", "tli")
W = ("w1", "w2", "w3")
# The targets that the search tries.
EPS_GRID, LAM_GRID, GAMMA_GRID = (0.02, 0.04, 0.06, 0.08, 0.10), (0.75, 0.80, 0.85, 0.90), (1e-4, 1e-3, 1e-2)


def profile(q: Dialect, candidates: int = 3, samples: int = 60) -> Steps:
    """``cohorts``: TRAIN, holdout, the synthetic cohort split into candidates, and the two anchors' cohorts."""
    return {"cohorts": f"""select cohort, sample_idx, variant_idx, chrom, pos, dosage from geno where cohort in ('TR', 'HO')
    union all select 'G' || {q.text(f"{q.int_div('sample_idx', '5')} % {candidates}")}, sample_idx, variant_idx, chrom, pos, dosage from geno where cohort = 'SYN'
    union all select 'SAFE', sample_idx + 1000000, variant_idx, chrom, pos, dosage from safe_geno
    union all select 'LEAKY', sample_idx + 2000000, variant_idx, chrom, pos, dosage from leaky_geno"""}


def components() -> Steps:
    """``scores``: the three indices of each synthetic cohort, from their sub-risks by ``name`` (``pli_of``, ``replay``, ``ike``, ``hap_risk``, ``spec``, ``mia``, ``uniq``)."""
    role = "case when p.name = 'SAFE' then 'safe anchor' when p.name = 'LEAKY' then 'leaky anchor' else 'candidate' end"
    return {
        "scores": f"""select p.name, {role} as role, row_number() over (order by p.name) as ord, round(p.pli, 6) as pli, round(greatest(r.r_replay, i.r_ike, h.r_hap, s.r_spec), 6) as kri, round(greatest(m.r_mia, u.r_uniq), 6) as tli
    from pli_of p join replay r on r.name = p.name join (select name, max(r) as r_ike from ike group by name) i on i.name = p.name join hap_risk h on h.name = p.name join spec s on s.name = p.name join mia m on m.name = p.name join uniq u on u.name = p.name""",
    }


def listed(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """A user's rows ``name, pli, kri, tli, role`` with their place in the list, ``ord``."""
    return spark.createDataFrame([(*row, place) for place, row in enumerate(rows)], "name string, pli double, kri double, tli double, role string, ord long")


def given(name: str = "given") -> Steps:
    """``scores`` from a user's table ``name, pli, kri, tli, role, ord`` bound as ``name``: the first anchor of a role and ties go by ``ord``."""
    return {"scores": f"select name, role, row_number() over (order by ord, name) as ord, cast(pli as double) as pli, cast(kri as double) as kri, cast(tli as double) as tli from {name}"}


def spectral_risk() -> Steps:
    """``spec`` from ``eigen(cohort, ratio)``: how much more the largest eigenvalue stands out than among real people."""
    return {"spec": f"select s.cohort as name, s.ratio as s, h.ratio as s0, case when s.ratio <= h.ratio then {d(0.0)} else {clamp01(f'(s.ratio - h.ratio) / (s.ratio + {d(1e-12)})')} end as r_spec from eigen s cross join (select ratio from eigen where cohort = 'HO') h where s.cohort not in ('TR', 'HO')"}


def proximity_of(q: Dialect, quantile: float = 0.01) -> Steps:
    """``pli_of``: the proximity index of each synthetic cohort, from ``near(cohort, sample_idx, dd)``."""
    rho = f"q_syn / greatest(q_real, {d(1e-12)})"
    return {"pli_of": f"""select cohort as name, greatest({clamp01(f'1 - {rho}')}, greatest({d(0.0)}, {d(0.5)} - a) / {d(0.5)}) as pli from (select s.cohort, {q.percentile('s.dd', quantile)} as q_syn, {q.percentile('r.dd', quantile)} as q_real, avg(case when r.dd < s.dd then {d(1.0)} else {d(0.0)} end) as a
    from near s join near r on r.sample_idx = s.sample_idx and r.cohort = 'HO' where s.cohort <> 'HO' group by s.cohort) t"""}


def anchors() -> Steps:
    """``anchor``: the first row of each anchor's role."""
    return {"anchor": "select * from (select s.*, row_number() over (partition by role order by ord) as nth from scores s where role in ('safe anchor', 'leaky anchor')) t where nth = 1"}


def grid(q: Dialect) -> Steps:
    """``grid``: weights on the simplex in steps of a hundredth."""
    return {"grid": f"select i, j, i * {d(0.01)} as w1, j * {d(0.01)} as w2, 1 - i * {d(0.01)} - j * {d(0.01)} as w3 from {q.series('i', 0, 100)} a cross join {q.series('j', 0, 100)} b where 1 - i * {d(0.01)} - j * {d(0.01)} >= 0"}


def _raw(alias: str) -> str:
    return noisy_or(tuple(f"{alias}.{r}" for r in R), tuple(f"g.{w}" for w in W))


def targets() -> Steps:
    """``targets``: the pooled risks that anchors are to have: a little above the median of what they pool to without weights (0), within bounds."""
    zero = tuple(d(0.0) for _ in R)
    middle = lambda role: f"coalesce((select median({noisy_or(tuple(f'a.{r}' for r in R), zero)}) from scores a where a.role = '{role}'), {d(0.0)})"
    within = lambda x, low, high: f"least({d(high)}, greatest({d(low)}, {x}))"
    return {"targets": f"select {within(middle('safe anchor') + ' + ' + d(0.02), 0.02, 0.10)} as eps, {within(middle('leaky anchor') + ' + ' + d(0.10), 0.75, 0.90)} as lam"}


def _lowest(loss: str) -> str:
    """The least loss (to 12 places) and the first grid point that has it, as one whole number."""
    return f"min(cast(floor(({loss}) * {d(1e12)} + {d(0.5)}) as bigint) * 16384 + i * 128 + j)"


def _point(q: Dialect, key: str) -> str:
    return f"cast({q.int_div(f'({key} % 16384)', '128')} as int) as i, cast({key} % 128 as int) as j"


def fit(q: Dialect, eps: float = 0.02, lam: float = 0.75, gamma: float = 1e-3) -> Steps:
    """``weights``: the first grid point of least loss between the anchors' scores and their targets."""
    return anchors() | grid(q) | {
        "loss": f"select i, j, w1, w2, w3, (a - {d(eps)}) * (a - {d(eps)}) + (b - {d(lam)}) * (b - {d(lam)}) + {d(gamma)} * (w1 * w1 + w2 * w2 + w3 * w3) as loss from (select g.*, {_raw('s')} as a, {_raw('l')} as b from grid g cross join (select * from anchor where role = 'safe anchor') s cross join (select * from anchor where role = 'leaky anchor') l) t",
        "weights": f"select i, j, i * {d(0.01)} as w1, j * {d(0.01)} as w2, 1 - i * {d(0.01)} - j * {d(0.01)} as w3, loss from (select {_point(q, 'key')}, loss from (select {_lowest('loss')} as key, min(loss) as loss from loss) k) t",
    }


_TIE, _EVEN = 1e-12, " + ".join(f"(case when g.{w} > 0 then -g.{w} * ln(g.{w}) else {d(0.0)} end)" for w in W)


def _folded(q: Dialect) -> str:
    """The walk over ``i, j, loss, far, even`` in the grid's order: a lower loss is taken, and a near-tie of smaller, or else more even, weights."""
    fields = ("i", "j", "loss", "far", "even")
    tie = f"abs(x.loss - a.loss) <= {d(_TIE)} and (x.far + {d(1e-15)} < a.far or x.even > a.even + {d(1e-12)})"
    step = f"case when x.loss + {d(_TIE)} < a.loss then x when {tie} then {q.row(i='x.i', j='x.j', loss='a.loss', far='x.far', even='x.even')} else a end"
    rows = q.row(**{f: f for f in fields})
    if q.spark:
        return f"aggregate(array_sort(collect_list({rows})), {q.row(i='0', j='0', loss=d(math.inf), far=d(0.0), even=d(0.0))}, (a, x) -> {step})"
    return f"list_reduce(list_sort(list({rows})), lambda a, x: {step})"


def _near(loss: str, least: str, keys: tuple[str, ...], source: str) -> str:
    """Points that the walk may end at: nothing is taken after a loss that isn't within a near-tie or two of the least one."""
    by = "".join(f"{k}, " for k in keys)
    return f"select {by}i, j, {loss} as loss, far, even from {source} where {loss} <= {least} + 3 * {d(_TIE)}"


def fold_fit(q: Dialect, eps: float = 0.02, lam: float = 0.75, gamma: float = 1e-3) -> Steps:
    """``weights`` like :func:`fit`, but by the walk."""
    return {name: text for name, text in fit(q, eps, lam, gamma).items() if name != "weights"} | {
        "loss_near": _near("g.loss", "m.low", (), f"(select g.i, g.j, g.loss, g.w1 * g.w1 + g.w2 * g.w2 + g.w3 * g.w3 as far, {_EVEN} as even from loss g) g cross join (select min(loss) as low from loss) m"),
        "weights": f"select w.i, w.j, w.i * {d(0.01)} as w1, w.j * {d(0.01)} as w2, 1 - w.i * {d(0.01)} - w.j * {d(0.01)} as w3, w.loss from (select {_folded(q)} as w from loss_near) t",
    }


def scored() -> Steps:
    """``scored``: every row's pooled risk and its place between the first anchors."""
    return anchors() | {
        "raw": f"select s.name, s.role, s.ord, s.pli, s.kri, s.tli, {_raw('s')} as r_raw from scores s cross join weights g",
        "ends_of": "select max(case when a.role = 'safe anchor' then r.r_raw end) as lo, max(case when a.role = 'leaky anchor' then r.r_raw end) as hi from raw r join anchor a on a.name = r.name and a.ord = r.ord",
        "scored": f"select r.name, r.role, r.ord, r.pli, r.kri, r.tli, r.r_raw, {calibrate('r.r_raw', 'a.lo', 'a.hi')} as score from raw r cross join ends_of a",
    }


def jittered(q: Dialect, draws: int, sigma: float = 0.01) -> Steps:
    """``jit``: the anchors' components in each draw, moved by normal noise and kept in 0..1."""

    def moved(role: str, r: str) -> str:
        key = lambda n: f"'j:{n}:{role}:{r}:' || {q.text('b.b')}"
        z = f"sqrt(-2 * ln(({q.draw(key(1))} + 1) / cast(4294967297 as double))) * cos({d(6.283185307179586)} * {q.uniform(key(2))})"
        return f"greatest({d(0.0)}, least({d(1.0)}, a.{role}_{r} + {d(sigma)} * {z})) as {role}_{r}"

    ends = ", ".join(f"max(case when role = '{role} anchor' then {r} end) as {role}_{r}" for role in ("safe", "leaky") for r in R)
    return anchors() | {"jit": f"select b.b, {', '.join(moved(role, r) for role in ('safe', 'leaky') for r in R)} from {q.series('b', 0, draws - 1)} b cross join (select {ends} from anchor) a"}


def _jit_raw(role: str) -> str:
    return noisy_or(tuple(f"j.{role}_{r}" for r in R), tuple(f"g.{w}" for w in W))


def draws_fixed() -> Steps:
    """``draw``: each candidate's scores by draw, with the weights held."""
    return {
        "ends": f"select j.b, {_jit_raw('safe')} as lo, {_jit_raw('leaky')} as hi from jit j cross join weights g",
        "draw": f"select e.b, r.name, r.ord, r.r_raw, {calibrate('r.r_raw', 'e.lo', 'e.hi')} as score from ends e cross join (select * from raw where role = 'candidate') r",
    }


def draw_stats(q: Dialect) -> Steps:
    """``stats``: mean, deviation and intervals of each candidate, raw and calibrated; ``pairs``: two-sided tests of all differences."""
    lo, hi = q.percentile("score", 0.025), q.percentile("score", 0.975)
    dlo, dhi = q.percentile("diff", 0.025), q.percentile("diff", 0.975)
    rlo, rhi = q.percentile("r_raw", 0.025), q.percentile("r_raw", 0.975)
    share = lambda op: f"avg(case when diff {op} 0 then {d(1.0)} else {d(0.0)} end)"
    return {
        "stats": f"select name, avg(r_raw) as mean_r, stddev_samp(r_raw) as sd_r, {rlo} as lo_r, {rhi} as hi_r, avg(score) as mean_g, stddev_samp(score) as sd_g, {lo} as lo_g, {hi} as hi_g from draw group by name",
        "diffs": "select a.b, a.name || ' - ' || c.name as pair, a.score - c.score as diff from draw a join draw c on c.b = a.b and a.ord < c.ord",
        "pairs": f"select pair, avg(diff) as mean_diff, {dlo} as lo, {dhi} as hi, least({d(1.0)}, 2 * least({share('>=')}, {share('<=')})) as p from diffs group by pair",
    }


def rankings(q: Dialect, source: str = "draw", keys: tuple[str, ...] = (), permutations: int = 2000) -> Steps:
    """``tau``: agreement of each draw's ranking with the first one's and its interval; ``modal``: rankings by how often they come."""
    by = "".join(f"{k}, " for k in keys)
    part = f"partition by {by.rstrip(', ')}" if keys else ""
    same = lambda a, b: "".join(f" and {a}.{k} = {b}.{k}" for k in keys)
    return {
        "place": f"select {by}b, name, ord, row_number() over (partition by {by}b order by round(score, 9) desc, ord) as pos from {source}",
        "first": f"select {by}name, ord, pos from place where b = 0",
        "first_pair": f"select {''.join(f'x.{k}, ' for k in keys)}x.ord as o1, z.ord as o2, sign(x.pos - z.pos) as s from first x join first z on z.ord > x.ord{same('z', 'x')}",
        "rank_text": f"select {by}b, {q.ranking('name', 'pos')} as ranking from place group by {by}b",
        "tau_b": f"""select {''.join(f'x.{k}, ' for k in keys)}x.b, avg(cast(sign(x.pos - z.pos) * f.s as double)) as tau from place x join place z on z.b = x.b and z.ord > x.ord{same('z', 'x')}
    join first_pair f on f.o1 = x.ord and f.o2 = z.ord{same('f', 'x')} group by {''.join(f'x.{k}, ' for k in keys)}x.b""",
        "tau": f"select {by}avg(tau) as mean_tau, coalesce(stddev_samp(tau), 0) as sd_tau, {q.percentile('tau', 0.025)} as lo, {q.percentile('tau', 0.975)} as hi from tau_b" + (f" group by {by.rstrip(', ')}" if keys else ""),
        "modal": f"select {by}ranking, n, row_number() over ({part} order by n desc, first_b) as rn, share from (select {by}ranking, count(*) as n, min(b) as first_b, count(*) / cast(sum(count(*)) over ({part}) as double) as share from rank_text group by {by}ranking) t",
        "perm": f"select p.p, c.ord, c.name, row_number() over (partition by p.p order by {q.draw(f"'p:' || {q.text('p.p')} || ':' || c.name")}, c.ord) as pos from {q.series('p', 0, permutations - 1)} p cross join (select distinct name, ord from scores where role = 'candidate') c",
    }


def tau_null(keys: tuple[str, ...] = ()) -> Steps:
    """``tau_p``: random rankings' agreement with the first draw's (mean and deviation), and how often it is as good as the draws'."""
    by = "".join(f"{k}, " for k in keys)
    same = "".join(f" and t.{k} = n.{k}" for k in keys) or " and true"
    one = lambda op: f"avg(case when n.tau {op} t.mean_tau then {d(1.0)} else {d(0.0)} end)"
    return {
        "perm_pair": "select x.p, x.ord as o1, z.ord as o2, sign(x.pos - z.pos) as s from perm x join perm z on z.p = x.p and z.ord > x.ord",
        "tau_perm": f"select {''.join(f'f.{k}, ' for k in keys)}x.p, avg(cast(x.s * f.s as double)) as tau from perm_pair x join first_pair f on f.o1 = x.o1 and f.o2 = x.o2 group by {''.join(f'f.{k}, ' for k in keys)}x.p",
        "tau_p": f"select {''.join(f'n.{k}, ' for k in keys)}avg(n.tau) as null_mean, stddev_samp(n.tau) as null_sd, least({d(1.0)}, 2 * least({one('>=')}, {one('<=')})) as p from tau_perm n join tau t on true{same}" + (f" group by {', '.join(f'n.{k}' for k in keys)}" if by else ""),
    }


def search(q: Dialect, eps: tuple[float, ...] = EPS_GRID, lam: tuple[float, ...] = LAM_GRID, gamma: tuple[float, ...] = GAMMA_GRID) -> Steps:
    """``draw``: candidates' scores by configuration and draw, weights refitted for each; ``best``: those weights.

    The anchors' pooled risks depend on the draw and the weights alone, so they
    are worked out once and met by all configurations.  Of a draw's grid only the
    points that the walk may end at are kept, and walked in order.
    """
    rows = lambda name, values: " union all ".join(f"select {d(v)} as {name}" for v in values)
    loss = "(e.lo - c.eps) * (e.lo - c.eps) + (e.hi - c.lam) * (e.hi - c.lam) + c.gamma * e.far"
    return grid(q) | {
        "config": f"select eps, lam, gamma from ({rows('eps', eps)}) a cross join ({rows('lam', lam)}) b cross join ({rows('gamma', gamma)}) c",
        "ends_w": f"select j.b, g.i, g.j, w1 * w1 + w2 * w2 + w3 * w3 as far, {_EVEN} as even, {_jit_raw('safe')} as lo, {_jit_raw('leaky')} as hi from jit j cross join grid g",
        "lowest": f"select c.eps, c.lam, c.gamma, e.b, min({loss}) as low from ends_w e cross join config c group by c.eps, c.lam, c.gamma, e.b",
        "near_w": _near(loss, "l.low", ("c.eps", "c.lam", "c.gamma", "e.b"), "ends_w e cross join config c join lowest l on l.eps = c.eps and l.lam = c.lam and l.gamma = c.gamma and l.b = e.b"),
        "best": f"select p.eps, p.lam, p.gamma, p.b, g.w1, g.w2, g.w3 from (select eps, lam, gamma, b, {_folded(q)} as w from near_w group by eps, lam, gamma, b) p join grid g on g.i = p.w.i and g.j = p.w.j",
        "draw": f"select g.eps, g.lam, g.gamma, g.b, s.name, s.ord, {_raw('s')} as r_raw, {calibrate(_raw('s'), _jit_raw('safe'), _jit_raw('leaky'))} as score from best g join jit j on j.b = g.b cross join (select * from scores where role = 'candidate') s",
        "weight_stats": "select eps, lam, gamma, count(*) as n_boot, " + ", ".join(f"avg({w}) as {w}_mean, coalesce(stddev_samp({w}), 0) as {w}_sd" for w in W) + " from best group by eps, lam, gamma",
    }
