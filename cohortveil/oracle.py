"""The check's SQL for what Spark runs by kernels or rewritten steps: plain joins over all pairs, cells and draws, for DuckDB.

Nothing here runs on Spark, and little is shared with it: draws by md5, the
genotype table and a few scalar rules.  One synthetic cohort, SYN, at a time.
"""

from __future__ import annotations

from .functions.dialect import DUCKDB as Q
from .functions.dialect import d
from .functions.scalars import clamp01, excess
from .operators import relations as rel

Steps = dict[str, str]


def chain(steps: Steps, select: str) -> str:
    return "with recursive " + ",\n".join(f"{n} as {'materialized ' if n.startswith('pow_') else ''}({s})" for n, s in steps.items()) + "\n" + select


def standardised() -> Steps:
    return {
        "frequency": "select variant_idx, case when m < 1e-6 then 1e-6::double when m > 1 - 1e-6::double then 1 - 1e-6::double else m end as p from (select variant_idx, coalesce(sum(dosage) / count(dosage), 0::double) / 2 as m from geno where cohort = 'TR' group by variant_idx) t",
        "std": "select g.cohort, g.sample_idx, g.variant_idx, case when g.dosage is null then 0::double else (g.dosage - 2 * f.p) / (sqrt(2 * f.p * (1 - f.p)) + 1e-6::double) end as x from geno g join frequency f using (variant_idx)",
    }


def pairs() -> Steps:
    """``kin``: every pair of a cohort."""
    return {"kin": """select a.cohort, a.sample_idx as i, b.sample_idx as j, round(sum(a.x * b.x) / max(m.n), 9) as k
    from std a join std b on a.cohort = b.cohort and a.variant_idx = b.variant_idx and a.sample_idx <= b.sample_idx
    cross join (select count(distinct variant_idx) as n from std) m where a.cohort <> 'TR' group by a.cohort, a.sample_idx, b.sample_idx"""}


def components_of(source: str = "std", k: int = 10, squarings: int = 26) -> Steps:
    """``part``: all samples on TRAIN's leading components, a component for a variant; one after the other, each by squaring what is left of the covariance."""
    trace = lambda m: f"list_sum(list_transform(range(1, len({m}) + 1), lambda i: {m}[i][i]))"
    return {
        "varied": f"select variant_idx, avg(x) as mean, dense_rank() over (order by variant_idx) as v from {source} where cohort = 'TR' group by variant_idx having var_pop(x) > 1e-8::double",
        "moved": f"select s.cohort, s.sample_idx, c.v, s.x - c.mean as x from {source} s join varied c using (variant_idx)",
        "cov": "select list(r order by i) as m from (select i, list(c order by j) as r from (select a.v as i, b.v as j, sum(a.x * b.x) as c from moved a join moved b on a.sample_idx = b.sample_idx and a.cohort = 'TR' and b.cohort = 'TR' group by all) t group by i) u",
        "axes": f"""select 1 as c, 0 as s, m as rest, list_transform(m, lambda r: list_transform(r, lambda x: x / t)) as p, []::double[] as axis from (select m, {trace("m")} as t from cov) z
    union all select * from (select case when turned then c + 1 else c end, case when turned then 0 else s + 1 end, rest, list_transform(q, lambda r: list_transform(r, lambda x: x / t)), axis from (
      select c, s, turned, rest, q, axis, {trace("q")} as t from (select c, s, turned, rest, axis, case when turned then rest else list_transform(p, lambda r: list_transform(p, lambda o: list_dot_product(r, o))) end as q from (
        select c, s, turned, p, axis, case when turned then list_transform(range(1, len(rest) + 1), lambda i: list_transform(range(1, len(rest) + 1), lambda j: rest[i][j] - value * axis[i] * axis[j])) else rest end as rest from (
          select *, case when turned then list_dot_product(axis, list_transform(rest, lambda r: list_dot_product(r, axis))) end as value from (
            select c, s, rest, p, s = {squarings} as turned, case when s = {squarings} then list_transform(p[top], lambda x: x / sqrt(p[top][top])) else []::double[] end as axis from (
              select *, list_position(list_transform(range(1, len(p) + 1), lambda i: p[i][i]), list_max(list_transform(range(1, len(p) + 1), lambda i: p[i][i]))) as top from axes where c <= {k} and c <= len(rest)) a) b) d) e) f) g) h""",
        "part": "select m.cohort, m.sample_idx, a.c as variant_idx, sum(m.x * a.axis[m.v]) as x from moved m cross join (select c - 1 as c, axis from axes where len(axis) > 0) a group by all",
    }


def distances(source: str = "part") -> Steps:
    """``dist`` and ``near``: each HO sample's distance to the nearest sample of each cohort but itself, over components or plain values."""
    some = "join (select variant_idx from std where cohort = 'TR' group by variant_idx having var_pop(x) > 1e-8::double) v on v.variant_idx = a.variant_idx" if source == "std" else ""
    return {
        "pair_d": f"select a.sample_idx as i, b.cohort, b.sample_idx as j, sqrt(sum((a.x - b.x) * (a.x - b.x))) as dd from {source} a {some} join {source} b on a.variant_idx = b.variant_idx where a.cohort = 'HO' and b.cohort <> 'TR' and (a.sample_idx <> b.sample_idx or b.cohort <> 'HO') group by a.sample_idx, b.cohort, b.sample_idx",
        "near": "select cohort, i as sample_idx, round(min(dd), 9) as dd from pair_d group by cohort, i",
        "dist": "select sample_idx, max(dd) filter (where cohort = 'SYN') as d_syn, max(dd) filter (where cohort = 'HO') as d_real from near group by sample_idx",
    }


def tails(thetas: tuple[float, ...]) -> Steps:
    return {"tail": " union all ".join(f"select cohort, {d(t)} as theta, avg((k >= {d(t)})::int) as frac from kin where i < j group by cohort" for t in thetas)}


def draws(n: int) -> Steps:
    return rel.resamples(Q, n) | {"kin_b": """select a.b, k.k, case when k.i = k.j then a.c * (a.c - 1) / 2 else a.c * b.c end as w
    from kin k join mult a on a.sample_idx = k.i join mult b on b.sample_idx = k.j and b.b = a.b where k.cohort = 'HO' and (k.i < k.j or a.c > 1)"""}


def kinship_excess(thetas: tuple[float, ...]) -> Steps:
    null = " union all ".join(f"select b, {d(t)} as theta, sum(case when k >= {d(t)} then w else 0 end) / sum(w) as f from kin_b group by b" for t in thetas)
    return tails(thetas) | {
        "ike_null": f"select theta, avg(f) as f0 from ({null}) t group by theta",
        "ike": f"select t.theta, t.frac, n.f0, {excess('t.frac', 'n.f0')} as r from tail t join ike_null n on n.theta = t.theta where t.cohort = 'SYN'",
    }


def _bin(k: str, theta: float, upper: float, bins: int) -> str:
    """The number of edges at or below a value, the last bin closed."""
    edges = ", ".join(f"({d(theta)} + {t} * {d((upper - theta) / bins)})" for t in range(bins))
    return f"len(list_filter([{edges}], lambda e: e <= {k})) - 1"


def similarity(p: str, q: str) -> str:
    """One number from two relations ``(t, n)``: 1 - JS / ln 2, 0 if either is empty."""
    each = "select t, coalesce(p.n, 0)::double as p, coalesce(q.n, 0)::double as q from (select unnest(range(0, 100)) as t) b left join (%s) p using (t) left join (%s) q using (t)" % (p, q)
    part = lambda a: f"sum(case when {a} > 0 then {a} * ln(({a} + 1e-12::double) / ((p + q) / 2 + 1e-12::double)) else 0 end)"
    return f"(select case when min(sp) <= 0 or min(sq) <= 0 then 0::double else {clamp01(f'1 - ({part("p")} + {part("q")}) / 2 / ln(2::double)')} end from (select p / (sum(p) over () + 1e-12::double) as p, q / (sum(q) over () + 1e-12::double) as q, sum(p) over () as sp, sum(q) over () as sq from ({each}) e) n)"


def replay(theta: float = 0.125, upper: float = 0.5, bins: int = 25) -> Steps:
    of = lambda cohort: f"select t, n from hist where cohort = '{cohort}'"
    drawn = "select t, n from hist_b where hist_b.b = d.b"
    return {
        "hist": f"select cohort, {_bin('k', theta, upper, bins)} as t, count(*) as n from kin where i < j and k >= {d(theta)} group by all",
        "hist_b": f"select b, {_bin('k', theta, upper, bins)} as t, sum(w) as n from kin_b where k >= {d(theta)} group by all",
        "m_b": f"select d.b, {similarity(drawn, of('SYN'))} as m from (select distinct b from mult) d",
        "replay": f"select obs, base, sd, {excess('obs', 'base')} as r_replay, n_real_close, n_syn_close from (select {similarity(of('HO'), of('SYN'))} as obs, (select avg(m) from m_b) as base, (select coalesce(stddev_samp(m), 0) from m_b) as sd, coalesce((select sum(n) from hist where cohort = 'HO'), 0)::bigint as n_real_close, coalesce((select sum(n) from hist where cohort = 'SYN'), 0)::bigint as n_syn_close) t",
    }


def value_null(n: int, thetas: tuple[float, ...], theta: float = 0.125, upper: float = 0.5, bins: int = 25) -> Steps:
    """Draws of whole values by their rank."""
    pick = lambda kind, size, have: f"select b.b, s.slot, {Q.draw(f"'v:{kind}:' || b.b || ':' || s.slot")} % {have} as at from {Q.series('b', 0, n - 1)} b cross join (select unnest(range(0, {size})) as slot) s"
    size = lambda cohort: f"(select count(*) from kin where i < j and cohort = '{cohort}')"
    return {
        "place": "select cohort, k, row_number() over (partition by cohort order by k) - 1 as at from kin where i < j",
        "hist": f"select cohort, {_bin('k', theta, upper, bins)} as t, count(*) as n from kin where i < j and k >= {d(theta)} group by all",
        "drawn_r": f"select p.b, v.k from ({pick('replay', size('SYN'), size('SYN'))}) p join place v on v.cohort = 'SYN' and v.at = p.at",
        "drawn_e": f"select p.b, v.k from ({pick('excess', size('SYN'), size('HO'))}) p join place v on v.cohort = 'HO' and v.at = p.at",
        "hist_v": f"select b, {_bin('k', theta, upper, bins)} as t, count(*) as n from drawn_r where k >= {d(theta)} group by all",
        "m_v": f"select d.b, {similarity("select t, n from hist where cohort = 'HO'", 'select t, n from hist_v where hist_v.b = d.b')} as m from {Q.series('b', 0, n - 1)} d",
        "value_null": "select 'replay' as kind, null::double as theta, avg(m) as base from m_v union all " + " union all ".join(f"select 'excess', {d(t)}, avg(f) from (select b, avg((k >= {d(t)})::int) as f from drawn_e group by b)" for t in thetas),
    }


def spectral(squarings: int = 24) -> Steps:
    """``top``: the largest eigenvalue of each cohort by squaring: log top = sum of log trace / 2**step."""
    steps = {"pow_0": "select cohort, i, j, k from kin union all select cohort, j, i, k from kin where i < j"}
    for n in range(squarings + 1):
        steps[f"pow_t{n}"] = f"select cohort, sum(k) as t from pow_{n} where i = j group by cohort"
        if n < squarings:
            steps[f"pow_{n + 1}"] = f"select a.cohort, a.i, b.j, sum(a.k * b.k) / max(t.t) / max(t.t) as k from pow_{n} a join pow_{n} b on b.cohort = a.cohort and b.i = a.j join pow_t{n} t on t.cohort = a.cohort group by a.cohort, a.i, b.j"
    logs = " union all ".join(f"select cohort, ln(t) / {2**n} as l from pow_t{n}" for n in range(squarings + 1))
    return steps | {
        "top": f"select l.cohort, exp(sum(l.l)) as top, max(t.t) as trace from ({logs}) l join pow_t0 t on t.cohort = l.cohort group by l.cohort",
        "spectral_risk": f"select s.cohort as name, s.top / (s.trace + 1e-12::double) as s, h.top / (h.trace + 1e-12::double) as s0, case when s.top / (s.trace + 1e-12::double) <= h.top / (h.trace + 1e-12::double) then 0::double else {clamp01('(s.top / (s.trace + 1e-12::double) - h.top / (h.trace + 1e-12::double)) / (s.top / (s.trace + 1e-12::double) + 1e-12::double)')} end as r_spec from top s cross join top h where h.cohort = 'HO' and s.cohort <> 'HO'",
    }


def haplotype_risk(min_poly: int = 6) -> Steps:
    """Every draw's cells, one by one, with that draw's own usual values."""
    return rel.haplotypes(Q) | {
        "value_b": "select m.b, a.variant_idx, a.dosage, sum(m.c) as n from autosome a join mult m on m.sample_idx = a.sample_idx where a.cohort = 'HO' and a.dosage is not null group by all",
        "usual_b": "select b, variant_idx, dosage, kinds from (select *, row_number() over (partition by b, variant_idx order by n desc, dosage) as rn, count(*) over (partition by b, variant_idx) as kinds from value_b) t where rn = 1",
        "window_b": f"select u.b, w.chrom, w.wid from usual_b u join in_window w on w.variant_idx = u.variant_idx group by all having sum((u.kinds >= 2)::int) >= {min_poly}",
        "cell_b": """select m.b, w.chrom, w.wid, m.sample_idx, m.c, string_agg(coalesce(a.dosage, u.dosage, 0)::int, '|' order by w.c) as code
    from mult m join autosome a on a.sample_idx = m.sample_idx and a.cohort = 'HO' join in_window w on w.variant_idx = a.variant_idx
    join window_b g on g.b = m.b and g.chrom = w.chrom and g.wid = w.wid left join usual_b u on u.b = m.b and u.variant_idx = a.variant_idx group by all""",
        "rate_b": "select b, chrom, wid, sum(n * (n - 1) / 2) / max(total * (total - 1) / 2) as rho from (select b, chrom, wid, code, sum(c)::double as n from cell_b group by all) g cross join (select count(*)::double as total from person) p group by all",
        "null_b": "select avg(c) as c0 from (select m.b, coalesce(avg(r.rho), 0::double) as c from (select distinct b from mult) m left join rate_b r on r.b = m.b group by m.b) t",
        "hap_risk": f"select mean_rho as obs, c0 as base, max_rho as cmax, case when mean_rho <= c0 or max_rho <= c0 + 1e-12::double then 0::double else {clamp01('(mean_rho - c0) / (max_rho - c0 + 1e-12::double)')} end as r_hap from hap_collision cross join null_b where cohort = 'SYN'",
    }


def frequencies(alpha: float) -> Steps:
    p = f"(coalesce(sum(dosage), 0) + {alpha}::double) / (2 * count(dosage) + {2 * alpha}::double)"
    return {"maf": f"select variant_idx, p, case when p > 0.5::double then 1 - p else p end as maf, nobs from (select variant_idx, greatest(1e-12::double, least(1 - 1e-12::double, {p})) as p, count(dosage) as nobs from geno where cohort = 'TR' group by variant_idx) t"}


def burden(maf_limit: float) -> Steps:
    """Every cell meets every feature."""
    return {
        "train_n": "select count(distinct sample_idx) as n from geno where cohort = 'TR'",
        "rare": f"select variant_idx from maf cross join train_n where maf < greatest({maf_limit}::double, 0.5::double / greatest(n, 1))",
        "burden": """select g.cohort, g.sample_idx, f.feature, sum(case when r.variant_idx is not null and (f.feature = 'global' or f.feature = g.chrom) then coalesce(g.dosage, 0) else 0 end)::double as value
    from geno g cross join (select 'global' as feature union all select distinct chrom from geno where try_cast(chrom as int) between 1 and 22) f left join rare r on r.variant_idx = g.variant_idx group by g.cohort, g.sample_idx, f.feature""",
    }


def membership() -> Steps:
    """Whole burdens, every real sample against every synthetic one; the AUC as the share of pairs won, ties half."""
    return {
        "whole": "select cohort, sample_idx, list(value order by feature) as v from burden group by all",
        "l1": "select a.cohort, a.sample_idx, min(list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))) as dist from whole a cross join whole b where a.cohort in ('TR', 'HO') and b.cohort = 'SYN' group by all",
        "mia": f"select auc, {clamp01('2 * (auc - 0.5::double)')} as r_mia from (select avg(case when t.dist < h.dist then 1::double when t.dist = h.dist then 0.5::double else 0::double end) as auc from l1 t cross join l1 h where t.cohort = 'TR' and h.cohort = 'HO') a",
    }


def unique_carriers(maf_limit: float) -> Steps:
    return {
        "chosen": f"select m.variant_idx, 1 - (1 - m.p) ** 2 as qq from maf m semi join rare r on r.variant_idx = m.variant_idx cross join train_n t where m.nobs >= greatest(1, floor(0.8::double * t.n)) and m.maf < greatest({maf_limit}::double, 0.5::double / greatest(m.nobs, 1))",
        "seen": "select c.variant_idx, c.qq, list_filter(list(g.dosage), lambda x: x is not null) as calls from chosen c join geno g on g.variant_idx = c.variant_idx where g.cohort = 'SYN' group by all",
        "uniq": f"select n_used, u, u0, {excess('u', 'u0')} as r_uniq from (select count(*) as n_used, coalesce(avg((len(list_filter(calls, lambda x: x > 0)) >= 2)::int::double), 0::double) as u, coalesce(avg(1 - (1 - qq) ** len(calls) - len(calls) * qq * (1 - qq) ** (len(calls) - 1)), 0::double) as u0 from seen where len(calls) >= 2) t",
    }


def proximity(quantile: float = 0.01) -> Steps:
    return {"pli": f"select rho, {clamp01('1 - rho')} as r_p, a, greatest(0::double, 0.5::double - a) / 0.5::double as r_a, greatest({clamp01('1 - rho')}, greatest(0::double, 0.5::double - a) / 0.5::double) as pli from (select quantile_cont(d_syn, {quantile}) / greatest(quantile_cont(d_real, {quantile}), 1e-12::double) as rho, avg((d_real < d_syn)::int::double) as a from dist) t"}


def components(names: tuple[str, ...], n_draws: int, thetas: tuple[float, ...], alpha: float, maf_limit: float) -> Steps:
    """``scores`` from ``cohorts``: the three indices of each synthetic cohort, one after the other."""
    role = {"SAFE": "safe anchor", "LEAKY": "leaky anchor"}
    whole = {"std_all": standardised()["std"].replace("from geno g", "from cohorts g"), "kin_all": pairs()["kin"].replace("std a", "std_all a").replace("join std b", "join std_all b").replace("from std)", "from std_all)")}
    whole = {"frequency": standardised()["frequency"].replace("from geno", "from cohorts")} | whole
    powers = {n: s.replace("from kin ", "from kin_all ") for n, s in spectral().items()}
    powers["pow_0"] = "select cohort, i, j, k from kin_all union all select cohort, j, i, k from kin_all where i < j"
    parts = []
    for ord_, name in enumerate(sorted(names), 1):
        steps = {
            "geno": f"select case when cohort = '{name}' then 'SYN' else cohort end as cohort, sample_idx, variant_idx, chrom, pos, dosage from cohorts where cohort in ('TR', 'HO', '{name}')",
            "std": f"select case when cohort = '{name}' then 'SYN' else cohort end as cohort, sample_idx, variant_idx, x from std_all where cohort in ('TR', 'HO', '{name}')",
            "part": f"select case when cohort = '{name}' then 'SYN' else cohort end as cohort, sample_idx, variant_idx, x from part_all where cohort in ('HO', '{name}')",
            "kin": f"select case when cohort = '{name}' then 'SYN' else cohort end as cohort, i, j, k from kin_all where cohort in ('HO', '{name}')",
        } | distances() | proximity() | draws(n_draws) | kinship_excess(thetas) | replay() | haplotype_risk() | frequencies(alpha) | burden(maf_limit) | membership() | unique_carriers(maf_limit)
        told = f"""select '{name}' as name, '{role.get(name, 'candidate')}' as role, {ord_} as ord, round(pli, 6) as pli, round(greatest(r_replay, r_ike, r_hap, r_spec), 6) as kri, round(greatest(r_mia, r_uniq), 6) as tli
        from pli cross join replay cross join (select max(r) as r_ike from ike) i cross join hap_risk cross join (select r_spec from spectral_risk where name = '{name}') s cross join mia cross join uniq"""
        parts.append(f"select * from ({chain(steps, told)}) x_{name}")
    parts_of = {"part_all" if n == "part" else n: text for n, text in components_of("std_all").items()}
    return whole | powers | parts_of | {"scores": " union all ".join(parts)}
