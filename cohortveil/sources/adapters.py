"""Genotype tables made from the star schema: the same rows in Spark and DuckDB."""

from __future__ import annotations

from ..functions.dialect import Dialect, d

#: Columns of every genotype relation: cohort, sample_idx, variant_idx, chrom, pos, dosage (NULL: missing).


def from_embeddings(q: Dialect) -> str:
    """A vector is a sample, a dimension a variant; cohort by id (three fifths TR, then HO, SYN).

    Every eighth variant is rare; one cell in 53 is missing.
    """
    items = "select vec_id, posexplode(embedding) as (j, v) from embeddings" if q.spark else "select vec_id, unnest(range(0, len(embedding))) as j, unnest(embedding) as v from embeddings"
    return f"""select case when vec_id % 5 <= 2 then 'TR' when vec_id % 5 = 3 then 'HO' else 'SYN' end as cohort,
      vec_id as sample_idx, cast(j as int) as variant_idx, {q.text("1 + " + q.int_div("j", "16"))} as chrom, cast(j as int) as pos,
      case when (vec_id * 7 + j) % 53 = 0 then null
           when j % 8 = 7 then (case when v > {d(0.33)} then {d(1.0)} else {d(0.0)} end)
           when v < {d(-0.1)} then {d(0.0)} when v < {d(0.1)} then {d(1.0)} else {d(2.0)} end as dosage
    from ({items}) t"""


def from_events(q: Dialect) -> str:
    """A user is a sample, (event type, k) a variant; dosage is the number of events, at most 2."""
    k = "cast(get_json_object(props, '$.k') as int)" if q.spark else "cast(json_extract_string(props, '$.k') as int)"
    return f"""select case when s.user_id % 5 <= 2 then 'TR' when s.user_id % 5 = 3 then 'HO' else 'SYN' end as cohort,
      s.user_id as sample_idx, v.variant_idx, v.chrom, v.pos, cast(least(coalesce(c.n, 0), 2) as double) as dosage
    from (select distinct user_id from events) s
    cross join (select event_type, k, cast(dense_rank() over (order by event_type, k) - 1 as int) as variant_idx, {q.text("dense_rank() over (order by event_type)")} as chrom, k as pos
                from (select distinct event_type, {k} as k from events) x) v
    left join (select user_id, event_type, {k} as k, count(*) as n from events group by 1, 2, 3) c
      on c.user_id = s.user_id and c.event_type = v.event_type and c.k = v.k"""
