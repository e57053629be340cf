"""Queries of the subpackage, over whole tables, with their SQL where SQL can say it."""

from pyspark.sql import functions as F

from driftline.llm.bpe import encode
from driftline.llm.canonical import CYCLES, SPACES, UNMATCHED, canonical, canonical_by_part, readings
from driftline.llm.components import components, star_edges
from driftline.llm.mixing import mixture
from driftline.llm.percentiles import combine, keep, kept, percentiles, summarise
from driftline.runtime import new_path, table, written

PERMILLE = list(range(10, 1000, 10))
CATALOGUE = ("principal_desig", "number", "name", "other_desigs")


def _night_summary(spark, sf_dir):
    return summarise(table(spark, sf_dir, "alerts", "nid", "fid", "magpsf"), ["nid", "fid"], "magpsf")


def p1_percentiles(spark, sf_dir):
    """Percentiles of each night and filter, and of each filter over all nights (scope ``all``): alerts are read once."""
    nights = written(_night_summary(spark, sf_dir), "nights").df
    whole = combine([nights], ["fid"]).withColumn("nid", F.lit(None).cast("int"))
    both = nights.withColumn("scope", F.lit("night")).unionByName(whole.withColumn("scope", F.lit("all")))
    return percentiles(both, ["scope", "nid", "fid"], PERMILLE)


def p1_merged(spark, sf_dir):
    """Quartiles per filter and 30 nights, from stored summaries of odd and even nights combined."""
    nights, folder = _night_summary(spark, sf_dir).withColumn("period", F.floor(F.col("nid") / 30).cast("int")), new_path(spark, "summaries")
    for k in (0, 1):
        keep(nights.where(F.col("nid") % 2 == k).drop("nid"), folder, str(k))
    return percentiles(combine(kept(spark, folder, ["0", "1"]), ["period", "fid"]), ["period", "fid"], [250, 500, 750])


def p4_found(spark, sf_dir):
    alerts = table(spark, sf_dir, "alerts", "ssnamenr", "obs_month")
    return canonical_by_part(alerts, "ssnamenr", "obs_month", table(spark, sf_dir, "mpcorb_extended"), *CATALOGUE)


def p4_exact(spark, sf_dir):
    """Of the values that are a number or a designation and nothing else, the entry each denotes: never a look-alike."""
    values = table(spark, sf_dir, "alerts", "ssnamenr").where("ssnamenr is not null").distinct()
    plain = values.where(F.element_at(readings(F.col("ssnamenr")), 1)[0].rlike("^[nd]:") & (F.size(F.element_at(readings(F.col("ssnamenr")), 1)) == 1))
    found = canonical(plain, "ssnamenr", table(spark, sf_dir, "mpcorb_extended"), *CATALOGUE)
    return found.select(F.col("value").alias("ssnamenr"), F.col("entry").alias("principal_desig"))


def p4_unmatched(spark, sf_dir):
    """Values without an entry, with the alerts that have them."""
    alerts = table(spark, sf_dir, "alerts", "ssnamenr").where(F.col("ssnamenr").isNotNull())
    counts = alerts.groupBy("ssnamenr").agg(F.count(F.lit(1)).alias("n_rows"))
    found = canonical(counts, "ssnamenr", table(spark, sf_dir, "mpcorb_extended"), *CATALOGUE).where(F.col("entry") == UNMATCHED)
    return counts.join(found.select(F.col("value").alias("ssnamenr")), "ssnamenr")


def p6_found(spark, sf_dir):
    trajectories = table(spark, sf_dir, "trajectories", "trajectory_id", "candid").where("trajectory_id <> -1 and candid is not null")
    pairs = table(spark, sf_dir, "path_edges", "left_candid", "right_candid")
    edges = star_edges(trajectories, "trajectory_id", "candid").unionByName(pairs.select(F.col("left_candid").alias("u"), F.col("right_candid").alias("v")))
    return components(edges).select(F.col("item").alias("candid"), F.col("group_id").alias("group_candid"))


def p7_ids(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _mixed(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mixture(documents, "doc_id", "source", "text", table(spark, sf_dir, "mix_targets"))


def p8_mixture(spark, sf_dir):
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark, sf_dir):
    return _mixed(spark, sf_dir)[1]


QUERIES = {
    "p1_percentiles": p1_percentiles,
    "p1_merged": p1_merged,
    "p4_found": p4_found,
    "p4_exact": p4_exact,
    "p4_unmatched": p4_unmatched,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
}


def _percentile_sql(source: str, groups: str, permille: str) -> str:
    return f"""
with v as ({source}),
 c as (select {groups}, bin, count(*) as n from v group by {groups}, bin),
 r as (select *, sum(n) over (partition by {groups} order by bin rows unbounded preceding) as upto,
              sum(n) over (partition by {groups}) as n_values from c),
 q as (select unnest({permille}) as permille)
select {groups}, cast(permille as int) as permille, cast(n_values as bigint) as n_values, bin as value, 0.00005::double as max_error
from r join q on upto - n < greatest(1, (permille * n_values + 999) // 1000) and greatest(1, (permille * n_values + 999) // 1000) <= upto
"""


_NUMBER = "ltrim(regexp_replace(replace(regexp_replace({0}, '\\.0+$', ''), 'O', '0'), '[^0-9]', '', 'g'), '0')"


def _designated(x: str) -> str:
    t = f"upper(regexp_replace({x}, '[\\s_\\-]', '', 'g'))"
    return f"replace(substr({t}, 1, 4), 'O', '0') || substr({t}, 5, 2) || ltrim(replace(substr({t}, 7), 'O', '0'), '0')"


_BINNED = "case when abs(magpsf * 10000.0::double) < 1099511627776 then round(magpsf * 10000.0::double) / 10000.0::double else magpsf end as bin from alerts where magpsf is not null and not isnan(magpsf)"

SQL = {
    "p1_percentiles": _percentile_sql(
        f"select 'night' as scope, nid, fid, {_BINNED} union all select 'all', cast(null as int), fid, {_BINNED}", "scope, nid, fid", "range(10, 1000, 10)"
    ),
    "p1_merged": _percentile_sql(f"select cast(nid // 30 as int) as period, fid, {_BINNED} and nid is not null", "period, fid", "[250, 500, 750]"),
    "p4_exact": f"""
with v as (select distinct ssnamenr, trim(regexp_replace(translate(ssnamenr, '{SPACES}', '{' ' * len(SPACES)}'), ' +', ' ', 'g')) as v from alerts where ssnamenr is not null),
 k as (select ssnamenr, v, case
    when regexp_matches(v, '^(?:[Nn]o\\.? ?|#)?\\(?[\\dO]+(?:,[\\dO]{{3}})*\\)?(?:\\.0+)?$') then nullif('n:' || {_NUMBER.format('v')}, 'n:')
    when regexp_matches(v, '^[12][\\dO]{{3}}[\\s_\\-]*[A-Za-z]{{2}}[\\s_\\-]*[\\dO]*$') then 'd:' || {_designated('v')}
    when regexp_matches(v, '^[IJK]\\d\\d[A-Z][0-9A-Za-z]\\d[A-Z]$') then 'd:' || (17 + instr('IJK', substr(v, 1, 1))) || substr(v, 2, 3) || substr(v, 7, 1)
      || coalesce(nullif(cast((instr('{CYCLES}', substr(v, 5, 1)) - 1) * 10 + cast(substr(v, 6, 1) as int) as varchar), '0'), '') end as token from v),
 c as (select principal_desig, 'n:' || {_NUMBER.format('number')} as token from mpcorb_extended where number is not null
   union select principal_desig, 'd:' || {_designated('d')} from (select principal_desig, unnest(list_append(coalesce(other_desigs, []), principal_desig)) as d from mpcorb_extended) where d is not null)
select k.ssnamenr, coalesce(min(c.principal_desig), 'UNMATCHED') as principal_desig from k left join c using (token) where token is not null group by 1
""",
    "p6_found": """
with recursive links as (
  select distinct u, v from (
    select left_candid as u, right_candid as v from path_edges
    union all select right_candid, left_candid from path_edges
    union all (select m, candid from (select candid, min(candid) over (partition by trajectory_id) as m from trajectories where trajectory_id is not null and trajectory_id <> -1))
    union all (select candid, m from (select candid, min(candid) over (partition by trajectory_id) as m from trajectories where trajectory_id is not null and trajectory_id <> -1)))
  where u <> v and u is not null and v is not null),
 reach(candid, lab) as (
  select distinct u, u from links
  union select l.v, r.lab from reach r join links l on l.u = r.candid where r.lab < l.v)
select candid, min(lab) as group_candid from reach group by candid
""",
}


def _scored(spark, sf_dir):
    from driftline.llm.toxicity import fit, score

    documents = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    model, cut = fit(documents, table(spark, sf_dir, "doc_labels", "doc_id", "toxic"))
    return score(documents, ["doc_id", "source"], "text", model), cut


def p9_found(spark, sf_dir):
    scored, cut = _scored(spark, sf_dir)
    return scored.where(F.col("score") >= cut).select("doc_id")


def p9_rates(spark, sf_dir):
    """Documents, cases and their share per source; documents without a source are a source of their own."""
    scored, cut = _scored(spark, sf_dir)
    found = (F.col("score") >= cut).cast("int")
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(found).alias("n_found"), F.avg(found).alias("rate"), F.avg("score").alias("mean_score"))


QUERIES |= {"p9_found": p9_found, "p9_rates": p9_rates}
