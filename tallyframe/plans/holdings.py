"""Queries on model books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import holdings as h
from ..operators import writes
from ..sources.kept import kept
from ..sources.tables import Tables
from .registry import query

LATEST = "cur as (select model_key, instrument, weight from version_holdings join (select model_key, max(effective_date) as effective_date from version_holdings group by 1) using (model_key, effective_date))"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
MER = "mer as (select n_name as instrument, case when n_nationkey % 4 = 3 then null else n_nationkey / 10.0::double end as mer, r_name as region from nation join region on n_regionkey = r_regionkey)"


def current(t: Tables) -> DataFrame:
    """Each model's last version: one pass over the versions, written once for all parts of a query."""
    if "current" not in t.__dict__:
        last = F.max("effective_date").over(Window.partitionBy("model_key"))
        x = t.version_holdings.withColumn("last", last).where("effective_date = last").select("model_key", "instrument", "weight")
        t.__dict__["current"] = kept(x, "current")
    return t.__dict__["current"]


def instruments(t: Tables) -> DataFrame:
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_name").alias("instrument"), F.when(F.col("n_nationkey") % 4 != 3, F.col("n_nationkey") / F.lit(10.0)).alias("mer"), F.col("r_name").alias("region"))


def segments(t: Tables) -> list[str]:
    """All models, a column each in the pivot: a name for each, not a row of a holding, comes to the driver."""
    return [r["model_key"] for r in t.models.select("model_key").orderBy("model_key").collect()]


@query("joi13_model_pairs", f"""with {LATEST}, p as (select a.model_key as a, b.model_key as b, b.risk_rank = a.risk_rank + 1 as adjacent from models a join models b on a.risk_rank < b.risk_rank),
o as (select x.model_key as a, y.model_key as b, sum(least(x.weight, y.weight)) as overlap, count(*) as shared from cur x join cur y using (instrument) group by 1, 2)
select p.a, p.b, round(coalesce(overlap, 0), 8) as overlap, coalesce(shared, 0) as shared, adjacent from p left join o on p.a = o.a and p.b = o.b""", "models version_holdings")
def _(t: Tables) -> DataFrame:
    return h.overlap(current(t), t.models).withColumn("overlap", F.round("overlap", 8))


@query("agg22_unique_shared", f"with {LATEST}, n as (select *, count(*) over (partition by instrument) as n from cur) select model_key, round(coalesce(sum(weight) filter (n = 1), 0), 8) as unique_weight, round(coalesce(sum(weight) filter (n > 1), 0), 8) as shared_weight from n group by 1", "version_holdings")
def _(t: Tables) -> DataFrame:
    return h.shared_weight(current(t)).select("model_key", F.round("unique_weight", 8).alias("unique_weight"), F.round("shared_weight", 8).alias("shared_weight"))


@query("agg23_universe_pivot", f"with {LATEST} select instrument, " + ", ".join(f"sum(weight) filter (model_key = '{m}') as {m}" for m in SEGMENTS) + ", count(*) as models, max(weight) as max_weight from cur group by 1", "version_holdings")
def _(t: Tables) -> DataFrame:
    return h.universe(current(t), segments(t))


@query("agg16_blended_mer", f"with {LATEST}, {MER} select model_key, round(sum(weight * mer) / sum(weight) filter (mer is not null), 8) as mer, round(coalesce(sum(weight) filter (mer is not null), 0) / sum(weight), 8) as known from cur join mer using (instrument) group by 1", "version_holdings")
def _(t: Tables) -> DataFrame:
    mean, known = h.weighted_mean(F.col("mer"), F.col("weight"))
    return current(t).join(instruments(t), "instrument").groupBy("model_key").agg(F.round(mean, 8).alias("mer"), F.round(known, 8).alias("known"))


@query("agg18_weight_by_region", f"with {LATEST}, {MER} select model_key, coalesce(region, 'Unclassified') as region, round(sum(weight), 8) as weight from cur left join mer using (instrument) group by 1, 2", "version_holdings")
def _(t: Tables) -> DataFrame:
    return current(t).join(instruments(t), "instrument", "left").groupBy("model_key", F.coalesce("region", F.lit("Unclassified")).alias("region")).agg(F.round(F.sum("weight"), 8).alias("weight"))


@query("agg19_look_through", f"""with {LATEST}, b as (select n_name as instrument, c_mktsegment as label, sum(cast(c_acctbal as decimal(18,2)))::double as share from customer join nation on c_nationkey = n_nationkey where n_nationkey % 3 <> 0 and c_acctbal > 0 group by 1, 2),
q as (select instrument, label, share / sum(share) over (partition by instrument) as part from b)
select model_key, coalesce(label, case when n_regionkey = 1 then r_name end, 'Unclassified') as label, round(sum(weight * coalesce(part, 1)), 8) as weight
from cur join nation on n_name = instrument join region on r_regionkey = n_regionkey left join q using (instrument) group by 1, 2""", "version_holdings")
def _(t: Tables) -> DataFrame:
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    b = t.customer.where("c_acctbal > 0").join(t.nation.where("n_nationkey % 3 <> 0"), F.col("c_nationkey") == F.col("n_nationkey"))
    b = b.groupBy(F.col("n_name").alias("instrument"), F.col("c_mktsegment").alias("label")).agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("share"))
    held = current(t).join(n.select(F.col("n_name").alias("instrument"), F.when(F.col("n_regionkey") == 1, F.col("r_name")).alias("bucket")), "instrument")
    return h.look_through(held, b).withColumn("weight", F.round("weight", 8))


@query("win09_percent_slices", f"""with {LATEST}, p as (select *, round(weight * 1000 / sum(weight) over (partition by model_key))::bigint as p from cur),
q as (select *, 1000 - sum(p) over (partition by model_key) as rest, row_number() over (partition by model_key order by weight desc, instrument) as k from p)
select model_key, instrument, (p + case when k = 1 then rest else 0 end) / 10.0::double as pct from q""", "version_holdings")
def _(t: Tables) -> DataFrame:
    return h.percent_slices(current(t), ["model_key"], "weight", "instrument").select("model_key", "instrument", "pct")


@query("win19_largest_remainder", f"""with {LATEST}, x as (select *, weight * 100 / sum(weight) over (partition by model_key) as x from cur), f as (select *, floor(round(x, 9))::bigint as f from x),
g as (select *, 100 - sum(f) over (partition by model_key) as short, row_number() over (partition by model_key order by round(x - f, 9) desc, instrument) as k from f)
select model_key, instrument, (f + case when k <= short then 1 else 0 end)::bigint as units from g""", "version_holdings")
def _(t: Tables) -> DataFrame:
    return h.largest_remainder(current(t), ["model_key"], "weight", 100, "instrument").select("model_key", "instrument", "units")


#: Books to fund: cash in two of them at most, one at 97 %, one within half a percent of the whole, one with hardly any cash.
BOOKS = f"""{LATEST}, book as (select model_key, instrument, weight * case model_key when 'BUILDING' then 0.97 when 'FURNITURE' then 0.997 else 1 end::double * case when model_key = 'MACHINERY' and instrument in ('BRAZIL', 'CHINA') then 0.001 else 1 end::double as weight,
  instrument in ('BRAZIL', 'CHINA') and model_key <> 'HOUSEHOLD' as cash from cur)"""


def books(t: Tables, share: float) -> tuple[DataFrame, float, Column]:
    cash = F.col("instrument").isin("BRAZIL", "CHINA")
    part = F.when(F.col("model_key") == "BUILDING", 0.97).when(F.col("model_key") == "FURNITURE", 0.997).otherwise(1.0) * F.when((F.col("model_key") == "MACHINERY") & cash, 0.001).otherwise(1.0)
    return current(t).withColumn("weight", F.col("weight") * part), share, cash & (F.col("model_key") != "HOUSEHOLD")


@query("fin27_fund_new_holding", f"""with {BOOKS}, a as (select model_key, sum(weight) as s, sum(weight) filter (not cash) as nc, sum(weight) filter (cash) as c, count(*) filter (cash) as n from book group by 1),
r as (select b.model_key, instrument, case when n = 0 or nc is null or 0.95::double - 0.95::double * nc < -1e-8 then weight * 0.95::double / s when cash then weight / c * (0.95::double - 0.95::double * nc) else weight * 0.95::double end as weight from book b join a using (model_key)),
x as (select *, weight * 9500 / sum(weight) over (partition by model_key) as x from r), f as (select *, floor(round(x, 9))::bigint as f from x),
g as (select *, 9500 - sum(f) over (partition by model_key) as short, row_number() over (partition by model_key order by round(x - f, 9) desc, instrument) as k from f)
select model_key, instrument, (f + case when k <= short then 1 else 0 end) / 10000.0::double as weight, true as can_add from g union all select distinct model_key, 'NEW', 0.05::double, true from book""", "version_holdings")
def _(t: Tables) -> DataFrame:
    return h.fund_proportional(*books(t, 0.05))


@query("fin27_from_cash", f"""with {BOOKS}, u as (select *, round(weight * 10000)::bigint as u, min(instrument) filter (cash) over (partition by model_key) as giver, sum(round(weight * 10000)::bigint) over (partition by model_key) as total from book),
m as (select *, max(u - 500) filter (instrument = giver) over (partition by model_key) as after, sum(u) filter (instrument is distinct from giver) over (partition by model_key) as others from u),
r as (select model_key, instrument, case when giver is null then weight when instrument = giver then (case when after >= 0 and abs(total - 10000) <= 50 and others <= 9500 then 9500 - others else after end) / 10000.0::double else u / 10000.0::double end as weight, coalesce(after >= 0, false) as can_add from m)
select * from r union all select distinct model_key, 'NEW', 0.05::double, can_add from r""", "version_holdings")
def _(t: Tables) -> DataFrame:
    return h.fund_from_cash(*books(t, 0.05))


@query("fin27_manual", f"with {BOOKS} select model_key, instrument, weight, true as can_add from book union all select distinct model_key, 'NEW', 0.05::double, true from book", "version_holdings")
def _(t: Tables) -> DataFrame:
    return h.fund_manual(*books(t, 0.05)[:2])


@query("win18_tie_slices", """with recursive i as (select o_orderpriority as grp, n_name as item, count(*) as amount from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2),
k as (select grp, amount, count(*) as size, row_number() over (partition by grp order by amount desc) as rk from i group by 1, 2),
q as (select grp, rk, amount, case when size <= 12 or size <= 16 then 'item' else 'group' end as kind, case when size <= 16 then size else 1 end as used from k where rk = 1
  union all select k.grp, k.rk, k.amount, case when q.used >= 12 then 'other' when k.size <= 12 - q.used or q.used + k.size <= 16 then 'item' else 'group' end,
    q.used + case when q.used >= 12 then 0 when k.size <= 12 - q.used or q.used + k.size <= 16 then k.size else 1 end from q join k on k.grp = q.grp and k.rk = q.rk + 1)
select i.grp, case q.kind when 'item' then item when 'group' then 'Equal at ' || i.amount else 'Other' end as slice, count(*) as n, sum(i.amount)::bigint as total from i join q on q.grp = i.grp and q.amount = i.amount group by 1, 2""")
def _(t: Tables) -> DataFrame:
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    x = x.groupBy(F.col("o_orderpriority").alias("grp"), F.col("n_name").alias("item")).agg(F.count("*").alias("amount"))
    return h.tie_slices(x, ["grp"], "amount")


@query("win15_ladder_neighbours", "select model_key, lag(model_key) over (order by risk_rank) as safer, lead(model_key) over (order by risk_rank) as bolder from models", "models")
def _(t: Tables) -> DataFrame:
    w = Window.orderBy("risk_rank")
    return t.models.select("model_key", F.lag("model_key").over(w).alias("safer"), F.lead("model_key").over(w).alias("bolder"))


@query("joi01_held_instruments", f"with {LATEST}, {MER} select m.model_key, risk_rank, instrument, weight, region from cur c join models m on m.model_key = c.model_key join mer using (instrument)", "models version_holdings")
def _(t: Tables) -> DataFrame:
    return current(t).join(t.models, "model_key").join(instruments(t), "instrument").select("model_key", "risk_rank", "instrument", "weight", "region")


@query("joi16_held_by", f"with {LATEST} select instrument, count(*) as models, list(model_key order by model_key) as held_by from cur group by 1", "version_holdings")
def _(t: Tables) -> DataFrame:
    return current(t).groupBy("instrument").agg(F.count("*").alias("models"), F.array_sort(F.collect_list("model_key")).alias("held_by"))


@query("snk07_version_changed", """with p as (select *, lag(effective_date) over (partition by model_key order by effective_date) as prior from versions),
x as (select p.model_key, p.effective_date, h.instrument, h.weight as wa, 0::double as wb from p join version_holdings h on h.model_key = p.model_key and h.effective_date = p.effective_date where prior is not null
 union all select p.model_key, p.effective_date, h.instrument, 0, h.weight from p join version_holdings h on h.model_key = p.model_key and h.effective_date = p.prior),
s as (select model_key, effective_date, instrument, sum(wa) - sum(wb) as diff from x group by 1, 2, 3)
select model_key || ' ' || effective_date::varchar as key, bool_and(abs(diff) <= 1e-6) as same from s group by 1""", "versions version_holdings")
def _(t: Tables) -> DataFrame:
    prior = t.versions.withColumn("prior", F.lag("effective_date").over(Window.partitionBy("model_key").orderBy("effective_date"))).where("prior is not null")
    key = F.concat_ws(" ", "model_key", F.col("effective_date").cast("string")).alias("key")
    a = prior.join(t.version_holdings, ["model_key", "effective_date"]).select(key, "instrument", "weight")
    old = t.version_holdings.withColumnRenamed("effective_date", "prior")
    b = prior.join(old, ["model_key", "prior"]).select(key, "instrument", "weight")
    return h.same_holdings(a, b)


@query("agg21_growth_split", f"with {LATEST}, {MER} select model_key, round(coalesce(sum(weight) filter (region in ('ASIA', 'EUROPE')), 0), 8) as growth, round(coalesce(sum(weight) filter (region not in ('ASIA', 'EUROPE')), 0), 8) as income from cur join mer using (instrument) group by 1", "version_holdings")
def _(t: Tables) -> DataFrame:
    x = current(t).join(instruments(t), "instrument")
    part = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0.0)), 8)
    grows = F.col("region").isin("ASIA", "EUROPE")
    return x.groupBy("model_key").agg(part(grows).alias("growth"), part(~grows).alias("income"))


@query("agg24_consolidate", "select l_orderkey, l_partkey, sum(cast(l_quantity as decimal(18,2)))::double as quantity from lineitem group by 1, 2")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


@query("agg26_class_slices", """with g as (select p_type as class, count(*) as n, sum(l_quantity)::bigint as total from lineitem join part on l_partkey = p_partkey group by 1), p as (select *, round(total * 1000.0::double / sum(total) over ())::bigint as p from g),
q as (select *, 1000 - sum(p) over () as rest, row_number() over (order by total desc, class) as k from p) select class, n, total, (p + case when k = 1 then rest else 0 end) / 10.0::double as pct from q""")
def _(t: Tables) -> DataFrame:
    g = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("class")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("total"))
    return h.percent_slices(g, [], "total", "class")


@query("snk07_appended_versions", f"""with {LATEST}, d as (select model_key, max(effective_date) as day from version_holdings group by 1),
i as (select model_key as key, case model_key when 'FURNITURE' then day when 'MACHINERY' then day - 400 else day + 30 end as effective_date, instrument, case when model_key in ('BUILDING', 'FURNITURE', 'MACHINERY') and instrument = (select min(instrument) from cur c where c.model_key = cur.model_key) then weight + 0.001 else weight end as weight from cur join d using (model_key)
  union all select 'NEW', date '1999-01-01', 'X', 1.0::double) select * from i where key in ('BUILDING', 'NEW')""", "version_holdings")
def _(t: Tables) -> DataFrame:
    """A changed version, equal ones, changed ones of a stored day and of an earlier one, and one of a new model."""
    stored = t.version_holdings.withColumnRenamed("model_key", "key")
    w = Window.partitionBy("model_key")
    day = t.version_holdings.groupBy("model_key").agg(F.max("effective_date").alias("day"))
    x = current(t).join(day, "model_key").withColumn("first", F.min("instrument").over(w) == F.col("instrument"))
    date = F.when(F.col("model_key") == "FURNITURE", F.col("day")).when(F.col("model_key") == "MACHINERY", F.date_sub("day", 400)).otherwise(F.date_add("day", 30))
    moved = F.col("model_key").isin("BUILDING", "FURNITURE", "MACHINERY") & F.col("first")
    incoming = x.select(F.col("model_key").alias("key"), date.alias("effective_date"), "instrument", (F.col("weight") + F.when(moved, 0.001).otherwise(0.0)).alias("weight"))
    new = t.spark.sql("select 'NEW' as key, date '1999-01-01' as effective_date, 'X' as instrument, double(1) as weight")
    return writes.append_versions(stored, incoming.unionByName(new))
