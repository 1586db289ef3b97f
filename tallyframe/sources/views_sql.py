"""The domain views once more, as SQL for the comparison engine. Written apart from the Spark plans."""

from __future__ import annotations

from .tables import AMOUNT_RANGES

_CASES = " ".join(f"when a >= {lo}" + (f" and a <= {hi}" if hi else "") + f" then '{label}'" for label, lo, hi in AMOUNT_RANGES)
_LOW = " ".join(f"when amount_range = '{label}' then {lo}" for label, lo, _ in AMOUNT_RANGES)
_HIGH = " ".join(f"when amount_range = '{label}' then {hi}" for label, _, hi in AMOUNT_RANGES if hi)

VIEWS: dict[str, tuple[str, str]] = {
    "price_points": ("", """
      select symbol, date, round(sum(cast(px as decimal(18,4))) over w::double / count(*) over w, 6) as close from (
        select n_name as symbol, cast(o_orderdate as date) as date, sum(cast(o_totalprice as decimal(18,2)))::double / count(*) as px
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2)
      window w as (partition by symbol order by date rows between 19 preceding and current row)"""),
    "daily_points": ("", """
      select event_type as symbol, cast(ts as date) as date, arg_max(value, {'a': ts, 'b': event_id}) as close from events group by 1, 2"""),
    "models": ("", "select c_mktsegment as model_key, row_number() over (order by c_mktsegment) as risk_rank from customer group by c_mktsegment"),
    "version_holdings": ("", """
      select model_key, effective_date, instrument, round(rev::double / (sum(rev) over (partition by model_key, effective_date))::double, 6) as weight from (
        select * from (
          select c_mktsegment as model_key, cast(date_trunc('year', o_orderdate) as date) as effective_date, n_name as instrument, sum(cast(l_extendedprice as decimal(18,2))) as rev
          from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3)
        qualify row_number() over (partition by model_key, effective_date order by rev desc, instrument) <= 10)"""),
    "versions": ("version_holdings", "select distinct model_key, effective_date from version_holdings"),
    "filings": ("", """
      select o_orderkey as filing_id, o_custkey as person_key, c_name as person_name,
        case n_regionkey when 0 then 'house' when 1 then 'senate' when 2 then 'president' when 3 then 'vice-president' else 'house' end as office,
        substr('DRI', cast(n_nationkey % 3 + 1 as int), 1) as party,
        case o_orderpriority when '5-LOW' then 'candidate' when '1-URGENT' then null else 'member' end as filer_status,
        greatest(cast(o_orderdate as date), last_ship) as filed_date,
        case o_orderstatus when 'F' then 'parsed' when 'O' then 'partial' else 'needs_manual_review' end as parse_status
      from orders left join (select l_orderkey, cast(max(l_shipdate) as date) as last_ship from lineitem group by 1) on o_orderkey = l_orderkey
        join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""),
    "trades": ("filings", f"""
      select filing_id, row_index, person_key, person_name, office, party, filer_status, ticker, asset_class, tx_type, tx_date, filed_date as disclosed_date, case {_CASES} end as amount_range
      from (select f.*, l.row_index, case when p_size > 5 then p_brand || '-' || p_type end as ticker,
              case when p_size % 7 = 0 then 'option' when p_size % 5 = 0 then 'etf' when p_size % 11 = 0 then 'bond' else 'stock' end as asset_class,
              case l_returnflag when 'A' then 'buy' when 'R' then 'sell' else 'exchange' end as tx_type,
              least(cast(l_shipdate as date), filed_date) as tx_date, floor(l_extendedprice * l_quantity * l_quantity / 2) as a
            from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as row_index from lineitem) l
              join part on l_partkey = p_partkey join filings f on l_orderkey = filing_id)"""),
    "bounded": ("trades", f"select *, case {_LOW} end as low, case {_HIGH} end as high from trades"),
}


def with_views(names: list[str], body: str) -> str:
    """The body after the views that it names, their own views first."""
    done: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS[name][0].split():
            add(other)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    if not done:
        return body
    return "with " + ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in done) + ("\n" + body if not body.lstrip().startswith("with ") else ",\n" + body.lstrip()[5:])
