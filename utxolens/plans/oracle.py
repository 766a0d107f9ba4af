"""The same datasets as SQL text over the driver's tables."""

from __future__ import annotations

from utxolens.plans import catalog

# The derived ledger, one common table expression per table.
LEDGER = r"""
tx as (
  select o_orderkey as id, 'tx' || md5(cast(o_orderkey as varchar)) as hash,
         cast(floor(o_orderkey / 8) as bigint) as block_id,
         cast(round(o_totalprice) as bigint) as fee
  from orders),
block as (
  select block_id as id, block_id + 3 as block_no, 'blk' || block_id as hash,
         cast(floor(block_id / 4) as bigint) as epoch_no, block_id * 20 as slot_no,
         count(*) as tx_count, 788918400000000 + block_id * 108000000000 as time,
         block_id as slot_leader_id
  from tx group by block_id),
slot_leader as (select c_custkey as id, c_custkey as pool_hash_id from customer),
pool_hash as (select s_suppkey as id, s_name as view from supplier),
stake_address as (
  select p_partkey as id, 'stake' || p_partkey as view from part
  union all select -1 - s_suppkey, 'earner' || s_suppkey from supplier),
outputs as (
  select l_orderkey * 10 + l_linenumber as id, l_orderkey as tx_id, l_linenumber as idx,
         'addr' || case when l_linenumber = 1 and min(l_partkey) % 3 = 0
           then 'w' || cast(floor(l_orderkey / 16) as bigint)
           else cast(min(l_partkey * 100 + l_suppkey) as varchar) end as address,
         'raw' || case when l_linenumber = 1 and min(l_partkey) % 3 = 0
           then 'w' || cast(floor(l_orderkey / 16) as bigint)
           else cast(min(l_partkey * 100 + l_suppkey) as varchar) end as address_raw,
         min(l_partkey) as stake_address_id, min(l_suppkey) as supp,
         cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as value
  from lineitem group by l_orderkey, l_linenumber),
tx_out as (
  select id, tx_id, idx, address, address_raw, stake_address_id, value from outputs),
tx_in as (
  select o.id, t.id as tx_in_id, o.tx_id as tx_out_id, o.idx as tx_out_index,
         case when o.stake_address_id % 2 = 0 then o.id end as redeemer_id
  from outputs o join tx t on t.id = o.tx_id + 1 + (o.stake_address_id + o.idx) % 11
  where o.supp % 4 <> 0),
reward as (
  select event_id as id,
         case when event_type = 'purchase' then -1 - user_id else user_id end as addr_id,
         case when event_type <> 'error' then user_id end as pool_id,
         date_diff('day', date '2024-01-01', cast(ts as date)) as earned_epoch,
         cast(round(value * 1000000) as bigint) as amount,
         case event_type when 'view' then 'member' when 'purchase' then 'leader'
           else event_type end as type
  from events where event_type <> 'signup'),
treasury as (
  select event_id as id, user_id as addr_id, cast(round(value * 1000000) as bigint) as amount
  from events where event_type = 'signup'),
withdrawal as (
  select id, stake_address_id as addr_id, cast(floor(value / 100) as bigint) as amount, tx_id
  from outputs where supp % 4 = 1),
redeemer as (
  select i.redeemer_id as id, i.tx_in_id as tx_id,
         'script' || o.stake_address_id as script_hash,
         o.value % 1000 as unit_mem, o.value % 100000 as unit_steps, o.value % 10000 as fee,
         i.redeemer_id as datum_id
  from tx_in i join outputs o on o.id = i.id where i.redeemer_id is not null),
script as (
  select 'script' || p_partkey as hash, p_partkey * 7 as tx_id,
         case when p_partkey % 4 = 0 then 'plutus' else 'timelock' end as type
  from part),
datum as (
  select redeemer_id as id, tx_out_id as tx_id from tx_in where redeemer_id is not null),
multi_asset as (
  select p_partkey as id, 'asset' || p_partkey as fingerprint, p_brand as policy,
         chr(92) || 'x' || p_partkey as name from part),
ma_tx_mint as (
  select l_orderkey as tx_id, l_partkey as ident,
         case when l_partkey % 2 = 0 and min(l_linenumber) % 2 = 0 then -1
              when l_partkey % 2 = 0 then 1
              when min(l_returnflag) = 'R' then -cast(sum(cast(l_quantity as bigint)) as bigint)
              else cast(sum(cast(l_quantity as bigint)) as bigint) end as quantity
  from lineitem group by l_orderkey, l_partkey),
ma_tx_out as (
  select id as tx_out_id, stake_address_id as ident, value % 97 + 1 as quantity from outputs
  union all
  select id, cast(floor(tx_id / 16) as bigint), value % 89 + 1 from outputs where idx = 2),
tx_metadata as (
  select o_orderkey as tx_id,
         cast(case when o_orderpriority = '1-URGENT' then 721 else 674 end as bigint) as key
  from orders where o_orderpriority in ('1-URGENT', '2-HIGH')
  union all
  select o_orderkey, cast(20 as bigint) from orders where o_orderkey % 7 = 0),
spent as (
  select o.*, i.tx_in_id as spent_in, i.redeemer_id from tx_out o
  join tx_in i on o.tx_id = i.tx_out_id and o.idx = i.tx_out_index),
unspent as (
  select o.* from tx_out o where not exists (
    select 1 from tx_in i where o.tx_id = i.tx_out_id and o.idx = i.tx_out_index)),
inputs as (select distinct address, spent_in as tx_id, value as amount from spent),
made as (
  select distinct o.tx_id, o.address, o.value as amount from tx_out o join tx t on t.id = o.tx_id),
network as (
  select t.id as tx_id, t.hash as tx_hash, i.address as src, o.address as dst,
         cast(i.amount as double) / 1000000 as ada_in, cast(o.amount as double) / 1000000 as ada_out
  from inputs i join tx t on t.id = i.tx_id join made o on o.tx_id = i.tx_id
  where i.address <> o.address),
history as (
  select s.id, s.view, r.earned_epoch, p.view as delegated_pool, r.amount as lovelace
  from reward r join stake_address s on r.addr_id = s.id join pool_hash p on r.pool_id = p.id),
received as (select stake_address_id as k, sum(value) as v from tx_out group by 1),
spending as (
  select stake_address_id as k, sum(s.value) as v from spent s join tx t on t.id = s.tx_id group by 1),
rewarded as (select addr_id as k, sum(amount) as v from reward group by 1),
withdrawn as (select addr_id as k, sum(amount) as v from withdrawal group by 1),
account_keys as (
  select k from received union select k from spending union select k from rewarded
  union select k from withdrawn),
balances as (
  select a.k, s.view, r.v is not null as has_received,
         coalesce(r.v, 0) + coalesce(w.v, 0) - coalesce(p.v, 0) - coalesce(d.v, 0) as lovelace
  from account_keys a left join received r using (k) left join rewarded w using (k)
  left join spending p using (k) left join withdrawn d using (k)
  left join stake_address s on s.id = a.k where a.k <> 0),
matched as (
  select distinct o.stake_address_id as sid, o.address from tx_out o
  join stake_address s on s.id = o.stake_address_id),
paid as (
  select distinct w.id as withdrawal_id, w.addr_id as stake_address_id, w.tx_id, w.amount as value
  from withdrawal w join tx t on t.id = w.tx_id join tx_out o on o.tx_id = t.id
  join matched m on m.address = o.address and m.sid = w.addr_id),
stake_payments as (
  select distinct p.stake_address_id, o.address, t.hash as tx_hash,
         cast(p.value as double) / 1000000 as "ADA_Input",
         cast(o.amount as double) / 1000000 as "ADA_Output"
  from paid p join tx t on t.id = p.tx_id join made o on o.tx_id = p.tx_id),
calls as (
  select r.script_hash, cast(sum(o.value) as double) / 1000000 as tx_out_value,
         cast(sum(r.unit_mem) as bigint) as tot_unit_mem,
         cast(sum(r.unit_steps) as bigint) as tot_unit_steps,
         cast(sum(r.fee) as double) / 1000000 as total_fees,
         min(b.block_no) as block_no
  from tx t join redeemer r on r.tx_id = t.id join tx_in i on i.redeemer_id = r.id
  join tx_out o on i.tx_out_id = o.tx_id and i.tx_out_index = o.idx
  join block b on b.id = t.block_id group by r.script_hash),
script_totals as (
  select c.script_hash, c.tx_out_value, c.tot_unit_mem, c.tot_unit_steps, c.total_fees,
         strftime(make_timestamp(b.time), '%Y-%m-%d') as deployment_timestamp,
         c.block_no, b.hash as block_hash
  from calls c join block b on b.block_no = c.block_no),
supply as (
  select ident, cast(sum(quantity) as bigint) as quantity, count(*) as cnt, min(tx_id) as mtx
  from ma_tx_mint group by ident),
types as (
  select a.fingerprint, m.key, a.policy, a.name, s.ident, s.cnt as mints,
         s.quantity as total_supply,
         strftime(make_timestamp(b.time), '%Y-%m-%d') as date_created
  from supply s left join multi_asset a on a.id = s.ident left join tx t on t.id = s.mtx
  left join tx_metadata m on m.tx_id = s.mtx left join block b on b.id = t.block_id),
token_moves as (
  select src, dst, tx_hash, "ADA_Input", "ADA_Output", token, cast(sum(q) as bigint) as quantity
  from (
    select distinct s.address as src, n.address as dst, t.hash as tx_hash,
           cast(s.value as double) / 1000000 as "ADA_Input",
           cast(n.value as double) / 1000000 as "ADA_Output",
           substring(a1.name, 3) as token, s.id, m1.quantity as q
    from spent s join ma_tx_out m1 on m1.tx_out_id = s.id join multi_asset a1 on a1.id = m1.ident
    join tx t on t.id = s.spent_in join tx_out n on n.tx_id = t.id
    join ma_tx_out m2 on m2.tx_out_id = n.id join multi_asset a2 on a2.id = m2.ident
    where s.address <> n.address and a1.name = a2.name)
  group by all),
pairs as (select distinct src, dst from network),
shapes as (
  select coalesce(i.tx_id, o.tx_id) as tx_id, coalesce(n_in, 0) as n_in,
         coalesce(n_out, 0) as n_out, least_in
  from (select spent_in as tx_id, count(*) as n_in, min(value) as least_in from spent group by 1) i
  full join (select tx_id, count(*) as n_out from tx_out group by 1) o on i.tx_id = o.tx_id),
reuse as (
  select tx_id, min(out_id) as out_id from (
    select o.tx_id, o.address, min(o.id) as out_id from tx_out o
    where exists (select 1 from spent s where s.spent_in = o.tx_id and s.address = o.address)
    group by 1, 2)
  group by tx_id having count(*) = 1),
low_outputs as (
  select o.tx_id, o.id from tx_out o join shapes s on s.tx_id = o.tx_id
  where s.n_in > 1 and s.n_out > 1 and o.value < s.least_in),
optimal as (
  select tx_id, min(id) as out_id from low_outputs group by tx_id having count(*) = 1),
optimal_coded as (
  select tx_id, id as out_id from (
    select *, row_number() over (partition by tx_id order by id) as nr,
           count(*) over (partition by tx_id) as n from low_outputs)
  where nr = least(n, 2)),
peeling as (
  select s.tx_id, max(s.id) as out_id from spent s
  join shapes a on a.tx_id = s.tx_id and a.n_in = 1 and a.n_out = 2
  join shapes b on b.tx_id = s.spent_in and b.n_in = 1 and b.n_out = 2
  group by s.tx_id),
change as (
  select tx_id, min(out_id) as out_id from (
    select * from reuse union all select * from optimal union all select * from peeling)
  group by tx_id having min(out_id) = max(out_id)),
members as (
  select distinct s.spent_in as tx_id, s.address from spent s
  where s.spent_in in (select tx_id from shapes where n_in > 1)
     or s.spent_in in (select tx_id from change)
  union
  select c.tx_id, o.address from change c join tx_out o on o.id = c.out_id),
numbers as (select address, min(id) as nr from tx_out group by address)
"""

# Entities: smallest label carried over member links until nothing changes.
ENTITIES = r"""
member_nr as (select m.tx_id, n.nr from members m join numbers n using (address)),
star as materialized (
  select distinct m.nr as a, c.nr as b from member_nr m
  join (select tx_id, min(nr) as nr from member_nr group by tx_id) c using (tx_id)
  where m.nr <> c.nr),
link as materialized (select a, b from star union select b, a from star),
label(nr, entity) using key (nr) as (
  select nr, nr as entity from numbers
  union
  select l.b, min(c.entity) from label c join link l on l.a = c.nr
  join recurring.label r on r.nr = l.b
  where c.entity < r.entity group by l.b),
entity as materialized (
  select n.address, l.entity as entity_id from numbers n join label l using (nr)),
entity_link as (
  select distinct s.entity_id as src, d.entity_id as dst
  from (select distinct spent_in as tx_id, address from spent) i
  join entity s on s.address = i.address
  join (select distinct tx_id, address from tx_out) o on o.tx_id = i.tx_id
  join entity d on d.address = o.address
  where s.entity_id <> d.entity_id),
entity_degree as (
  select e.entity_id, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) as out_degree,
         coalesce(b.n, 0) as degree
  from (select distinct entity_id from entity) e
  left join (select dst, count(*) as n from entity_link group by dst) i on i.dst = e.entity_id
  left join (select src, count(*) as n from entity_link group by src) o on o.src = e.entity_id
  left join (select x, count(*) as n from (
      select src as x, dst as y from entity_link union select dst, src from entity_link)
    group by x) b on b.x = e.entity_id),
entity_balance as (
  select e.entity_id, cast(coalesce(sum(o.value) filter (
           where t.block_id <= c.last and (i.tx_in_id is null or s.block_id >= c.last)), 0)
           as bigint) as balance
  from entity e join tx_out o using (address) join tx t on t.id = o.tx_id
  left join tx_in i on i.tx_out_id = o.tx_id and i.tx_out_index = o.idx
  left join tx s on s.id = i.tx_in_id cross join (select max(block_id) as last from tx) c
  group by e.entity_id),
core_steps as (
  select degree, row_number() over (order by degree desc, entity_id) - 1 as k from entity_degree),
core as (select max(k) as k_best from core_steps where k - 1 - degree < 0)
"""


def _gini(condition: str) -> str:
    return f"""(select sum((2 * i - n - 1) * (balance + 1e-7)) / (n * sum(balance + 1e-7)) from (
      select cast(balance as double) as balance, row_number() over (order by balance) as i,
             count(*) over () as n from entity_balance where {condition}) group by n)"""


_NETWORK_COLUMNS = """src, dst, tx_hash, ada_in as "ADA_Input", ada_out as "ADA_Output" """

_DEGREES = """
  select address, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree,
         cast(sum(o + i) as bigint) as degree
  from (select src as address, 1 as o, 0 as i from network
        union all select dst, 0, 1 from network) group by address"""


def _top_degree(column: str) -> str:
    return f"""select address, {column} from ({_DEGREES}) where {column} > 0
               order by {column} desc, address limit 15"""


def _script_network(condition: str) -> str:
    return f"""select {_NETWORK_COLUMNS} from network
               where tx_id in (select tx_id from script where {condition})"""


PLAIN: dict[str, str] = {
    "tx_inputs": """
        select distinct t.hash as tx_hash, s.address, s.tx_id, s.value as input_value
        from spent s join tx t on t.id = s.spent_in""",
    "tx_outputs": """
        select distinct t.hash, o.tx_id, o.address_raw, o.address as address_output, o.idx,
               o.value as output_value from tx_out o join tx t on o.tx_id = t.id""",
    "transaction_network": """
        select distinct i.tx_hash, i.address as input_addr, o.address as output_addr,
               i.value / 1000000 as "input_ADA_value", o.value / 1000000 as "output_ADA_value"
        from (select t.hash as tx_hash, s.address, s.value from spent s
              join tx t on t.id = s.spent_in) i
        left join (select t.hash, o.address, o.value from tx_out o join tx t on o.tx_id = t.id) o
          on i.tx_hash = o.hash
        where i.address <> o.address""",
    "network_in": """
        select s.id, s.tx_id, s.idx, s.address, s.address_raw, s.stake_address_id, s.value,
               t.hash as tx_hash from spent s join tx t on t.id = s.spent_in""",
    "network_out": "select o.* from tx_out o join tx t on o.tx_id = t.id",
    "network_address_outputs": """
        select o.id, o.address as address_output, t.hash
        from tx_out o join tx t on o.tx_id = t.id""",
    "network_pairs": """
        select s.address as input, o.address as output, t.hash as tx_hash,
               s.value / 1000000 as "ADA_value"
        from spent s join tx t on t.id = s.spent_in join tx_out o on o.tx_id = t.id
        where s.address <> o.address""",
    "network_pairs_all": """
        select s.address as input, o.address as output, t.hash as tx_hash,
               s.value / 1000000 as "ADA_value"
        from spent s join tx t on t.id = s.spent_in left join tx_out o on o.tx_id = t.id""",
    "spent_output_addresses": """
        select o.address as address_output, s.address from tx_out o join tx t on t.id = o.tx_id
        join spent s on s.id = o.id join tx u on u.id = s.spent_in""",
    "tx_with_output_values": """
        select t.*, o.value from tx t left join tx_out o on o.tx_id = t.id""",
    "outputs_by_value": """
        select o.* from tx_out o join tx t on o.tx_id = t.id
        where o.value = (select max(value) from tx_out)""",
    "output_input_values": """
        select o.address as output_address, s.address as input_address,
               o.value as output_value, s.value as input_value
        from tx_out o join tx t on o.tx_id = t.id join spent s on s.tx_id = o.tx_id
        join tx u on u.id = s.spent_in where o.value = (select max(value) from tx_out)""",
    "current_supply": """
        select cast(sum(value) as double) / 1000000 as current_supply from unspent""",
    "addresses": "select distinct address from tx_out",
    "new_addresses": """
        select distinct address from tx_out except
        select address from tx_out where tx_id <= (select floor(max(id) / 2) from tx)""",
    "address_ids": """
        select row_number() over (order by md5(address), address) as id, address
        from (select distinct address from tx_out)""",
    "network_with_ids": """
        select n.tx_id, n.tx_hash, a.id as input_addr_id, b.id as output_addr_id,
               n.ada_in as "input_ADA_value", n.ada_out as "output_ADA_value"
        from network n
        left join (select row_number() over (order by md5(address), address) as id, address
                   from (select distinct address from tx_out)) a on a.address = n.src
        left join (select row_number() over (order by md5(address), address) as id, address
                   from (select distinct address from tx_out)) b on b.address = n.dst""",
    "network_slice": f"""
        select tx_id, src as input_addr, dst as output_addr, ada_in as "input_ADA_value",
               ada_out as "output_ADA_value" from network
        where tx_id between {catalog.SLICE[0]} and {catalog.SLICE[1]}""",
    "co_input_pairs": """
        select distinct a.spent_in as tx_id, a.address as input1, b.address as input2
        from spent a join spent b on a.spent_in = b.spent_in where a.address <> b.address""",
    "co_input_links": """
        select distinct s.spent_in as tx_id, m.first as input1, s.address as input2 from spent s
        join (select spent_in, min(address) as first from spent group by 1) m using (spent_in)
        where s.address <> m.first""",
    "rewards_history": "select * from history order by earned_epoch desc",
    "reward_history_for_address": f"""
        select earned_epoch, delegated_pool, lovelace from history
        where view = '{catalog.STAKE_VIEW}' order by earned_epoch""",
    "rewards_by_epoch": """
        select earned_epoch, cast(sum(lovelace) as double) / 1000000 as "tot_ADA"
        from history group by earned_epoch""",
    "rewards_by_pool": """
        select delegated_pool, cast(sum(lovelace) as double) / 1000000 as "tot_ADA"
        from history group by delegated_pool""",
    "distribution_whales": """
        select view, cast(sum(lovelace) as double) / 1000000 as "tot_ADA"
        from history group by view order by 2 desc, 1 limit 10""",
    "rewards_by_type": 'select type, count(*) as "count" from reward group by type',
    "ada_rewards_by_type": """
        select type, cast(sum(amount) as double) / 1000000 as "ADA_amount"
        from reward group by type""",
    "pool_blocks_in_epoch": f"""
        select b.block_no, b.epoch_no, p.view as pool_view from block b
        join slot_leader l on b.slot_leader_id = l.id join pool_hash p on l.pool_hash_id = p.id
        where b.epoch_no = {catalog.EPOCH} and p.view = '{catalog.POOL_VIEW}'""",
    "pool_rewards_top": """
        select p.view as pool_id, cast(sum(r.amount) as double) / 1000000 as total_rewards
        from reward r join pool_hash p on r.pool_id = p.id group by p.view
        order by 2 desc, 1 limit 15""",
    "staking_rewards_top": """
        select s.view as stake_address, cast(sum(r.amount) as double) / 1000000 as total_rewards
        from reward r join stake_address s on r.addr_id = s.id group by s.view
        order by 2 desc, 1 limit 15""",
    "total_rewards_per_address": """
        select s.view as stake_address, t.amount as treasury_reward,
               cast(null as bigint) as staking_reward, t.amount as total_rewards
        from treasury t join stake_address s on t.addr_id = s.id
        union
        select s.view, cast(null as bigint), r.amount, r.amount
        from reward r join stake_address s on r.addr_id = s.id
        union
        select * from (
          select s.view, t.amount, r.amount, t.amount + r.amount as total
          from treasury t join reward r on r.addr_id = t.addr_id
          join stake_address s on s.id = t.addr_id order by 4 desc, 1, 2, 3 limit 15)""",
    "account_received": """
        select stake_address_id, cast(sum(value) as bigint) as value from tx_out group by 1""",
    "account_spent": """
        select o.stake_address_id, cast(sum(o.value) as bigint) as value
        from tx_out o join tx t on o.tx_id = t.id
        join tx_in i on i.tx_out_id = t.id and i.tx_out_index = o.idx group by 1""",
    "account_rewards": """
        select addr_id, cast(sum(amount) as bigint) as amount from reward group by 1""",
    "account_withdrawals": """
        select addr_id, cast(sum(amount) as bigint) as amount from withdrawal group by 1""",
    "account_balance": """
        select k as input_stake_address, view,
               cast(lovelace as double) / 1000000 as "account_balance_ADA" from balances""",
    "account_balance_as_coded": """
        select k as input_stake_address, view,
               cast(lovelace as double) / 1000000 as "account_balance_ADA"
        from balances where has_received""",
    "top_10_balances": """
        select view, cast(lovelace as double) / 1000000 as "account_balance_ADA"
        from balances order by lovelace desc, k limit 10""",
    "top_10_sum": """
        select cast(sum(lovelace) as double) / 1000000 as top_balances_sum
        from (select lovelace from balances order by lovelace desc, k limit 10)""",
    "total_balance": """
        select cast(sum(lovelace) as double) / 1000000 as total_balance from balances""",
    "stake_totals": """
        select s.id as stake_address_id, s.view, cast(u.v as bigint) as utxo,
               cast(r.v as bigint) as total_rewards, cast(t.v as bigint) as total_treasuries,
               cast(w.v as bigint) as total_withdrawals
        from stake_address s
        left join (select stake_address_id as k, sum(value) as v from unspent group by 1) u on u.k = s.id
        left join rewarded r on r.k = s.id
        left join (select addr_id as k, sum(amount) as v from treasury group by 1) t on t.k = s.id
        left join (select stake_address_id as k, sum(value) as v from paid group by 1) w on w.k = s.id
        """,
    "stake_balance_case": """
        select stake_address, cast(case
            when coalesce(r, 0) - coalesce(w, 0) < 0 then coalesce(u, 0) + coalesce(t, 0)
            else coalesce(u, 0) + coalesce(r, 0) + coalesce(t, 0) - coalesce(w, 0)
          end as bigint) as balance
        from (
          select s.view as stake_address, u.v as u, r.v as r, t.v as t, w.v as w
          from stake_address s
          left join (select stake_address_id as k, sum(value) as v from unspent group by 1) u on u.k = s.id
          left join rewarded r on r.k = s.id
          left join (select addr_id as k, sum(amount) as v from treasury group by 1) t on t.k = s.id
          left join (select stake_address_id as k, sum(value) as v from paid group by 1) w on w.k = s.id)
        """,
    "script_calls": "select * from script_totals",
    "script_averages": """
        select avg(total_fees) as "ADA_avg_fees", avg(tx_out_value) as "ADA_avg_value",
               avg(tot_unit_mem) as avg_unit_mem, avg(tot_unit_steps) as avg_unit_steps
        from script_totals""",
    "scripts_per_block": "select block_no, count(*) as cnt_sc from script_totals group by 1",
    "scripts_by_date": """
        select deployment_timestamp, count(*) as nr_sc_created from script_totals group by 1""",
    "token_supply": "select * from supply",
    "token_types": "select * from types",
    "tokens_by_day": """
        select date_created, count(*) as tokens_created_count from types group by 1""",
    "distinct_tokens_by_day": """
        select date_created, count(distinct ident) as tokens_created_count from types group by 1""",
    "nfts_by_day": """
        select date_created, count(*) as tokens_created_count from types
        where key = 721 group by 1""",
    "fts_by_day": """
        select date_created, count(*) as tokens_created_count from types
        where key not in (721) group by 1""",
    "tokens_by_supply": """
        select total_supply as token_supply, count(*) as token_count from types
        where total_supply > 0 and total_supply <> 1 group by 1 order by 1""",
    "tokens_unique_supply": """
        select total_supply as token_supply, count(*) as tokens_count_tot_supply from types
        where total_supply > 0 and total_supply = 1 group by 1 order by 1""",
    "input_edges": "select * from inputs",
    "output_edges": "select * from made",
    "token_edges": "select * from token_moves",
    "minted_in": """
        select distinct m.ident as asset_id, m.tx_id, m.quantity from ma_tx_mint m
        join multi_asset a on a.id = m.ident join tx t on t.id = m.tx_id""",
    "sent_in": """
        select distinct m.ident as asset_id, o.tx_id, m.quantity from ma_tx_out m
        join multi_asset a on a.id = m.ident join tx_out o on o.id = m.tx_out_id
        join tx t on t.id = o.tx_id""",
    "tx_scripts": """
        select distinct t.id as tx_id, s.hash as script_hash
        from tx t join script s on t.id = s.tx_id""",
    "redeemer_scripts": """
        select distinct r.id as redeemer_id, s.hash as script_hash
        from redeemer r join script s on s.hash = r.script_hash""",
    "redeemer_txs": """
        select distinct r.id as redeemer_id, t.id as tx_id
        from redeemer r join tx t on t.id = r.tx_id""",
    "datum_txs": """
        select distinct d.id as datum_id, t.id as tx_id from datum d join tx t on t.id = d.tx_id""",
    "redeemer_datums": """
        select distinct r.id as redeemer_id, d.id as datum_id
        from redeemer r join datum d on d.id = r.datum_id""",
    "stake_reward_edges": """
        select distinct r.id as reward_id, s.id as stake_address_id, r.amount
        from reward r join stake_address s on s.id = r.addr_id""",
    "pool_reward_edges": """
        select distinct r.id as reward_id, p.id as pool_id, r.amount
        from reward r join pool_hash p on p.id = r.pool_id""",
    "treasury_edges": """
        select distinct r.id as treasury_id, s.id as stake_address_id, r.amount
        from treasury r join stake_address s on s.id = r.addr_id""",
    "stake_input_edges": "select distinct stake_address_id, tx_id, value from paid",
    "withdrawal_edges": "select distinct stake_address_id, withdrawal_id, value from paid",
    "stake_payment_edges": "select * from stake_payments",
    "address_stake_links": """
        select distinct o.address, s.view
        from tx_out o join stake_address s on s.id = o.stake_address_id""",
    "co_spent_address_edges": """
        select distinct x.id as src, y.id as dst from spent a
        join spent b on a.spent_in = b.spent_in and a.address <> b.address
        join (select row_number() over (order by md5(address), address) as id, address
              from (select distinct address from tx_out)) x on x.address = a.address
        join (select row_number() over (order by md5(address), address) as id, address
              from (select distinct address from tx_out)) y on y.address = b.address""",
    "transaction_document_sizes": """
        select t.id, coalesce(n_in, 0) as n_inputs, coalesce(n_out, 0) as n_outputs
        from tx t left join shapes s on s.tx_id = t.id""",
    "nested_transactions": """
        select t.id as of_tx, t.hash, t.block_id, x.side, x.id, x.tx_id, x.idx, x.address, x.value
        from tx t join (
          select spent_in as of_tx, 'inputs' as side, id, tx_id, idx, address, value from spent
          union all select tx_id, 'outputs', id, tx_id, idx, address, value from tx_out) x
        on x.of_tx = t.id""",
    "neighbour_members": """
        with p as (select distinct s.address as src, o.address as dst
                   from spent s join tx_out o on o.tx_id = s.spent_in)
        select src as address, 'outputs' as side, dst as neighbour from p
        union all select dst, 'inputs', src from p""",
    "adjacency": """
        select src as id, dst as neighbour from pairs union select dst, src from pairs""",
    "stream_event_windows": """
        with arrived as (
          select *, date_trunc('day', ts) as day, cast(floor(date_diff('day', date '2024-01-01', cast(ts as date)) / 8) as bigint)
                 + case when event_id % 13 < 2 then event_id % 13 + 1 else 0 end as batch from events),
        marks as (
          select batch, max(max(ts)) over (order by batch rows between unbounded preceding and 1 preceding)
                 - interval 2 day as mark from arrived group by batch),
        judged as (
          select a.*, coalesce(day + interval 1 day <= mark, false) as late from arrived a join marks using (batch))
        select strftime(day, '%Y-%m-%d') as window_start, event_type, count(*) as events
        from judged where not late group by all
        union all select null, event_type, count(*) filter (late) from judged group by event_type""",
    "snapshots": """
        select strftime(e.snapshot_ts, '%Y-%m-%d %H:%M:%S') as snapshot_ts, (select max(b.id) from block b
                               where make_timestamp(b.time) < e.snapshot_ts) as cut_off
        from (select unnest(generate_series(
                min(make_timestamp(time)) + interval 4 month,
                max(make_timestamp(time)) + interval 4 month, interval 4 month)) as snapshot_ts
              from block) e""",
    "stream_ada_rewards_by_type": """
        select type, cast(sum(amount) as double) / 1000000 as "ADA_amount"
        from reward group by type""",
    "stream_token_supply": "select * from supply",
    "address_neighbours": """
        with p as (select distinct s.address as src, o.address as dst
                   from spent s join tx_out o on o.tx_id = s.spent_in)
        select src as id, 'outputs' as side, count(*) as size from p group by src
        union all select dst, 'inputs', count(*) from p group by dst""",
    "network_edge_table": f"select {_NETWORK_COLUMNS} from network",
    "weighted_edges": """
        select s.address as src, o.address as dst, s.value / 1000000 as weight
        from spent s join tx t on t.id = s.spent_in join tx_out o on o.tx_id = t.id
        where s.address <> o.address""",
    "id_edges": """
        with ids as (select row_number() over (order by md5(address), address) as id, address
                     from (select distinct address from tx_out))
        select a.id as src, b.id as dst, n.tx_hash, n.tx_id, n.ada_in as input, n.ada_out as output
        from network n join ids a on a.address = n.src join ids b on b.address = n.dst""",
    "stream_id_edges": """
        with ids as (select row_number() over (order by md5(address), address) as id, address
                     from (select distinct address from tx_out))
        select a.id as src, b.id as dst, n.tx_hash, n.tx_id, n.ada_in as input, n.ada_out as output
        from network n join ids a on a.address = n.src join ids b on b.address = n.dst""",
    "stream_network": """
        select tx_hash, src as input_addr, dst as output_addr, ada_in as "input_ADA_value",
               ada_out as "output_ADA_value" from network""",
    "new_address_ids": """
        with known as (select distinct address from tx_out
                       where tx_id <= (select floor(max(id) / 2) from tx))
        select (select count(*) from known) + row_number() over (order by md5(address), address)
                 as id, address
        from (select distinct address from tx_out
              where address not in (select address from known))""",
    "network_increment": """
        select tx_hash, src as input_addr, dst as output_addr, ada_in as "input_ADA_value",
               ada_out as "output_ADA_value" from network
        where tx_id > (select floor(max(id) / 2) from tx)""",
    "other_outputs": """
        select id, tx_id, address from tx_out where id not in (select out_id from change)""",
    "stream_messages": "select event_id, user_id, event_type from events",
    "script_network": _script_network("true"),
    "plutus_network": _script_network("type = 'plutus'"),
    "timelock_network": _script_network("type = 'timelock'"),
    "tx_by_hash": f"""
        select distinct src as "Inputs", ada_in as "ADA_Input", dst as "Outputs",
               ada_out as "ADA_Output" from network where tx_hash = '{catalog.TX_HASH}'""",
    "network_table": """
        select src as "from", dst as "to", ada_in as amount from network
        union
        select s.view, p.address, p."ADA_Input" from stake_payments p
        join stake_address s on s.id = p.stake_address_id""",
    "token_transactions": """
        select src, dst, tx_hash, "ADA_Input", "ADA_Output", count(*) as tokens
        from token_moves group by all""",
    "token_edge_maps": """
        select src, dst, tx_hash, "ADA_Input", "ADA_Output",
               string_agg(token || '=' || quantity, ',' order by token || '=' || quantity) as tokens
        from token_moves group by all""",
    "top_out_degree": _top_degree("out_degree"),
    "top_in_degree": _top_degree("in_degree"),
    "top_degree": _top_degree("degree"),
    "latest_block": "select max(block_no) as latest_block from block",
    "latest_epoch": "select max(epoch_no) as latest_epoch from block",
    "in_degrees": "select dst as id, count(*) as in_degree from pairs group by dst",
    "adjacency_sizes": """
        select x as id, count(*) as neighbours from (
          select src as x, dst as y from pairs union select dst, src from pairs) group by x""",
    "triangles": """
        with link as materialized (
          select distinct least(src, dst) as a, greatest(src, dst) as b from pairs),
        tri as (
          select x.a as a, x.b as b, y.b as c from link x join link y on x.b = y.a
          join link z on z.a = x.a and z.b = y.b)
        select id, cast(sum(n) as bigint) as "count" from (
          select a as id, 1 as n from tri union all select b, 1 from tri
          union all select c, 1 from tri
          union all select a, 0 from link union all select b, 0 from link)
        group by id""",
    "change_reuse": "select * from reuse",
    "change_optimal": "select * from optimal",
    "change_optimal_as_coded": "select * from optimal_coded",
    "change_peeling": "select * from peeling",
    "change_final": "select * from change",
    "cluster_members": "select * from members",
}

RECURSIVE: dict[str, str] = {
    "entities_incremental": "select address, entity_id from entity",
    "balance_series": """
        select c.cut_off, e.entity_id, cast(coalesce(sum(o.value) filter (
                 where t.block_id <= c.cut_off
                   and (i.tx_in_id is null or s.block_id >= c.cut_off)), 0) as bigint) as balance
        from entity e join tx_out o using (address) join tx t on t.id = o.tx_id
        left join tx_in i on i.tx_out_id = o.tx_id and i.tx_out_index = o.idx
        left join tx s on s.id = i.tx_in_id
        cross join (select cast(floor(max(block_id) * q / 4) as bigint) as cut_off
                    from tx, (select unnest([1, 2, 3, 4]) as q) group by q) c
        group by c.cut_off, e.entity_id""",
    "entities": "select address, entity_id from entity",
    "entity_edges": "select * from entity_link",
    "entity_degrees": "select * from entity_degree",
    "degree_histogram": """
        select kind, value, count(*) as "count" from (
          select 'in' as kind, in_degree as value from entity_degree
          union all select 'out', out_degree from entity_degree
          union all select 'total', degree from entity_degree) group by 1, 2""",
    "entity_balances": "select * from entity_balance",
    "gini": f"""
        select round({_gini('true')}, 9) as gini_index,
               round({_gini('balance > 0')}, 9) as gini_index_no_zeros,
               (select cast(sum(balance) as double) / count(*) from entity_balance)
                 as average_wealth""",
    "core_size": """
        select k_best as core_length, (select count(*) from entity_degree) as total_entities
        from core""",
    "core_description": """
        select degree, count(*) as "count" from core_steps, core where k < k_best group by degree""",
    "entity_counts": """
        select count(distinct entity_id) as no_ent, count(*) as no_addr from entity""",
    "motif_mutual": """
        select e1.src as a, e1.dst as b from entity_link e1
        join entity_link e2 on e1.dst = e2.src and e1.src = e2.dst""",
    "addresses_per_entity": """
        select n as value, count(*) as "count" from (
          select count(*) as n from entity group by entity_id) group by n""",
}


def _page_rank(start: str, base: str, key: str, total: str, columns: str) -> str:
    """Ten rounds of page rank, one common table expression each."""
    parts = [
        "link as materialized (select src, dst from pairs)",
        "w as materialized (select src, dst, 1.0::double / count(*) over (partition by src) as w from link)",
        "v as materialized (select src as id from link union select dst from link)",
        "sources as (select distinct src as address from link order by 1)",
        f"r0 as materialized ({start})",
    ]
    on = "a.id = r.id" + (f" and a.{key} = r.{key}" if key else "")
    keyed = f"r.{key}, " if key else ""
    for i in range(1, catalog.PAGERANK_ROUNDS + 1):
        group = f", r.{key}" if key else ""
        parts.append(
            f"r{i} as materialized (select {keyed}r.id, r.base + 0.85 * coalesce(a.s, 0) as rank, r.base "
            f"from r0 r left join (select {keyed}w.dst as id, sum(r.rank * w.w) as s "
            f"from r{i - 1} r join w on w.src = r.id group by w.dst{group}) a on {on})"
        )
    last = f"r{catalog.PAGERANK_ROUNDS}"
    over = f"over (partition by {key})" if key else "over ()"
    parts.append(
        f"scaled as (select *, rank * {total} / sum(rank) {over} as pr from {last})"
    )
    return ", ".join(parts) + f" select {columns} from scaled"


_START = "select id, {rank} as rank, {base} as base from v"

def _page_rank_to_tolerance(rounds: int = 60) -> str:
    """Rounds up to the first that moves no rank by more than the tolerance; no rows
    if that takes longer than ``rounds``."""
    parts = [
        "link as materialized (select src, dst from pairs)",
        "w as materialized (select src, dst, 1.0::double / count(*) over (partition by src) as w from link)",
        "r0 as materialized (select id, 1.0::double as rank from "
        "(select src as id from link union select dst from link))",
    ]
    for i in range(1, rounds + 1):
        parts.append(
            f"r{i} as materialized (select r.id, 0.15 + 0.85 * coalesce(a.s, 0) as rank "
            f"from r0 r left join (select w.dst as id, sum(r.rank * w.w) as s "
            f"from r{i - 1} r join w on w.src = r.id group by w.dst) a on a.id = r.id)"
        )
    every = " union all ".join(
        f"select {i} as nr, max(abs(a.rank - b.rank)) as moved "
        f"from r{i} a join r{i - 1} b on a.id = b.id"
        for i in range(1, rounds + 1)
    )
    parts.append(
        f"last as (select min(nr) as nr from ({every}) where moved <= {catalog.PAGERANK_TOLERANCE})"
    )
    chosen = " union all ".join(
        f"select id, rank from r{i} where (select nr from last) = {i}"
        for i in range(1, rounds + 1)
    )
    parts.append(f"chosen as materialized ({chosen})")
    return ", ".join(parts) + (
        " select id, round(rank * (select count(*) from chosen) / (select sum(rank) from chosen), 6)"
        " as pagerank from chosen"
    )


def _strong(rounds: int = 6) -> str:
    """Strong components: smallest labels along and against the edges, then the edges
    inside one class of labels again. ``rest`` counts edges left after the last round.
    """
    parts = ["e0 as materialized (select src, dst from entity_link)"]
    for i in range(rounds):
        # another order of the vertices in each round
        order = f"(md5(id || '-{i}') || '-' || id)"
        vertices = f"select src as id from e{i} union select dst from e{i}"
        for name, here, there in [("f", "src", "dst"), ("b", "dst", "src")]:
            parts.append(
                f"{name}{i}(id, label) using key (id) as ("
                f"select id, {order} as label from ({vertices}) union "
                f"select e.{there}, min(l.label) from {name}{i} l join e{i} e on e.{here} = l.id "
                f"join recurring.{name}{i} r on r.id = e.{there} "
                f"where l.label < r.label group by e.{there})"
            )
        parts.append(
            f"c{i} as materialized (select f.id, f.label as f, b.label as b "
            f"from f{i} f join b{i} b on f.id = b.id)"
        )
        parts.append(
            f"e{i + 1} as materialized (select e.src, e.dst from e{i} e "
            f"join c{i} s on s.id = e.src join c{i} d on d.id = e.dst "
            f"where s.f = d.f and s.b = d.b and s.f <> s.b)"
        )
    found = " union all ".join(
        f"select id, '{i}-' || f as label from c{i} where f = b" for i in range(rounds)
    )
    parts.append(
        "settled as materialized (select id, min(id) over (partition by label) as component "
        f"from ({found}))"
    )
    parts.append(
        "strong as materialized (select v.id, coalesce(s.component, v.id) as component "
        "from (select src as id from entity_link union select dst from entity_link) v "
        f"left join settled s on s.id = v.id where (select count(*) from e{rounds}) = 0)"
    )
    return ", ".join(parts)


PAGE_RANK: dict[str, str] = {
    "pagerank": _page_rank_to_tolerance(),
    "pagerank_fixed": _page_rank(
        _START.format(rank="1.0::double", base="0.15::double"),
        "",
        "",
        "(select count(*) from v)",
        "id, round(pr, 6) as pagerank",
    ),
    "pagerank_personal": _page_rank(
        _START.format(
            rank="case when id = (select min(src) from link) then 1.0::double else 0 end",
            base="case when id = (select min(src) from link) then 0.15::double else 0 end",
        ),
        "",
        "",
        "1.0",
        "id, round(pr, 6) as pagerank",
    ),
    "pagerank_parallel": _page_rank(
        """select s.address as source_id, v.id,
                  case when v.id = s.address then 1.0::double else 0 end as rank,
                  case when v.id = s.address then 0.15::double else 0 end as base
           from v cross join (select address from sources limit 4) s""",
        "",
        "source_id",
        "1.0",
        "source_id, id, round(pr, 6) as pagerank",
    )
    + " where pr > 0",
}


STRONG: dict[str, str] = {
    "strong_components": "select id, component from strong",
    "series_ratios": """
        select (select max(block_id) from tx) as snapshot_ts,
               (select count(*) / count(distinct entity_id) from entity) as addresses_per_entity,
               (select k_best / (select count(*) from entity_degree) from core) as core_share,
               (select max(n) from (select count(*) as n from strong group by component))
                 / (select count(*) from entity_degree) * 100 as scc_percent""",
    "largest_scc": """
        select max(n) as scc_size from (select count(*) as n from strong group by component)""",
}


def _snapshot(quarter: int) -> str:
    """Metrics of the ledger up to a block, clustered on its own."""
    cut = f"(select cast(floor(max(floor(o_orderkey / 8)) * {quarter} / 4) as bigint) from orders)"
    ledger = LEDGER.replace("value from outputs),", f"value from outputs where floor(tx_id / 8) <= {cut}),").replace(
        "where o.supp % 4 <> 0)", f"where o.supp % 4 <> 0 and t.block_id <= {cut})"
    )
    entities = ENTITIES.replace("(select max(block_id) as last from tx)", f"(select {cut} as last)")
    return f"""select * from (with recursive {ledger}, {entities}
        select {cut} as cut_off, count(distinct entity_id) as no_ent, count(*) as no_addr,
               (select max(n) from (select count(*) as n from entity group by entity_id)) as largest_entity,
               (select count(*) from (
                  select distinct least(src, dst), greatest(src, dst) from entity_link)) as links,
               (select k_best from core) as core_length,
               round({_gini('true')}, 9) as gini_index,
               round({_gini('balance > 0')}, 9) as gini_index_no_zeros,
               (select cast(sum(balance) as double) / count(*) from entity_balance)
                 as average_wealth
        from entity)"""


SERIES: dict[str, str] = {
    "snapshot_series": " union all ".join(_snapshot(quarter) for quarter in (1, 2, 3, 4))
}


def oracle_sql() -> dict[str, str]:
    plain = {
        name: f"with {LEDGER}{',' if _is_with(body) else ''} {_strip_with(body)}"
        for name, body in PLAIN.items()
    }
    recursive = {
        name: f"with recursive {LEDGER}, {ENTITIES} {body}" for name, body in RECURSIVE.items()
    }
    ranks = {name: f"with {LEDGER}, {body}" for name, body in PAGE_RANK.items()}
    strong = {
        name: f"with recursive {LEDGER}, {ENTITIES}, {_strong()} {body}"
        for name, body in STRONG.items()
    }
    return {**plain, **recursive, **ranks, **strong, **SERIES}


def _is_with(body: str) -> bool:
    return body.strip().startswith("with ")


def _strip_with(body: str) -> str:
    body = body.strip()
    return body[len("with ") :] if _is_with(body) else body
