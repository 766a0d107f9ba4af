from ledgers import Book, rows
from utxolens.operators import accounts, edges, rewards, scripts, tokens, utxo


def amounts(spark, data, columns="id bigint, addr_id bigint, amount bigint"):
    return spark.createDataFrame(data, columns)


def stakes(spark):
    return spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s3")], "id bigint, view string")


def test_account_balance_keeps_accounts_found_once(spark):
    tx, tx_in, tx_out = (
        Book()
        .pay(1, [("A", 5_000_000, 1), ("B", 7_000_000, 2), ("C", 1, 0), ("D", 1)])
        .pay(2, [("A", 2_000_000, 1)], [(1, 0)])
        .tables(spark)
    )
    reward = amounts(spark, [(1, 3, 4_000_000), (2, 1, 1_000_000)])
    withdrawal = amounts(spark, [(1, 1, 500_000)])
    total = accounts.account_totals(tx, tx_in, tx_out, reward, withdrawal, stakes(spark))
    assert rows(accounts.account_balance(total)) == [(1, "s1", 2.5), (2, "s2", 7.0), (3, "s3", 4.0)]
    coded = accounts.account_totals(
        tx, tx_in, tx_out, reward, withdrawal, stakes(spark), as_coded=True
    )
    assert rows(accounts.account_balance(coded)) == [(1, "s1", 2.5), (2, "s2", 7.0)]
    assert rows(accounts.top_balances(total, 2)) == [("s2", 7.0), ("s3", 4.0)]
    assert rows(accounts.top_balances_sum(total, 2)) == [(11.0,)]
    assert rows(accounts.total_balance(total)) == [(13.5,)]


def test_balance_leaves_out_withdrawals_above_rewards(spark):
    unspent = spark.createDataFrame([(1, 10), (2, 10)], "stake_address_id bigint, value bigint")
    fields = "stake_address_id bigint, amount bigint"
    total = accounts.stake_totals(
        stakes(spark),
        unspent,
        spark.createDataFrame([(1, 1), (2, 5)], fields),
        spark.createDataFrame([(1, 2)], fields),
        spark.createDataFrame([(1, 3), (2, 1)], "stake_address_id bigint, value bigint"),
    )
    assert rows(accounts.stake_balance_case(total)) == [("s1", 12), ("s2", 14), ("s3", 0)]
    assert [r.utxo for r in total.filter("view = 's3'").collect()] == [None]


def test_unspent_outputs_are_added_up_not_overwritten(spark):
    _, tx_in, tx_out = (
        Book().pay(1, [("A", 5, 1), ("A", 6, 1), ("A", 7, 1)]).pay(2, [("B", 1, 2)], [(1, 0)]).tables(spark)
    )
    unspent = utxo.unspent_outputs(tx_out, tx_in)
    nothing = spark.createDataFrame([], "stake_address_id bigint, amount bigint")
    total = accounts.stake_totals(
        stakes(spark), unspent, nothing, nothing, nothing.withColumnRenamed("amount", "value")
    )
    assert [r.utxo for r in total.orderBy("stake_address_id").collect()] == [13, 1, None]


def test_largest_sums_of_rewards_match_all_pairs(spark):
    import random

    rng = random.Random(1)
    treasury = [(i, rng.randrange(1, 4), rng.randrange(1, 12)) for i in range(60)]
    reward = [(i, rng.randrange(1, 4), rng.randrange(1, 12)) for i in range(80)]
    got = rewards.total_rewards_per_address(
        amounts(spark, reward), amounts(spark, treasury), stakes(spark), k=7
    )
    sums = sorted(
        (
            (-(t + r), f"s{a}", t, r)
            for _, a, t in treasury
            for _, b, r in reward
            if a == b
        )
    )[:7]
    want = {(v, t, r, -n) for n, v, t, r in sums}
    assert {tuple(r) for r in got.filter("treasury_reward is not null and staking_reward is not null").collect()} == want
    assert got.filter("staking_reward is null").count() == len({(a, t) for _, a, t in treasury})


def test_reward_queries(spark):
    reward = spark.createDataFrame(
        [(1, 1, 1, 5, 10_000_000, "member"), (2, 1, None, 6, 1, "leader"), (3, 2, 1, 6, 5_000_000, "member")],
        "id bigint, addr_id bigint, pool_id bigint, earned_epoch bigint, amount bigint, type string",
    )
    pool = spark.createDataFrame([(1, "p1")], "id bigint, view string")
    history = rewards.rewards_history(reward, stakes(spark), pool)
    assert rows(history) == [(1, "s1", 5, "p1", 10_000_000), (2, "s2", 6, "p1", 5_000_000)]
    assert [r.earned_epoch for r in rewards.newest_first(history).collect()] == [6, 5]
    assert rows(rewards.rewards_by_pool(history)) == [("p1", 15.0)]
    assert rows(rewards.rewards_by_type(reward)) == [("leader", 1), ("member", 2)]


def test_withdrawal_counts_when_its_transaction_pays_the_account(spark):
    tx, _, tx_out = Book().pay(1, [("A", 5, 1)]).pay(2, [("B", 5, 2)]).tables(spark)
    withdrawal = spark.createDataFrame(
        [(1, 1, 9, 1), (2, 1, 9, 2)], "id bigint, addr_id bigint, amount bigint, tx_id bigint"
    )
    paid = edges.paid_withdrawals(withdrawal, tx, tx_out, stakes(spark))
    assert rows(edges.withdrawal_edges(paid)) == [(1, 1, 9)]
    assert rows(edges.stake_input_edges(paid)) == [(1, 1, 9)]
    raw = edges.stake_payment_edges(paid, tx, tx_out, in_ada=False)
    assert rows(raw) == [(1, "A", "h1", 9, 5)]


def test_tokens(spark):
    mint = spark.createDataFrame(
        [(1, 1, 5), (2, 1, -5), (1, 2, 1), (3, 3, 9)], "tx_id bigint, ident bigint, quantity bigint"
    )
    asset = spark.createDataFrame(
        [(1, "f1", "p", "\\x1"), (2, "f2", "p", "\\x2")],
        "id bigint, fingerprint string, policy string, name string",
    )
    tx = spark.createDataFrame([(1, 7), (3, 8)], "id bigint, block_id bigint")
    metadata = spark.createDataFrame([(1, 721), (1, 20)], "tx_id bigint, key bigint")
    block = spark.createDataFrame(
        [(7, 5, 0), (8, 6, 86_400_000_000)], "id bigint, block_no bigint, time bigint"
    )
    types = tokens.token_types(tokens.token_supply(mint), asset, tx, metadata, block)
    assert types.count() == 5  # two keys for tokens 1 and 2, none for token 3
    assert rows(tokens.tokens_by_day(types)) == [("1970-01-01", 4), ("1970-01-02", 1)]
    assert rows(tokens.tokens_by_day(types, distinct_tokens=True)) == [("1970-01-01", 2), ("1970-01-02", 1)]
    assert rows(tokens.nfts_by_day(types)) == [("1970-01-01", 2)]
    assert rows(tokens.fts_by_day(types)) == [("1970-01-01", 2)]
    assert rows(tokens.tokens_by_supply(types)) == [(9, 1)]  # burned supply 0 is left out
    assert rows(tokens.tokens_unique_supply(types)) == [(1, 2)]


def test_scripts_use_block_id_and_earliest_block(spark):
    tx, tx_in, tx_out = (
        Book()
        .pay(1, [("A", 2_000_000), ("A", 3_000_000)])
        .pay(2, [("B", 1)], block=7)
        .pay(3, [("B", 1)], block=5)
        .tables(spark)
    )
    tx_in = spark.createDataFrame([(1, 2, 1, 0, 11), (2, 3, 1, 1, 12)], tx_in.schema)
    redeemer = spark.createDataFrame(
        [(11, 2, "s", 1, 2, 1_000_000), (12, 3, "s", 3, 4, 0)],
        "id bigint, tx_id bigint, script_hash string, unit_mem bigint, unit_steps bigint, fee bigint",
    )
    block = spark.createDataFrame(
        [(7, 5, "x7", 0), (5, 4, "x5", 86_400_000_000)],
        "id bigint, block_no bigint, hash string, time bigint",
    )
    calls = scripts.script_calls(tx, redeemer, tx_in, tx_out, block)
    assert rows(calls) == [("s", 5.0, 4, 6, 1.0, "1970-01-02", 4, "x5")]
    coded = scripts.script_calls(tx, redeemer, tx_in, tx_out, block, as_coded=True)
    assert [r.block_hash for r in coded.collect()] == ["x7"]
    assert rows(scripts.script_averages(calls)) == [(1.0, 5.0, 4.0, 6.0)]
    assert rows(scripts.scripts_by_date(calls)) == [("1970-01-02", 1)]


def test_token_edges_add_up_per_token(spark):
    tx, tx_in, tx_out = (
        Book()
        .pay(1, [("A", 5_000_000), ("A", 5_000_000), ("B", 1_000_000)])
        .pay(2, [("C", 2_000_000), ("A", 3_000_000)], [(1, 0), (1, 1), (1, 2)])
        .tables(spark)
    )
    carried = spark.createDataFrame(
        [(100, 1, 4), (101, 1, 6), (102, 2, 1), (200, 1, 10), (201, 1, 1), (200, 2, 1)],
        "tx_out_id bigint, ident bigint, quantity bigint",
    )
    asset = spark.createDataFrame([(1, "\\xaa"), (2, "\\xbb")], "id bigint, name string")
    found = edges.token_edges(tx, tx_in, tx_out, carried, asset)
    assert rows(found) == [("A", "C", "h2", 5.0, 2.0, "aa", 10), ("B", "C", "h2", 1.0, 2.0, "bb", 1)]
    maps = edges.token_edge_maps(found).filter("src = 'A'").collect()
    assert [r.tokens for r in maps] == [{"aa": 10}]
