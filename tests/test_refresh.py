import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ledgers import Book, random_book, rows
from utxolens.operators import tokens, utxo
from utxolens.schemas import schema
from utxolens.sources import sinks, streams, tables
from utxolens.streaming import entity_state, event_windows, feeds, incremental


def test_increments_equal_a_full_run(spark, tmp_path):
    """New inputs that spend old outputs are found, and a run without news does nothing."""
    tx, tx_in, tx_out = random_book(21).tables(spark)
    marks = incremental.Marks(spark, f"{tmp_path}/marks")
    target, log = f"{tmp_path}/network", f"{tmp_path}/log"

    def run(high):
        known = {
            "tx": tx.filter(F.col("id") <= high),
            "tx_in": tx_in.filter(F.col("tx_in_id") <= high),
            "tx_out": tx_out.filter(F.col("tx_id") <= high),
        }
        try:
            stored = spark.read.parquet(target).drop("batch_id")
        except AnalysisException:
            stored = None
        return incremental.run_increment(
            marks,
            "network",
            known,
            lambda delta: incremental.network_increment(
                delta, known["tx"], known["tx_in"], known["tx_out"], stored
            ),
            target,
            log_path=log,
        )

    # inputs carry the id of the output they spend, so ids do not follow arrival;
    # the transactions touched bring the missing ones in
    assert [run(20), run(45), run(45), run(60)] == [0, 1, None, 2]
    stored = spark.read.parquet(target).drop("batch_id")
    assert rows(stored) == rows(utxo.transaction_network(tx, tx_in, tx_out))
    assert spark.read.parquet(log).count() == 3
    assert marks.last_ids("network")["tx"] == 60


def test_nothing_new_changes_no_mark(spark, tmp_path):
    marks = incremental.Marks(spark, f"{tmp_path}/marks")
    source = {"mint": spark.createDataFrame([(3, 1)], "id bigint, x bigint")}
    copy = lambda delta: delta["mint"]
    assert incremental.run_increment(marks, "job", source, copy, f"{tmp_path}/out") == 0
    assert incremental.run_increment(marks, "job", source, copy, f"{tmp_path}/out") is None
    assert marks.last_ids("job") == {"mint": 3}
    replay = incremental.next_increment(marks, "job", source, replay_from=2)
    assert replay.rows["mint"].count() == 1
    empty = {"mint": source["mint"].limit(0)}
    assert incremental.next_increment(marks, "other", empty).is_empty()


def test_a_run_that_dies_before_its_marks_is_repeated(spark, tmp_path):
    marks = incremental.Marks(spark, f"{tmp_path}/marks")
    target = f"{tmp_path}/out"
    source = {"mint": spark.range(5)}
    increment = incremental.next_increment(marks, "job", source)
    sinks.append_batch(increment.rows["mint"], target, increment.batch_id)  # and no commit
    incremental.run_increment(marks, "job", source, lambda d: d["mint"], target)
    assert spark.read.parquet(target).count() == 5


def test_supply_of_increments_is_merged(spark):
    mint = spark.createDataFrame(
        [(1, 1, 5), (2, 1, -2), (3, 2, 1)], "tx_id bigint, ident bigint, quantity bigint"
    )
    first, second = mint.filter("tx_id = 1"), mint.filter("tx_id > 1")
    merged = tokens.merge_token_supply(tokens.token_supply(first), tokens.token_supply(second))
    assert rows(merged) == rows(tokens.token_supply(mint))


def test_new_addresses_continue_the_ids(spark):
    _, _, tx_out = random_book(22).tables(spark)
    known = utxo.address_ids(tx_out.filter("tx_id <= 30")).cache()
    more = incremental.address_increment({"tx_out": tx_out}, known)
    every = known.unionByName(more)
    count = utxo.addresses(tx_out).count()
    assert sorted(r.id for r in every.collect()) == list(range(1, count + 1))


def test_blocks(spark):
    block = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id bigint, time bigint")
    register = spark.createDataFrame([(2,)], "block_id bigint")
    assert rows(incremental.unprocessed_blocks(block, register).select("id")) == [(1,), (3,)]
    # a block on a boundary is in exactly one window
    windows = [incremental.time_slice(block, a, b) for a, b in [(10, 20), (20, 31)]]
    assert [[r.id for r in w.orderBy("id").collect()] for w in windows] == [[1], [2, 3]]


def test_snapshot_cut_offs(spark):
    at = lambda text: f"unix_micros(timestamp '{text}')"
    block = spark.sql(
        f"select 1L as id, {at('2020-01-01')} as time union all select 2L, {at('2020-02-01')} "
        f"union all select 3L, {at('2020-03-01')} union all select 4L, {at('2020-06-15')}"
    )
    got = [(str(r.snapshot_ts), r.cut_off) for r in entity_state.snapshot_cut_offs(block, 1).collect()]
    assert sorted(got) == [
        ("2020-02-01 00:00:00", 1),
        ("2020-03-01 00:00:00", 2),
        ("2020-04-01 00:00:00", 3),
        ("2020-05-01 00:00:00", 3),
        ("2020-06-01 00:00:00", 3),
        ("2020-07-01 00:00:00", 4),
    ]


@pytest.mark.parametrize("months", [1, 4, 7])
@pytest.mark.parametrize("first", ["2019-10-31 13:00:00", "2020-02-29 00:00:00", "2020-01-01 00:00:00"])
def test_snapshot_cut_offs_equal_a_search_of_all_ends(spark, first, months):
    block = spark.sql(
        f"select id, unix_micros(timestamp '{first}') + id * 86400000000L + id % 5 * 3600000000L as time from range(900)"
    )
    got = entity_state.snapshot_cut_offs(block, months)
    step, at = f"make_ym_interval(0, {months})", "timestamp_micros(time)"
    block.createOrReplaceTempView("cut_off_blocks")
    want = spark.sql(
        f"with ends as (select explode(sequence(min({at}) + {step}, max({at}) + {step}, {step})) as e from cut_off_blocks) "
        f"select e, max(id) from ends left join cut_off_blocks on {at} < e group by e"
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_do_not_carry_all_ends(spark):
    block = spark.range(10).select("id", (F.col("id") * 10**13).alias("time"))
    text = entity_state.snapshot_cut_offs(block)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in text


def test_snapshot_metrics_are_replaced_not_doubled(spark, tmp_path):
    tx, tx_in, tx_out = random_book(23, transactions=25).tables(spark)
    for cut_off, day in [(3, "2020-05-01"), (6, "2020-09-01"), (6, "2020-09-01")]:
        entity_state.snapshot_metrics(spark, day, cut_off, tx, tx_in, tx_out, str(tmp_path))
    counts = spark.read.parquet(f"{tmp_path}/entity_counts")
    assert counts.count() == 2
    assert spark.read.parquet(f"{tmp_path}/balances").count() == 2
    late = counts.filter("snapshot_ts >= '2020-09-01'").first()
    assert late.no_addr == utxo.addresses(tx_out).count()


def write_in_files(df, path, column, files):
    for i in range(files):
        part = df.filter(F.col(column) % files == i).coalesce(1)
        part.write.mode("append").parquet(path)


def test_network_feed_equals_batch_and_restarts(spark, tmp_path):
    tx, tx_in, tx_out = random_book(24, transactions=40).tables(spark)
    source, target = f"{tmp_path}/in", f"{tmp_path}/network"
    write_in_files(tx_in, source, "id", 3)
    feed = lambda: feeds.network_feed(
        streams.file_stream(spark, source, "tx_in", files_per_batch=1),
        tx, tx_out, target, f"{tmp_path}/checkpoint",
    )
    feed()
    want = rows(utxo.transaction_network(tx, tx_in, tx_out))
    assert rows(spark.read.parquet(target).drop("batch_id")) == want
    feed()
    assert rows(spark.read.parquet(target).drop("batch_id")) == want


def test_other_feeds(spark, tmp_path):
    tx, tx_in, tx_out = random_book(25, transactions=30).tables(spark)
    outs, ins = f"{tmp_path}/outs", f"{tmp_path}/ins"
    fields = "id bigint, tx_id bigint, idx int, address string, value bigint"
    write_in_files(tx_out.select("id", "tx_id", "idx", "address", "value"), outs, "tx_id", 2)
    write_in_files(tx_in, ins, "tx_in_id", 2)
    stream = streams.file_stream(
        spark, outs, spark.createDataFrame([], fields).schema, files_per_batch=1
    )
    feeds.address_feed(stream, f"{tmp_path}/addresses", f"{tmp_path}/c1")
    addresses = spark.read.parquet(f"{tmp_path}/addresses").select("id", "address")
    count = utxo.addresses(tx_out).count()
    assert sorted(r.id for r in addresses.collect()) == list(range(1, count + 1))
    assert addresses.select("address").distinct().count() == count

    feeds.edge_feed(
        streams.file_stream(spark, ins, "tx_in", files_per_batch=1),
        tx, tx_out, addresses, str(tmp_path), f"{tmp_path}/c2",
    )
    edges = spark.read.parquet(f"{tmp_path}/edges/TRANSACTED_WITH")
    assert edges.count() == utxo.transaction_network(tx, tx_in, tx_out).count()

    mint = spark.createDataFrame([(i, i % 3, i) for i in range(9)], schema("ma_tx_mint"))
    write_in_files(mint, f"{tmp_path}/mint", "tx_id", 2)
    mints = streams.file_stream(spark, f"{tmp_path}/mint", "ma_tx_mint", files_per_batch=1)
    feeds.token_supply_feed(mints, f"{tmp_path}/supply", f"{tmp_path}/c3")
    supply = feeds.read_token_supply(spark.read.parquet(f"{tmp_path}/supply"))
    assert rows(supply) == rows(tokens.token_supply(mint))


def test_messages(spark, tmp_path):
    raw = spark.createDataFrame(
        [(bytearray(b"k"), bytearray(b'{"id": 5, "view": "p"}'), [("h", bytearray(b"x"))])],
        "key binary, value binary, headers array<struct<key: string, value: binary>>",
    )
    assert streams.message_values(raw).first().value == '{"id": 5, "view": "p"}'
    assert streams.messages_with_headers(raw).first().key == "k"
    assert rows(streams.parsed_messages(raw, schema("pool_hash"))) == [(5, "p")]
    dump = tmp_path / "dump.txt"
    dump.write_text("{'value': '{\"id\": 5, \"view\": \"p\"}'}\n")
    assert rows(tables.read_stream_dump(spark, str(dump), schema("pool_hash"))) == [(5, "p")]


def test_sources_and_sinks(spark, tmp_path):
    root = str(tmp_path)
    pools = tables.rows(spark, [(1, "a"), (2, "b")], "id bigint, view string")
    sinks.overwrite(pools, f"{root}/pool_hash", files=1)
    assert rows(tables.read_table(spark, root, "pool_hash", ["view"])) == [("a",), ("b",)]
    pools.coalesce(1).write.json(f"{root}/json")
    assert rows(tables.read_json(spark, f"{root}/json/*.json", "pool_hash")) == [(1, "a"), (2, "b")]
    assert tables.list_files(spark, f"{root}/json").count() == 1
    tables.register_views({"pools": pools})
    assert spark.sql("select max(id) from pools").first()[0] == 2

    network = utxo.network_pairs(*Book().pay(1, [("A", 1)]).pay(2, [("B", 1)], [(1, 0)]).tables(spark))
    for _ in range(2):
        sinks.write_network_csv(network, f"{root}/csv")
    assert rows(tables.read_network_csv(spark, f"{root}/csv")) == [("A", "B", "h2", 1e-6)]

    first = sinks.upsert_vertices(pools, root, "Pool", "id", 0)
    more = pools.unionByName(tables.rows(spark, [(3, "c")], "id bigint, view string"))
    second = sinks.upsert_vertices(more, root, "Pool", "id", 1)
    assert (first.count(), second.count()) == (2, 1)
    vertices = tables.read_vertices(spark, root, "Pool")
    assert vertices.count() == 3

    edges = tables.rows(spark, [(1, 2, None), (1, 9, 5)], "src bigint, dst bigint, amount bigint")
    for batch in (0, 1):
        sinks.write_edges(edges, vertices, root, "PAYS", batch)
    assert spark.read.parquet(f"{root}/edges/PAYS").count() == 1
    assert len(sinks.to_pandas(pools, 1)) == 1
    sinks.show(pools)


def test_event_windows_drop_and_count_late_rows(spark, tmp_path):
    """Each run is a batch; a day is closed once the latest event is two days past its end."""
    batches = [
        [("2024-01-01 10:00", "a"), ("2024-01-02 09:00", "b")],
        [("2024-01-01 11:00", "a"), ("2024-01-05 12:00", "a")],
        # days up to the 2nd are closed now, the 3rd is not
        [("2024-01-01 23:00", "a"), ("2024-01-02 23:00", "b"), ("2024-01-03 01:00", "b")],
        [("2024-01-09 00:00", "a"), ("2024-01-03 02:00", "b")],
    ]
    events = None
    for batch in batches:
        rows_of = spark.createDataFrame(batch, "ts string, event_type string").selectExpr(
            "cast(ts as timestamp) as ts", "event_type"
        )
        rows_of.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        events = spark.read.parquet(f"{tmp_path}/events")
        stream = streams.file_stream(spark, f"{tmp_path}/events", events.schema)
        event_windows.window_feed(stream, f"{tmp_path}/windows", f"{tmp_path}/checkpoint")
    counts = event_windows.read_window_counts(spark.read.parquet(f"{tmp_path}/windows"))
    got = [(r.window_start.strftime("%d"), r.event_type, r.events) for r in counts.collect()]
    assert sorted(got) == [("01", "a", 2), ("02", "b", 1), ("03", "b", 2), ("05", "a", 1), ("09", "a", 1)]
    assert rows(event_windows.late_events(events, counts)) == [("a", 1), ("b", 1)]


def test_stored_rows_are_compared_only_where_a_batch_may_repeat_them(spark, tmp_path):
    root = str(tmp_path / "graph")
    fields = "src bigint, dst bigint, tx_id bigint, tx_hash string"
    first = spark.createDataFrame([(1, 2, 10, "a"), (1, 3, 10, None), (2, 3, 11, "b")], fields)
    again = spark.createDataFrame([(1, 2, 10, "a"), (1, 3, 10, None), (1, 4, 10, "a"), (2, 3, 12, "b")], fields)
    for batch_id, edges in enumerate((first, again, again)):
        group = edges.select("tx_id").distinct()
        sinks.write_edges(edges, None, root, "PAYS", batch_id, group=group)
    stored = spark.read.parquet(f"{root}/edges/PAYS")
    assert sorted(r.batch_id for r in stored.collect()) == [0, 0, 0, 1, 1]
    # a retry of a batch doesn't see its own rows
    sinks.write_edges(again, None, root, "PAYS", 1, group=again.select("tx_id").distinct())
    assert spark.read.parquet(f"{root}/edges/PAYS").count() == 5
    assert sinks.rows_of(first, again.select("tx_id").distinct()).count() == 2
