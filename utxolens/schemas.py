"""Explicit schemas of every ledger table; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "tx": (
        "id bigint, hash string, block_id bigint, out_sum decimal(38,0), fee bigint, "
        "deposit bigint, size int, script_size int, valid_contract boolean, "
        "invalid_before bigint, invalid_hereafter bigint"
    ),
    "tx_in": (
        "id bigint, tx_in_id bigint, tx_out_id bigint, tx_out_index int, redeemer_id bigint"
    ),
    "tx_out": (
        "id bigint, tx_id bigint, idx int, address string, address_raw string, "
        "address_has_script boolean, payment_cred string, stake_address_id bigint, "
        "data_hash string, inline_datum_id bigint, reference_script_id bigint, value bigint"
    ),
    "block": (
        "id bigint, hash string, block_no bigint, epoch_no bigint, slot_no bigint, "
        "tx_count bigint, time bigint, slot_leader_id bigint"
    ),
    "slot_leader": "id bigint, pool_hash_id bigint",
    "pool_hash": "id bigint, view string",
    "stake_address": "id bigint, view string",
    "reward": (
        "id bigint, addr_id bigint, pool_id bigint, earned_epoch bigint, "
        "amount bigint, type string"
    ),
    "withdrawal": "id bigint, addr_id bigint, amount bigint, tx_id bigint",
    "treasury": "id bigint, addr_id bigint, amount bigint",
    "redeemer": (
        "id bigint, tx_id bigint, script_hash string, unit_mem bigint, "
        "unit_steps bigint, fee bigint, datum_id bigint"
    ),
    "script": "hash string, tx_id bigint, type string",
    "datum": "id bigint, tx_id bigint",
    "multi_asset": "id bigint, fingerprint string, policy string, name string",
    "ma_tx_mint": "tx_id bigint, ident bigint, quantity bigint",
    "ma_tx_out": "tx_out_id bigint, ident bigint, quantity bigint",
    "tx_metadata": "tx_id bigint, key bigint",
    # refined tables
    "transaction_network": (
        "tx_hash string, input_addr string, output_addr string, "
        "input_ADA_value double, output_ADA_value double"
    ),
    "addresses": "id bigint, address string",
    "entities": "address string, entity_id bigint",
    # network text export
    "network_csv": "input string, output string, tx_hash string, ADA_value double",
    # stream envelope
    "message": (
        "key string, value string, headers array<struct<key: string, value: binary>>"
    ),
}


def ddl(table: str) -> str:
    """Schema of one table as text, usable before there is a session."""
    return _DDL[table]


def schema(table: str, columns: list[str] | None = None) -> StructType:
    """Schema of one table, narrowed to ``columns`` when given."""
    full = StructType.fromDDL(_DDL[table])
    if columns is None:
        return full
    return StructType([full[name] for name in columns])


def table_names() -> list[str]:
    return list(_DDL)
