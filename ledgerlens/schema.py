"""Tables of the event stream as DDL, one per kind of message. Unsigned 64-bit amounts are DECIMAL(20, 0)."""

from __future__ import annotations

ACCOUNTS = (
    "slot long, is_startup boolean, pubkey binary, lamports decimal(20,0), owner binary, executable boolean,"
    " rent_epoch decimal(20,0), data binary, write_version long, txn_signature binary, created_at timestamp"
)
SLOTS = ("slot long, parent long, status string, dead_error string, created_at timestamp")
ENTRIES = (
    "slot long, idx long, num_hashes long, hash binary, executed_transaction_count long,"
    " starting_transaction_index long, created_at timestamp"
)
_REWARD = "struct<pubkey: string, lamports: long, post_balance: decimal(20,0), reward_type: string, commission: string>"
BLOCK_META = (
    "slot long, blockhash string, parent_slot long, parent_blockhash string, block_time long, block_height long,"
    f" executed_transaction_count long, entries_count long, rewards array<{_REWARD}>, num_partitions long,"
    " created_at timestamp"
)
_INSTRUCTION = "struct<program_id_index: long, accounts: binary, data: binary>"
_BALANCE = (
    "struct<account_index: long, mint: string, owner: string, program_id: string, ui_amount: double,"
    " decimals: long, amount: string, ui_amount_string: string>"
)
_META = (
    "struct<err: binary, fee: decimal(20,0), pre_balances: array<decimal(20,0)>, post_balances: array<decimal(20,0)>,"
    f" inner_instructions: array<struct<idx: long, instructions: array<{_INSTRUCTION}>>>, log_messages: array<string>,"
    f" pre_token_balances: array<{_BALANCE}>, post_token_balances: array<{_BALANCE}>, rewards: array<{_REWARD}>,"
    " loaded_writable: array<binary>, loaded_readonly: array<binary>, return_program: binary, return_data: binary,"
    " compute_units_consumed: decimal(20,0), cost_units: decimal(20,0)>"
)
TRANSACTIONS = (
    "slot long, idx long, is_vote boolean, signatures array<binary>, recent_blockhash binary,"
    f" static_keys array<binary>, instructions array<{_INSTRUCTION}>, versioned boolean, meta {_META}, created_at timestamp"
)
DESHRED = (
    "slot long, signature binary, is_vote boolean, static_keys array<binary>, loaded_writable array<binary>,"
    " loaded_readonly array<binary>, first_shred long, last_shred long, created_at timestamp"
)

KINDS = {
    "accounts": ACCOUNTS,
    "slots": SLOTS,
    "transactions": TRANSACTIONS,
    "entries": ENTRIES,
    "block_meta": BLOCK_META,
    "deshred": DESHRED,
}

# Commitment levels in order, and the statuses of a slot's life besides them.
COMMITMENTS = ("processed", "confirmed", "finalized")
LIFECYCLE = ("first_shread_received", "completed", "created_bank", "dead")
