"""Common table expressions for DuckDB: requests, classified requests, the ledger and the replies."""

from __future__ import annotations

RETRY = 1_000_000_000_000

ORIGINALS = """
e0 AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) AS tm, CAST(round(coalesce(value, 0.0) * 100) AS BIGINT) AS cents FROM events
), e1 AS (
  SELECT *, CASE WHEN event_id % 29 = 0 THEN 0 ELSE cents END AS own FROM e0
), e2 AS (
  SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN {'tx': event_id, 'tm': tm, 'amount': own} END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target FROM e1
), originals AS (
  SELECT event_id AS arrival_ord, user_id AS account_id, event_id AS tx_id, tm AS transaction_at,
    CASE event_type WHEN 'purchase' THEN 'debit' WHEN 'error' THEN 'refund' ELSE 'credit' END AS operation,
    CASE WHEN event_type <> 'error' THEN own WHEN event_id % 29 = 0 THEN 0 WHEN target IS NULL THEN cents
         ELSE target.amount + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END END AS amount,
    CASE WHEN event_type = 'error' AND target IS NOT NULL THEN user_id END AS refund_account,
    CASE WHEN event_type = 'error' THEN target.tx END AS refund_tx,
    CASE WHEN event_type = 'error' THEN target.tm END AS refund_at
  FROM e2
)"""

REQUESTS = (
    ORIGINALS
    + f""", requests AS (
  SELECT * FROM originals
  UNION ALL SELECT * REPLACE (arrival_ord + {RETRY} AS arrival_ord) FROM originals WHERE arrival_ord % 17 = 0
  UNION ALL SELECT * REPLACE (arrival_ord + {2 * RETRY} AS arrival_ord, amount + 1 AS amount) FROM originals WHERE arrival_ord % 19 = 0
)"""
)

CLASSIFIED = (
    REQUESTS
    + """, firsts AS (
  SELECT *, account_id % 4 AS shard_id,
    first_value(arrival_ord) OVER w AS first_ord,
    first_value({'o': operation, 'a': amount, 'x': refund_account, 'y': refund_tx, 'z': refund_at}) OVER w AS body
  FROM requests WINDOW w AS (PARTITION BY account_id, tx_id, transaction_at ORDER BY arrival_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), classified AS (
  SELECT * EXCLUDE (body), CASE WHEN first_ord = arrival_ord THEN 'new'
    WHEN body IS NOT DISTINCT FROM {'o': operation, 'a': amount, 'x': refund_account, 'y': refund_tx, 'z': refund_at} THEN 'replay' ELSE 'conflict' END AS kind
  FROM firsts
)"""
)

_FOLD = """, n AS (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY arrival_ord) AS rn FROM {rows}
), fold AS (
  SELECT DISTINCT account_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS balance, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS arrival_ord,
    CAST([] AS BIGINT[]) AS ids, CAST([] AS BIGINT[]) AS amounts, CAST([] AS BIGINT[]) AS used FROM n
  UNION ALL
  SELECT account_id, rn,
    balance + CASE WHEN st <> 'applied' THEN 0 WHEN operation = 'debit' THEN -amount ELSE amount END, st, ord,
    CASE WHEN st = 'applied' AND operation = 'debit' THEN list_append(ids, tx_id) ELSE ids END,
    CASE WHEN st = 'applied' AND operation = 'debit' THEN list_append(amounts, amount) ELSE amounts END,
    CASE WHEN st = 'applied' AND operation = 'refund' THEN list_append(used, refund_tx) ELSE used END
  FROM (
    SELECT n.account_id, n.rn, n.arrival_ord AS ord, n.operation, n.amount, n.tx_id, n.refund_tx, f.balance, f.ids, f.amounts, f.used,
      CASE WHEN n.amount = 0 THEN 'invalid_amount'
        WHEN n.operation = 'credit' THEN 'applied'
        WHEN n.operation = 'debit' THEN CASE WHEN f.balance >= n.amount THEN 'applied' ELSE 'insufficient_funds' END
        WHEN n.refund_tx IS NULL OR NOT list_contains(f.ids, n.refund_tx) THEN 'invalid_refund'
        WHEN f.amounts[list_position(f.ids, n.refund_tx)] <> n.amount THEN 'invalid_refund'
        WHEN list_contains(f.used, n.refund_tx) THEN 'refund_already_used'
        ELSE 'applied' END AS st
    FROM fold f JOIN n ON n.account_id = f.account_id AND n.rn = f.rn + 1
  )
)"""

LEDGER = (
    CLASSIFIED
    + ", fresh AS (SELECT * FROM classified WHERE kind = 'new')"
    + _FOLD.replace("{rows}", "fresh")
    + """, seqs AS (
  SELECT *, CAST(sum(CASE WHEN kind = 'new' THEN 1 ELSE 0 END) OVER (PARTITION BY shard_id ORDER BY arrival_ord) AS BIGINT) AS sq FROM classified
), ledger AS (
  SELECT CAST(s.shard_id AS INTEGER) AS shard_id, s.sq AS seq, s.arrival_ord, s.account_id, s.tx_id, s.transaction_at, s.operation, s.amount,
    s.refund_account, s.refund_tx, s.refund_at, f.status, f.balance
  FROM seqs s JOIN fold f ON f.arrival_ord = s.arrival_ord WHERE s.kind = 'new'
)"""
)

WALLET = (
    CLASSIFIED
    + ", fresh AS (SELECT * FROM classified WHERE kind = 'new' AND operation <> 'refund')"
    + _FOLD.replace("{rows}", "fresh")
)


def over(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"
