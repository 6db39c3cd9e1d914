"""The volumes once more, as self-joins in DuckDB over any payment rows."""

from collections import Counter

import duckdb

from limitline.oracle import _volumes

COLUMNS = {
    "user_id": "bigint", "t": "timestamp", "currency": "varchar", "product": "varchar",
    "recipient": "bigint", "risk_level": "varchar", "eur": "decimal(18,8)",
    "has_us": "boolean", "tw": "boolean",
}


def self_join(rows, form):
    """Distinct rows of one of the forms grouped, linked, linked_window, user_window."""
    db = duckdb.connect()
    db.execute(f"create table pay ({', '.join(f'{c} {t}' for c, t in COLUMNS.items())})")
    for r in rows:
        db.execute(
            f"insert into pay values ({', '.join('?' * len(COLUMNS))})",
            (r[0], r[2], r[3], r[4], r[5], r[6], r[7], r[8], r[9]),
        )
    return Counter(db.execute(_volumes("v", "pay")[f"v_{form}"]).fetchall())


def spark_rows(df):
    return Counter(tuple(r) for r in df.collect())
