"""A small shop whose rows follow from seeds: orders in three layouts and by month, customers, countries.

The number of rows is that of a demonstration (20,000 orders), so they are drawn in this process and
written with PyArrow, which can fix row groups, pages and dictionaries; Spark only reads them.
"""

from __future__ import annotations

import datetime
import json
import os
import random
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.parquet as pq

from quern.sources.manifest import bounds_of

# Results on these tables are published, so seeds, domains and the order of draws must not change.
ORDERS = 20_000
CUSTOMERS = 1_000
ROWS_A_GROUP = 2_000
ORDER_SEED, SHUFFLE_SEED, CUSTOMER_SEED = 20240101, 20240102, 20240102
FIRST_ORDER, YEAR = datetime.date(2024, 1, 1), 366
FIRST_SIGNUP, SIGNUP_DAYS = datetime.date(2019, 1, 1), 5 * 365
ZIPF = 1.1
STATUS_WEIGHTS = {"shipped": 70, "delivered": 20, "returned": 6, "cancelled": 3, "pending": 1}
NOTE_WORDS = [
    "fragile", "gift", "leave", "with", "neighbour", "call", "before", "delivery", "rear", "door",
    "urgent", "reorder", "same", "as", "last", "time", "no", "invoice", "please", "wrap",
]
SEGMENTS = ["consumer", "small business", "enterprise", "public sector"]
COUNTRIES = ["DE", "FR", "UK", "US", "PL", "SE", "ES", "IT", "NL", "JP", "BR", "IN"]
COUNTRY_NAMES = {
    "DE": "Germany", "FR": "France", "UK": "United Kingdom", "US": "United States", "PL": "Poland", "SE": "Sweden",
    "ES": "Spain", "IT": "Italy", "NL": "Netherlands", "JP": "Japan", "BR": "Brazil", "IN": "India",
}
REGIONS = {"US": "Americas", "BR": "Americas", "JP": "Asia", "IN": "Asia"}
OTHER_REGION = "Europe"
PAGED_DICTIONARIES = ["order_date", "customer_id", "status", "quantity"]
PAGE_BYTES = 1024


def _fields(nullable: set[str] = frozenset(), **types: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field(n, t, n in nullable) for n, t in types.items()])


def _table(rows: Iterator[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _sales(n: int) -> Iterator[tuple]:
    r = random.Random(ORDER_SEED)
    buyers, states = range(1, CUSTOMERS + 1), list(STATUS_WEIGHTS)
    by_buyer, by_state = list(accumulate(1 / k**ZIPF for k in buyers)), list(accumulate(STATUS_WEIGHTS.values()))
    for nth in range(n):
        [who], [state] = r.choices(buyers, cum_weights=by_buyer), r.choices(states, cum_weights=by_state)
        pieces = r.randint(1, 10)
        paid = round(pieces * r.uniform(2.0, 250.0), 2)
        bare = r.random() < 0.15
        note = None if bare else " ".join(r.choices(NOTE_WORDS, k=r.randint(2, 6)))
        yield nth + 1, FIRST_ORDER + datetime.timedelta(nth * YEAR // n), who, state, pieces, paid, note


def orders(n: int = ORDERS) -> pa.Table:
    """Orders by date: most come from a few customers; dates spread evenly over the year."""
    i32, text = pa.int32(), pa.string()
    shape = _fields({"note"}, order_id=pa.int64(), order_date=pa.date32(), customer_id=i32, status=text, quantity=i32, amount=pa.float64(), note=text)
    return _table(_sales(n), shape)


def shuffled(t: pa.Table) -> pa.Table:
    places = list(range(t.num_rows))
    random.Random(SHUFFLE_SEED).shuffle(places)
    return t.take(places)


def customers() -> pa.Table:
    r = random.Random(CUSTOMER_SEED)
    homes = [r.choice(COUNTRIES) for _ in range(CUSTOMERS)]
    segments = [r.choice(SEGMENTS) for _ in homes]
    since = [FIRST_SIGNUP + datetime.timedelta(r.randrange(SIGNUP_DAYS)) for _ in homes]
    ids = range(1, CUSTOMERS + 1)
    shape = _fields(customer_id=pa.int32(), name=pa.string(), country=pa.string(), segment=pa.string(), signup_date=pa.date32())
    return _table(zip(ids, (f"customer {k:04d}" for k in ids), homes, segments, since, strict=True), shape)


def countries() -> pa.Table:
    return _table(((c, COUNTRY_NAMES[c], REGIONS.get(c, OTHER_REGION)) for c in COUNTRIES), _fields(country=pa.string(), name=pa.string(), region=pa.string()))


def write_months(t: pa.Table, root: str) -> None:
    """month=YYYY-MM/part-0.parquet and metadata.json, which lists files with bounds of every column."""
    months = [d.strftime("%Y-%m") for d in t.column("order_date").to_pylist()]
    files = []
    for month in sorted(set(months)):
        name = f"month={month}/part-0.parquet"
        at = os.path.join(root, name)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        part = t.filter(pa.array([m == month for m in months]))
        pq.write_table(part, at, row_group_size=part.num_rows)
        files.append({"path": name, "partition": {"month": month}, "rows": part.num_rows, "bytes": os.path.getsize(at), "bounds": bounds_of(part)})
    about = {"table": os.path.basename(root), "schema": [f"{f.name}: {f.type}" for f in t.schema], "files": files}
    with open(os.path.join(root, "metadata.json"), "w", encoding="utf-8") as f:
        json.dump(about, f, separators=(",", ":"))


def write_all(root: str, n: int = ORDERS) -> None:
    """All tables under one folder of this machine, or one that is mounted everywhere."""
    os.makedirs(root, exist_ok=True)
    sales = orders(n)
    grouped = {"row_group_size": ROWS_A_GROUP}
    paged = {"row_group_size": n, "write_page_index": True, "data_page_size": PAGE_BYTES, "use_dictionary": PAGED_DICTIONARIES}
    for name, t, how in (
        ("orders-sorted", sales, grouped),
        ("orders-shuffled", shuffled(sales), grouped),
        ("orders-paged", sales, paged),
        ("customers", customers(), grouped),
        ("countries", countries(), grouped),
    ):
        pq.write_table(t, os.path.join(root, f"{name}.parquet"), **how)
    write_months(sales, os.path.join(root, "orders-by-month"))
