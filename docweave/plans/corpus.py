"""Corpora that queries run over: real tables, and a Markdown site derived from orders and customers.

The site is one deterministic SQL expression that both engines read, so operators on Markdown can be compared
with an oracle at any scale factor. Defects are placed by the order key's remainders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shipping import ship

#: Lines of an order's page: an SQL condition on k (order key) and c (customer key), and an SQL string.
_LINES: list[tuple[str | None, str]] = [
    (None, "CASE WHEN k % 97 = 0 THEN '----' ELSE '---' END"),
    (None, "concat('title: Order ', k)"),
    ("k % 5 <> 0", "concat('status: ', CASE WHEN k % 3 = 0 THEN 'open' WHEN k % 3 = 1 THEN 'done' ELSE 'lost' END)"),
    ("k % 31 = 0", "'internal: yes'"),
    (None, "'---'"),
    ("k % 29 = 0", "'<!-- docweave:ignore Z601 -->'"),
    (None, "concat('# Order ', k)"),
    (None, "''"),
    (None, "concat('See [customer](../cust/', c % 60, '.md#s', k % 4, ') and [next](', k - k % 8 + (k + 1) % 8, '.md).')"),
    ("k % 13 = 0", "'# Second title'"),
    (None, "CASE WHEN k % 11 = 0 THEN '#### Details' ELSE '## Details' END"),
    (None, "'The parcel was packed by hand and is checked at the gate.'"),
    (None, "CASE WHEN k % 7 = 0 THEN '## Notes:' ELSE '## Notes' END"),
    ("k % 12 <> 0", "concat('Note ', k % 10, ' was written by the clerk.')"),
    ("k % 9 = 0", "'##  details {#d2}'"),
    ("k % 9 = 0", "'More details were given.'"),
    (None, "'## Code'"),
    (None, "CASE WHEN k % 2 = 0 THEN '```' ELSE '```json' END"),
    (None, "CASE WHEN k % 25 = 1 THEN '{\"a\": }' ELSE '{\"a\": 1}' END"),
    ("k % 2 = 0", "'# not a heading'"),
    (None, "'```'"),
    (None, "CASE WHEN k % 6 = 0 THEN '![](../img/a.png)' WHEN k % 6 = 1 THEN concat('![screenshot 2](../img/b', k % 5, '.png)') ELSE '![Chart of orders](../img/c.png)' END"),
    ("k % 10 = 0", "concat('Visit https://example.com/p', k % 3, '. Or <https://example.com/q> now.')"),
    ("k % 8 = 0", "'TODO write this part. FIXME soon.'"),
    ("k % 28 = 0", "'OldBrand is a trademark. <!-- docweave:ignore Z601 -->'"),
    ("k % 27 = 0", "'OldBrand sells this.'"),
    ("k % 20 = 0", "'Read [abs](/etc/passwd) or [site](/home.md).'"),
    ("k % 21 = 0", "'Go [up](../../../secret.md).'"),
    ("k % 22 = 0", "'An [](../cust/1.md) empty label and [details](#details).'"),
    (None, "'A [guide][ref1] is linked.'"),
    ("k % 23 = 0", "'The [gone][missing] one.'"),
    (None, "''"),
    (None, "'[ref1]: https://docs.example.com/a'"),
    ("k % 19 = 0", "'[REF1]: https://other.example.org/b'"),
    ("k % 17 = 0", "'[unused]: ../cust/1.md'"),
    ("k % 14 = 0", "'<a href=\"#\" onclick=\"go()\" foo=\"1\">x</a>'"),
    ("k % 15 = 0", "'<a class=\"k\">none</a>'"),
    ("k % 16 = 0", "'<a href=\"mailto:x@example.com\">m</a>'"),
    ("k % 18 = 0", "'<a href=\"java&#x73;cript:1\">j</a> <img src=\"../img/a.png\">'"),
    ("k % 24 = 0", "concat('first part;', {n}, 'second part;', {n}, 'third part;', {n}, 'the end.')"),
    ("k % 26 = 0", "concat(repeat('word ', 41 + k % 3), 'end. Short one.')"),
    ("k % 39 = 0", "concat('openai sk-', repeat('aB3', 16), ' github ghp_', repeat('x9', 12), ' gitlab glpat-', repeat('q_-', 8))"),
    ("k % 41 = 0", "concat('stripe sk_live_', repeat('4eC', 8), ' slack xoxb-', repeat('12-', 5), ' google AIza', repeat('Sy_-9', 7))"),
    ("k % 43 = 0", "concat('-----BEGIN RSA PRIVATE', ' KEY----- and ', chr(92), 'x41', chr(92), 'x42', chr(92), 'x43')"),
    ("k % 46 = 0", "concat('split \"AKIA\" + \"ABCDEFGHIJKLMNOP\" and `glpat-`', repeat('w', 20))"),
    ("k % 47 = 0", "concat('over AKIA12345678', {n}, '90ABCDEF two lines')"),
    ("k % 33 = 0", "concat('key AKIA', 'ABCDEFGHIJKLMN', lpad(cast(k % 90 + 10 AS {s}), 2, '0'), ' leaked')"),
    ("k % 34 = 0", "'<a href=\"b.md\" data-route=\"r\" DATA-x=\"1\" aria-label=\"l\" download=\"d\">o</a>'"),
    ("k % 35 = 0", "concat('<!-- hidden [x](gone.md)', {n}, 'still [y](gone.md) --> seen [z](none.md)')"),
    ("k % 37 = 0", "'A [ref1] and [unused] by shortcut.'"),
    (None, "'This is very simple, basically.'"),
]
_CUST = [
    "concat('# Customer ', n)",
    "'## S0'",
    "CASE WHEN n = 49 THEN 'No way out.' ELSE concat('Go to [a](', (n * 7 + 1) % 60, '.md) and [b](', (n * 3) % 50, '.md#s1).') END",
    "'## S1'",
    "CASE WHEN n % 10 = 9 THEN 'Nothing [here] or there.' ELSE concat('Back to [home](../index.md) and [order](../orders/', n * 8, '.md).') END",
    "'## S2'",
    "'The end of it.'",
]


def site_sql(dialect: str) -> str:
    """SELECT of (doc_path, text) for ``spark`` or ``duckdb``."""
    nl, kind = ("'\\n'", "STRING") if dialect == "spark" else ("chr(10)", "VARCHAR")

    def page(lines):
        parts = []
        for i, (cond, text) in enumerate(lines):
            text = text.replace("{n}", nl).replace("{s}", kind)
            line = text if i == 0 else f"concat({nl}, {text})"
            parts.append(line if cond is None else f"CASE WHEN {cond} THEN {line} ELSE '' END")
        return "concat(" + ", ".join(parts) + ")"

    numbers = "SELECT explode(sequence(0, 49)) AS n" if dialect == "spark" else "SELECT unnest(range(0, 50)) AS n"
    return f"""SELECT concat('orders/', k, '.md') AS doc_path, {page(_LINES)} AS text FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders) o
UNION ALL SELECT concat('cust/', n, '.md'), {page([(None, x) for x in _CUST])} FROM ({numbers}) m
UNION ALL SELECT 'index.md', concat('# Home', {nl}, 'Start at [one](cust/1.md) or [two](cust/2.md).', {nl}, '![Logo](img/logo.png)')"""


#: Pages of the site that one task makes, of about 800 bytes each from two numbers.
PAGES = 20_000


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_path, text) of the derived Markdown site.

    Orders are a hundredth of the text that is made of them, so a file's splits say nothing of the work: keys are dealt out by their number.
    """
    ship(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    orders.repartition(orders.count() // PAGES + 1, "o_orderkey").createOrReplaceTempView("docweave_orders")
    return spark.sql(site_sql("spark").replace("FROM orders)", "FROM docweave_orders)"))


#: Assets of the site, entry points of its navigation, and the tables of codes and policies live with the queries.
ASSETS = ["img/a.png", "img/b0.png", "img/b1.png", "img/b2.png", "img/c.png", "img/logo.png", "img/never.png", "files/data.zip"]
