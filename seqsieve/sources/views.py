"""Views over the given tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from seqsieve.functions.constants import SITES, WILD_TYPE

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _variants(source: str, key: str, value: str, below: str) -> str:
    """Sequences that differ from the wild type at a site where a hex digit of the key's md5 is below a bound."""
    pieces, at = [], 1
    for i, site in enumerate(SITES):
        if site > at:
            pieces.append(f"'{WILD_TYPE[at - 1 : site - 1]}'")
        pieces.append(f"CASE WHEN substr(h, {i + 14}, 1) < '{below}' THEN translate(substr(h, {i + 1}, 1), '0123456789abcdef', 'ACGUACGUACGUACGU') ELSE '{WILD_TYPE[site - 1]}' END")
        at = site + 1
    pieces.append(f"'{WILD_TYPE[at - 1 :]}'")
    return f"SELECT {key} AS cand_id, concat({', '.join(pieces)}) AS sequence, {value} AS y FROM (SELECT {key}, {value}, md5(CAST({key} AS VARCHAR(20))) AS h FROM {source}) q"


VIEWS = {
    "variants": _variants("part", "p_partkey", "p_retailprice", "4"),
    "dense_variants": _variants("orders", "o_orderkey", "o_totalprice", "c"),
    "patterned": "SELECT cand_id, sequence, y, concat(substr(sequence, 30, 4), substr(sequence, 89, 4), substr(sequence, 127, 5)) AS pattern FROM variants",
    "labelled": "SELECT * FROM patterned WHERE substr(md5(concat('1:', CAST(cand_id AS VARCHAR(20)))), 1, 1) < '5'",
    "pool": "SELECT * FROM patterned WHERE substr(md5(concat('1:', CAST(cand_id AS VARCHAR(20)))), 1, 1) >= '5'",
    "preds": "SELECT l_suppkey % 10 AS seed, l_returnflag AS model, l_orderkey * 8 + l_linenumber AS id, min(CAST(l_extendedprice AS DOUBLE)) AS truth, min(CAST(l_quantity AS DOUBLE)) AS pred FROM lineitem GROUP BY l_suppkey % 10, l_returnflag, l_orderkey * 8 + l_linenumber",
    "metrics": "SELECT l_suppkey AS seed, l_returnflag AS method, l_linestatus AS model, round(avg(CAST(l_discount AS DOUBLE)), 6) AS value FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linestatus",
    "runs": "SELECT o_custkey % 30 AS seed, o_orderstatus AS strategy, year(o_orderdate) AS round, min(CAST(o_totalprice AS DOUBLE)) AS best FROM orders GROUP BY o_custkey % 30, o_orderstatus, year(o_orderdate)",
    "archive": "SELECT user_id AS search_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call_no, event_id AS id, CAST(value AS DOUBLE) AS pred, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events",
    "manifest": "SELECT concat(source, '/', CAST(doc_id AS VARCHAR(20))) AS path, source AS root_name, n_chars AS size_bytes, md5(text) AS digest, lang FROM documents",
    "selected": "SELECT DISTINCT l_suppkey AS seed, l_returnflag AS method, l_linenumber AS feature FROM lineitem WHERE l_quantity > 45",
    "returns": """SELECT cand_id AS ord, concat('b', CAST(cand_id % 7 AS VARCHAR(20))) AS batch_id,
        CASE WHEN substr(h, 1, 1) = '0' THEN 'x' ELSE '' END || substr(md5(sequence), 1, 16) AS candidate_id,
        CASE WHEN substr(h, 2, 1) = '0' THEN NULL ELSE sequence END AS sequence,
        CASE WHEN substr(h, 3, 1) < '2' THEN NULL ELSE CAST(y AS DOUBLE) END AS measured,
        CASE WHEN substr(h, 4, 1) < 'a' THEN 'pass' WHEN substr(h, 4, 1) < 'd' THEN 'fail' WHEN substr(h, 4, 1) < 'e' THEN 'pending' WHEN substr(h, 4, 1) < 'f' THEN 'bad' ELSE NULL END AS status,
        CASE WHEN substr(h, 5, 1) < '1' THEN NULL WHEN substr(h, 5, 1) < '2' THEN 'p9' ELSE 'p1' END AS protocol_id
        FROM (SELECT *, md5(concat('r', CAST(cand_id AS VARCHAR(20)))) AS h FROM variants) q""",
    "batches": "SELECT DISTINCT concat('b', CAST(cand_id % 7 AS VARCHAR(20))) AS batch_id, substr(md5(sequence), 1, 16) AS candidate_id, sequence FROM variants WHERE cand_id % 7 < 6 AND substr(md5(concat('k', CAST(cand_id AS VARCHAR(20)))), 1, 1) < 'e'",
    "scores": "SELECT l_suppkey % 10 AS seed, l_orderkey * 8 + l_linenumber AS id, min(CAST(l_quantity AS DOUBLE)) AS a, min(CAST(l_extendedprice AS DOUBLE)) AS b, min(CAST(l_discount AS DOUBLE)) AS c, min(CAST(l_tax AS DOUBLE)) AS d FROM lineitem GROUP BY l_suppkey % 10, l_orderkey * 8 + l_linenumber",
    "features": "SELECT l_orderkey * 8 + l_linenumber AS id, min(CAST(l_quantity AS DOUBLE)) AS f_quantity, min(CAST(l_discount AS DOUBLE)) AS f_discount, min(CAST(l_tax AS DOUBLE)) AS f_tax, min(CAST(l_linenumber AS DOUBLE)) AS f_line, min(CAST(l_suppkey % 100 AS DOUBLE)) AS f_supplier, min(2000 * CAST(l_quantity AS DOUBLE)) + min(CAST(l_extendedprice AS DOUBLE)) / 10 + min(CAST(l_linenumber AS DOUBLE)) * 300 AS y FROM lineitem GROUP BY l_orderkey * 8 + l_linenumber",
    "events_long": "SELECT event_id, user_id, event_type, ts, CAST(value AS DOUBLE) AS value FROM events",
    "ensemble": "SELECT l_orderkey AS id, l_linenumber AS member, min(CAST(l_extendedprice AS DOUBLE)) AS pred FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "measurements": "SELECT o_custkey AS key_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS replica_id, CAST(o_totalprice AS DOUBLE) AS value FROM orders",
}


#: Views whose rows cost far more than their bytes, with the table and its key: a small file would make one task of them.
SPREAD = {"variants": ("part", "p_partkey"), "dense_variants": ("orders", "o_orderkey")}


def names_in(sql: str) -> set[str]:
    return set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one of VIEWS as a DataFrame; no temporary view is left in the session."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    needs = sorted(names_in(sql) & {*TABLES, *VIEWS})
    text = sql.replace("{", "{{").replace("}", "}}")
    for n in needs:
        text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
    given = {n: view(spark, sf_dir, n) for n in needs}
    if name in SPREAD:
        table, key = SPREAD[name]
        given[table] = given[table].repartition(2 * spark.sparkContext.defaultParallelism, key)
    return spark.sql(text, **given)


def with_views(body: str) -> str:
    """body for DuckDB, led by the views that it reads."""
    order: list[str] = []

    def add(sql: str) -> None:
        for n in sorted(names_in(sql) & set(VIEWS)):
            if n not in order:
                add(VIEWS[n])
                order.append(n)

    add(body)
    if not order:
        return body
    heads = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    rest, start = body.strip(), "WITH"
    if rest.upper().startswith("WITH RECURSIVE"):
        rest, start = f"WITH {rest[14:]}", "WITH RECURSIVE"
    return f"{start} {heads}" + (f",\n{rest[5:]}" if rest.upper().startswith("WITH ") else f"\n{rest}")
