"""Derived inputs: tables of legal text, messages, files, a checklist, a graph and run logs made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.functions.shared import dealt, spread

LEGAL = """
select o_orderkey as doc_no, concat('room-', o_custkey % 4) as store, concat('order_', o_orderkey, '.txt') as source,
  concat('THIS SERVICES AGREEMENT ("Agreement") is made between ',
    split_part('Summit,Harbor,Cedar,Granite,Bluewater,Northwind,Ironwood', ',', cast(o_custkey % 7 as int) + 1), ' ',
    split_part('Digital,Marine,Energy,Logistics,Foods', ',', cast(o_custkey % 5 as int) + 1), ' ',
    split_part('Inc,LLC,Corp,Ltd', ',', cast(o_custkey % 4 as int) + 1),
    ', a Delaware corporation ("Company"), and ',
    split_part('Summit,Harbor,Cedar,Granite,Bluewater,Northwind,Ironwood', ',', cast(o_orderkey % 7 as int) + 1), ' Holdings Ltd (the "',
    split_part('Client,Supplier,Lender', ',', cast(o_orderkey % 3 as int) + 1), '"). ',
    '"Closing Date" shall mean the day of payment. ',
    split_part('Jane,Mary,Omar,Lena,Paul,Ruth', ',', cast(o_custkey % 6 as int) + 1), ' ',
    split_part('Smith,Doe,Khan,Chen,Novak', ',', cast(o_orderkey % 5 as int) + 1),
    ' serves as CFO of the Company and reported annual revenue of $', cast(floor(o_totalprice / 1000) as int), ' million. ',
    'Granite acquired Harbor', '. Contact: info@mail', o_custkey % 9, '.com.') as text
from orders
"""

MESSAGES = """
select conv_id, turn, role,
  case when turn % 4 = 0 then concat('Please parse the checklist. ', text)
       when turn % 4 = 1 then concat('Match this. ', text)
       when turn % 4 = 2 then concat(text, ' Is it complete?')
       else text end as text
from conversations
"""

GRAPH = """
select concat('part:', l_partkey) as src, concat('supp:', l_suppkey) as dst, l_returnflag as relationship, concat('order_', l_orderkey) as source_document, l_linestatus as context
from lineitem
"""

FILES = """
select concat('/rooms/', lang, '/', source, '/doc_', doc_id, split_part('.pdf,.docx,.txt,.md,.xyz', ',', cast(doc_id % 5 as int) + 1)) as path,
  lang as project, source as room, concat('doc_', doc_id, split_part('.pdf,.docx,.txt,.md,.xyz', ',', cast(doc_id % 5 as int) + 1)) as name,
  split_part('.pdf,.docx,.txt,.md,.xyz', ',', cast(doc_id % 5 as int) + 1) as ext, n_chars as size, text
from documents
"""

RUN_LOG = "select event_id, concat('stage-', user_id % 7) as stage, event_type as status, ts from events"

CHECKLIST = """
select n_nationkey as item_no, substr('ABCDEFGHIJ', cast(n_regionkey as int) + 1, 1) as letter, concat('Category ', n_regionkey) as category,
  concat('Provide the documents of ', n_name) as text, case when n_nationkey % 3 = 0 then null else concat(n_nationkey, '. ', n_name) end as original, 7 * n_nationkey as vec_id
from nation
"""

TABLES = {"legal": LEGAL, "messages": MESSAGES, "graph_rows": GRAPH, "files": FILES, "run_log": RUN_LOG, "checklist": CHECKLIST}
INPUTS = {"legal": "orders", "messages": "conversations", "graph_rows": "lineitem", "files": "documents", "run_log": "events", "checklist": "nation"}

LONG = {"legal": "o_orderkey"}
TEXTS = {"documents", "conversations", "orders"}  # tables whose rows cost much


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table by name, or a given one."""
    given = INPUTS.get(name, name)
    rows = spark.read.parquet(f"{sf_dir}/{given}.parquet")
    if name in LONG:  # few bytes become long texts, so tasks are cut by rows
        rows = dealt(rows, rows, LONG[name])
    elif given in TEXTS:
        rows = spread(rows)
    if name not in TABLES:
        return rows
    return spark.sql(TABLES[name].replace(f"from {given}", f"from {{{given}}}"), **{given: rows})


def with_corpora(sql: str) -> str:
    """Oracle SQL with the derived tables that it names put in front."""
    used = [n for n in TABLES if n in sql]
    if not used:
        return sql
    defs = ", ".join(f"{n} as ({TABLES[n]})" for n in used)
    body = sql.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {defs}, {body[len('with recursive') :]}"
    if body.lower().startswith("with "):
        return f"with {defs}, {body[5:]}"
    return f"with {defs} {body}"
