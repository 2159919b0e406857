"""The registry of queries, and the truth about the derived corpora in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where it can be said in SQL, its oracle."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def member_rows(publish: str, listen: str) -> str:
    return f"""
      SELECT DISTINCT 'svc-' || l_suppkey AS service, 'order-' || l_orderkey AS topic, '{publish}' AS role
      FROM lineitem
      UNION SELECT 'svc-' || l_suppkey, 'urgent-' || l_orderkey, '{publish}' FROM lineitem WHERE l_quantity >= 48
      UNION SELECT 'svc-' || o_custkey, 'order-' || o_orderkey, '{listen}' FROM orders
      UNION SELECT 'svc-' || o_custkey, 'urgent-' || o_orderkey, '{listen}' FROM orders
      UNION SELECT 'svc-' || o_custkey, 'audit-' || substr(o_orderpriority, 1, 1), '{listen}'
      FROM orders WHERE o_orderstatus = 'O'"""


MEMBERS = f"members AS ({member_rows('producer', 'consumer')})"

# every pattern hit with its place: analyzer, pattern, role, topic, path, line, col
HITS = """
hits AS (
  SELECT h.a AS analyzer, h.p AS pattern, 'producer' AS role, 'order-' || l_orderkey AS topic,
         path, CAST(h.l AS INTEGER) AS line, CAST(h.c AS INTEGER) AS col
  FROM (SELECT *, 'svc-' || l_suppkey || '/src/main/java/shop/Line' || l_orderkey || 'x' || l_linenumber
               || 'x' || l_partkey || '.java' AS path FROM lineitem) f
  JOIN (VALUES ('R','java','send',5,9), ('R','generic','any_send',5,22), ('R','generic','template_send',5,9),
               ('A','java','const_send',7,9), ('A','generic','producer_send_const',7,9),
               ('N','java','record',5,23), ('N','generic','record',5,23)) h(flag, a, p, l, c)
    ON h.flag = f.l_returnflag
  UNION ALL
  SELECT a.a, 'send_to', 'producer', 'urgent-' || l_orderkey,
         'svc-' || l_suppkey || '/src/main/java/shop/Line' || l_orderkey || 'x' || l_linenumber
               || 'x' || l_partkey || '.java',
         CASE l_returnflag WHEN 'R' THEN 7 WHEN 'A' THEN 9 ELSE 8 END, 5
  FROM lineitem, (VALUES ('java'), ('generic'), ('spring')) a(a) WHERE l_quantity >= 48
  UNION ALL
  SELECT h.a, h.p, 'consumer', CASE WHEN h.t = 'audit' THEN 'audit-' || substr(o_orderpriority, 1, 1)
                                    ELSE 'order-' || o_orderkey END,
         'svc-' || o_custkey || '/src/main/java/shop/Order' || o_orderkey || '.java', h.l, h.c
  FROM orders
  JOIN (VALUES ('F','java','listener','order',4,5), ('F','generic','listener','order',4,5),
               ('F','spring','listener','order',4,5),
               ('O','java','subscribe_as_list','order',5,9), ('O','java','subscribe_as_list','audit',5,9),
               ('P','generic','listener_const','order',6,5)) h(status, a, p, t, l, c)
    ON h.status = o_orderstatus
  UNION ALL
  SELECT a.a, 'stream_listener', 'consumer', 'urgent-' || o_orderkey,
         'svc-' || o_custkey || '/src/main/java/shop/Order' || o_orderkey || '.java',
         CASE o_orderstatus WHEN 'F' THEN 6 WHEN 'O' THEN 7 ELSE 8 END, 5
  FROM orders, (VALUES ('java'), ('generic'), ('spring')) a(a)
)"""

ROLES = f"""{HITS},
roles AS (SELECT DISTINCT split_part(path, '/', 1) AS service, topic, role, path, line, col FROM hits)"""

LANGUAGES = (
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'java' WHEN 'BUILDING' THEN 'java'"
    " WHEN 'FURNITURE' THEN 'javascript' WHEN 'HOUSEHOLD' THEN 'python' ELSE 'csharp' END"
)
SERVICES = f"services AS (SELECT 'svc-' || c_custkey AS service, {LANGUAGES} AS language FROM customer)"
USES = (
    "uses AS (SELECT DISTINCT 'svc-' || l_suppkey AS service, 'Part' || l_partkey AS schema,"
    " 'avro' AS type, 'shop.s' || l_suppkey AS namespace FROM lineitem)"
)
EDGES = f"""{MEMBERS},
topic_edges AS (
  SELECT p.service AS source, c.service AS target, p.topic
  FROM members p JOIN members c ON p.topic = c.topic AND p.role = 'producer' AND c.role = 'consumer'
  WHERE p.service <> c.service)"""
PAIRS = f"""{EDGES},
pairs AS (SELECT DISTINCT source, target FROM topic_edges)"""
REACH = f"""{PAIRS},
reach AS (
  SELECT source, target FROM pairs
  UNION SELECT r.source, u.target FROM reach r JOIN pairs u ON r.target = u.source)"""
