"""DuckDB SQL for the derived fixtures, used to build the oracle queries.

These are the fixture definitions of FIXTURES.md, written once as CTEs; each
oracle query names the fixtures it needs and ``with_fixtures`` prepends them.
They are independent of the Spark code in ``trylens.sources.fixtures``.
"""

from __future__ import annotations

FIXTURE_SQL: dict[str, str] = {
    "code_lines": """
WITH body AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem),
u AS (
 SELECT o_orderkey AS method_id, 0 AS ord, concat('public void m', CAST(o_orderkey AS VARCHAR(20)), ' ( Arg arg ) {') AS line, 0 AS label, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS pred FROM orders
 UNION ALL
 SELECT l_orderkey, rn,
  CASE CAST(l_partkey % 9 AS INT)
   WHEN 0 THEN concat('    Widget w', CAST(rn AS VARCHAR(9)), ' = arg . get ( w1 , n1 ) ;')
   WHEN 1 THEN concat('int  n', CAST(rn AS VARCHAR(9)), ' = ', CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), ' ;')
   WHEN 2 THEN concat('if ( n', CAST(rn AS VARCHAR(9)), ' > 3 ) { arg . close ( ) ; }')
   WHEN 3 THEN 'log . info ( " a ; b { try " ) ;'
   WHEN 4 THEN 'n1 = w2 + n3 ;'
   WHEN 5 THEN 'try {'
   WHEN 6 THEN 'for ( int i = f ( n1 ) ; i >>>= 3 ; i ++ ) {'
   WHEN 7 THEN ', w2 )'
   ELSE 'return w1 ;' END,
  CASE WHEN l_partkey % 9 IN (0, 2, 4) THEN 1 ELSE 0 END,
  CASE WHEN (l_partkey + l_suppkey) % 5 < 2 THEN 1 ELSE 0 END
 FROM body
 UNION ALL
 SELECT o_orderkey, 1000000, '}', 0, 0 FROM orders)
SELECT method_id, CAST(row_number() OVER (PARTITION BY method_id ORDER BY ord) AS INT) AS line_no, line, label, pred,
 CASE WHEN method_id % 10 < 8 THEN 'train' WHEN method_id % 10 = 8 THEN 'valid' ELSE 'test' END AS split
FROM u""",
    "targets": """
SELECT o_orderkey AS method_id,
 CASE CAST(o_custkey % 16 AS INT)
  WHEN 0 THEN 'catch ( Exception e ) { }' WHEN 1 THEN 'catch ( IOException e ) { }' WHEN 2 THEN 'catch ( InterruptedException e ) { }'
  WHEN 3 THEN 'catch ( IllegalArgumentException e ) { }' WHEN 4 THEN 'catch ( SQLException e ) { }' WHEN 5 THEN 'catch ( NumberFormatException e ) { }'
  WHEN 6 THEN 'catch ( RuntimeException e ) { }' WHEN 7 THEN 'catch ( ClassNotFoundException e ) { }' WHEN 8 THEN 'catch ( AssertionError e ) { }'
  WHEN 9 THEN 'catch ( RemoteException e ) { }' WHEN 10 THEN 'catch ( IOException|SQLException e ) { }' WHEN 11 THEN 'catch ( IOException | SQLException e ) { }'
  WHEN 12 THEN 'finally { }' WHEN 13 THEN 'catch ( final RemoteException e ) { throw e ; }'
  WHEN 14 THEN 'catch ( java . io . IOException a ) { } catch ( SQLException b ) { }' ELSE 'catch ( CustomError e ) { }' END AS tgt
FROM orders""",
    "class_map": """
SELECT name, class_id FROM (VALUES ('Exception',0),('IOException',1),('InterruptedException',2),('IllegalArgumentException',3),('SQLException',4),('NumberFormatException',5),('RuntimeException',6),('ClassNotFoundException',7),('AssertionError',8),('RemoteException',9)) AS t(name, class_id)""",
    "logits": """
SELECT o_orderkey AS id, class_id, CAST((o_orderkey * 31 + class_id * 17 + o_custkey * 7) % 101 - 30 AS DOUBLE) / 10 AS logit, CAST(o_custkey % 9 AS INT) AS label
FROM orders CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS c(class_id)""",
    "hash_records": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN 'void,m#a,b,c#IOException'
 ELSE concat('void,m,Arg#a,b,c,d,e,f#', CASE WHEN o_custkey % 3 = 0 THEN 'IOException,SQLException' WHEN o_custkey % 3 = 1 THEN 'SQLException' ELSE 'Odd' END, '#', CAST(o_orderkey % 3 AS VARCHAR(9)), ',', CAST(o_orderkey % 3 + o_custkey % 5 AS VARCHAR(9))) END AS value FROM orders""",
    "train_log": """
SELECT CAST(floor(event_id / 250.0) AS INT) AS epoch, CAST(event_id % 250 AS INT) AS batch, value AS loss, CAST(user_id % 17 AS INT) AS correct, 16 AS total FROM events""",
    "feedback": """
SELECT event_id AS record_id, concat('m', CAST(user_id AS VARCHAR(20))) AS code_data, CASE WHEN event_id % 4 = 0 THEN '0,0,0' ELSE '0,1,1' END AS line_predict,
 CASE WHEN event_type = 'error' THEN 'IOException' ELSE 'Exception' END AS exception_predict, -1 AS user_evaluation, '' AS line_artificial, '' AS exception_artificial FROM events""",
    "methods": """
SELECT c.method_id, any_value(c.split) AS split,
 list(c.line ORDER BY c.line_no) AS lines, list(c.label ORDER BY c.line_no) AS labels,
 list(c.pred ORDER BY c.line_no) AS preds,
 array_to_string(list(c.line ORDER BY c.line_no), ' ') AS src, any_value(t.tgt) AS tgt
FROM code_lines c JOIN targets t ON c.method_id = t.method_id
GROUP BY c.method_id""",
}

FIXTURE_DEPS = {"methods": ("code_lines", "targets")}


def with_fixtures(body: str, *names: str, ctes: tuple[tuple[str, str], ...] = ()) -> str:
    """``WITH <fixtures>, <extra ctes> <body>``; fixture dependencies first."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in FIXTURE_DEPS.get(n, ()):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({FIXTURE_SQL[n]}\n)" for n in order]
    parts += [f"{n} AS (\n{sql}\n)" for n, sql in ctes]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
