"""The code corpus derived from the driver tables (see FIXTURES.md).

The driver tables hold no source code, so methods, catch clauses, scores and
logs are derived from ``orders``, ``lineitem`` and ``events``.  Every function
returns a lazy DataFrame whose size grows with the input tables.

Plan notes: ``methods`` shuffles ``lineitem`` once (grouped by order key)
and joins ``orders`` once; ``code_lines`` is exploded from it without a
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.java import EXCEPTION_CLASSES
from ..session import table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _split_of(method_id):
    d = method_id % 10
    return F.when(d < 8, "train").when(d == 8, "valid").otherwise("test")


# Body line templates by ``l_partkey % 9``; ``{rn}`` is the line number within
# the order and ``{qty}`` the integer quantity.
_BODY_KINDS = {
    0: ("    Widget w", "rn", " = arg . get ( w1 , n1 ) ;"),
    1: ("int  n", "rn", " = ", "qty", " ;"),
    2: ("if ( n", "rn", " > 3 ) { arg . close ( ) ; }"),
    3: ('log . info ( " a ; b { try " ) ;',),
    4: ("n1 = w2 + n3 ;",),
    5: ("try {",),
    6: ("for ( int i = f ( n1 ) ; i >>>= 3 ; i ++ ) {",),
    7: (", w2 )",),
    8: ("return w1 ;",),
}


def code_lines(spark: SparkSession, sf_dir: str, methods_df: DataFrame | None = None) -> DataFrame:
    """One row per source line: method_id, line_no (1-based), line, label, pred, split.

    Exploded from ``methods`` (no shuffle); rows stay partitioned by
    ``method_id``, so per-method windows downstream need no exchange.
    """
    m = methods_df if methods_df is not None else methods(spark, sf_dir)
    z = m.select("method_id", "split", F.posexplode(F.arrays_zip("lines", "labels", "preds")).alias("i", "z"))
    return z.select("method_id", (F.col("i") + 1).cast("int").alias("line_no"), F.col("z.lines").alias("line"),
                    F.col("z.labels").alias("label"), F.col("z.preds").alias("pred"), "split")


def _body_line(s, rn):
    """Text of a body line from its lineitem struct ``s`` and 1-based number ``rn``."""
    kind = (s["l_partkey"] % 9).cast("int")
    parts = {"rn": rn.cast("string"), "qty": s["l_quantity"].cast("int").cast("string")}
    line = None
    for k, tpl in _BODY_KINDS.items():
        text = F.concat(*[parts.get(p, F.lit(p)) for p in tpl]) if len(tpl) > 1 else F.lit(tpl[0])
        line = F.when(kind == k, text) if line is None else line.when(kind == k, text)
    return line


_TARGETS = (
    "catch ( Exception e ) { }", "catch ( IOException e ) { }",
    "catch ( InterruptedException e ) { }", "catch ( IllegalArgumentException e ) { }",
    "catch ( SQLException e ) { }", "catch ( NumberFormatException e ) { }",
    "catch ( RuntimeException e ) { }", "catch ( ClassNotFoundException e ) { }",
    "catch ( AssertionError e ) { }", "catch ( RemoteException e ) { }",
    "catch ( IOException|SQLException e ) { }", "catch ( IOException | SQLException e ) { }",
    "finally { }", "catch ( final RemoteException e ) { throw e ; }",
    "catch ( java . io . IOException a ) { } catch ( SQLException b ) { }",
    "catch ( CustomError e ) { }",
)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catch clause per method: method_id, tgt."""
    o = table(spark, sf_dir, "orders")
    k = (F.col("o_custkey") % 16).cast("int")
    expr = F.element_at(F.array(*[F.lit(t) for t in _TARGETS]), k + 1)
    return o.select(F.col("o_orderkey").alias("method_id"), expr.alias("tgt"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods as ordered arrays + joined source + catch target.

    Columns: method_id, split, lines, labels, preds, src, tgt.  ``lineitem``
    is shuffled once (grouped by order key); its lines are numbered by
    sorting each order's array, so no window runs.  ``orders`` supplies the
    header line, the catch target and methods with no body lines.
    """
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("method_id"), item.alias("item"), F.lit(None).cast("long").alias("o_custkey"))
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("method_id"), F.lit(None).cast(item_type(spark, sf_dir)).alias("item"),
        "o_custkey")
    # One shuffle for both tables: order rows and line-item rows meet in the
    # same group, so no join is needed and the result is hash-partitioned by
    # method_id for all per-method work downstream.
    g = li.unionByName(o).groupBy("method_id").agg(
        F.array_sort(F.collect_list("item")).alias("_b"), F.max("o_custkey").alias("o_custkey"))
    header = F.concat(F.lit("public void m"), F.col("method_id").cast("string"), F.lit(" ( Arg arg ) {"))
    head_pred = F.when(F.col("method_id") % 11 == 0, 1).otherwise(0)
    k = (F.col("o_custkey") % 16).cast("int")
    full = g.select(
        "method_id", _split_of(F.col("method_id")).alias("split"),
        F.concat(F.array(header), F.transform("_b", lambda s, i: _body_line(s, i + 1)),
                 F.array(F.lit("}"))).alias("lines"),
        F.concat(F.array(F.lit(0)), F.transform("_b", lambda s: F.when(
            (s["l_partkey"] % 9).isin(0, 2, 4), 1).otherwise(0)), F.array(F.lit(0))).alias("labels"),
        F.concat(F.array(head_pred), F.transform("_b", lambda s: F.when(
            (s["l_partkey"] + s["l_suppkey"]) % 5 < 2, 1).otherwise(0)), F.array(F.lit(0))).alias("preds"),
        F.element_at(F.array(*[F.lit(t) for t in _TARGETS]), k + 1).alias("tgt"))
    return full.select("method_id", "split", "lines", "labels", "preds",
                       F.array_join("lines", " ").alias("src"), "tgt")


def item_type(spark: SparkSession, sf_dir: str):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                              "l_extendedprice").alias("s")).schema["s"].dataType


def class_map(spark: SparkSession) -> DataFrame:
    """The 10-class forward map (name -> class_id), inverted from the reverse map."""
    rows = [(name, i) for i, name in enumerate(EXCEPTION_CLASSES)]
    return spark.createDataFrame(rows, "name string, class_id int")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten class scores per order: id, class_id, logit, label (long form)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cls = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("class_id")
    x = o.select("o_orderkey", "o_custkey", cls)
    raw = (F.col("o_orderkey") * 31 + F.col("class_id") * 17 + F.col("o_custkey") * 7) % 101 - 30
    return x.select(
        F.col("o_orderkey").alias("id"), F.col("class_id").cast("int").alias("class_id"),
        (raw.cast("double") / 10).alias("logit"),
        (F.col("o_custkey") % 9).cast("int").alias("label"))


def hash_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``#`` records (id, value); every 50th has only three fields."""
    o = table(spark, sf_dir, "orders")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    exc = F.when(ck % 3 == 0, "IOException,SQLException").when(ck % 3 == 1, "SQLException").otherwise("Odd")
    full = F.concat(F.lit("void,m,Arg#a,b,c,d,e,f#"), exc, F.lit("#"),
                    (ok % 3).cast("string"), F.lit(","), (ok % 3 + ck % 5).cast("string"))
    value = F.when(ok % 50 == 0, F.lit("void,m#a,b,c#IOException")).otherwise(full)
    return o.select(ok.alias("id"), value.alias("value"))


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per training batch, 250 batches per epoch."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.floor(F.col("event_id") / 250.0).cast("int").alias("epoch"),
        (F.col("event_id") % 250).cast("int").alias("batch"),
        F.col("value").alias("loss"),
        (F.col("user_id") % 17).cast("int").alias("correct"),
        F.lit(16).alias("total"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback records in the plugin's table layout, plus our record_id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("record_id"),
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("code_data"),
        F.when(F.col("event_id") % 4 == 0, "0,0,0").otherwise("0,1,1").alias("line_predict"),
        F.when(F.col("event_type") == "error", "IOException").otherwise("Exception").alias("exception_predict"),
        F.lit(-1).alias("user_evaluation"),
        F.lit("").alias("line_artificial"),
        F.lit("").alias("exception_artificial"))


# Members of a Java class by ``l_partkey % 10``, one text per line; ``#`` is the
# line item's number within its order.
JAVA_MEMBERS = (
    ("  int f#(int a){ return a+1; } // }",),
    ('  private String s# = "{ try";',),
    ("  void g#() throws Exception{", "    try{", '      a.b("}");', "    }catch(IOException e){ throw e; }",
     "    int[] x = {1,2};", "    x[0]=3;", "  }"),
    ("  static class I#{", "    int h#(){ if(a) return 1; else return 2; }", "  }"),
    ("  enum E#{A{int k#(){return 0;}},B(1),C;void l#(){}}",),
    ("  Runnable r#(){", "    return new Runnable(){", "      public void run(){ for(int i=0;i<3;i++){ x(i); } }",
     "    };", "  }"),
    ("  void t#(){", '    String q = """', '      { " \\""" try }', '    """;', "    l.forEach(v -> {", "      if(v > 1){ y(v); }",
     "    });", "  }"),
    ("  /* abstract { */", "  abstract int z#(Map<String,List<X>> m);"),
    ("  int w#(int c){", "    switch(c){", "      case 1: c++;", "        break;", "      default: return '}';", "    }",
     "    do {", "      c--;", "    } while(c>0);", "    outer: while(true)", "      break;", "    int total = c", "      + 1;",
     "    return c;", "  }"),
    ("  @Test(expected = A.class)", "  C# m#(final int a){", "    if (a > 0)", "      go(a);", "    else {",
     "      b = 'x'; }", "    synchronized (this){ n++; }", "    throw new E(\"try\");", "  }"),
)


def _java_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, members): the member lines of each order, one array per line item."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(
        F.array_sort(F.collect_list(item)).alias("b"))
    texts = F.array(*[F.array(*[F.lit(x) for x in m]) for m in JAVA_MEMBERS])

    def member(s, i):
        rn = (i + 1).cast("string")
        k = (s["l_partkey"] % len(JAVA_MEMBERS)).cast("int")
        # try_: a null part has null lines, which element_at of this array declares not null
        return F.struct(k.alias("k"), (i + 1).alias("rn"),
                        F.transform(F.try_element_at(texts, k + 1), lambda x: F.replace(x, F.lit("#"), rn)).alias("lines"))
    return li.select("file_id", F.transform("b", member).alias("members"))


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Java file per order with unspaced source: file_id, src.

    Every 13th file lacks its last brace, the next one has one too many, the
    one after that has two types left open."""
    x = _java_items(spark, sf_dir)
    r = F.col("file_id") % 13
    lines = F.concat(F.array(F.lit("package p; // {"), F.concat(F.lit("public class C"), F.col("file_id").cast("string"), F.lit(" {"))),
                     F.flatten(F.transform("members", lambda m: m["lines"])),
                     F.array(F.when(r == 0, F.lit("")).when(r == 1, F.lit("}}")).when(r == 2, F.lit("class X{class Y{"))
                             .otherwise(F.lit("}"))))
    return x.select("file_id", F.array_join(lines, "\n").alias("src"))


def java_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members that are methods, one row each: file_id, rn, lines, src."""
    x = _java_items(spark, sf_dir).select("file_id", F.explode("members").alias("m"))
    x = x.where(F.col("m.k").isin(0, 2, 5, 6, 8, 9))
    return x.select("file_id", F.col("m.rn").alias("rn"), F.col("m.lines").alias("lines"),
                    F.array_join("m.lines", "\n").alias("src"))
