"""Flow graphs of statements as edge tables: control flow, data flow over branches and loops, calls, and what joins and branches there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velarium.operators import ranged
from velarium.operators.fixpoint import closure, follow
from velarium.session import materialize


def control_flow(statements: DataFrame) -> DataFrame:
    """statements (method, id, kind, target) -> method, a, b, kind: NEXT to the following one; of a BRANCH, TRUE to it and FALSE to its target; a RETURN leads nowhere. A method is one task's sort, as its statements are few."""
    after = F.lead("id").over(W.partitionBy("method").orderBy("id"))
    rows = statements.withColumn("__after", after)
    ways = F.when(F.col("kind") == "BRANCH", F.array(F.struct(F.col("__after").alias("b"), F.lit("TRUE").alias("kind")), F.struct(F.col("target").alias("b"), F.lit("FALSE").alias("kind"))))
    ways = ways.when(F.col("kind") != "RETURN", F.array(F.struct(F.col("__after").alias("b"), F.lit("NEXT").alias("kind"))))
    return rows.select("method", F.col("id").alias("a"), F.explode(ways).alias("w")).where("w.b IS NOT NULL").select("method", "a", "w.b", "w.kind")


def call_edges(statements: DataFrame) -> DataFrame:
    """statements (method, id, kind, callee) -> method, a, callee, b, kind: CALL from a call to the callee's first statement, RETURN from each of the callee's ways out (a RETURN, or its last statement) to the statement after the call."""
    w = W.partitionBy("method").orderBy("id")
    rows = statements.select("method", "id", "kind", "callee", F.lead("id").over(w).alias("after"))
    calls = rows.where("kind = 'CALL' AND callee IS NOT NULL").select(F.col("method").alias("caller"), F.col("id").alias("site"), F.col("callee").alias("method"), F.col("after").alias("back"))
    entries = rows.groupBy("method").agg(F.min("id").alias("entry"))
    exits = rows.where("kind = 'RETURN' OR after IS NULL").select("method", F.col("id").alias("exit"))
    to = calls.join(entries, "method").select(F.col("caller").alias("method"), F.col("site").alias("a"), F.col("method").alias("callee"), F.col("entry").alias("b"), F.lit("CALL").alias("kind"))
    back = calls.where("back IS NOT NULL").join(exits, "method").select(F.col("caller").alias("method"), F.col("exit").alias("a"), F.col("method").alias("callee"), F.col("back").alias("b"), F.lit("RETURN").alias("kind"))
    return to.unionByName(back)


def blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (method, node), edges (method, a, b) -> method, node, block, place: runs of nodes with one way in from a node with one way on are a block, named by its first node; place counts from 0.

    Blocks are found by pointers that go twice as far each round. Nodes of a ring that nothing enters are blocks of their own.
    """
    pairs = edges.select("method", "a", "b").distinct()
    one_on = pairs.groupBy("method", "a").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("method", "a")
    one_in = pairs.groupBy("method", "b").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a")).where("n = 1 AND a <> b").select("method", "a", "b")
    inner = one_in.join(one_on, ["method", "a"]).select("method", F.col("b").alias("a"), F.col("a").alias("b"))  # each to the node before it
    at = follow(inner, ["method"]).where("end IS NOT NULL").select("method", F.col("a").alias("node"), F.col("end").alias("block"), F.col("steps").alias("place"))
    return nodes.select("method", "node").distinct().join(at, ["method", "node"], "left").select("method", "node", F.coalesce("block", "node").alias("block"), F.coalesce("place", F.lit(0)).alias("place"))


def reaching(accesses: DataFrame, edges: DataFrame) -> DataFrame:
    """accesses (method, id, variable, defines, kind), edges (method, a, b) -> method, variable, a, b, kind: each definition a with each use b that it reaches on some way without another definition of the variable between.

    Definitions and uses inside a block of statements meet in its order. Between blocks, a definition that its
    block keeps goes on to the next blocks, and through those that don't define the variable, until nothing new is reached.
    A statement uses before it defines. Edges are written once, as they are read many times.
    """
    edges = materialize(edges.select("method", "a", "b").distinct(), "edges")
    ends = edges.select("method", F.col("a").alias("node")).union(edges.select("method", F.col("b").alias("node")))
    place = materialize(blocks(ends.union(accesses.select("method", F.col("id").alias("node"))), edges), "blocks")
    held = accesses.join(place.withColumnRenamed("node", "id"), ["method", "id"]).withColumn("__def", F.when(F.col("defines"), F.col("id")))
    met = materialize(ranged.over(held, ["method", "block", "variable"], ["place", "defines"], a=("last_before", "__def")), "accesses")
    uses = met.where("NOT defines")
    inside = uses.where("a IS NOT NULL").select("method", "variable", "a", F.col("id").alias("b"), "kind")
    kept = materialize(met.where("defines").groupBy("method", "block", "variable").agg(F.max_by("id", "place").alias("def")), "definitions")
    leads = edges.join(place.select("method", F.col("node").alias("a"), "block"), ["method", "a"])
    heads = place.where("node = block").select("method", F.col("node").alias("b"))
    ways = materialize(leads.join(heads, ["method", "b"], "left_semi").select("method", "block", F.col("b").alias("__to")).distinct(), "ways")
    go = lambda facts: facts.join(ways, ["method", "block"]).select("method", "variable", "def", F.col("__to").alias("block"))
    at = ["method", "block", "variable"]
    ends = kept.select(*at)
    # Few facts go to the blocks that end them, and on, without a shuffle of either.
    few = lambda facts: go(F.broadcast(facts.join(F.broadcast(ends.join(F.broadcast(facts.select(*at)), at, "left_semi")), at, "left_anti")))
    facts = closure(go(kept), lambda facts: go(facts.join(ends, at, "left_anti")), tag="reaching", few=few)
    open_uses = uses.where("a IS NULL").select("method", "block", "variable", "id", "kind")
    return inside.unionByName(open_uses.join(facts, ["method", "block", "variable"]).select("method", "variable", F.col("def").alias("a"), F.col("id").alias("b"), "kind"))


def data_flow(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """statements (method, id, kind, variable, defines, source, callee), edges of their control flow -> method, variable, a, b, kind.

    DEF_USE from a definition to a statement that uses its variable, ASSIGNMENT to one that gives it (as `source`) to
    its own variable, ARGUMENT_TO_PARAMETER from a call that uses a variable to the callee's first statement.
    """
    statements = materialize(statements.select("method", "id", "kind", "variable", "defines", "source", "callee"), "statements")
    reads = statements.where("NOT defines").select("method", "id", "variable", F.lit(False).alias("defines"), F.lit("DEF_USE").alias("kind"))
    given = statements.where("defines AND source IS NOT NULL").select("method", "id", F.col("source").alias("variable"), F.lit(False).alias("defines"), F.lit("ASSIGNMENT").alias("kind"))
    writes = statements.where("defines").select("method", "id", "variable", F.lit(True).alias("defines"), F.lit(None).cast("string").alias("kind"))
    found = reaching(reads.unionByName(given).unionByName(writes), edges)
    entries = statements.groupBy(F.col("method").alias("callee")).agg(F.min("id").alias("b"))
    calls = statements.where("kind = 'CALL' AND NOT defines").select("method", "variable", F.col("id").alias("a"), "callee").join(entries, "callee")
    return found.unionByName(calls.select("method", "variable", "a", "b", F.lit("ARGUMENT_TO_PARAMETER").alias("kind")))


def call_graph(calls: DataFrame) -> DataFrame:
    """calls (caller, callee) -> node, n_out, n_in, role: ENTRY (nothing calls it), LEAF (calls nothing), INNER; and how many different ones."""
    pairs = calls.where("caller IS NOT NULL AND callee IS NOT NULL").select("caller", "callee").distinct()
    ends = pairs.select(F.col("caller").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(pairs.select("callee", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return nodes.withColumn("role", F.when(F.col("n_in") == 0, "ENTRY").when(F.col("n_out") == 0, "LEAF").otherwise("INNER"))


def dispositions(edges: DataFrame) -> DataFrame:
    """edges (method, a, b) -> method, node, disposition: BRANCH (several ways on), JOIN (several ways in), BOTH, START, END or LINEAR."""
    pairs = edges.select("method", "a", "b").distinct()
    ends = pairs.select("method", F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(pairs.select("method", "b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("method", "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    kind = F.when((F.col("o") > 1) & (F.col("i") > 1), "BOTH").when(F.col("o") > 1, "BRANCH").when(F.col("i") > 1, "JOIN").when(F.col("i") == 0, "START").when(F.col("o") == 0, "END").otherwise("LINEAR")
    return nodes.select("method", "node", kind.alias("disposition"))


def unsettled(enqueued: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """key, side: what was enqueued and never processed (PENDING), or processed and never enqueued (STRAY). A closed work list has none."""
    a, b = enqueued.select(key).distinct(), processed.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("PENDING")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("STRAY")))
