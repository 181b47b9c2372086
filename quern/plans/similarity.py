"""Structural similarity of SQL: bound trees of optimised plans, their edit distance and the edits.

A query's plan is optimised by the rules that move and merge operators; rules that compute with literals, infer conditions
or fold casts are left out, so that a tree has what the query has.  Then every name is bound:

- a column of a table is named by table, and by the table's place among its kind where a query has it twice;
- a column that an operator makes is named by the operator's number and its place among what that makes, and one that
  only renames another is that other;
- what a query returns counts by position: a projection stays wherever its columns reach the result, an arm of a set
  operation or a subquery, through limits, sorts and filters; elsewhere projections that only choose columns say nothing;
- literals carry their type, orders their direction and where nulls go, expressions all their parameters.

AND and OR are flattened and sorted, comparisons turned one way, and blocks of inner joins are sets of inputs and of
conditions unless a table stands in them twice.  Casts count if the query has them.  Where text has a collation of its own,
the sides of a comparison are not interchangeable: such queries are not scored if that is all they differ in.
"""

from __future__ import annotations

import hashlib
import json
import re
import threading
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.gate import Gate, GateError, class_name, seq, walk
from quern.session import ready, shared_folder

MAX_NODES = 600
#: Distinct queries whose trees the driver holds before it writes them.
CHUNK = 2_000

#: Rules of the optimiser that change what a query says rather than where it says it.
LEFT_OUT = (
    "ConstantFolding", "ConstantPropagation", "NullPropagation", "FoldablePropagation", "UnwrapCastInBinaryComparison", "SimplifyCasts", "OptimizeIn",
    "LikeSimplification", "InferFiltersFromConstraints", "InferFiltersFromGenerate", "PropagateEmptyRelation", "ConvertToLocalRelation",
    "ReplaceNullWithFalseInPredicate", "LimitPushDown", "PushFoldableIntoBranches", "EliminateLimits",
)
EXCLUDED = "spark.sql.optimizer.excludedRules"
_optimising = threading.Lock()


@dataclass
class Node:
    label: str
    children: list[Node] = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def key(self) -> str:
        return json.dumps([self.label, [c.key() for c in self.children]])

    def packed(self) -> list:
        return [self.label, [c.packed() for c in self.children]]

    @staticmethod
    def unpacked(x: list) -> Node:
        return Node(x[0], [Node.unpacked(c) for c in x[1]])


TURNED = {"GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual"}
SORTED = frozenset(["And", "Or", "Add", "Multiply", "EqualTo", "EqualNullSafe", "In", "InSet"])
COMPARED = ("EqualTo", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual")
LEAVES = ("LogicalRelation", "LogicalRDD", "LocalRelation")
#: Operators that hand on their child's columns in their order.
PASSING = frozenset(["GlobalLimit", "LocalLimit", "Offset", "Tail", "Sort", "Filter", "Window", "Sample", "RepartitionByExpression", "Repartition", "Deduplicate"])


class Trees:
    """Trees of one query's plans, with every name bound."""

    def __init__(self, jvm, analyzed, optimized):
        self.user_cast = jvm.org.apache.spark.sql.catalyst.expressions.Cast.USER_SPECIFIED_CAST()
        self.table: dict[int, str] = {}  # of each column's id
        self.same: dict[int, int] = {}  # the id that another id only renames
        self.made: dict[int, str] = {}  # names of columns that operators make
        self.seen: dict[str, int] = {}  # how often a table has been met
        known: dict[int, str] = {}  # tables by the hash of their canonical plan
        for kind, node in walk(analyzed):
            if kind == "plan" and class_name(node) == "SubqueryAlias":
                self._name(node, known)
        operators = 0
        for plan in (analyzed, optimized):
            for kind, node in walk(plan):
                if kind != "plan":
                    continue
                ids = [x.exprId().id() for x in seq(node.output())] if class_name(node) != "UnresolvedWith" else []
                if class_name(node) in LEAVES:
                    if ids and ids[0] not in self.table:  # a table that the optimiser wrote out once more
                        self._bind(known.get(node.semanticHash(), "values"), ids)
                    continue
                aliases = [e for e in seq(node.expressions()) if class_name(e) == "Alias"]
                for e in aliases:
                    if class_name(e.child()) == "AttributeReference" and e.exprId().id() != e.child().exprId().id():
                        self.same.setdefault(e.exprId().id(), e.child().exprId().id())
                below = {x.exprId().id() for c in seq(node.children()) for x in seq(c.output())}
                new = [i for i in ids if i not in below and i not in self.same and i not in self.table]
                if plan is optimized and new:
                    operators += 1
                    for place, i in enumerate(new):
                        self.made[i] = f"made {operators}.{place}"
                elif new:
                    for place, i in enumerate(new):
                        self.made.setdefault(i, f"made {place}")

    def _bind(self, name: str, ids: list[int]) -> None:
        n = self.seen[name] = self.seen.get(name, 0) + 1
        for i in ids:
            self.table[i] = name if n == 1 else f"{name}#{n}"

    def _name(self, alias, known: dict[int, str]) -> None:
        """Names the columns of the table below its innermost alias."""
        below, name = alias, ""
        while class_name(below) in ("SubqueryAlias", "View"):
            name = below.alias() if class_name(below) == "SubqueryAlias" else name
            below = seq(below.children())[0]
        if class_name(below) not in LEAVES:
            return
        ids = [x.exprId().id() for x in seq(below.output())]
        known.setdefault(below.semanticHash(), name.lower())
        if ids and ids[0] not in self.table:
            self._bind(name.lower(), ids)

    def column(self, e) -> Node:
        i = e.exprId().id()
        while i not in self.table and i in self.same:
            i = self.same[i]
        if i in self.table:
            return Node(f"column {self.table[i]}.{self._spelling(i, e)}")
        return Node(self.made.get(i, f"column {e.name().lower()}"))

    def _spelling(self, i: int, e) -> str:
        return self.spelling.get(i) or e.name().lower()

    def spell(self, *plans) -> Trees:
        """Notes what tables call their columns, whatever later operators rename them to."""
        self.spelling = {}
        for plan in plans:
            for kind, node in walk(plan):
                if kind == "plan" and class_name(node) in LEAVES:
                    for x in seq(node.output()):
                        self.spelling.setdefault(x.exprId().id(), x.name().lower())
        return self

    def parameters(self, e) -> list[str]:
        """What an expression has besides its operands: escape characters, ordinals, frames, flags."""
        if class_name(e) in ("AggregateExpression", "Alias"):
            return []
        it, out = e.productIterator(), []
        while it.hasNext():
            x = it.next()
            if isinstance(x, (bool, int, float, str)):
                out.append(str(x))
        return out

    def expression(self, e) -> Node:
        name = class_name(e)
        below = seq(e.children())
        if name in ("Alias", "KnownFloatingPointNormalized", "NormalizeNaNAndZero"):
            return self.expression(below[0])
        if name == "Cast":
            child = self.expression(below[0])
            asked = e.getTagValue(self.user_cast).isDefined()
            return Node(f"cast {e.dataType().catalogString()}", [child]) if asked else child
        if name == "AttributeReference":
            return self.column(e)
        if name == "OuterReference":
            return self.expression(e.e())
        if name == "Literal":
            return Node(f"literal {e.dataType().catalogString()} {e.toString()}")
        if name == "SortOrder":
            return Node(f"order {e.direction().toString()} {e.nullOrdering().toString()}", [self.expression(below[0])])
        if name == "ResolvedCollation":
            return Node(f"collation {e.toString()}")
        children = [self.expression(c) for c in below]
        if name in ("And", "Or"):
            flat: list[Node] = []
            for c in children:
                flat += c.children if c.label == name else [c]
            children = flat
        if name in TURNED:
            name, children = TURNED[name], children[::-1]
        if name in ("In", "InSet"):
            children = children[:1] + sorted(children[1:], key=Node.key)
        elif name in SORTED:
            children = sorted(children, key=Node.key)
        if name == "AggregateExpression":
            name = "AggregateExpression distinct" if e.isDistinct() else "AggregateExpression"
        elif name.endswith("Subquery") and hasattr(e, "plan"):
            children.append(self.plan(e.plan(), True))
        elif not below or name in ("Like", "ILike", "SpecifiedWindowFrame", "GetStructField", "Rand"):
            name = " ".join([name, *self.parameters(e)])
        return Node(name, children)

    def conditions(self, nodes: list[Node]) -> list[Node]:
        """AND taken apart; conditions that are always true say nothing."""
        flat: list[Node] = []
        for e in nodes:
            flat += e.children if e.label == "And" else [e]
        return sorted((e for e in flat if e.label != "literal boolean true"), key=Node.key)

    def plan(self, p, placed: bool) -> Node:
        """placed: whether the places of this operator's columns count."""
        name = class_name(p)
        if name in LEAVES or name == "Join" or name not in PASSING and name not in ("Project", "Aggregate", "Union"):
            node = self._operator(p, name, False)
            return Node("Project", [node, *(self.expression(x) for x in seq(p.output()))]) if placed else node
        return self._operator(p, name, placed)

    def _operator(self, p, name: str, placed: bool) -> Node:
        if name in LEAVES:
            ids = [x.exprId().id() for x in seq(p.output())]
            return Node("relation " + (self.table.get(ids[0], "") if ids else ""))
        if name == "Project":
            children = [self.plan(c, False) for c in seq(p.children())]
            told = seq(p.projectList())
            if not placed:  # what only chooses or renames says nothing here
                told = [e for e in told if class_name(e) == "Alias" and class_name(e.child()) != "AttributeReference"]
            return Node(name, children + [self.expression(e) for e in told]) if told or placed else children[0]
        if name == "Aggregate":
            child = self.plan(seq(p.children())[0], False)
            by = Node("by", [self.expression(e) for e in seq(p.groupingExpressions())])
            told = [self.expression(e) for e in seq(p.aggregateExpressions()) if placed or class_name(e) == "Alias" and class_name(e.child()) != "AttributeReference"]
            return Node(name, [child, by, Node("out", told)])
        children = [self.plan(c, placed or name in ("Union", "Intersect", "Except")) for c in seq(p.children())]
        expressions = [self.expression(e) for e in seq(p.expressions())]
        if name == "Join":
            kind = p.joinType().toString()
            if kind in ("Inner", "Cross"):
                # Inner joins under one another are one set of inputs and one set of conditions.
                inputs, conditions = [], list(expressions)
                for c in children:
                    if c.label == "Join Inner":
                        inputs += c.children[0].children
                        conditions += c.children[1].children
                    elif c.label == "Filter" and c.children[0].label == "Join Inner":
                        inputs += c.children[0].children[0].children
                        conditions += c.children[0].children[1].children + c.children[1:]
                    elif c.label == "Filter" and c.children[0].label.startswith("relation "):
                        # The optimiser moves conditions on one input below the join, wherever the query has them.
                        inputs.append(c.children[0])
                        conditions += c.children[1:]
                    else:
                        inputs.append(c)
                if not any("#" in x.label for x in inputs):
                    inputs.sort(key=Node.key)
                return Node("Join Inner", [Node("inputs", inputs), Node("conditions", self.conditions(conditions))])
            return Node(f"Join {kind}", children + self.conditions(expressions))
        if name == "Filter":
            flat = self.conditions(expressions)
            return Node(name, children + flat) if flat else children[0]
        return Node(name, children + expressions)

    def orientation(self, analyzed) -> list[str]:
        """Comparisons of two columns of text with a collation of its own, as they stand in the query."""
        out = []
        for kind, node in walk(analyzed):
            if kind == "expression" and class_name(node) in COMPARED:
                sides = seq(node.children())
                if all(class_name(x) == "AttributeReference" for x in sides) and any("collate" in x.dataType().catalogString().lower() for x in sides):
                    out.append(" ".join([class_name(node), *(self.expression(x).label for x in sides)]))
        return sorted(out)


@dataclass
class Prepared:
    tree: Node
    mark: str
    orientation: list[str]


def _optimised(gate: Gate, run):
    """The optimised plan without the rules of LEFT_OUT; the session's own exclusions stay as they were."""
    conf = gate.spark.conf
    with _optimising:
        before = conf.get(EXCLUDED, None)
        names = [f"org.apache.spark.sql.catalyst.optimizer.{x}" for x in LEFT_OUT]
        conf.set(EXCLUDED, ",".join(([before] if before else []) + names))
        try:
            return run.optimizedPlan()
        finally:
            conf.unset(EXCLUDED) if before is None else conf.set(EXCLUDED, before)


def prepare(gate: Gate, sql: str, max_nodes: int = MAX_NODES) -> Prepared:
    """A query's tree, its hash and its collated comparisons; GateError if it can't be scored.

    Output columns are c0, c1, ...: their names do not count, their places do.
    """
    plan = gate.validate(sql)
    if any(class_name(n) == "UnresolvedWith" and n.allowRecursion() for k, n in walk(plan) if k == "plan"):
        raise GateError("unscorable", "recursive query")
    df = gate.dataframe(sql)
    df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    run = df._jdf.queryExecution()
    analyzed, optimized = run.analyzed(), _optimised(gate, run)
    trees = Trees(gate.spark._jvm, analyzed, optimized).spell(analyzed, optimized)
    tree = trees.plan(optimized, True)
    if tree.size() > max_nodes:
        raise GateError("unscorable", f"more than {max_nodes} nodes")
    return Prepared(tree, hashlib.sha256(tree.key().encode()).hexdigest(), trees.orientation(analyzed))


def schema_mark(schema: dict[str, list[str]]) -> str:
    """A hash of a schema that depends on the order of columns and not on that of tables."""
    return hashlib.sha256(json.dumps(sorted(schema.items()), separators=(",", ":")).encode()).hexdigest()


# Distances and edits


class Matching:
    """Unit-cost distance of two ordered trees and an optimal set of edits.

    Dynamic programming over post-order numbers: forests between a node's leftmost leaf and itself, for the nodes that
    begin a path of their own.  The edits are traced back through the forests of the subtrees that matched.
    """

    def __init__(self, a: Node, b: Node):
        self.a, self.b = self._flat(a), self._flat(b)
        (la, fa, _), (lb, fb, _) = self.a, self.b
        self.tree = [[0] * len(lb) for _ in la]
        for i in sorted({f: i for i, f in enumerate(fa)}.values()):
            for j in sorted({f: j for j, f in enumerate(fb)}.values()):
                self._forest(i, j)
        self.distance = self.tree[-1][-1]

    @staticmethod
    def _flat(root: Node) -> tuple[list[str], list[int], list[str]]:
        """Labels, leftmost leaves and paths, in post-order."""
        labels, first, paths = [], [], []

        def visit(n: Node, path: str) -> int:
            leftmost = None
            for i, c in enumerate(n.children):
                x = visit(c, f"{path}/{i}")
                leftmost = x if leftmost is None else leftmost
            labels.append(n.label)
            paths.append(path)
            first.append(len(labels) - 1 if leftmost is None else leftmost)
            return first[-1]

        visit(root, "root")
        return labels, first, paths

    def _forest(self, i: int, j: int) -> list[list[int]]:
        """Distances of all forests that begin where i's and j's subtrees begin; notes those of whole subtrees."""
        (la, fa, _), (lb, fb, _) = self.a, self.b
        m, n = i - fa[i] + 2, j - fb[j] + 2
        d = [list(range(n))] + [[x] + [0] * (n - 1) for x in range(1, m)]
        for x in range(1, m):
            p = fa[i] + x - 1
            for y in range(1, n):
                q = fb[j] + y - 1
                if fa[p] == fa[i] and fb[q] == fb[j]:
                    d[x][y] = min(d[x - 1][y] + 1, d[x][y - 1] + 1, d[x - 1][y - 1] + (la[p] != lb[q]))
                    self.tree[p][q] = d[x][y]
                else:
                    d[x][y] = min(d[x - 1][y] + 1, d[x][y - 1] + 1, d[fa[p] - fa[i]][fb[q] - fb[j]] + self.tree[p][q])
        return d

    def pairs(self) -> list[tuple[int | None, int | None]]:
        """(node of a, node of b) by post-order number; None where a node has no partner."""
        (_, fa, _), (_, fb, _) = self.a, self.b
        out, todo = [], [(len(fa) - 1, len(fb) - 1)]
        while todo:
            i, j = todo.pop()
            d = self._forest(i, j)
            x, y = i - fa[i] + 1, j - fb[j] + 1
            while x or y:
                p, q = fa[i] + x - 1, fb[j] + y - 1
                if x and d[x][y] == d[x - 1][y] + 1:
                    out.append((p, None))
                    x -= 1
                elif y and d[x][y] == d[x][y - 1] + 1:
                    out.append((None, q))
                    y -= 1
                elif fa[p] == fa[i] and fb[q] == fb[j]:
                    out.append((p, q))
                    x, y = x - 1, y - 1
                else:
                    todo.append((p, q))
                    x, y = fa[p] - fa[i], fb[q] - fb[j]
        return out

    def edits(self) -> list[dict]:
        """delete, insert and replace with labels and paths of the nodes, as many as the distance.

        A deleted node's children go to its parent, an inserted one adopts its children; paths are those of the trees given.
        """
        (la, _, pa), (lb, _, pb) = self.a, self.b
        out = []
        for p, q in self.pairs():
            if p is None or q is None or la[p] != lb[q]:
                op = "insert" if p is None else "delete" if q is None else "replace"
                out.append({
                    "op": op, "left": None if p is None else la[p], "left_path": None if p is None else pa[p],
                    "right": None if q is None else lb[q], "right_path": None if q is None else pb[q],
                })
        return sorted(out, key=lambda e: (e["left_path"] or "", e["right_path"] or ""))


def edit_distance(a: Node, b: Node) -> int:
    return Matching(a, b).distance


def similarity(gate: Gate, left: str, right: str) -> float | None:
    """1 for the same query, None where either can't be scored."""
    try:
        a, b = prepare(gate, left), prepare(gate, right)
    except GateError:
        return None
    if a.mark == b.mark:
        return 1.0 if a.orientation == b.orientation else None
    return max(0.0, 1 - edit_distance(a.tree, b.tree) / max(a.tree.size(), b.tree.size()))


EDITS = "array<struct<op:string,left:string,left_path:string,right:string,right_path:string>>"
TREES = "sql string, tree string, mark string, orientation string, problem string"


def trees_of(gate: Gate, texts: Iterator[str]) -> Iterator[tuple]:
    """(sql, tree, mark, orientation, problem) of each text; one of the parts is null."""
    for sql in texts:
        try:
            x = prepare(gate, sql)
            yield sql, json.dumps(x.tree.packed()), x.mark, json.dumps(x.orientation), None
        except GateError as e:
            yield sql, None, None, None, e.kind


def score_table(gate: Gate, pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """pairs with status, left_size, right_size, distance, similarity and edits; other columns pass through.

    Analysis needs the driver's session: each distinct text passes through it once, in chunks that are written to the shared
    folder.  Matching does not: pairs meet the trees of their texts by a join, and tasks match them.  A null text can't be
    scored; repeated pairs are rows of their own.
    """
    spark = ready(gate.spark)
    texts = pairs.select(F.col(left).alias("sql")).union(pairs.select(right)).where("sql is not null").distinct()
    path, chunk = shared_folder(spark, "trees"), []

    def keep() -> None:
        spark.createDataFrame(chunk, TREES).write.mode("append").parquet(path)
        chunk.clear()

    for row in trees_of(gate, (r["sql"] for r in texts.toLocalIterator())):
        chunk.append(row)
        if len(chunk) >= CHUNK:
            keep()
    keep()
    return matched(pairs, spark.read.schema(TREES).parquet(path), left, right)


def matched(pairs: DataFrame, trees: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with the distances of their texts' trees; each distinct pair of texts is matched once and meets its rows by a join."""
    parallel = max(pairs.sparkSession.sparkContext.defaultParallelism, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = pairs.select(F.col(left).alias("_left"), F.col(right).alias("_right")).dropna().distinct()
    # Small trees can be much work, so that their partitions are not coalesced by size.
    scores = _matched(texts.repartition(parallel, "_left", "_right"), trees, "_left", "_right").withColumnRenamed("status", "_status")
    found = [c for c in scores.columns if c not in ("_left", "_right", "_status")]
    out = pairs.join(scores, (pairs[left] == scores["_left"]) & (pairs[right] == scores["_right"]), "left")
    # A null text meets nothing.
    return out.select(*(pairs[c] for c in pairs.columns), F.coalesce("_status", F.lit("unscorable:empty_sql")).alias("status"), *(scores[c] for c in found))


def _matched(pairs: DataFrame, trees: DataFrame, left: str, right: str) -> DataFrame:
    """matched, row by row."""
    columns = ("tree", "mark", "orientation", "problem")
    l, r = (trees.select(F.col("sql").alias(f"_{s}_sql"), *(F.col(c).alias(f"_{s}_{c}") for c in columns)) for s in ("l", "r"))
    both = pairs.join(l, pairs[left] == l["_l_sql"], "left").join(r, pairs[right] == r["_r_sql"], "left")
    problem = F.when(F.col("_l_sql").isNull() | F.col("_r_sql").isNull(), "empty_sql").otherwise(F.coalesce("_l_problem", "_r_problem"))
    turned = (F.col("_l_mark") == F.col("_r_mark")) & (F.col("_l_orientation") != F.col("_r_orientation"))
    problem = F.coalesce(problem, F.when(turned, "unscorable"))

    @F.pandas_udf(f"left_size int, right_size int, distance int, edits {EDITS}")
    def match(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append((None, None, None, None))
            else:
                x, y = Node.unpacked(json.loads(x)), Node.unpacked(json.loads(y))
                m = Matching(x, y)
                out.append((x.size(), y.size(), m.distance, m.edits()))
        f = pd.DataFrame(out, columns=["left_size", "right_size", "distance", "edits"])
        return f.astype({c: "Int32" for c in ("left_size", "right_size", "distance")})

    fine = F.col("_problem").isNull()
    out = both.withColumn("_problem", problem).withColumn("_m", match(F.when(fine, F.col("_l_tree")), F.when(fine, F.col("_r_tree"))))
    status = F.when(fine, "scored").otherwise(F.concat(F.lit("unscorable:"), "_problem")).alias("status")
    score = F.greatest(F.lit(0.0), 1 - F.col("_m.distance") / F.greatest("_m.left_size", "_m.right_size")).alias("similarity")
    return out.select(*pairs.columns, status, "_m.left_size", "_m.right_size", "_m.distance", F.when(fine, score).alias("similarity"), "_m.edits")


def score_pairs(gate: Gate, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """score_table of (id, left, right)."""
    return score_table(gate, gate.spark.createDataFrame(pairs, "id string, left string, right string")).drop("left", "right")


# What a query names: tables, columns and equality edges between tables.

UNKNOWN, AMBIGUOUS = "!unknown", "!ambiguous"


def schema_graph(gate: Gate, sql: str) -> dict:
    """tables, columns (table.column), edges (sorted pairs), parsed, valid; names that do not resolve carry a mark."""
    none = {"tables": [], "columns": [], "edges": [], "parsed": False, "valid": False}
    try:
        plan = gate.parse(sql)
    except GateError:
        return none
    catalog = gate.namespace.schema_map()
    ctes, tables, aliases = set(), [], {}
    for kind, n in walk(plan):
        if kind == "plan" and class_name(n) == "UnresolvedWith":
            ctes |= {t._1().lower() for t in seq(n.cteRelations())}
    for kind, n in walk(plan):
        if kind != "plan":
            continue
        if class_name(n) == "SubqueryAlias":
            child = seq(n.children())[0]
            if class_name(child) == "UnresolvedRelation":
                aliases[n.alias().lower()] = seq(child.multipartIdentifier())[-1].lower()
            else:
                aliases.setdefault(n.alias().lower(), None)
        elif class_name(n) == "UnresolvedRelation":
            t = seq(n.multipartIdentifier())[-1].lower()
            if t not in ctes:
                tables.append(t)
                aliases.setdefault(t, t)
    named = sorted(set(tables))
    outputs = {x._1().lower() for k, n in walk(plan) if k == "plan" and class_name(n) == "UnresolvedWith" for x in seq(n.cteRelations())}
    made = {n.name().lower() for k, n in walk(plan) if k == "expression" and class_name(n) == "Alias"}

    def resolve(parts: list[str]) -> str | None:
        column = parts[-1].lower()
        if len(parts) > 1:
            owner = aliases.get(parts[-2].lower(), parts[-2].lower() if parts[-2].lower() in catalog else UNKNOWN)
            if owner is None or parts[-2].lower() in outputs:
                owners = [t for t in named if column in catalog.get(t, ())]
                return f"{owners[0]}.{column}" if len(owners) == 1 else None
            if owner == UNKNOWN or owner not in catalog:
                return f"{UNKNOWN}.{column}"
            return f"{owner}.{column}" if column in catalog[owner] else f"{owner}.{UNKNOWN}_{column}"
        owners = [t for t in named if column in catalog.get(t, ())]
        if len(owners) == 1:
            return f"{owners[0]}.{column}"
        if len(owners) > 1:
            return f"{AMBIGUOUS}_{column}"
        return None if column in made else f"{UNKNOWN}_{column}"

    columns, edges = set(), set()
    for kind, n in walk(plan):
        if kind != "expression":
            continue
        if class_name(n) == "UnresolvedAttribute":
            columns.add(resolve(list(seq(n.nameParts()))))
        elif class_name(n) == "UnresolvedStar":
            for t in named:
                columns |= {f"{t}.{c}" for c in catalog.get(t, ())}
        elif class_name(n) == "EqualTo":
            ends = [resolve(list(seq(c.nameParts()))) if class_name(c) == "UnresolvedAttribute" else None for c in seq(n.children())]
            if None not in ends and ends[0].split(".")[0] != ends[1].split(".")[0]:
                edges.add(tuple(sorted(ends)))
    columns.discard(None)
    marked = [t if t in catalog else f"{UNKNOWN}_{t}" for t in named]
    valid = not any("!" in x for x in [*marked, *columns])
    return {"tables": sorted(marked), "columns": sorted(columns), "edges": sorted("=".join(e) for e in edges), "parsed": True, "valid": valid}


#: Failure categories of verifier errors.
CATEGORIES = {
    "parse_error": "sql_syntax_error", "syntax_error": "sql_syntax_error", "unknown_table": "wrong_table", "unknown_column": "schema_understanding",
    "ambiguous_column": "schema_understanding", "invalid_json": "invalid_json", "invalid_action": "invalid_json", "invalid_arguments": "wrong_arguments",
    "timeout": "timeout", "no_final_sql": "no_final_sql",
}


def _features(gate: Gate, sql: str) -> tuple:
    joins, aggregates, where = [], [], []
    plan = gate.parse(sql)
    functions = re.compile(r"count|sum|min|max|avg|mean|stddev|variance|collect", re.I)
    for kind, n in walk(plan):
        name = class_name(n)
        if kind == "plan" and name == "Join":
            joins.append((n.joinType().toString(), n.condition().toString()))
        elif kind == "plan" and name == "Filter" and not where:
            where.append(n.condition().toString())
        elif kind == "expression" and name == "UnresolvedFunction" and functions.match(seq(n.nameParts())[-1]):
            aggregates.append(n.toString())
    return gate.tables(sql), joins, aggregates, where


def failure_category(gate: Gate, error: str | None, submitted: str | None, reference: str) -> str:
    """By the error where it says enough, else the first of tables, joins, aggregates and conditions that differs."""
    if error in CATEGORIES:
        return CATEGORIES[error]
    if error != "wrong_result" or not submitted:
        return error or "wrong_result"
    try:
        a, b = _features(gate, submitted), _features(gate, reference)
    except GateError:
        return "sql_syntax_error"
    for x, y, name in zip(a, b, ("wrong_table", "join_error", "aggregation_error", "condition_error")):
        if x != y:
            return name
    return "wrong_result"
