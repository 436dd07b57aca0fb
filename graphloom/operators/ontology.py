"""Class hierarchies and a reasoner for the EL rules, over tables of (sub, super)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.storage import forget, written

SUB = "subClassOf"


def class_edges(g: Graph) -> DataFrame:
    """(sub, super): names of classes, by the edges subClassOf from sub to super. A class's name is its property
    ``name``, else its label."""
    e = g.edge_table(SUB).select("source", "target")
    n = g.node_table()
    name = F.coalesce(F.col("name").cast("string"), F.col("label")) if "name" in n.columns else F.col("label")
    n = n.where("kind = 'Class'").select("id", name.alias("class"))
    return e.join(n.toDF("source", "sub"), "source").join(n.toDF("target", "super"), "target").select("sub", "super").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(sub, super): all pairs connected by (sub, super) edges, without pairs of a class with itself.

    Known ways are joined with known ways, so a chain of n takes log n rounds.
    """
    if not edges.where("sub = super").isEmpty():
        raise ValueError("a class can't be below itself")
    now = written(edges.distinct())
    n = now.count()
    while True:
        longer = now.select("sub", F.col("super").alias("mid")).join(now.select(F.col("sub").alias("mid"), "super"), "mid").select("sub", "super")
        after = written(now.union(longer).where("sub <> super").distinct())
        m = after.count()
        forget(now)
        now = after
        if m == n:
            return now
        n = m


def below(g: Graph, name: str) -> DataFrame:
    """(label): classes strictly below a class; none if there is no such class. Goes down from the class, a level a
    round, over the ontology's own edges."""
    if SUB not in g.edges:
        return g.spark.createDataFrame([], "label string")
    edges = written(class_edges(g))
    found = written(edges.where(F.col("super") == name).select(F.col("sub").alias("label")).distinct())
    fringe = found
    while True:
        more = edges.join(fringe, edges.super == fringe.label).select(F.col("sub").alias("label")).distinct()
        more = written(more.join(found, "label", "left_anti"))
        if more.isEmpty():
            return found.where(F.col("label") != name)
        found, fringe = found.union(more), more


@dataclass
class Reasoner:
    """Told axioms and what follows by: A < B < C gives A < C (CR1); X < B, X < C, B and C < D give X < D (CR2);
    A < some R.B, B < C, some R.C < D give A < D (CR3)."""

    spark: object
    classes: set = field(default_factory=set)
    told: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    some: list = field(default_factory=list)
    domains: list = field(default_factory=list)
    derived: DataFrame | None = None

    @classmethod
    def of(cls, g: Graph) -> Reasoner:
        r = cls(g.spark)
        r.told = [(x["sub"], x["super"]) for x in class_edges(g).toLocalIterator()] if SUB in g.edges else []
        return r

    def register_class(self, name: str) -> None:
        self.classes.add(name)

    def assert_subclass(self, sub: str, sup: str) -> None:
        if sub == sup:
            raise ValueError("a class can't be below itself")
        self.classes |= {sub, sup}
        self.told.append((sub, sup))

    def assert_conjunction(self, b: str, c: str, d: str) -> None:
        self.pairs.append((b, c, d))

    def assert_existential(self, a: str, role: str, b: str) -> None:
        self.some.append((a, role, b))

    def assert_existential_domain(self, role: str, c: str, d: str) -> None:
        self.domains.append((role, c, d))

    def axiom_count(self) -> int:
        return len(self.told) + len(self.pairs) + len(self.some) + len(self.domains)

    def _table(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def classify_all(self, fixpoint: bool = True) -> DataFrame:
        """(sub, super, rule) of what follows and wasn't told. Without ``fixpoint`` the rules CR2 and CR3 run once."""
        told = self._table(self.told, "sub string, super string").distinct()
        pairs = self._table(self.pairs, "b string, c string, d string")
        some = self._table(self.some, "a string, role string, b string")
        domains = self._table(self.domains, "role string, c string, d string")
        names = self._table([(c,) for c in sorted({*self.classes, *(x for t in self.told for x in t), *(x for t in self.pairs for x in t), *(x for a, _, b in self.some for x in (a, b)), *(x for _, c, d in self.domains for x in (c, d))})], "sub string")
        up = closure(told)
        rules = up.join(told, ["sub", "super"], "left_anti").withColumn("rule", F.lit("CR1"))
        known, base = up, told
        while True:
            wide = known.union(names.select("sub", F.col("sub").alias("super")))
            x, y = wide.select(F.col("sub").alias("x"), F.col("super").alias("b")), wide.select(F.col("sub").alias("x"), F.col("super").alias("c"))
            two = pairs.join(x, "b").join(y, ["x", "c"]).select(F.col("x").alias("sub"), F.col("d").alias("super"), F.lit("CR2").alias("rule"))
            over = wide.select(F.col("sub").alias("b"), F.col("super").alias("c"))
            three = some.join(over, "b").join(domains, ["role", "c"]).select(F.col("a").alias("sub"), F.col("d").alias("super"), F.lit("CR3").alias("rule"))
            new = two.union(three).where("sub <> super").join(known, ["sub", "super"], "left_anti")
            new = written(new.groupBy("sub", "super").agg(F.min("rule").alias("rule")))
            if new.isEmpty():
                break
            rules = rules.unionByName(new)
            base = base.union(new.select("sub", "super")).distinct()
            if not fixpoint:
                break
            after = closure(base)
            rules = rules.unionByName(after.join(known, ["sub", "super"], "left_anti").join(new, ["sub", "super"], "left_anti").withColumn("rule", F.lit("CR1")))
            known = after
        self.derived = written(rules.groupBy("sub", "super").agg(F.min("rule").alias("rule")))
        return self.derived

    def _known(self) -> DataFrame:
        told = closure(self._table(self.told, "sub string, super string"))
        return told if self.derived is None else told.union(self.derived.select("sub", "super")).distinct()

    def is_subclass_of(self, sub: str, sup: str) -> bool:
        return sub != sup and not self._known().where((F.col("sub") == sub) & (F.col("super") == sup)).isEmpty()

    def superclasses(self, name: str) -> DataFrame:
        return closure(self._table(self.told, "sub string, super string")).where(F.col("sub") == name).select(F.col("super").alias("class"))

    def subclasses(self, name: str) -> DataFrame:
        return closure(self._table(self.told, "sub string, super string")).where(F.col("super") == name).select(F.col("sub").alias("class"))

    def derived_inferences(self) -> DataFrame:
        return self.derived if self.derived is not None else self._table([], "sub string, super string, rule string")

    def derived_count(self) -> int:
        return self.derived_inferences().count()

    def clear_derived(self) -> None:
        self.derived = None
