"""Statements of every kind, and what they return."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import versions
from graphloom.plans.compile import Compiler, title
from graphloom.plans.syntax import Add, Commit, CreateIndex, Delete, DropIndex, Explain, PatternError, Profile, Query, Sketch, Update, danger, parse
from graphloom.sources import files


@dataclass
class Result:
    """kind: query, write, index, explain, profile, export or message. df: a query's lazy rows. graph: the graph
    after the statement."""

    kind: str
    graph: Graph
    df: DataFrame | None = None
    summary: dict = field(default_factory=dict)
    text: str = ""
    warning: str | None = None

    def __iter__(self):
        return iter(self.df.toLocalIterator()) if self.df is not None else iter(())


def plan_text(g: Graph, q: Query) -> str:
    """The query's logical steps, then Spark's plan. Nothing runs but what algorithms in the query need."""
    lines = []
    for p in q.patterns:
        for i, n in enumerate(p.nodes):
            lines.append(f"{'Scan' if i == 0 else 'Reach'} {n.var}{':' + n.label if n.label else ''}{' ' + str(dict(n.props)) if n.props else ''}")
            if i < len(p.rels):
                r = p.rels[i]
                bounds = f" {{{r.least},{r.most}}}" if r.least is not None else ""
                lines.append(f"{'VarExpand' if bounds else 'Expand'} {r.direction} {r.type or '*'}{bounds}")
    if len(q.patterns) > 1:
        lines.append("Join patterns")
    if q.where is not None:
        lines.append(f"Filter {title(q.where)}")
    if q.group:
        lines.append(f"Group {', '.join(map(title, q.group))}")
    if q.order:
        lines.append(f"Sort {', '.join(title(e) for e, _ in q.order)}")
    if q.limit is not None:
        lines.append(f"Limit {q.limit}")
    df = Compiler(g, q).compile()
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return "\n".join(lines) + "\n\n" + df._jdf.queryExecution().explainString(mode)


def execute(g: Graph, text: str) -> Result:
    return run(g, parse(text))


def run(g: Graph, s) -> Result:
    if isinstance(s, Query):
        df = Compiler(g, s).compile()
        if s.export:
            form, options = s.export
            return Result("export", g, df, files.export(df, form, options))
        return Result("query", g, df)
    if isinstance(s, Explain):
        return Result("explain", g, text=plan_text(g, s.query))
    if isinstance(s, Profile):
        return profiled(g, s.query)
    if isinstance(s, Add):
        after, summary = versions.add(g, s)
        return Result("write", after, summary=summary)
    if isinstance(s, (Delete, Update)):
        after, summary = (versions.delete if isinstance(s, Delete) else versions.update)(g, s)
        return Result("write", after, summary=summary, warning=danger(s))
    if isinstance(s, CreateIndex):
        name = f"{s.label}_{s.prop}"
        if name in g.indexes:
            raise PatternError(f"there is an index {name}")
        from graphloom.operators.indexes import build

        held = build(g, s.label, s.prop, s.kind)
        after = g.but(indexes={**g.indexes, name: (s.label, s.prop, s.kind)}, built={**g.built, name: held} if held is not None else g.built)
        return Result("index", after, summary={"created": name})
    if isinstance(s, DropIndex):
        if s.name not in g.indexes:
            raise PatternError(f"no index {s.name}")
        after = g.but(indexes={k: v for k, v in g.indexes.items() if k != s.name}, built={k: v for k, v in g.built.items() if k != s.name})
        return Result("index", after, summary={"dropped": s.name})
    if isinstance(s, Sketch):
        return sketched(g, s)
    if isinstance(s, Commit):
        if s.name not in g.sketches:
            raise PatternError(f"no sketch {s.name}")
        after = g.but(sketches={k: v for k, v in g.sketches.items() if k != s.name})
        return run(after, g.sketches[s.name])
    raise PatternError("not a statement")


def sketched(g: Graph, s: Sketch) -> Result:
    """The statement is kept, and what it would do is shown: a query's first ten rows and count, or the rows that a
    write would touch."""
    if s.name in g.sketches:
        raise PatternError(f"there is a sketch {s.name}")
    after = g.but(sketches={**g.sketches, s.name: s.statement})
    if isinstance(s.statement, Query):
        df = Compiler(g, s.statement).compile()
        return Result("message", after, df.limit(10), {"rows": df.count()})
    if isinstance(s.statement, Add):
        return Result("message", after, summary={"nodes": len({n.var for n in s.statement.pattern.nodes}), "edges": len(s.statement.pattern.rels)})
    hits = versions.matched(g, s.statement.pattern, s.statement.where, s.statement.limit)
    return Result("message", after, hits.limit(10), {"rows": hits.count()}, warning=danger(s.statement))


def profiled(g: Graph, q: Query) -> Result:
    """Runs the query once and observes its rows on the way."""
    from pyspark.sql import Observation

    from graphloom.storage import written

    began = time.time()
    matched, seen = Observation(), Observation()
    compiler = Compiler(g, q, matched)
    df = compiler.compile().observe(seen, F.count(F.lit(1)).alias("rows"))
    rows = written(df)
    summary = {"rows": seen.get["rows"], "columns": rows.columns, "ms": round(1000 * (time.time() - began), 3)}
    summary |= {"bindings_examined": matched.get["bindings"], "bindings_emitted": seen.get["rows"]}
    if any(r.least is not None for p in q.patterns for r in p.rels):
        summary["max_depth"] = matched.get["depth"] or 0
    return Result("profile", g, rows, summary, plan_text(g, q))
