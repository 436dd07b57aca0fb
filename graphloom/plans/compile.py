"""Queries as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.expressions import Typed, condition, failing, literal, required, strict, truth, value
from graphloom.model import Graph, named
from graphloom.operators import algorithms, ontology, retrieval
from graphloom.plans.matching import EDGES, NODES, Needs, cut, joined, match
from graphloom.plans.syntax import Bin, Call, Lit, PatternError, Prop, Query, Star, Un, conjuncts, walk

AGGREGATES = {"count", "sum", "avg", "min", "max"}
ALGORITHMS = {"pagerank", "betweenness", "clustering", "degree", "community", "community_fast", "leiden"}
REDUCERS = {"path_sum", "path_min", "path_max", "path_avg"}
PATH_WORDS = {"depth", "nodes", "edges", "start", "end", "state", "result"}
VECTORS = {"path_has_embeddings", "pattern_has_embeddings", "path_embedding", "pattern_embedding", "path_embedding_similarity", "path_knn_references", "path_anomaly_score"}
MEMBERS = {f"path_{w}_{k}" for w in ("start", "end", "any", "all") for k in ("instanceof", "subclassof")}
NODE_TESTS = {"instanceof", "subclassof", "has_embedding", "similar_to", "hybrid", "embedding_similarity", "knn_nodes"}
ONLY_FIND = {"nodes", "edges", "start", "end", "state"}


def title(e) -> str:
    """The name of an unnamed output column."""
    if isinstance(e, Prop):
        return ".".join((e.var, *e.names))
    if isinstance(e, Lit):
        return f'"{e.value}"' if isinstance(e.value, str) else str(e.value).lower() if isinstance(e.value, bool) else str(e.value)
    if isinstance(e, Call):
        if e.name.lower() in AGGREGATES:
            return e.name.lower()
        return f"{e.name}({', '.join(map(title, e.args))})"
    if isinstance(e, Un):
        return f"{e.op} {title(e.arg)}"
    return f"{title(e.left)} {e.op} {title(e.right)}"


def is_aggregate(e) -> bool:
    return any(isinstance(x, Call) and x.name.lower() in AGGREGATES for x in walk(e))


def text_of(e: Call, i: int, default: str | None = None) -> str:
    if i >= len(e.args) and default is not None:
        return default
    if i >= len(e.args) or not isinstance(e.args[i], Lit) or not isinstance(e.args[i].value, str):
        raise PatternError(f"{e.name} needs a string as argument {i + 1}")
    return e.args[i].value


class Compiler:
    def __init__(self, g: Graph, q: Query, observation=None):
        """observation: gets the number of matches and their greatest depth, for PROFILE."""
        self.g, self.q, self.observation = g, q, observation
        if q.at is not None:
            from graphloom.operators.versions import as_of

            self.g = as_of(g, q.at)
        self.nodes: dict[str, str | None] = {}
        self.rels: dict[str, str | None] = {}
        self.quantified = any(r.least is not None for p in q.patterns for r in p.rels)
        for p in q.patterns:
            for n in p.nodes:
                if n.var in self.rels:
                    raise PatternError(f"{n.var} is both a node and a relationship")
                self.nodes[n.var] = self.nodes.get(n.var) or n.label
            for r in p.rels:
                if r.var in self.nodes:
                    raise PatternError(f"{r.var} is both a node and a relationship")
                if r.least is None:
                    self.rels[r.var] = r.type
        self.df: DataFrame | None = None
        self.attached: dict = {}
        self.classes: dict[str, DataFrame] = {}
        self.state: dict[str, Typed] | None = None

    # what is read

    def expressions(self) -> list:
        q = self.q
        out = [e for e, _ in q.find if not isinstance(e, Star)] + q.group + [e for e, _ in q.order]
        return out + [e for e in (q.where, q.having) if e is not None]

    def needs(self) -> Needs:
        needs = Needs()
        aliases = {a or title(e) for e, a in self.q.find if not isinstance(e, Star)}

        def want(var: str, prop: str | None) -> None:
            if needs.props.get(var, ()) is not None:
                needs.props[var] = None if prop is None else needs.props.get(var, set()) | {prop}

        for e in self.expressions():
            for x in walk(e):
                if isinstance(x, Prop):
                    if x.var in self.nodes or x.var in self.rels:
                        want(x.var, None if x.names == ("*",) else "type" if x.var in self.rels and x.names[:1] == ("edge_type",) else x.names[0] if x.names else "id")
                    elif x.var == "path" and x.names:
                        needs.path = True
                        if x.names[0] not in PATH_WORDS:
                            raise PatternError(f"no path.{x.names[0]}")
                    elif x.names or x.var not in aliases:
                        raise PatternError(f"unknown variable {x.var}")
                elif isinstance(x, Call):
                    name = x.name.lower()
                    if name in REDUCERS:
                        needs.path = True
                        needs.path_edge_props.add(text_of(x, 0))
                    elif name in VECTORS:
                        needs.path = True
                        # A single name stands for both models.
                        at = 1 if name == "path_embedding_similarity" else 0
                        needs.node_models += [m for m in [text_of(x, at)] if m not in needs.node_models]
                        needs.edge_models += [m for m in [text_of(x, at + 1)] if m not in needs.edge_models]
                    elif name in MEMBERS or name == "path_eval":
                        needs.path = True
                    elif name == "all":
                        want(x.args[0].var, None)
                    elif name in ("instanceof", "subclassof"):
                        want(x.args[0].var, "label")
                        want(x.args[0].var, "kind")
        if any(isinstance(e, Star) for e, _ in self.q.find):
            for v in (*self.nodes, *self.rels):
                want(v, None)
        for e in [e for _, e in self.q.init + self.q.gather] + ([self.q.result] if self.q.result is not None else []):
            needs.path = True
            for x in walk(e):
                if isinstance(x, Prop) and x.names:
                    if x.var == "edge":
                        needs.path_edge_props.add(x.names[0])
                    elif x.var in ("source", "target"):
                        needs.path_node_props.add(x.names[0])
        needs.path_edge_props -= {"id", "type", "source", "target"}
        needs.path_node_props -= {"id", "label", "kind"}
        if self.observation is not None and self.quantified and len(self.q.patterns) == 1:
            needs.path = True
        if needs.path and (len(self.q.patterns) != 1 or not self.q.patterns[0].rels):
            raise PatternError("path functions need one pattern with a relationship")
        return needs

    # names

    def look(self, e) -> Typed | None:
        if isinstance(e, Prop):
            if e.var == "path":
                return self.path_word(e.names[0])
            if e.var not in self.nodes and e.var not in self.rels:
                return None
            prop = e.names[0] if e.names else "id"
            if e.var in self.rels and prop == "edge_type":
                prop = "type"
            name = f"{e.var}.{prop}"
            if name in self.df.columns:
                return named(name), self.df.schema[name].dataType
            return F.lit(None), T.NullType()  # a property that none has: missing
        key = (e.name.lower(), e.args)
        if key in self.attached:
            name = self.attached[key]
            return named(name), self.df.schema[name].dataType
        name = e.name.lower()
        if name in REDUCERS:
            return self.reduced(name, text_of(e, 0))
        if name == "path_eval":
            from graphloom.plans.syntax import machine_expression

            return strict(machine_expression(text_of(e, 0)), self.state_look)
        if name in MEMBERS:
            return self.members(name, text_of(e, 0))
        if name in VECTORS:
            return self.vectors(name, e)
        if name in ("pattern_embedding_similarity",):
            raise PatternError(f"{e.name} is gone; use path_embedding_similarity")
        return None

    # attached columns

    def attach(self, e: Call, frame: DataFrame | None, on: str, default=None) -> None:
        """A column from frame (key, value), joined on a variable's column."""
        name = f"%c{len(self.attached)}"
        self.attached[e.name.lower(), e.args] = name
        right = frame.toDF("%key", name)
        if self.df.schema[on].dataType != right.schema["%key"].dataType:
            right = right.withColumn("%key", F.col("%key").cast(self.df.schema[on].dataType))
        self.df = self.df.join(right, named(on) == F.col("%key"), "left").drop("%key")
        if default is not None:
            self.df = self.df.withColumn(name, F.coalesce(named(name), F.lit(default)))

    def calls(self, names: set, *parts) -> list[Call]:
        out = []
        for e in parts:
            for x in walk(e) if e is not None else ():
                if isinstance(x, Call) and x.name.lower() in names and (x.name.lower(), x.args) not in self.attached and x not in out:
                    out.append(x)
        return out

    def attach_tests(self, *parts) -> None:
        g = self.g
        for e in self.calls(NODE_TESTS, *parts):
            name, var = e.name.lower(), e.args[0].var if e.args and isinstance(e.args[0], Prop) else None
            if var not in self.nodes:
                raise PatternError(f"{e.name} needs a node variable first")
            k = self.q.limit or 10
            flag = lambda ids: ids.select(F.col(ids.columns[0]), F.lit(True))
            if name in ("instanceof", "subclassof"):
                kind = "Individual" if name == "instanceof" else "Class"
                self.attach(e, flag(self.below(text_of(e, 1))), f"{var}.label", False)
                column = self.attached[name, e.args]
                self.df = self.df.withColumn(column, named(column) & (named(f"{var}.kind") == kind))
            elif name == "has_embedding":
                self.attach(e, flag(retrieval.vectors_of(g, text_of(e, 1)).select("id").distinct()), f"{var}.id", False)
            elif name == "similar_to":
                self.attach(e, flag(retrieval.knn_reference(g, text_of(e, 1), text_of(e, 2, "default"), k)), f"{var}.id", False)
            elif name == "hybrid":
                hits = retrieval.hybrid(g, text_of(e, 1), retrieval.reference(g, text_of(e, 2)), text_of(e, 3, "default"), k)
                self.attach(e, flag(hits), f"{var}.id", False)
            elif name == "embedding_similarity":
                self.attach(e, retrieval.similarity_to(g, e.args[1].value, text_of(e, 2, "default")), f"{var}.id")
            else:
                wanted = self.df.select(named(f"{var}.id").alias("id")).distinct()
                self.attach(e, retrieval.knn_lists(g, wanted, int(e.args[1].value), text_of(e, 2, "default")), f"{var}.id")

    def attach_algorithms(self, *parts) -> None:
        for e in self.calls(ALGORITHMS | {"shortestpath"}, *parts):
            name = e.name.lower()
            if name == "shortestpath":
                u, v = (a.value if isinstance(a, Lit) else None for a in e.args)
                column = f"%c{len(self.attached)}"
                self.df = self.df.withColumn(column, F.lit(algorithms.distance(self.g, u, v)))
                self.attached[name, e.args] = column
                continue
            var = e.args[0].var if len(e.args) == 1 and isinstance(e.args[0], Prop) and not e.args[0].names else None
            if var not in self.nodes:
                raise PatternError(f"{e.name} needs a node variable")
            g = self.g
            if name in ("betweenness", "clustering") and not any(p.rels for p in self.q.patterns):
                if self.q.where is not None or any(n.label or n.props for p in self.q.patterns for n in p.nodes):
                    g = g.subgraph(self.df.select(named(f"{var}.id")))
            self.attach(e, algorithms.by_name(name, g), f"{var}.id")

    # paths

    def path_word(self, word: str) -> Typed:
        def node(x):
            return F.struct(x["id"].alias("id"), x["label"].alias("label"))

        df = self.df
        nodes, edges = F.col(NODES), F.col(EDGES)
        id_type = df.schema[NODES].dataType.elementType["id"].dataType
        if word == "depth":
            return F.size(edges).cast("long"), T.LongType()
        if word == "nodes":
            return F.transform(nodes, node), T.ArrayType(T.StructType([T.StructField("id", id_type), T.StructField("label", T.StringType())]))
        if word == "edges":
            return F.transform(edges, lambda x: F.struct(*[x[c].alias(c) for c in ("id", "type", "source", "target")])), T.ArrayType(T.StructType())
        if word in ("start", "end"):
            return node(F.element_at(nodes, 1 if word == "start" else -1)), T.StructType()
        if word == "state":
            return F.struct(*[c.alias(v) for v, (c, _) in self.states().items()]), T.StructType()
        if self.q.result is None:
            raise PatternError("path.result needs RETURN")
        return strict(self.q.result, self.return_look)

    def reduced(self, name: str, prop: str) -> Typed:
        fields = self.df.schema[EDGES].dataType.elementType
        t = fields[prop].dataType if prop in fields.names else T.NullType()
        if not isinstance(t, T.NumericType):
            return failing(f"{name}: no number {prop} on the path's edges", T.DoubleType()), T.DoubleType()
        kind = T.LongType() if isinstance(t, T.IntegralType) else T.DoubleType()
        values = F.transform(EDGES, lambda x: required(x[prop].cast(kind), kind, prop))
        total = F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)
        if name == "path_avg":
            return total.cast("double") / F.size(EDGES), T.DoubleType()
        return {"path_sum": total, "path_min": F.array_min(values), "path_max": F.array_max(values)}[name], kind

    def states(self) -> dict[str, Typed]:
        if self.state is None:
            self.state = self.folded()
        return self.state

    def state_look(self, e: Prop) -> Typed | None:
        if e.var == "path" and e.names == ("depth",):
            return self.path_word("depth")
        return self.states().get(e.var) if not e.names else None

    def return_look(self, e: Prop) -> Typed | None:
        if e.var == "path" and e.names[:1] in (("start",), ("end",)) and len(e.names) == 2 and e.names[1] in ("id", "label"):
            x = F.element_at(NODES, 1 if e.names[0] == "start" else -1)[e.names[1]]
            return x, self.df.schema[NODES].dataType.elementType[e.names[1]].dataType
        return self.state_look(e)

    def folded(self) -> dict[str, Typed]:
        """The machine's variables after the last hop: one fold over the path."""
        q = self.q
        depth = self.path_word("depth")
        if not q.init:
            if q.gather:
                raise PatternError("GATHER needs INIT")
            return {}
        early: dict[str, Typed] = {}
        for var, e in q.init:
            early[var] = strict(e, lambda p: depth if (p.var, p.names) == ("path", ("depth",)) else early.get(p.var) if not p.names else None)
        kinds = {v: t for v, (_, t) in early.items()}
        node_fields, edge_fields = (self.df.schema[c].dataType.elementType for c in (NODES, EDGES))

        def hop(acc: dict[str, Typed], edge, source, target) -> dict[str, Typed]:
            now = dict(acc)

            def look(p: Prop) -> Typed | None:
                if not p.names:
                    return now.get(p.var)
                if (p.var, p.names) == ("path", ("depth",)):
                    return depth
                for word, x, fields in (("edge", edge, edge_fields), ("source", source, node_fields), ("target", target, node_fields)):
                    if p.var == word:
                        t = fields[p.names[0]].dataType if p.names[0] in fields.names else T.NullType()
                        if isinstance(t, T.NullType):
                            return failing(f"a path lacks {word}.{p.names[0]}", T.DoubleType()), T.DoubleType()
                        wide = T.LongType() if isinstance(t, T.IntegralType) else T.DoubleType() if isinstance(t, T.NumericType) else t
                        return required(x[p.names[0]].cast(wide), wide, f"{word}.{p.names[0]}"), wide
                return None

            for var, e in q.gather:
                if var not in now:
                    raise PatternError(f"GATHER sets {var}, which INIT lacks")
                c, t = strict(e, look)
                if t != kinds[var]:
                    if isinstance(t, T.NumericType) and isinstance(kinds[var], T.NumericType):
                        if isinstance(t, T.DoubleType):
                            kinds[var] = t
                    else:
                        raise PatternError(f"{var} changes its kind")
                now[var] = (c.cast(kinds[var]), kinds[var])
            return now

        def as_struct(vars_: dict[str, Typed]):
            return F.struct(*[c.cast(kinds[v]).alias(v) for v, (c, _) in vars_.items()])

        probe = F.col(EDGES)[0]
        for _ in range(len(kinds) + 1):  # until no variable's type widens any more
            before = dict(kinds)
            hop({v: (F.lit(None).cast(t), t) for v, t in kinds.items()}, probe, F.col(NODES)[0], F.col(NODES)[1])
            if kinds == before:
                break
        hops = F.transform(EDGES, lambda x, i: F.struct(x.alias("edge"), F.get(NODES, i).alias("source"), F.get(NODES, i + 1).alias("target")))
        last = F.aggregate(hops, as_struct(early), lambda acc, h: as_struct(hop({v: (acc[v], t) for v, t in kinds.items()}, h["edge"], h["source"], h["target"])))
        self.df = self.df.withColumn("%state", last)
        return {v: (F.col("%state")[v], t) for v, t in kinds.items()}

    def below(self, cls: str) -> DataFrame:
        """The classes below one, looked up once a query."""
        if cls not in self.classes:
            self.classes[cls] = ontology.below(self.g, cls)
        return self.classes[cls]

    def members(self, name: str, cls: str) -> Typed:
        _, which, what = name.split("_")
        column = f"%m{len(self.df.columns)}"
        below = self.below(cls).agg(F.collect_set("label").alias(column))  # as many as the ontology has classes
        self.df = self.df.crossJoin(below)
        kind = "Individual" if what == "instanceof" else "Class"
        test = lambda x: F.array_contains(F.col(column), x["label"]) & (x["kind"] == kind)
        nodes = F.col(NODES)
        one = {"start": lambda: test(F.element_at(nodes, 1)), "end": lambda: test(F.element_at(nodes, -1)), "any": lambda: F.exists(nodes, test), "all": lambda: F.forall(nodes, test)}[which]
        return one(), T.BooleanType()

    def vectors(self, name: str, e: Call) -> Typed:
        at = 1 if name == "path_embedding_similarity" else 0
        nm, em = (f"v:{text_of(e, at + i)}" for i in (0, 1))
        nodes = F.transform(NODES, lambda x: x.getField(nm).cast("array<double>"))
        edges = F.transform(EDGES, lambda x: x.getField(em).cast("array<double>"))
        array = T.ArrayType(T.DoubleType())
        if name.endswith("has_embeddings"):
            return F.forall(nodes, lambda v: v.isNotNull()) & F.forall(edges, lambda v: v.isNotNull()), T.BooleanType()
        if name == "pattern_embedding":
            whole = F.concat(F.flatten(F.zip_with(nodes, edges, lambda n, x: F.concat(retrieval.present(n), F.coalesce(x, F.array().cast("array<double>"))))))
            return F.when(F.exists(edges, lambda v: v.isNull()), failing("an edge of the path has no vector", array)).otherwise(whole), array
        held = f"%v{len(self.df.columns)}"  # a column of its own, or each use would repeat the whole expression
        self.df = self.df.withColumn(held, F.concat(retrieval.mean(nodes, "node"), retrieval.mean(edges, "edge")))
        path = named(held)
        if name == "path_embedding":
            return path, array
        if name == "path_embedding_similarity":
            ref = retrieval.reference(self.g, text_of(e, 0))
            return retrieval.strict_cosine(path, retrieval.vector_literal(ref)), T.DoubleType()
        refs = retrieval.references_of(self.g, text_of(e, at), text_of(e, at + 1))
        if name == "path_knn_references":
            k, least = int(e.args[2].value), float(e.args[3].value)
            column = f"%r{len(self.df.columns)}"
            self.df = self.df.crossJoin(refs.agg(F.sort_array(F.collect_list(F.struct("name", "vector"))).alias(column)))
            same = F.filter(F.col(column), lambda r: F.size(r["vector"]) == F.size(path))
            scored = F.transform(same, lambda r: F.struct((-retrieval.cosine(path, r["vector"])).alias("s"), r["name"].alias("name")))
            good = F.filter(F.array_sort(scored), lambda r: -r["s"] >= least)
            return F.transform(F.slice(good, 1, k), lambda r: F.struct(r["name"].alias("name"), (-r["s"]).alias("score"))), T.ArrayType(T.StructType())
        column = f"%r{len(self.df.columns)}"
        self.df = self.df.crossJoin(refs.agg(F.collect_list("vector").alias(column)))
        fit = F.filter(F.col(column), lambda r: F.size(r) == F.size(path))
        centre = retrieval.mean(fit, "reference")
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - retrieval.cosine(path, centre)))
        return F.when(F.size(fit) == 0, 1.0).otherwise(F.when(retrieval.norm(centre) == 0, 1.0).otherwise(score)), T.DoubleType()

    # the query

    def compile(self) -> DataFrame:
        q = self.q
        needs = self.needs()
        self.check(needs)
        frames = []
        for p in q.patterns if needs.path else cut(q.patterns):
            vs = {n.var for n in p.nodes} | {r.var for r in p.rels}
            frames.append((match(self.g, p, needs), vs))
        self.df = joined(frames)
        if self.observation is not None:
            depth = F.max(F.size(EDGES)) if EDGES in self.df.columns else F.lit(None).cast("int")
            self.df = self.df.observe(self.observation, F.count(F.lit(1)).alias("bindings"), depth.alias("depth"))
        if q.where is not None:
            parts = conjuncts(q.where)
            slow = [c for c in parts if self.calls(ALGORITHMS | {"shortestpath"}, c)]
            for group in ([c for c in parts if c not in slow], slow):
                if group:
                    self.attach_tests(*group)
                    self.attach_algorithms(*group)
                    for c in group:
                        cond = condition(c, self.look)
                        self.df = self.df.where(cond)
        rest = [e for e, _ in q.find if not isinstance(e, Star)] + [e for e, _ in q.order] + [q.having] + q.group
        self.attach_tests(*rest)
        self.attach_algorithms(*rest)
        if q.gather and not q.init:
            raise PatternError("GATHER needs INIT")
        out = self.grouped() if q.group or any(is_aggregate(e) for e, _ in q.find if not isinstance(e, Star)) else self.plain()
        if q.limit is not None:
            if q.offset:
                out = out.offset(q.offset)
            out = out.limit(q.limit)
        return out.drop(*[c for c in out.columns if c.startswith("%o")])

    def check(self, needs: Needs) -> None:
        q = self.q
        if q.result is not None and (q.order or q.group or q.having is not None):
            raise PatternError("RETURN doesn't go with ORDER BY, GROUP BY or HAVING")
        if q.where is not None:
            for x in walk(q.where):
                if isinstance(x, Prop) and x.var == "path" and x.names[:1] and x.names[0] in ONLY_FIND:
                    raise PatternError(f"path.{x.names[0]} can't be in WHERE")
            if is_aggregate(q.where):
                raise PatternError("WHERE has no aggregates")
        for x in (x for e in self.expressions() for x in walk(e)):
            if isinstance(x, Call) and x.name.lower() not in AGGREGATES | ALGORITHMS | REDUCERS | VECTORS | MEMBERS | NODE_TESTS | {"shortestpath", "path_eval", "all", "pattern_embedding_similarity"}:
                raise PatternError(f"unknown function {x.name}")

    def items(self) -> list[tuple[object, str]]:
        """(expression, output name), wildcards taken apart."""
        out: list = []

        def whole(var: str) -> None:
            prefix = f"{var}."
            own = [c.removeprefix(prefix) for c in self.df.columns if c.startswith(prefix)]
            skip = ("kind", "source", "target") if var in self.rels else ("kind",)
            for p in sorted(p for p in own if p not in (*skip, "id", "label", "type")):
                out.append((Prop(var, (p,)), f"{var}.{p}"))
            out.append((Prop(var, ("type" if var in self.rels else "label",)), f"{var}.{'type' if var in self.rels else 'label'}"))
            out.append((Prop(var, ("id",)), f"{var}.id"))

        hidden = {n.var for p in self.q.patterns for n in p.nodes if not n.named} | {r.var for p in self.q.patterns for r in p.rels if not r.named}
        for e, alias in self.q.find:
            if isinstance(e, Star):
                for v in (*self.nodes, *self.rels):
                    if v not in hidden:
                        whole(v)
            elif isinstance(e, Call) and e.name.lower() == "all":
                whole(e.args[0].var)
            elif isinstance(e, Prop) and e.names == ("*",):
                whole(e.var)
            else:
                out.append((e, alias or title(e)))
        seen: dict = {}
        for e, name in out:
            if name in seen and seen[name] != e:
                raise PatternError(f"two columns are named {name}")
            seen[name] = e
        return [(e, n) for n, e in seen.items()]

    def plain(self) -> DataFrame:
        q = self.q
        items = self.items()
        by_name = {n: e for e, n in items}
        if q.having is not None:
            raise PatternError("HAVING needs GROUP BY or an aggregate")
        outputs = [(value(e, self.look)[0], n) for e, n in items]
        keys: list[tuple[str, bool]] = []
        extra: list[tuple[Column, str]] = []
        for e, down in q.order:
            if isinstance(e, Prop) and not e.names and e.var in by_name and e.var not in self.nodes | self.rels:
                keys.append((e.var, down))
            elif (found := next((n for x, n in items if x == e), None)) is not None:
                keys.append((found, down))
            elif q.distinct:
                raise PatternError("with DISTINCT, ORDER BY takes output columns")
            else:
                extra.append((value(e, self.look)[0], f"%o{len(extra)}"))
                keys.append((extra[-1][1], down))
        out = self.df.select(*[c.alias(n) for c, n in outputs + extra])
        if q.distinct:
            out = out.distinct()
        return ordered(out, keys)

    def grouped(self) -> DataFrame:
        """Keys are what GROUP BY names and the output's other columns without aggregates; algorithms are averaged."""
        q = self.q
        aliases = {a or title(e): e for e, a in q.find if not isinstance(e, Star)}
        group = [aliases.get(e.var, e) if isinstance(e, Prop) and not e.names and e.var not in self.nodes | self.rels else e for e in q.group]
        items = self.items()
        numeric = ALGORITHMS | {"embedding_similarity", "shortestpath"}
        aggregated = lambda e: is_aggregate(e) or (isinstance(e, Call) and e.name.lower() in numeric)
        keys = list(dict.fromkeys([*group, *(e for e, _ in items if not aggregated(e))]))
        column = {e: f"%k{i}" for i, e in enumerate(keys)}
        typed = {e: value(e, self.look) for e in keys}
        wanted: dict = {}

        def collect(e) -> None:
            for x in walk(e):
                if x not in column and isinstance(x, Call) and x.name.lower() in AGGREGATES | numeric:
                    wanted.setdefault(x, f"%g{len(wanted)}")

        for e in [e for e, _ in items] + [q.having] + [e for e, _ in q.order]:
            if e is not None:
                collect(e)
        folds = [self.aggregate(x).alias(n) for x, n in wanted.items()]
        base = self.df.groupBy(*[typed[e][0].alias(column[e]) for e in keys])
        out = base.agg(*folds) if folds else base.agg(F.count(F.lit(1)).alias("%n"))

        def look(e) -> Typed | None:
            name = column.get(e) or wanted.get(e)
            if name is None and isinstance(e, Prop) and not e.names and e.var in aliases:
                return value(aliases[e.var], look)
            return (named(name), out.schema[name].dataType) if name else None

        def of(e) -> Typed:
            if (found := look(e)) is not None:
                return found
            return value(e, look)

        if q.having is not None:
            out = out.where(condition(q.having, look) if look(q.having) is None else truth(*of(q.having)))
        extra, order = [], []
        for e, down in q.order:
            same = next((n for x, n in items if x == e or (isinstance(e, Prop) and not e.names and e.var == n)), None)
            if same is None and q.distinct:
                raise PatternError("with DISTINCT, ORDER BY takes output columns")
            if same is None:
                extra.append(of(e)[0].alias(f"%o{len(extra)}"))
                same = f"%o{len(extra) - 1}"
            order.append((same, down))
        out = out.select(*[of(e)[0].alias(n) for e, n in items], *extra)
        return ordered(out.distinct() if q.distinct else out, order)

    def aggregate(self, e: Call) -> Column:
        name = e.name.lower()
        if name not in AGGREGATES:
            return F.avg(value(e, self.look)[0])
        if name == "count" and (e.star or not e.args):
            return F.count(F.lit(1))
        if len(e.args) != 1:
            raise PatternError(f"{name} takes one argument")
        c, t = value(e.args[0], self.look)
        if name == "count":
            return F.count(c)
        if name in ("min", "max"):
            return {"min": F.min, "max": F.max}[name](c)
        c = c.cast("double") if isinstance(t, T.NumericType) else F.lit(None).cast("double")
        return F.coalesce(F.sum(c), F.lit(0.0)) if name == "sum" else F.avg(c)


def ordered(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Missing values are last upwards and first downwards."""
    if not keys:
        return df
    return df.orderBy(*[named(n).desc_nulls_first() if down else named(n).asc_nulls_last() for n, down in keys])


def compile_query(g: Graph, q: Query) -> DataFrame:
    return Compiler(g, q).compile()


__all__ = ["Bin", "Compiler", "compile_query", "literal", "title"]
