"""Reading and writing: CSV, JSON, Parquet, Arrow, Turtle, tensors."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.model import Edges, Graph, Nodes, named

NESTED = (T.ArrayType, T.MapType, T.StructType)


def flat(df: DataFrame) -> DataFrame:
    """Columns that a text file can't hold, as text: nested ones as JSON, bytes as their number."""
    out = []
    for f in df.schema:
        c = named(f.name)
        if isinstance(f.dataType, NESTED):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.when(c.isNotNull(), F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes>")))
        elif isinstance(f.dataType, T.NullType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinity are null in JSON."""
    out = []
    for f in df.schema:
        c = named(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.when(c.isNotNull(), F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes>")))
        out.append(c.alias(f.name))
    return df.select(*out)


def export(df: DataFrame, form: str, options: dict) -> dict:
    """Write a query's rows into a folder of files, in parallel. CSV: separator (or delimiter), header. JSON: a row a
    line. Arrow: one stream file a task."""
    path = options.get("path")
    if not path:
        raise ValueError("EXPORT needs a path")
    out = df.write.mode("overwrite")
    if form == "csv":
        flat(df).write.mode("overwrite").csv(path, sep=str(options.get("separator", options.get("delimiter", ","))), header=options.get("header", True) is not False, quote='"', escape='"', emptyValue="", nullValue="")
    elif form == "json":
        finite(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif form == "parquet":
        out.option("compression", "snappy").parquet(path)
    else:
        write_arrow(df, path)
    return {"format": form, "path": path}


def write_arrow(df: DataFrame, path: str) -> None:
    """Each task writes its rows as one Arrow stream through the file system that the path names."""
    import uuid

    run = uuid.uuid4().hex

    def save(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        place, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))
        place.create_dir(root, recursive=True)
        name, rows, writer = f"{root}/part-{TaskContext.get().partitionId():05d}-{run}.arrows", 0, None
        with place.open_output_stream(name) as to:
            for b in batches:
                writer = writer or pa.ipc.new_stream(to, b.schema)
                writer.write_batch(b)
                rows += b.num_rows
            if writer:
                writer.close()
        if not writer:
            place.delete_file(name)
        yield pa.RecordBatch.from_pydict({"rows": [rows]})

    df.mapInArrow(save, "rows long").agg(F.sum("rows")).first()


def read_arrow(spark: SparkSession, path: str, schema) -> DataFrame:
    """What write_arrow() wrote: Spark lists the files, each is read by a task, a batch at a time."""

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for name in b.column(0).to_pylist():
                place, inside = fs.FileSystem.from_uri(name)
                with place.open_input_stream(inside) as f:
                    yield from pa.ipc.open_stream(f)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.arrows").load(path).select("path").mapInArrow(read, schema)


def csv_text(df: DataFrame, separator: str = ",", header: bool = True) -> str:
    """A small result as CSV text: quoted where needed, null as nothing."""
    def cell(x) -> str:
        s = "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)
        return '"' + s.replace('"', '""') + '"' if any(c in s for c in (separator, '"', "\n", "\r")) else s

    lines = [separator.join(map(cell, df.columns))] if header else []
    return "\n".join(lines + [separator.join(map(cell, r)) for r in flat(df).toLocalIterator()]) + "\n"


def json_text(df: DataFrame, pretty: bool = False, jsonl: bool = False) -> str:
    import json

    rows = [json.loads(r[0]) for r in finite(df).select(F.to_json(F.struct(*[named(c) for c in df.columns]), {"ignoreNullFields": "false"})).toLocalIterator()]
    return "\n".join(json.dumps(r, ensure_ascii=False) for r in rows) if jsonl else json.dumps(rows, ensure_ascii=False, indent=2 if pretty else None)


# --- tables ----------------------------------------------------------------------------------------------------------


def nodes_table(g: Graph, label: str | None = None, properties: bool = True) -> DataFrame:
    """What nodes_arrow() holds: id, label and the properties, or their number."""
    df = g.node_table(label).drop("kind")
    props = [c for c in df.columns if c not in ("id", "label")]
    if not properties:
        count = sum((named(p).isNotNull().cast("int") for p in props), F.lit(0))
        return df.select("id", "label", count.alias("property_count"))
    plain = [p for p in props if not isinstance(df.schema[p].dataType, (*NESTED, T.BinaryType, T.NullType))]
    return df.select("id", "label", *[named(p) for p in sorted(plain)])


def edges_table(g: Graph, kind: str | None = None, properties: bool = True) -> DataFrame:
    df = g.edge_table(kind)
    props = sorted(c for c in df.columns if c not in ("id", "source", "target", "type"))
    first = ["id", "source", "target", F.col("type").alias("edge_type")]
    if not properties:
        return df.select(*first, sum((named(p).isNotNull().cast("int") for p in props), F.lit(0)).alias("property_count"))
    return df.select(*first, *[named(p).cast("string").alias(p) for p in props])


def history_table(g: Graph, label: str) -> DataFrame:
    h = g.history.nodes[label]
    return h.select("id", F.lit(label).alias("label"), "version", F.col("valid_from").alias("timestamp"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))


def nodes_arrow(g: Graph, label: str | None = None, properties: bool = True):
    """An Arrow table on the driver; what doesn't fit it goes through write_arrow() and read_arrow()."""
    return nodes_table(g, label, properties).toArrow()


def edges_arrow(g: Graph, kind: str | None = None, properties: bool = True):
    return edges_table(g, kind, properties).toArrow()


def history_arrow(g: Graph, label: str):
    return history_table(g, label).toArrow()


def save(g: Graph, folder: str) -> None:
    """One Parquet table a label and a type."""
    for label, n in g.nodes.items():
        n.frame.write.mode("overwrite").option("compression", "snappy").parquet(f"{folder}/nodes/{label}")
    for kind, e in g.edges.items():
        e.frame.write.mode("overwrite").option("compression", "snappy").parquet(f"{folder}/edges/{kind}")
    rows = [("node", k, None, None) for k in g.nodes] + [("edge", k, e.from_label, e.to_label) for k, e in g.edges.items()]
    g.spark.createDataFrame(rows, "what string, name string, from_label string, to_label string").coalesce(1).write.mode("overwrite").json(f"{folder}/catalogue")


def load(spark: SparkSession, folder: str) -> Graph:
    rows = spark.read.schema("what string, name string, from_label string, to_label string").json(f"{folder}/catalogue").collect()
    nodes = {r["name"]: Nodes(spark.read.parquet(f"{folder}/nodes/{r['name']}")) for r in rows if r["what"] == "node"}
    edges = {r["name"]: Edges(spark.read.parquet(f"{folder}/edges/{r['name']}"), r["from_label"], r["to_label"]) for r in rows if r["what"] == "edge"}
    return Graph(spark, nodes, edges)


# --- tensors ---------------------------------------------------------------------------------------------------------


@dataclass
class Tensors:
    """nodes: (index, id, features, vector); edges: (source, target, attributes), both ends as indexes."""

    nodes: DataFrame
    edges: DataFrame


def tensors(g: Graph, labels: list[str], features: list[str] = (), attributes: list[str] = (), model: str | None = None, size: int = 0) -> Tensors:
    """Dense indexes in the order of id; edges whose ends both have one. Missing features and attributes are 0, a
    missing vector is all 0."""
    from graphloom.operators.community import numbered

    tables = [g.node_table(x) for x in labels]
    rows = None
    for t in tables:
        cols = [F.coalesce(named(f).cast("double"), F.lit(0.0)) if f in t.columns else F.lit(0.0) for f in features]
        t = t.select("id", F.array(*cols).alias("features") if cols else F.array().cast("array<double>").alias("features"))
        rows = t if rows is None else rows.union(t)
    nodes = numbered(rows, "id").withColumnRenamed("n", "index")
    if model is not None:
        v = g.node_vectors.where(F.col("model") == model).select("id", "vector")
        nodes = nodes.join(v, "id", "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0).cast("float"), size)))
    e = g.edge_table()
    cols = [F.coalesce(named(a).cast("double"), F.lit(0.0)) if a in e.columns else F.lit(0.0) for a in attributes]
    e = e.select("source", "target", F.array(*cols).alias("attributes") if cols else F.array().cast("array<double>").alias("attributes"))
    n = nodes.select("id", "index")
    e = e.join(n.toDF("source", "a"), "source").join(n.toDF("target", "b"), "target")
    return Tensors(nodes, e.select(F.col("a").alias("source"), F.col("b").alias("target"), "attributes"))


# --- Turtle ----------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r'\s+|#[^\n]*|(?P<iri><[^>]*>)|(?P<text>"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*")(?:\^\^(?P<type><[^>]*>|[\w.-]*:[\w.-]+)|@[\w-]+)?|(?P<at>@prefix|@base)|(?P<name>[\w-]*:[\w.%-]*[\w%-]|[\w-]*:|\ba\b)|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<bool>true|false)|(?P<mark>[.;,])', re.S)
RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"


def triples(text: str) -> list[tuple[str, str, object]]:
    """(subject, predicate, object) of a Turtle text without blank nodes; IRIs are strings in angle brackets."""
    tokens, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"can't read Turtle at {at}: {text[at:at + 30]!r}")
        if m.lastgroup:
            tokens.append(m)
        at = m.end()
    prefixes, base, out = {}, "", []

    def term(m):
        if m["iri"]:
            iri = m["iri"][1:-1]
            return f"<{iri if ':' in iri else base + iri}>"
        if m["name"]:
            if m["name"] == "a":
                return f"<{RDF}type>"
            p, _, rest = m["name"].partition(":")
            return f"<{prefixes[p]}{rest}>"
        if m["number"]:
            return float(m["number"]) if re.search("[.eE]", m["number"]) else int(m["number"])
        if m["bool"]:
            return m["bool"] == "true"
        raw = m["text"]
        s = raw[3:-3] if raw.startswith('"""') else raw[1:-1]
        s = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), s)
        for cast in (int, float):
            try:
                return cast(s)
            except ValueError:
                pass
        return {"true": True, "false": False}.get(s, s)

    i = 0
    while i < len(tokens):
        if tokens[i]["at"]:
            if tokens[i]["at"] == "@prefix":
                prefixes[tokens[i + 1]["name"][:-1]] = tokens[i + 2]["iri"][1:-1]
                i += 4
            else:
                base = tokens[i + 1]["iri"][1:-1]
                i += 3
            continue
        s = term(tokens[i])
        i += 1
        while True:
            p = term(tokens[i])
            i += 1
            while True:
                out.append((s, p, term(tokens[i])))
                i += 1
                if tokens[i]["mark"] != ",":
                    break
                i += 1
            while tokens[i]["mark"] == ";":
                i += 1
            if tokens[i]["mark"] == ".":
                i += 1
                break
    return out


def short(iri: str) -> str:
    return re.split(r"[#/]", iri.strip("<>"))[-1]


def import_turtle(spark: SparkSession, text: str, into: Graph | None = None) -> tuple[Graph, dict]:
    """Classes as nodes of kind Class with their name as label, subClassOf edges from sub to super, individuals as
    nodes of their class with iri and literal properties. What is there already isn't doubled. Ids are the IRIs."""
    found = triples(text)
    kinds = {}
    for s, p, o in found:
        if p == f"<{RDF}type>":
            kinds.setdefault(s, []).append(o)
    meta = {f"<{OWL}{x}>" for x in ("Class", "Ontology", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "NamedIndividual")} | {f"<{RDFS}Class>"}
    class_marks = {f"<{OWL}Class>", f"<{RDFS}Class>"}
    subs = list(dict.fromkeys((s, o) for s, p, o in found if p == f"<{RDFS}subClassOf>"))
    classes = dict.fromkeys([s for s, k in kinds.items() if class_marks & set(k)] + [x for pair in subs for x in pair])
    individuals = {s: next(k for k in ks if k not in meta) for s, ks in kinds.items() if s not in classes and any(k not in meta for k in ks)}
    old = into or Graph(spark)
    nodes, edges = dict(old.nodes), dict(old.edges)
    by_label: dict[str, list[dict]] = {}
    for c in classes:
        by_label.setdefault(short(c), []).append({"id": c.strip("<>"), "kind": "Class", "iri": c.strip("<>"), "name": short(c)})
    literals: dict[str, dict] = {}
    for s, p, o in found:
        if s in individuals and not (isinstance(o, str) and o.startswith("<")):
            literals.setdefault(s, {})[short(p)] = o
    for s, k in individuals.items():
        props = literals.get(s, {})
        by_label.setdefault(short(k), []).append({"id": s.strip("<>"), "kind": "Individual", "iri": s.strip("<>"), **props})
    from graphloom.model import together

    for label, rows in by_label.items():
        names = list(dict.fromkeys(k for r in rows for k in r))
        fields = []
        for n in names:
            values = [r[n] for r in rows if r.get(n) is not None]
            t = T.BooleanType() if all(isinstance(v, bool) for v in values) else T.LongType() if all(isinstance(v, int) and not isinstance(v, bool) for v in values) else T.DoubleType() if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values) else T.StringType()
            fields.append((n, t))
        data = [tuple(None if r.get(n) is None else float(r[n]) if isinstance(t, T.DoubleType) else str(r[n]) if isinstance(t, T.StringType) else r[n] for n, t in fields) for r in rows]
        df = spark.createDataFrame(data, T.StructType([T.StructField(n, t) for n, t in fields])).coalesce(1)
        if label in nodes:
            df = df.join(nodes[label].frame.select("id"), "id", "left_anti")
            df = together([nodes[label].frame, df])
        nodes[label] = Nodes(df)
    links = [(a.strip("<>"), b.strip("<>")) for a, b in subs]
    linked = {}
    for s, p, o in found:
        if s in individuals and isinstance(o, str) and o in individuals:
            linked.setdefault(short(p), []).append((s.strip("<>"), o.strip("<>")))
    for kind, pairs in {**({"subClassOf": links} if links else {}), **linked}.items():
        e = spark.createDataFrame(pairs, "source string, target string").coalesce(1).select(F.xxhash64("source", "target").alias("id"), "source", "target")
        if kind in edges:
            e = edges[kind].frame.unionByName(e.join(edges[kind].frame, ["source", "target"], "left_anti"), allowMissingColumns=True)
        edges[kind] = Edges(e)
    return old.but(nodes=nodes, edges=edges), {"classes": len(classes), "subclass_edges": len(links), "individuals": len(individuals)}


def export_turtle(g: Graph) -> str:
    """Classes, subclass edges and individuals with an iri as Turtle, sorted. An ontology's size, so it's gathered."""
    lines = [f"@prefix owl: <{OWL}> .", f"@prefix rdfs: <{RDFS}> .", ""]
    n = g.node_table()
    if "iri" not in n.columns:
        return "\n".join(lines)
    classes = {r["id"]: r["iri"] for r in n.where("kind = 'Class' and iri is not null").select("id", "iri").collect()}
    by_label = {short(i): i for i in classes.values()}
    up: dict = {}
    if "subClassOf" in g.edges:
        for r in g.edge_table("subClassOf").select("source", "target").distinct().collect():
            if r["source"] in classes and r["target"] in classes:
                up.setdefault(classes[r["source"]], set()).add(classes[r["target"]])
    for iri in sorted(classes.values()):
        lines.append(f"<{iri}> a owl:Class" + "".join(f" ;\n    rdfs:subClassOf <{x}>" for x in sorted(up.get(iri, ()))) + " .")
    props = [c for c in n.columns if c not in ("id", "label", "kind", "iri", "name")] + (["name"] if "name" in n.columns else [])
    for r in n.where("kind = 'Individual' and iri is not null").orderBy("iri").collect():
        kind = by_label.get(r["label"], r["label"])
        stem = r["iri"][: len(r["iri"]) - len(short(r["iri"]))]
        parts = [f"<{r['iri']}> a <{kind}>"]
        for p in sorted(props):
            if r[p] is not None:
                v = r[p]
                shown = str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
                parts.append(f"    <{stem}{p}> {shown}")
        lines.append(" ;\n".join(parts) + " .")
    return "\n".join(lines) + "\n"
